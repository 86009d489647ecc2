"""Blocks and text nodes of pages, by the standard library's HTML parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.alignment import normal_with_map, plain_ampersands

BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "table", "figure", "blockquote", "ul", "ol", "aside", "math")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "image", "input", "link", "meta", "source", "track", "wbr"}
SILENT = ("script", "style", "head", "title")
# Code languages named by a class alone; class names and styles that hint at code; kinds of notes.
CODE = set("python javascript js typescript ts java c cpp cs go rust ruby php swift kotlin scala bash sh shell sql html css json yaml xml haskell".split())
CODE_CLASS = re.compile(r"\b(?:code|sourcecode|source-code|codeblock|code-block|listing|mono|monospace|verbatim|prettyprint|highlight|programlisting)\b", re.IGNORECASE)
CODE_STYLE = re.compile(r"font-family\s*:[^;]*(?:monospace|courier|consolas)", re.IGNORECASE)
LANGUAGE = re.compile(r"\b(?:language|lang|brush|sourceCode)[-:]([a-z0-9+#]+)\b", re.IGNORECASE)
NOTES = {"footnote", "endnote", "rearnote", "note", "footnotes"}
# What a whole page is left out for. Covers, dedications, forewords and the like are read.
DROPPED_STEMS = re.compile(r"(?:toc|nav|index|bibliography|biblio|glossary|copyright|titlepage|title-page|halftitle|half-title|colophon-toc)\b", re.IGNORECASE)
LANDMARKS = {"toc", "landmarks", "copyright-page", "titlepage", "title-page", "index", "bibliography", "loi", "lot"}
DROPPED_HEADINGS = {"contents", "table of contents", "toc", "index", "bibliography", "list of illustrations", "list of figures"}
BOILERPLATE_CLASSES, BOILERPLATE_IDS = {"pg-boilerplate", "pgheader", "pgfooter"}, {"pg-header", "pg-footer"}
MANY_LINKS, LINK_SHARE = 5, 0.6  # fixed
TYPES = ("epub:type", "epubtype", "data-epub-type")


class Tree(HTMLParser):
    """Top-most blocks, text nodes and images in order, and what pages are dropped for. An unclosed paragraph ends where
    the next block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[dict] = []
        self.block: dict | None = None
        self.depth = 0
        self.nodes: list[str] = []
        self.images: list[tuple[int, str]] = []
        self.links = self.link_chars = self.paragraphs = 0
        self.landmarks: set[str] = set()
        self.boilerplate = self.nav = False
        self.headings: dict[str, list[str]] = {}  # the text of the first h1 or h2, and of the first of these or h3
        self.reading: set[str] = set()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        kind = next((a[t] for t in TYPES if a.get(t)), "").lower()
        if tag in ("body", "section", "nav"):
            self.landmarks |= set(kind.split())
        self.boilerplate |= bool(set(a.get("class", "").lower().split()) & BOILERPLATE_CLASSES) or a.get("id", "").lower() in BOILERPLATE_IDS
        self.nav |= tag == "nav"
        self.paragraphs += tag == "p"
        self.links += tag == "a"
        title = tag in ("h1", "h2") and "title" not in self.headings
        for name in (["title"] if title else []) + (["heading"] if tag in ("h1", "h2", "h3") and "heading" not in self.headings else []):
            self.headings[name] = []
            self.reading.add(name)
        if tag in ("img", "image"):
            self.images.append((len(self.nodes), a.get("src") or a.get("xlink:href") or a.get("href") or ""))
            if self.block is not None:
                self.block["image"] = True
        if tag in BLOCKS and self.block is not None and self.block["tag"] == "p" and tag != "math":
            self._close()
        if tag in BLOCKS and self.block is None:
            self.block = {"tag": tag, "text": [], "class": a.get("class", ""), "style": a.get("style", ""), "type": kind, "inner": None, "title": title, "image": False}
            self.depth = len(self.open)
        elif self.block is not None and tag == "code" and self.block["inner"] is None:
            self.block["inner"] = a.get("class", "")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3"):
            self.reading.clear()
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if self.block is not None and len(self.open) <= self.depth:
            self._close()

    def _close(self):
        b, self.block = self.block, None
        b["text"] = " ".join(" ".join(b["text"]).split())
        self.blocks.append(b)
        self.open = self.open[: self.depth]

    def handle_data(self, data):
        if any(t in SILENT for t in self.open):
            return
        for name in self.reading:
            self.headings[name].append(data)
        if data.strip():
            self.nodes.append(data)
            if "a" in self.open:
                self.link_chars += len(data.strip())
        if self.block is not None:
            self.block["text"].append(data)

    def close(self):
        super().close()
        if self.block is not None:
            self._close()


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(plain_ampersands(html))
    tree.close()
    return tree


def code_language(classes: str) -> str:
    """The language that class names tell: after a prefix, else one known by its bare name; else none."""
    if m := LANGUAGE.search(classes):
        return m[1].lower()
    return next((c for c in classes.lower().split() if c in CODE), "")


def kind_of(b: dict) -> str:
    """The ladder: pre is code; tables, figures and formulas are what they are; an aside of a note's type is a footnote;
    a paragraph or quotation whose class or style hints at code is ambiguous; the rest is prose. Empty if there is
    nothing in it."""
    tag = b["tag"]
    if tag in ("table", "figure"):
        return tag if b["text"] or b["image"] else ""
    if not b["text"]:
        return ""
    if tag == "pre":
        return "code"
    if tag == "math":
        return "equation"
    if tag == "aside" and set(b["type"].split()) & NOTES:
        return "footnote"
    if tag in ("p", "blockquote") and (CODE_CLASS.search(b["class"]) or CODE_STYLE.search(b["style"])):
        return "ambiguous"
    return "prose"


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, tag, kind, language, text): top-most blocks but for the page's title; visual ones keep no text,
    empty ones are left out, ambiguous ones are prose unless a provider decides."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                no = 0
                for b in parsed(html or "").blocks:
                    kind = "" if b["title"] else kind_of(b)
                    if not kind:
                        continue
                    language = code_language(b["class"] if b["inner"] is None else b["inner"]) if kind in ("code", "ambiguous") else ""
                    rows.append((page, no, b["tag"], kind, language, b["text"] if kind in ("prose", "ambiguous") else ""))
                    no += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i in range(6)], ["page_id", "block_no", "tag", "kind", "language", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block_no long, tag string, kind string, language string, text string")


VISUAL = ("code", "table", "figure", "footnote", "equation")  # fixed: what a provider may name a block


def resolved(blocks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Ambiguous blocks by a provider's answers (page_id, block_no, answer): a visual kind, which keeps no text; dropped;
    or prose, also where there is no answer or one out of place."""
    if answers is None:
        return blocks.withColumn("kind", F.when(F.col("kind") == "ambiguous", "prose").otherwise(F.col("kind")))
    held = blocks.join(answers.select("page_id", "block_no", "answer"), ["page_id", "block_no"], "left")
    unclear = F.col("kind") == "ambiguous"
    held = held.where(~unclear | ~F.coalesce(F.col("answer") == "drop", F.lit(False)))
    visual = unclear & F.coalesce(F.col("answer").isin(*VISUAL), F.lit(False))
    kind = F.when(visual, F.col("answer")).when(unclear, "prose").otherwise(F.col("kind"))
    return held.withColumns({"text": F.when(visual, "").otherwise(F.col("text")), "kind": kind}).drop("answer")


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the text of each page's first h1 or h2, collapsed; empty without one."""

    def run(batches):
        for batch in batches:
            found = [" ".join(" ".join(parsed(h or "").headings.get("title", [])).split()) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, pa.string())], ["page_id", "title"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, title string")


def block_positions(blocks: DataFrame) -> DataFrame:
    """blocks with after_paragraph: how many prose blocks stand up to each in its page, less one."""
    order = Window.partitionBy("page_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("after_paragraph", (F.sum(F.when(F.col("kind") == "prose", 1).otherwise(0)).over(order) - 1).cast("long"))


def chapter_positions(blocks: DataFrame) -> DataFrame:
    """Non-prose blocks (chapter_id, spine_idx, page_id, block_no, kind, ...) with after_paragraph counted through the
    chapter: what stands before any prose of its page follows the last paragraph of the pages before."""
    order = Window.partitionBy("chapter_id").orderBy("spine_idx", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(F.col("kind") == "prose", 1).otherwise(0)).over(order)
    return blocks.withColumn("after_paragraph", (count - 1).cast("long")).where("kind <> 'prose'")


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, text) for narration: the first h1 or h2, and the text of every p that isn't blank, one paragraph
    each, with blank lines between. A p inside a p ends the outer one; images leave nothing."""

    def run(batches):
        for batch in batches:
            titles, texts = [], []
            for page in batch.column("html").to_pylist():
                tree = Paragraphs()
                tree.feed(page or "")
                tree.close()
                titles.append(" ".join(" ".join(tree.title or []).split()))
                texts.append("\n\n".join(t for t in (" ".join(" ".join(p).split()) for p in tree.paragraphs) if t))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["page_id", "title", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, title string, text string")


class Paragraphs(HTMLParser):
    """The title and the paragraphs of a page, wherever they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.paragraphs: list[list[str]] = []
        self.within = self.heading = False
        self.silent = ""

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.paragraphs.append([])
            self.within = True
        elif tag in ("h1", "h2") and self.title is None:
            self.title, self.heading = [], True
        elif tag in ("script", "style") and not self.silent:
            self.silent = tag

    def handle_endtag(self, tag):
        self.within = self.within and tag not in ("p", "body", "div", "section", "article", "blockquote")
        self.heading = self.heading and tag not in ("h1", "h2")
        self.silent = "" if tag == self.silent else self.silent

    def handle_data(self, data):
        if self.heading:
            self.title.append(data.strip())
        if self.within and not self.silent:
            self.paragraphs[-1].append(data.strip())


def page_drops(pages: DataFrame) -> DataFrame:
    """(page_id, reason): why a page (page_id, stem, html) is left out, by the first rule that holds: its stem, a
    landmark's type on body, section or nav, publisher's boilerplate, a nav without paragraphs, a heading that names a
    list of contents, or many links without paragraphs; else null."""

    def reason(stem: str, html: str) -> str | None:
        tree = parsed(html)
        heading = " ".join("".join(tree.headings.get("heading", [])).split()).lower().rstrip(".")
        chars = len(" ".join("".join(tree.nodes).split()))
        rules = {
            "stem": DROPPED_STEMS.match(stem) is not None,
            "landmark": bool(tree.landmarks & LANDMARKS),
            "boilerplate": tree.boilerplate,
            "nav": tree.nav and not tree.paragraphs,
            "heading": heading in DROPPED_HEADINGS,
            "links": tree.links >= MANY_LINKS and tree.link_chars > LINK_SHARE * chars and not tree.paragraphs,
        }
        return next((name for name, holds in rules.items() if holds), None)

    def run(batches):
        for batch in batches:
            found = [reason(s or "", h or "") for s, h in zip(batch.column("stem").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, pa.string())], ["page_id", "reason"])

    return pages.select("page_id", "stem", "html").mapInArrow(run, "page_id long, reason string")


def page_shadow(pages: DataFrame) -> DataFrame:
    """(page_id, node_no, s, e, raw): text nodes and their places in the page's normal form, a space after each."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                at = 0
                for no, raw in enumerate(parsed(html or "").nodes):
                    norm = normal_with_map(raw)[0]
                    rows.append((page, no, at, at + len(norm), raw))
                    at += len(norm) + (not norm.endswith(" "))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(5)], ["page_id", "node_no", "s", "e", "raw"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, node_no long, s long, e long, raw string")
