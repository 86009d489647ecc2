"""Main text of web pages by two passes of rules over blocks.

First pass: menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by their elements, roles
and class names. Every other block is judged by its length, the share of its characters inside links and the share of
stop words among its words: good, bad, or undecided where it is short or has few stop words. Second pass: an undecided
block takes the label of the nearest decided neighbours; where those differ, a heading goes with what follows it, and
any other block with the nearer one. On pages with an article (else a main) element that holds good or undecided
blocks, only what is inside of it counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import only

# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """the of and to in is that for it on with as was be by this are at from or an not but they his her have has had
    le la les de des du un une et que qui dans pour est sur par pas ne au aux avec il elle ce se son sa
    der die das und den dem ein eine einen ist nicht mit von zu im auf für sich des es als auch an
    el los las y en por con del no su al lo una como para más pero o si""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section
    select summary table tbody td textarea tfoot th thead title tr ul""".split()
) - {"br"}
HOLDERS = frozenset("article aside blockquote button dialog div dl fieldset figure footer form header main menu nav ol p section select span table td title tr ul head noscript template svg object".split()) - {"p"}
NEVER = frozenset("nav footer aside form button select fieldset dialog menu title head noscript template svg object".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CLUTTER = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie
    cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar
    aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar
    comment comments commentlist respond disqus discussion replies share sharing social related recommended
    recommendations pagination pager login search copyright disclaimer skip hidden""".split()
)
# What may follow the word that a name is about, as in ad-slot-1 or related-posts.
ENDINGS = frozenset(
    """wrap wrapper container inner outer box area section block list item items group panel bar row col column content
    left right top bottom main primary secondary fixed sticky mobile desktop link links text title body head form field
    button buttons icon icons slot unit card cards post posts article articles story stories news image img logo toggle
    message""".split()
)
# What makes a name tell how an element is laid out instead of what it is, as in has-sidebar or overflow-hidden.
STATES = frozenset("has no not non with without overflow layout".split())
SPARED = frozenset("article post entry content story main body".split())
SHORT, LONG, LINKS, FEW, MANY = 60, 140, 0.3, 0.06, 0.14

_OPEN = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
# From a tag's name to its end; quotes count where a value begins. No part gives back what it has read.
_REST = re.compile(r"""(?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+')|(?!\s*+["'])))*+>""")
RAW = frozenset("script style xmp textarea iframe noembed noframes".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|\Z))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


HARD, NAMED = 2, 1


def _named(name: str) -> bool:
    """Whether a class or id is a clutter name: its head, which is its last word but for endings, is a clutter word."""
    parts = [p.lower() for p in _NAME.findall(name)]
    if set(parts) & SPARED and not set(parts) & {"comment", "comments", "ad", "ads", "sidebar", "related", "advertisement"}:
        return False
    while parts and parts[-1] not in CLUTTER and (parts[-1] in ENDINGS or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in CLUTTER and not set(parts) & STATES


def _clutter(tag: str, attributes: str, within: bool) -> int:
    """HARD if an element is of a kind that is never main text, NAMED if only its class or id says so, else 0.
    within: inside an article or main."""
    if tag in NEVER or tag == "header" and not within:
        return HARD
    if not attributes:
        return 0
    named = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return HARD
        if name == "role" and value.lower() in ROLES:
            return HARD
        if name in ("class", "id") and any(map(_named, value.split())):
            named = NAMED
    return named


class Block:
    __slots__ = ("text", "linked", "region", "heading", "bad")

    def __init__(self, text: str, linked: int, region: int, heading: bool, bad: bool):
        self.text, self.linked, self.region, self.heading, self.bad = text, linked, region, heading, bad


def tags(page: str):
    """(start, end, name, whether it closes, attributes) of every tag, comment and declaration (these without a name).

    An element whose content isn't markup, such as a script, is one item without a name. Every character is read a
    bounded number of times: where a quote runs to the end of the page, quotes stop counting; a tag that nothing ends
    goes to the next < (or the page's end).
    """
    at, quotes, last = 0, True, page.rfind(">")
    while m := _OPEN.search(page, at):
        start, at = m.start(), m.end()
        if m[1]:
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        rest = _REST.match(page, at) if m[3] and quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = quotes and not m[3]
            end = page.find(">", at) + 1 if at <= last else 0
            if not end:
                end = page.find("<", at)
                end = len(page) if end < 0 else end
        name = (m[3] or "").lower()
        if name in RAW and not m[2]:
            stop = _RAW_ENDS[name].search(page, end)
            end = page.find(">", stop.end()) + 1 if stop else 0
            at = end or len(page)
            yield start, at, "", False, ""
            continue
        yield start, end, name, bool(m[2]), page[at : end - (page[end - 1] == ">")] if m[3] else ""
        at = end


def blocks(page: str) -> list[Block]:
    """Every block of text, in page order, without scripts, styles, comments and markup."""
    out: list[Block] = []
    parts: list[str] = []
    linked = links = clutter = 0
    stack: list[tuple[str, int, int]] = []
    depth: Counter = Counter()  # how many of each element are open
    outer: list[int] = []  # elements that are clutter by name alone: the one around each, or -1
    named = -1  # the innermost of them that is open
    under: list[int] = []  # for every block, the innermost around it
    held: list[tuple[str, int]] = []  # the same for every article and main
    region, heading, at = 0, False, 0

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, region, heading, clutter > 0))
            under.append(named)
        parts, linked = [], 0

    def add(text: str):
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    for start, stop, tag, end, attributes in tags(page):
        if start > at:
            add(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
            heading = not end and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            links = 0
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        if tag not in HOLDERS:
            continue
        if not end:
            if attributes.endswith("/") and tag in ("svg", "object", "span"):
                continue
            bad = _clutter(tag, attributes, region > 0)
            if bad and tag not in BLOCKS:
                flush()
            stack.append((tag, bad, region))
            depth[tag] += 1
            clutter += bad == HARD
            if bad == NAMED:
                outer.append(named)
                named = len(outer) - 1
            if tag in ("article", "main") and not bad:
                if not clutter:
                    held.append((tag, named))
                region = max(region, 2 if tag == "article" else 1)
        elif depth[tag]:
            while stack:
                t, bad, before = stack.pop()
                depth[t] -= 1
                if bad and t not in BLOCKS:
                    flush()
                clutter -= bad == HARD
                if bad == NAMED:
                    named = outer[named]
                region = before
                if t == tag:
                    break
    add(page[at:])
    flush()
    # A name doesn't count for an element that holds the page's main or articles. It does where another one stands outside
    # of all such names, or where articles alone are less than the text outside, as teasers below a page without any.
    freed = set()
    if all(x >= 0 for _, x in held):
        for _, x in held:
            while x >= 0 and x not in freed:
                freed.add(x)
                x = outer[x]
    some, every = [], []  # whether any of a named element and those around it is freed, and whether all are
    for x, around in enumerate(outer):
        some.append(x in freed or around >= 0 and some[around])
        every.append(x in freed and (around < 0 or every[around]))
    if freed and all(tag == "article" for tag, _ in held):
        sizes = [(len(b.text), x) for b, x in zip(out, under, strict=True) if not b.bad]
        if sum(n for n, x in sizes if x >= 0 and some[x]) < sum(n for n, x in sizes if x < 0):
            every = [False] * len(outer)
    for b, x in zip(out, under, strict=True):
        b.bad = b.bad or x >= 0 and not every[x]
    return out


def spoken(found: list[Block]) -> bool:
    """Whether the stop words are of the page's language: whether some of the words outside of clutter and links are."""
    every = [w for b in found if not b.bad and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text) for w in _WORD.findall(b.text.lower())]
    return not every or sum(w in STOP_WORDS for w in every) >= FEW / 2 * len(every)


def judge(b: Block, known: bool = True) -> bool | None:
    """The first pass: good, bad, or None where undecided. In a language whose stop words aren't known, length and links
    alone decide."""
    if b.bad:
        return False
    n = len(b.text)
    if b.linked > LINKS * n and not (b.region and n - b.linked >= LONG):
        return False
    if b.heading or n < SHORT:
        return None
    found = _WORD.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0
    if not known:
        return True if n >= LONG else None
    if share >= MANY or b.region and n >= LONG and share >= FEW:
        return True
    if share >= FEW:
        return True if n >= LONG else None
    return None if b.region else False


def main_text(page: str) -> str:
    """The main text of a page: its good blocks, joined by newlines; empty if there are none."""
    found = blocks(page)
    known = spoken(found)
    labels = [judge(b, known) for b in found]
    for level in (2, 1):
        if any(b.region >= level and label is not False for b, label in zip(found, labels, strict=True)):
            chosen = [i for i, b in enumerate(found) if b.region >= level]
            break
    else:
        level, chosen = 0, list(range(len(found)))
    order = [labels[i] for i in chosen]
    n = len(order)
    before: list = [None] * n  # the nearest decided block before each, and after it
    after: list = [None] * n
    seen = None
    for i in range(n):
        before[i] = seen
        seen = i if order[i] is not None else seen
    seen = None
    for i in reversed(range(n)):
        after[i] = seen
        seen = i if order[i] is not None else seen
    kept = []
    for i, label in enumerate(order):
        if label is None:
            x, y = before[i], after[i]
            if x is None and y is None:
                label = level > 0
            elif x is None or y is None:
                label = order[y if x is None else x] or level > 0 and not order[y if x is None else x] and not found[chosen[i]].linked
            elif order[x] == order[y]:
                label = order[x]
            elif found[chosen[i]].heading:
                label = order[y]
            else:
                label = order[x] if i - x <= y - i else order[y]
        if label:
            kept.append(found[chosen[i]].text)
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its n_chars (code points) of every row of pages (page_id, url, html).

    Null html counts as empty; a page without main text has an empty one. Repeated rows stay, other columns are
    ignored, and an empty table gives no rows. Text that no tag closes or opens is read to the end of the page, and a
    page of broken tags takes no longer than any other of its size.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
