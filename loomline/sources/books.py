"""EPUB containers and series of volumes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}


def package(data: bytes) -> dict:
    """Metadata, manifest, spine and cover of an EPUB's bytes. The cover is the item with that property, else the one a
    meta element names, else an image whose stem is cover."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = root.find(".//c:rootfile", NS).get("full-path")
        doc = ElementTree.fromstring(z.read(opf))
    base = posixpath.dirname(opf)
    items = [{"item_id": i.get("id"), "href": posixpath.normpath(posixpath.join(base, i.get("href", ""))), "media_type": i.get("media-type", ""), "properties": i.get("properties", "")} for i in doc.iterfind(".//o:manifest/o:item", NS)]
    named = next((m.get("content") for m in doc.iterfind(".//o:meta", NS) if m.get("name") == "cover"), None)
    tests = (lambda i: "cover-image" in i["properties"].split(), lambda i: i["item_id"] == named, lambda i: i["media_type"].startswith("image/") and re.fullmatch(r"cover", posixpath.splitext(posixpath.basename(i["href"]))[0], re.IGNORECASE))
    cover = next((i["href"] for t in tests for i in items if t(i)), None)
    first = lambda tag: next((e.text or "" for e in doc.iterfind(f".//d:{tag}", NS)), "")
    return {"title": first("title"), "authors": [e.text or "" for e in doc.iterfind(".//d:creator", NS)], "publisher": first("publisher"), "language": first("language"), "cover": cover, "manifest": items, "spine": [r.get("idref") for r in doc.iterfind(".//o:spine/o:itemref", NS)]}


PACKAGE = "title string, authors array<string>, publisher string, language string, cover string, manifest array<struct<item_id:string,href:string,media_type:string,properties:string>>, spine array<string>"


_ITEM = pa.struct([(n, pa.string()) for n in ("item_id", "href", "media_type", "properties")])
_PACKAGE = {"title": pa.string(), "authors": pa.list_(pa.string()), "publisher": pa.string(), "language": pa.string(), "cover": pa.string(), "manifest": pa.list_(_ITEM), "spine": pa.list_(pa.string())}


def _epubs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def epub_table(spark: SparkSession, path: str) -> DataFrame:
    """A row of metadata, manifest and spine for every EPUB under a path."""

    def run(batches):
        for batch in batches:
            found = [package(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[n] for f in found], k) for n, k in _PACKAGE.items())], ["path", *_PACKAGE])

    return _epubs(spark, path).mapInArrow(run, f"path string, {PACKAGE}")


def epub_members(spark: SparkSession, path: str, pattern: str = r"\.x?html?$") -> DataFrame:
    """(path, member, content) of the members of EPUBs whose names match, one at a time."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for n in z.namelist():
                        if re.search(pattern, n, re.IGNORECASE):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([z.read(n)], pa.binary())], ["path", "member", "content"])

    return _epubs(spark, path).mapInArrow(run, "path string, member string, content binary")


def epub_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, spine_idx, stem, href, html) of the text pages of every EPUB in reading order."""
    spine = epub_table(spark, path).select("path", "manifest", F.posexplode("spine").alias("spine_idx", "item_id"))
    items = spine.select("path", "spine_idx", "item_id", F.explode("manifest").alias("i")).where("i.item_id = item_id")
    stem = F.regexp_replace(F.regexp_extract("i.href", r"([^/]*)$", 1), r"\.[^.]*$", "")
    pages = epub_members(spark, path).select("path", F.col("member").alias("href"), F.col("content").cast("string").alias("html"))
    return items.select("path", "spine_idx", stem.alias("stem"), F.col("i.href").alias("href")).join(pages, ["path", "href"]).select("path", "spine_idx", "stem", "href", "html")


def repacked(data: bytes, changed: dict[str, bytes]) -> bytes:
    """An EPUB with members replaced: all others stay byte for byte, each with its own compression."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            new.writestr(info, changed.get(info.filename, old.read(info.filename)), info.compress_type)
    return out.getvalue()


def image_order(cover: DataFrame, refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(position, href) of images: the cover (href), then those of refs (spine_idx, ref_no, ref) in reading order, each
    resolved exactly, without ../ or by its base name, then what is left of manifest (item_no, href). No image twice."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    plain = F.regexp_replace("ref", r"\.\./", "")
    tiers = []
    for tier, (left, right) in enumerate(((F.col("ref"), F.col("href")), (plain, F.col("href")), (base(F.col("ref")), base(F.col("href"))))):
        a = refs.withColumn("k", left)
        b = manifest.withColumn("k", right)
        tiers.append(a.join(b, "k").select("spine_idx", "ref_no", F.lit(tier).alias("tier"), "item_no", "href"))
    found = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    best = found.groupBy("spine_idx", "ref_no").agg(F.min_by("href", F.struct("tier", "item_no")).alias("href"))
    every = cover.select("href", F.lit(0).alias("part"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    every = every.unionByName(best.select("href", F.lit(1).alias("part"), F.col("spine_idx").alias("x"), F.col("ref_no").alias("y")))
    every = every.unionByName(manifest.select("href", F.lit(2).alias("part"), F.col("item_no").alias("x"), F.lit(0).alias("y")))
    first = every.groupBy("href").agg(F.min(F.struct("part", "x", "y")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at", "href")).alias("position"), "href")


# Pages that narration leaves out, and chapters whose pages may be split in numbered parts.
SKIPPED_STEMS = r"(?i)^(?:cover|toc|copyright|signup|(?:insert|bonus|color)\d+)"
CHAPTER_BASE = r"(?i)^(chapter\d+|prologue|epilogue|afterword|interlude\d+|intro|preface)(?:_\d+)?$"


def narrated(pages: DataFrame) -> DataFrame:
    """Pages (stem, ...) without those that narration leaves out."""
    return pages.where(~F.col("stem").rlike(SKIPPED_STEMS))


def part_groups(pages: DataFrame, *book: str) -> DataFrame:
    """(book, chapter_no, base, title, parts, text) of pages (book, stem, spine_idx, title, text): stems of a known base
    with or without a closing _N are one chapter, any other stem is one by itself, in lower case. Chapters come in the
    order of their first page; the title is the first that isn't blank, else the base in words; texts that aren't blank
    are joined by blank lines."""
    base = F.lower(F.coalesce(F.nullif(F.regexp_extract("stem", CHAPTER_BASE, 1), F.lit("")), F.col("stem")))
    named = pages.withColumn("base", base)
    if "text" not in pages.columns:
        named = named.withColumn("text", F.lit(""))
    human = F.initcap(F.translate("base", "_", " "))
    parts = F.array_sort(F.collect_list(F.struct("spine_idx", "stem", "text")))
    out = named.groupBy(*book, "base").agg(F.min("spine_idx").alias("first"), F.min_by("title", F.when(F.trim("title") != "", F.col("spine_idx"))).alias("title"), parts.alias("p"))
    place = F.row_number().over(Window.partitionBy(*(book or (F.lit(0),))).orderBy("first"))
    joined = F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: F.trim(t) != ""), "\n\n")
    return out.select(*book, place.alias("chapter_no"), "base", F.coalesce("title", human).alias("title"), F.array_join(F.transform("p", lambda x: x["stem"]), ",").alias("parts"), joined.alias("text"))


def prior_volumes(volumes: DataFrame, book: str) -> DataFrame:
    """The volumes (book_id) of the same series that sort before a book, rising. A book id without a series has none."""
    series, _, leaf = book.rpartition("/")
    own = volumes.where(F.lit(bool(series)) & (F.regexp_extract("book_id", r"^(.*)/[^/]*$", 1) == series))
    return own.withColumn("leaf", F.regexp_extract("book_id", r"([^/]*)$", 1)).where(F.col("leaf") < leaf).orderBy("leaf")
