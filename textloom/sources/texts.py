"""Reading and writing documents: plain text, HTML pages, EPUB books, typed JSON lines, text export.

Files are read by Spark, one row a file; parsing is per row in Arrow batches with the standard library.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: HTML tags whose text isn't read, and tags that end a block.
SKIPPED = {"script", "style"}
BLOCKS = set("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, text`` of text and Markdown files; the title is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("text"))
    return files.select("path", F.regexp_extract(F.url_decode("path"), r"([^/]*?)(?:\.[^./]*)?\z", 1).alias("title"), "text")


class _Sections(HTMLParser):
    """Collects the text of a page, cut where an element has one of the given ids."""

    def __init__(self, anchors: Sequence[str | None]):
        super().__init__(convert_charrefs=True)
        self.places = {a: i for i, a in reversed(list(enumerate(anchors))) if a is not None}
        self.parts: list[list[str]] = [[] for _ in anchors]
        self.at, self.skipped = (0 if anchors and anchors[0] is None else -1), 0

    def _add(self, text: str) -> None:
        if 0 <= self.at < len(self.parts):
            self.parts[self.at].append(text)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
            return
        found = dict(attrs)
        anchor = found.get("id", found.get("xml:id"))
        self.at = max(self.at, self.places.get(anchor, -1)) if anchor is not None else self.at
        if tag in ("br", "hr"):  # they have no end tag
            self._add("\n" if tag == "br" else "")
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BLOCKS:
            self._add("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            self._add(data)


def html_sections(html: str, anchors: Sequence[str | None] = (None,)) -> list[str]:
    """The text of each section: from the start (None) or from an element's id up to the next one that is listed further on."""
    parser = _Sections(anchors)
    parser.feed(html)
    parser.close()
    return [re.sub("\n{3,}", "\n\n", "".join(p).replace("\r\n", "\n")).strip() for p in parser.parts]


@F.pandas_udf(StringType())
def _page_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_sections(h)[0], na_action="ignore")


def page_text(html: Column) -> Column:
    """The readable text of an HTML page; null for a null."""
    return _page_text(html)


# --- EPUB


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _under(element, name: str):
    return (x for x in element.iter() if _name(x) == name)


def epub_parts(data: bytes) -> tuple[dict, list[dict]]:
    """(title and authors, sections) of a book. A section has ``path`` (numbers from the root), ``title, href, anchor, text``.

    Sections follow the navigation document, else the NCX; pages of the spine that neither lists come last, without the
    cover and the pages that hold the navigation.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        read = lambda n: ElementTree.fromstring(book.read(n))
        package_path = next(_under(read("META-INF/container.xml"), "rootfile")).get("full-path")
        package, base = read(package_path), posixpath.dirname(package_path)
        full = lambda href, at=base: posixpath.normpath(posixpath.join(at, href))
        text_of = lambda n: ["".join(x.itertext()).strip() for x in _under(package, n)]
        meta = {"title": next(iter(text_of("title")), None), "authors": text_of("creator"), "language": next(iter(text_of("language")), None)}
        items = {x.get("id"): x for x in _under(package, "item")}
        spine = [full(items[x.get("idref")].get("href")) for x in _under(package, "itemref") if x.get("idref") in items]
        nav = next((full(x.get("href")) for x in items.values() if "nav" in (x.get("properties") or "").split()), None)
        cover = {full(x.get("href")) for x in items.values() if "cover" in (x.get("id") or "").lower() and "html" in (x.get("media-type") or "")}
        ncx = next((full(x.get("href")) for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
        found: list[dict] = []

        def add(path: tuple, title: str, href: str | None, at: str) -> None:
            target, _, anchor = (href or "").partition("#")
            found.append({"path": list(path), "title": title, "href": full(target, posixpath.dirname(at)) if target else None, "anchor": anchor or None})

        def from_list(ol, path: tuple) -> None:
            for i, li in enumerate(x for x in ol if _name(x) == "li"):
                label = next((x for x in li if _name(x) in ("a", "span")), None)
                add((*path, i), "".join(label.itertext()).strip() if label is not None else "", label.get("href") if label is not None else None, nav)
                for sub in (x for x in li if _name(x) == "ol"):
                    from_list(sub, (*path, i))

        def from_points(points, path: tuple) -> None:
            for i, p in enumerate(points):
                label = "".join(next(_under(p, "navLabel")).itertext()).strip()
                add((*path, i), label, next(_under(p, "content")).get("src"), ncx)
                from_points([x for x in p if _name(x) == "navPoint"], (*path, i))

        if nav in names:
            for ol in (x for n in _under(read(nav), "nav") if any(k.endswith("type") and v == "toc" for k, v in n.attrib.items()) for x in n if _name(x) == "ol"):
                from_list(ol, ())
        if not found and ncx in names:
            for m in _under(read(ncx), "navMap"):
                from_points([x for x in m if _name(x) == "navPoint"], ())
        listed = {s["href"] for s in found}
        top = sum(len(s["path"]) == 1 for s in found)
        for href in spine:
            if href not in listed and href not in cover and href not in (nav, ncx):
                found.append({"path": [top], "title": "", "href": href, "anchor": None})
                top += 1
        for href in {s["href"] for s in found} & names:
            own = [s for s in found if s["href"] == href]
            for s, text in zip(own, html_sections(book.read(href).decode("utf-8", "replace"), [s["anchor"] for s in own])):
                s["text"] = text
    return meta, [{**s, "text": s.get("text", "")} for s in found]


BOOK = "path string, title string, authors array<string>, language string, section array<long>, section_title string, href string, anchor string, text string"


def epub_sections(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of each book (see ``epub_parts``)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for place, data in zip(pdf["path"], pdf["content"]):
                meta, sections = epub_parts(data)
                rows += [(place, meta["title"], meta["authors"], meta["language"], s["path"], s["title"], s["href"], s["anchor"], s["text"]) for s in sections]
            yield pd.DataFrame(rows, columns=["path", "title", "authors", "language", "section", "section_title", "href", "anchor", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BOOK)


def import_plan(sections: DataFrame) -> DataFrame:
    """Sections with ``chapter_id``: those with text are numbered depth first from 1, a parent before its parts; of a single
    section without a title the book's title is taken."""
    from pyspark.sql import Window

    own = Window.partitionBy("path").orderBy("section")
    numbered = sections.filter(F.trim("text") != "").withColumn("chapter_id", F.row_number().over(own).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    title = F.when((F.col("section_title") == "") & (F.col("_n") == 1), F.col("title")).otherwise(F.col("section_title"))
    return numbered.withColumn("section_title", title).drop("_n")


# --- typed JSON lines

OBJECT_SCHEMA = (
    "type string, schemaVersion long, chapterId long, stream string, scope string, language string, prompt string, fragmentId long, summary string, id string, generation long, "
    "sentenceIndex long, label string, content string, sentenceIndexes array<long>, retention string, importance string, wordsCount long, weight double, fromChunkId string, toChunkId string, "
    "strength string, groupId long, startSentenceIndex long, endSentenceIndex long, localSnakeId long, size long, firstLabel string, lastLabel string, snakeId string, chunkId string, position long, "
    "fromSnakeId string, toSnakeId string, text string, rangeStart long, rangeEnd long, surface string, qid string, confidence double, note string, sourceMentionId string, targetMentionId string, "
    "predicate string, evidenceSentenceIndexes array<long>"
)
#: The types of records.
OBJECT_TYPES = "meta parameter source-fragment reading-chunk reading-edge fragment-group snake snake-chunk snake-edge summary mention mention-link end".split()


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Records of an object stream; a line that isn't JSON of this schema is an error."""
    return spark.read.schema(OBJECT_SCHEMA).option("mode", "FAILFAST").json(path)


def write_objects(objects: DataFrame, path: str, order: Sequence[str] = ("type", "id")) -> None:
    """Records as JSON lines, sorted, with an end record behind them; nulls are left out."""
    end = objects.sparkSession.createDataFrame([("end",)], "type string")
    whole = objects.unionByName(end, allowMissingColumns=True)
    whole.orderBy(F.col("type") == "end", F.col("type") != "meta", *order).write.mode("overwrite").json(path)


def object_faults(objects: DataFrame, sentences: int | None = None) -> DataFrame:
    """``type, id, fault``: unknown types, versions and references, evidence outside the chapter, a stream without its end."""
    known = lambda t: objects.filter(F.col("type") == t)
    fault = lambda df, name, text: df.select("type", F.col(name).alias("id"), F.lit(text).alias("fault"))

    def dangling(t: str, column: str, target: str) -> DataFrame:
        ids = known(target).select(F.col("id").alias(column)).distinct()
        return fault(known(t).join(ids, column, "left_anti"), column, f"unknown {column}")

    found = [
        fault(objects.filter(~F.col("type").isin(OBJECT_TYPES) | F.col("type").isNull()), "id", "unknown type"), fault(known("meta").filter(~(F.col("schemaVersion").eqNullSafe(1))), "id", "unknown schema version"),
        dangling("reading-edge", "fromChunkId", "reading-chunk"), dangling("reading-edge", "toChunkId", "reading-chunk"), dangling("snake-chunk", "snakeId", "snake"), dangling("snake-chunk", "chunkId", "reading-chunk"),
        dangling("snake-edge", "fromSnakeId", "snake"), dangling("snake-edge", "toSnakeId", "snake"), dangling("mention-link", "sourceMentionId", "mention"), dangling("mention-link", "targetMentionId", "mention"),
    ]
    if sentences is not None:
        outside = F.exists("evidenceSentenceIndexes", lambda i: (i < 0) | (i >= sentences))
        found.append(fault(known("mention-link").filter(outside), "id", "evidence outside the chapter"))
    ends = objects.agg(F.count_if(F.col("type") == "end").alias("n")).filter("n <> 1")
    found.append(ends.select(F.lit("end").alias("type"), F.lit(None).cast("string").alias("id"), F.lit("not one end record").alias("fault")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def export_text(chapters: DataFrame, path: str) -> None:
    """Chapters (``document_order, depth, title, text``) as one text: headings by depth, then the text, in document order."""
    heading = F.concat(F.repeat(F.lit("#"), F.col("depth") + 1), F.lit(" "), F.col("title"))
    body = F.concat_ws("\n\n", F.when(F.col("title") != "", heading), F.nullif(F.trim("text"), F.lit("")))
    chapters.orderBy("document_order").select(F.concat(body, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
