"""What is known of an archive as a whole: ``archive, title, authors, publisher, description``; its patches, page and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("title", "authors", "publisher", "description")
UNTITLED = "Archive metadata"


def patched(meta: DataFrame, patches: DataFrame) -> DataFrame:
    """Metadata after patches (``archive, ord, field, value``): the last patch of a field counts, a null value removes it.

    Authors are a JSON array of names. An archive without metadata gets a row; an unknown field makes an error.
    """
    last = patches.withColumn("r", F.row_number().over(Window.partitionBy("archive", "field").orderBy(F.desc("ord")))).filter("r = 1")
    known = F.when(F.col("field").isin(*FIELDS), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("no metadata field: "), F.coalesce("field", F.lit("null")))))
    sides = last.select("archive", known.alias("field"), "value").groupBy("archive").agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_{f}") for f in FIELDS))
    both = meta.join(sides, "archive", "full")
    value = lambda f: F.from_json(F.col(f"_{f}")["value"], "array<string>") if f == "authors" else F.col(f"_{f}")["value"]
    return both.select("archive", *(F.when(F.col(f"_{f}").isNotNull(), value(f)).otherwise(F.col(f)).alias(f) for f in FIELDS))


def titled(meta: DataFrame) -> Column:
    return F.coalesce(meta["title"], F.lit(UNTITLED))


def summary() -> Column:
    """Title, authors and publisher in a line; what is missing is left out."""
    authors = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")
    return F.array_join(F.filter(F.array("title", authors, "publisher"), lambda x: x.isNotNull() & (x != "")), " / ")


def as_text() -> Column:
    """The page as lines ``field: value``."""
    some = F.coalesce(F.size("authors") > 0, F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws("\n", line("title", F.coalesce("title", F.lit(UNTITLED))), F.when(some, line("authors", F.array_join("authors", ", "))), line("publisher", F.col("publisher")), line("description", F.col("description")))


def hits(meta: DataFrame) -> DataFrame:
    """An object of kind ``meta`` for each archive, as hits of a list."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return meta.select(
        F.lit("meta").alias("type"), "archive", F.lit("meta").alias("id"), none("chapter_id", "long"), none("sentence_index", "int"), none("document_order", "long"), none("score", "double"), none("match_count", "int"), titled(meta).alias("title")
    )


def grep(meta: DataFrame, needle: str) -> DataFrame:
    """``type, archive, id, chapter_id, field, snippet``: fields of metadata that hold the phrase, in any case; each author by itself."""
    low = needle.strip().lower()
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS if f != "authors"))
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda x: F.struct(F.lit("authors").alias("field"), x.alias("value")))
    each = meta.select("archive", F.explode(F.concat(values, authors)).alias("x")).filter(F.contains(F.lower("x.value"), F.lit(low)) & F.lit(low != ""))
    return each.select(F.lit("meta").alias("type"), "archive", F.lit("meta").alias("id"), F.lit(None).cast("long").alias("chapter_id"), "x.field", F.col("x.value").alias("snippet"))
