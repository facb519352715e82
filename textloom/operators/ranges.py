"""Ranges of sentences: merging, context, containment, overlap, running offsets, windows, fragments.

A range is ``chapter_id, start, end`` (both inside), with a ``score`` that may be null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sentences of context, window length and overlap in characters, words of a fragment as stored and as processed.
CONTEXT, WINDOW, OVERLAP, STORED_WORDS, PROCESSED_WORDS = 2, 1800, 700, 600, 320


def islands(ranges: DataFrame, keys: tuple[str, ...] = ("chapter_id",)) -> DataFrame:
    """Ranges with ``island``: a number that ranges share if they touch or overlap, directly or through others."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    fixed = ranges.withColumns({"start": low, "end": high})
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = fixed.withColumn("opens", F.when(F.col("start") > F.coalesce(before, F.col("start") - 2) + 1, 1).otherwise(0))
    return opened.withColumn("island", F.sum("opens").over(order)).drop("opens")


def merge_ranges(ranges: DataFrame, keys: tuple[str, ...] = ("chapter_id",)) -> DataFrame:
    """``keys, start, end, score``: one range for each island, with its largest score."""
    return islands(ranges, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("island")


def merge_in_order(ranges: DataFrame, rank: str, keys: tuple[str, ...] = ("chapter_id",)) -> DataFrame:
    """As ``merge_ranges``, with ``rank``: the place of an island's first member in the given order."""
    merged = islands(ranges, keys).groupBy(*keys, "island").agg(F.min(rank).alias(rank), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return merged.drop("island")


def with_context(ranges: DataFrame, sentences: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Ranges that reach ``context`` sentences further on both sides, inside their chapter."""
    last = sentences.groupBy("chapter_id").agg(F.max("sentence_index").alias("_last"))
    joined = ranges.join(last, "chapter_id")
    return joined.withColumns({"start": F.greatest(F.lit(0), F.col("start") - context), "end": F.least(F.col("_last"), F.col("end") + context)}).drop("_last")


def offsets(sentences: DataFrame) -> DataFrame:
    """Sentences with ``start_offset`` and ``end_offset`` in the chapter's text, where one character parts them."""
    order = Window.partitionBy("chapter_id").orderBy("sentence_index")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return sentences.withColumn("start_offset", before).withColumn("end_offset", before + F.length("text"))


def sentence_at(positions: DataFrame, sentences: DataFrame, strict: bool = False) -> DataFrame:
    """Positions (``chapter_id, offset``) with the sentence that holds the offset: the first whose end reaches it.

    An offset behind the text belongs to the last sentence; with ``strict`` a sentence's end is not part of it, and such an
    offset gives a null. In a chapter without sentences every offset gives a null. One union and one window, not a range join.
    """
    own = F.struct(*positions.columns)
    kind = positions.select(own.alias("own")).schema["own"].dataType
    ends = offsets(sentences).select("chapter_id", F.col("end_offset").alias("at"), F.lit(1).alias("k"), F.col("sentence_index").alias("i"), F.lit(None).cast(kind).alias("own"))
    asked = positions.select("chapter_id", F.col("offset").cast("long").alias("at"), F.lit(2 if strict else 0).alias("k"), F.lit(None).cast("int").alias("i"), own.alias("own"))
    ahead = Window.partitionBy("chapter_id").orderBy("at", "k")
    found = ends.unionByName(asked).withColumn("next", F.first("i", ignorenulls=True).over(ahead.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    found = found.withColumn("last", F.max("i").over(Window.partitionBy("chapter_id"))).filter("own IS NOT NULL")
    return found.select("own.*", (F.col("next") if strict else F.coalesce("next", "last")).alias("sentence_index"))


def overlapping(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans of characters (``chapter_id, span_start, span_end``, half open) with every sentence that they overlap."""
    placed = offsets(sentences).select(F.col("chapter_id"), "sentence_index", "start_offset", "end_offset")
    return spans.join(placed, "chapter_id").filter((F.col("span_start") < F.col("end_offset")) & (F.col("start_offset") < F.col("span_end")))


def hopping_windows(lengths: DataFrame, length: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``chapter_id, window_start, window_end`` over texts of ``n`` characters; the first window that reaches the end is the last."""
    step = length - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - length) / step)).cast("int")
    at = F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("window_start")
    return lengths.filter("n > 0").select("chapter_id", "n", at).select("chapter_id", "window_start", F.least("n", F.col("window_start") + length).alias("window_end"))


def mentions_in_windows(windows: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """``chapter_id, window_start, mentions``: the mentions (``range_start, range_end``) inside each window that has ``least`` of them."""
    inside = (F.col("range_start") >= F.col("window_start")) & (F.col("range_end") <= F.col("window_end"))
    met = windows.join(mentions.select("chapter_id", "mention_id", "range_start", "range_end"), "chapter_id").filter(inside)
    return met.groupBy("chapter_id", "window_start", "window_end").agg(F.array_sort(F.collect_list("mention_id")).alias("mentions")).filter(F.size("mentions") >= least)


def best_in_ranges(ranges: DataFrame, hits: DataFrame) -> DataFrame:
    """Ranges with ``best``: the largest score of the hits (``chapter_id, sentence_index, score``) inside. Ranges become the sentences that they hold."""
    each = ranges.withColumn("sentence_index", F.explode(F.sequence("start", "end")))
    return each.join(hits.select("chapter_id", "sentence_index", "score"), ["chapter_id", "sentence_index"]).groupBy(*ranges.columns).agg(F.max("score").alias("best"))


def neighbour_texts(sentences: DataFrame) -> DataFrame:
    order = Window.partitionBy("chapter_id").orderBy("sentence_index")
    return sentences.withColumns({"before_text": F.lag("text", 1, "").over(order), "after_text": F.lead("text", 1, "").over(order)})


def fragment_starts(words: list[int], budget: int) -> list[int]:
    """For each sentence the place of its fragment's first one: a sentence that would go over the budget opens a new one."""
    starts, first, total = [], 0, 0
    for i, w in enumerate(words):
        if i > first and total + w > budget:
            first, total = i, 0
        total += w
        starts.append(first)
    return starts


def fragments(sentences: DataFrame, budget: int = STORED_WORDS, skip_blank: bool = False) -> DataFrame:
    """Sentences with ``fragment_id``, the index of their fragment's first sentence: runs of at most ``budget`` words.

    The cut depends on all sentences before, so a chapter is folded in order, in one task of its own.
    """
    rows = sentences.filter(F.trim("text") != "") if skip_blank else sentences

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sentence_index")
        at = pdf["sentence_index"].tolist()
        return pdf.assign(fragment_id=[at[s] for s in fragment_starts(pdf["words_count"].tolist(), budget)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("chapter_id", "sentence_index", "words_count").schema)
    cut = rows.select("chapter_id", "sentence_index", "words_count").groupBy("chapter_id").applyInPandas(run, f"{kinds}, fragment_id long")
    return cut


def fragment_counts(cut: DataFrame) -> DataFrame:
    """``chapter_id, words, fragments``"""
    return cut.groupBy("chapter_id").agg(F.sum("words_count").alias("words"), F.count_distinct("fragment_id").alias("fragments"))


def fragment_neighbours(cut: DataFrame) -> DataFrame:
    """``chapter_id, fragment_id, previous, next``; null at the ends."""
    order = Window.partitionBy("chapter_id").orderBy("fragment_id")
    return cut.select("chapter_id", "fragment_id").distinct().select("chapter_id", "fragment_id", F.lag("fragment_id").over(order).alias("previous"), F.lead("fragment_id").over(order).alias("next"))


def coalesced_hits(page: DataFrame, rank: str = "rank") -> DataFrame:
    """A page's text hits with those of touching sentences (one chapter and stream) as one: the first one's row, the largest score.

    It runs on a page, after its limit.
    """
    marked = islands(page.withColumns({"start": F.col("sentence_index"), "end": F.col("sentence_index")}), ("chapter_id", "kind"))
    first = F.min_by(F.struct(*page.columns), rank).alias("hit")
    merged = marked.groupBy("chapter_id", "kind", "island").agg(first, F.max("score").alias("_score"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(*(F.col(f"hit.`{c}`") for c in page.columns if c != "score"), F.col("_score").alias("score"), "start", "end")


def rendered(sentences: DataFrame, ranges: DataFrame, parted: Column | None = None) -> DataFrame:
    """Ranges with ``text``: their sentences joined by a space. A range is a few sentences."""
    each = ranges.withColumn("sentence_index", F.explode(F.sequence("start", "end")))
    met = each.join(sentences.select("chapter_id", "sentence_index", F.col("text").alias("_text")), ["chapter_id", "sentence_index"])
    listed = F.array_sort(F.collect_list(F.struct("sentence_index", "_text")))["_text"]
    return met.groupBy(*ranges.columns).agg(F.array_join(listed, " ").alias("text"))
