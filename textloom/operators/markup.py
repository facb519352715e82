"""A clue's chunks as readable text: the segments that they lie in, with marked runs, and summaries of what is skipped between.

All steps are joins, windows and aggregates. Windows go over the sentences of one segment or the segments of one clue; arrays
hold the lines of one segment and the parts of one clue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import segment_of

#: Ranks of retention and importance, and the retentions that are wrapped.
RETENTION = {"verbatim": 4, "detailed": 3, "focused": 2, "relevant": 1}
IMPORTANCE = {"critical": 3, "important": 2, "helpful": 1}
WRAPPED = ("verbatim", "detailed")
CLUE = ["chapter_id", "clue_id"]


def _rank(ranks: dict[str, int], column: str) -> Column:
    found = F.lit(0)
    for value, rank in ranks.items():
        found = F.when(F.col(column) == value, rank).otherwise(found)
    return found


def merged_attributes(covered: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, label, retention, importance`` of what covers a sentence together: the highest retention and the highest
    importance, of equal ones the first by ``place``, and the label of the chunk whose rank is the higher one; retention's, if equal.

    ``covered``: keys, place, label, retention, importance.
    """
    ranked = covered.withColumns({"r": _rank(RETENTION, "retention"), "i": _rank(IMPORTANCE, "importance")})
    best = lambda rank: F.max_by(F.struct("label", "retention", "importance", rank), F.struct(F.col(rank), -F.col("place"), "label"))
    got = ranked.groupBy(*keys).agg(best("r").alias("x"), best("i").alias("y"))
    label = F.when(F.col("x")["r"] >= F.col("y")["i"], F.col("x")["label"]).otherwise(F.col("y")["label"])
    return got.select(*keys, F.coalesce(label, F.lit("")).alias("label"), F.col("x")["retention"].alias("retention"), F.col("y")["importance"].alias("importance"))


def tagged(text: Column, label: Column, retention: Column, importance: Column, mode: str = "plain") -> Column:
    """A run with its attributes as a tag: ``full`` shows all, ``retention`` only the highest retentions, ``plain`` none."""
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    if mode == "full":
        inner = F.concat_ws("", attribute("label", label), attribute("retention", retention), attribute("importance", importance))
        return F.concat(F.lit("<chunk"), inner, F.lit(">"), text, F.lit("</chunk>"))
    if mode == "retention":
        return F.when(retention.isin(*WRAPPED), F.concat(F.lit("<chunk"), attribute("retention", retention), F.lit(">"), text, F.lit("</chunk>"))).otherwise(text)
    return text


def rendered_clues(members: DataFrame, chunks: DataFrame, chunk_sentences: DataFrame, sentences: DataFrame, segments: DataFrame, mode: str = "plain") -> DataFrame:
    """``chapter_id, clue_id, markup`` of clues that cover a sentence of a segment.

    ``members``: chapter_id, clue_id, chunk_id, place (their order in the clue); ``chunks``: chunk_id, label, retention,
    importance; ``chunk_sentences``: chunk_id, chapter_id, sentence_index; ``sentences``: chapter_id, sentence_index, text;
    ``segments``: chapter_id, start_sentence_index, summary. Neighbouring covered sentences of a segment with one label are
    a run, with the attributes of its first. Parts are joined by an empty line, what lies in a part by blanks.
    """
    placed = segment_of(sentences, segments, ["chapter_id", "sentence_index"]).filter("segment IS NOT NULL")
    lines = sentences.select("chapter_id", "sentence_index", "text").join(placed, ["chapter_id", "sentence_index"])
    own = chunks.select("chunk_id", "label", "retention", "importance")
    covered = members.join(own, "chunk_id").join(chunk_sentences.select("chunk_id", "chapter_id", "sentence_index"), ["chunk_id", "chapter_id"])
    attributes = merged_attributes(covered, [*CLUE, "sentence_index"])
    # the segments of each clue, numbered in its chapter, so that the skipped ones are the numbers between
    number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("segment"))
    numbered = segments.select("chapter_id", F.col("start_sentence_index").alias("segment"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary")).withColumn("number", number)
    met = attributes.join(placed, ["chapter_id", "sentence_index"]).select(*CLUE, "segment").distinct().join(numbered.select("chapter_id", "segment", "number"), ["chapter_id", "segment"])
    shown = met.select(*CLUE, "segment", "number").join(lines, ["chapter_id", "segment"]).join(attributes.withColumn("covers", F.lit(True)), [*CLUE, "sentence_index"], "left")
    inside = Window.partitionBy(*CLUE, "segment").orderBy("sentence_index")
    begins = F.col("covers").isNull() | ~F.col("label").eqNullSafe(F.lag("label").over(inside))
    runs = shown.withColumn("run", F.sum(begins.cast("int")).over(inside)).groupBy(*CLUE, "segment", "number", "run").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("sentence_index", "text")))["text"]).alias("text"), F.min_by(F.struct("covers", "label", "retention", "importance"), "sentence_index").alias("a")
    )
    a = F.col("a")
    marked = F.when(a["covers"], tagged(F.col("text"), a["label"], a["retention"], a["importance"], mode)).otherwise(F.col("text"))
    bodies = runs.groupBy(*CLUE, "segment", "number").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("run", marked.alias("text"))))["text"]).alias("text"))
    before = F.lag("number").over(Window.partitionBy(*CLUE).orderBy("number"))
    gaps = met.withColumn("before", before).filter("number > before + 1").select(*CLUE, F.col("number").alias("next"), F.explode(F.sequence(F.col("before") + 1, F.col("number") - 1)).alias("number"))
    skipped = gaps.join(numbered.filter("summary <> ''").select("chapter_id", "number", "summary"), ["chapter_id", "number"])
    between = skipped.groupBy(*CLUE, F.col("next").alias("number")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.struct("number", "summary")))["summary"]).alias("text"))
    parts = bodies.select(*CLUE, "number", F.lit(1).alias("kind"), "text").unionByName(between.select(*CLUE, "number", F.lit(0).alias("kind"), "text"))
    return parts.groupBy(*CLUE).agg(F.concat_ws("\n\n", F.array_sort(F.collect_list(F.struct("number", "kind", "text")))["text"]).alias("markup"))
