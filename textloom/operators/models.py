"""The deterministic shells around steps that call a language model; the model is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import SEVERITY
from .ranges import WINDOW, hopping_windows

#: How often a summary is written at most, and its length against the text's.
ITERATIONS, RATIO = 5, 0.2


def by_batches(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that a model makes of batches of rows: entity recall, screening, grounding, relations, translation."""
    return rows.mapInPandas(lambda batches: (model(b) for b in batches), schema)


def relation_windows(lengths: DataFrame, length: int = WINDOW, overlap: int = 700) -> DataFrame:
    """The windows of a chapter that relations are looked for in."""
    return hopping_windows(lengths, length, overlap)


def accepted_chunks(answers: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected batches) of a model's answers ``batch_id, chapter_id, temp_id, label, content, sentence_indexes``.

    A batch with a chunk without label, content or evidence, or with evidence that isn't in the chapter, is rejected whole.
    A chunk's first sentence is its place; its words are those of its evidence.
    """
    each = answers.select("batch_id", "chapter_id", "temp_id", F.explode_outer(F.array_distinct("sentence_indexes")).alias("sentence_index"))
    words = each.join(sentences.select("chapter_id", "sentence_index", F.col("words_count").alias("w")), ["chapter_id", "sentence_index"], "left")
    sums = words.groupBy("batch_id", "temp_id").agg(F.sum("w").alias("words_count"), F.bool_and(F.col("w").isNotNull()).alias("known"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    judged = answers.join(sums, ["batch_id", "temp_id"]).withColumn("bad", blank(F.col("label")) | blank(F.col("content")) | ~F.col("known"))
    rejected = judged.groupBy("batch_id").agg(F.bool_or("bad").alias("bad")).filter("bad").select("batch_id")
    kept = judged.join(rejected, "batch_id", "left_anti").withColumn("sentence_index", F.element_at("sentence_indexes", 1))
    return kept.select(*answers.columns, "sentence_index", "words_count"), rejected


def accepted_links(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links (``batch_id, from_temp, to_temp``) whose ends are chunks of their batch; others are dropped."""
    for c in ("from_temp", "to_temp"):
        links = links.join(chunks.select("batch_id", F.col("temp_id").alias(c)).distinct(), ["batch_id", c], "left_semi")
    return links


def compressed(text: str, write: Callable[[str, Sequence[dict]], str], review: Callable[[str], list[dict]], most: int = ITERATIONS) -> tuple[str, float, int]:
    """(text, score, iterations): written and reviewed again until nothing is left to say, at most so often; the first of the best."""
    best, remarks = None, []
    for i in range(most):
        version = write(text, remarks)
        remarks = review(version)
        score = float(sum(SEVERITY[r["severity"]] * r["weight"] for r in remarks))
        if best is None or score < best[1]:
            best = (version, score, i)
        if score == 0:
            break
    return best[0], best[1], i + 1


def summaries(groups: DataFrame, write: Callable, review: Callable, most: int = ITERATIONS) -> DataFrame:
    """``chapter_id, summary`` of the rows ``chapter_id, group_id, text, fragments``: each group compressed, joined by blank lines; a
    chapter of one fragment or none stays as it is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        whole = int(pdf["fragments"].sum()) <= 1
        parts = [t if whole else compressed(t, write, review, most)[0] for t in pdf["text"]]
        return pd.DataFrame([(pdf["chapter_id"].iloc[0], "\n\n".join(parts))], columns=["chapter_id", "summary"])

    return groups.groupBy("chapter_id").applyInPandas(run, "chapter_id long, summary string")
