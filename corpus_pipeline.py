"""From raw documents to training ids: quality rules, toxicity, near-duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), with docs as the columns of ``documents``, and works on all rows that it gets. A
stage's result is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, pieces, quality, simhash, toxicity
from textloom.llm.common import shared_dir, table


def _filtered(docs: DataFrame, keeps) -> DataFrame:
    """Rows of ``docs`` that ``keeps(rows, names)`` keeps. The rows' columns are numbered meanwhile (``names``: how each is called), so
    that no column of the documents can clash with an operator's, whatever its name."""
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return keeps(numbered, dict(zip(docs.columns, numbered.columns, strict=True))).select(*numbered.columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet the threshold table. A null text counts as an empty one, and goes; repeated rows stay or go together."""
    return _filtered(docs, lambda rows, names: quality.quality_rules(rows, names["text"]).filter("kept"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the cut; the examples are those labelled documents that are still there.

    A null or empty text has a score, that of a text without neighbours. Without examples nothing goes.
    """
    index = toxicity.fit(table(spark, sf_dir, "labels"), docs.select("doc_id", "text"))
    return _filtered(docs, lambda rows, names: toxicity.score(rows, index, rows.columns, names["text"]).filter(F.col("score") < toxicity.CUT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a Jaccard similarity of 0.8 or more on five-word shingles: the smallest id.

    Rows that repeat an id are the same document and stay or go together; rows without an id or a text stay.
    """
    classes = simhash.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return _filtered(docs, lambda rows, names: rows.join(gone, rows[names["doc_id"]] == gone["doc_id"], "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target number of words, in training order; a document's repeats are rows of their own. Documents without
    a word are never used, those without a source are a source of their own."""
    return mixing.training_order(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: the SentencePiece ids of each row, whole texts; a null text has no ids."""
    return pieces.encode(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("near duplicates", near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", piece_ids),
]

#: SQL can't express the toxicity stage. Its score, the near-duplicate classes, the training positions and the piece ids are
#: tested against brute force or libraries; the stages themselves on the small tables and on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
