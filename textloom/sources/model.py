"""The relations of an archive, as DataFrames with an ``archive`` column, so that many archives lie in one table.

``from_documents`` projects the document table onto them: a document is a chapter of the archive named by its source,
sentences are cut at stops and line ends, every run of seven or more ASCII letters is a mention of an entity, neighbouring
mentions are linked, and every sentence is a node of the reading graph. Sentences and their surfaces are written once for
each input; all relations come from that table without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

#: A chunk's id holds its chapter's id and its sentence's place.
PLACES = 1 << 24


@dataclass(frozen=True)
class Archive:
    chapters: DataFrame  # archive, chapter_id, document_order, title
    sentences: DataFrame  # archive, kind (source or summary), chapter_id, sentence_index, text, words_count
    mentions: DataFrame  # archive, mention_id, chapter_id, sentence_index, position, surface, qid
    links: DataFrame  # archive, link_id, source_id, target_id, predicate
    link_evidence: DataFrame  # archive, link_id, chapter_id, sentence_index
    chunks: DataFrame  # archive, chapter_id, chunk_id, sentence_index, label, content, words_count, retention, importance, weight
    chunk_sentences: DataFrame  # archive, chunk_id, chapter_id, sentence_index
    edges: DataFrame  # archive, from_id, to_id, strength, weight

    def only(self, archive: str) -> Archive:
        return Archive(**{name: df.filter(F.col("archive") == archive) for name, df in vars(self).items()})


_KEPT: dict[tuple, DataFrame] = {}


def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``archive, chapter_id, sentence_index, n, text, surfaces``, written once a session for each state of the input's files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    changed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, changed)
    if key not in _KEPT:
        parts = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
        kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
        # counted before they are dealt out: beside the generator the whole list would be made again for each of its rows
        lists = docs.select(F.col("source").alias("archive"), F.col("doc_id").alias("chapter_id"), kept.alias("kept")).withColumn("n", F.size("kept"))
        rows = lists.select("archive", "chapter_id", "n", F.posexplode("kept").alias("sentence_index", "text"))
        _KEPT[key] = written(rows.withColumn("surfaces", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))), "sentences")
    return _KEPT[key]


def from_documents(spark: SparkSession, sf_dir: str) -> Archive:
    base = materialized(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = ["archive", "chapter_id", "sentence_index"]
    key = F.concat_ws(":", F.col("chapter_id"), F.col("sentence_index"))
    chunk_id = F.col("chapter_id") * PLACES + F.col("sentence_index")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), F.col("sentence_index") % n)
    words = base.select(*own, F.posexplode("surfaces").alias("position", "surface"))
    mentions = words.select("archive", F.concat_ws(":", key, "position").alias("mention_id"), "chapter_id", "sentence_index", "position", "surface", F.col("surface").alias("qid"))
    pairs = base.filter(F.size("surfaces") > 1).select(*own, F.posexplode(F.slice("surfaces", 1, F.size("surfaces") - 1)).alias("position", "surface"))
    ends = [F.concat_ws(":", key, (F.col("position") + i).cast("string")) for i in (0, 1)]
    predicate = F.when(F.length("surface") % 2 == 0, "follows").otherwise("part_of")
    links = pairs.select("archive", F.concat(F.lit("l"), ends[0]).alias("link_id"), ends[0].alias("source_id"), ends[1].alias("target_id"), predicate.alias("predicate"))
    proof = pairs.select("archive", F.concat(F.lit("l"), ends[0]).alias("link_id"), "chapter_id", "sentence_index")
    retention, importance = pick(("verbatim", "detailed", "focused", "relevant"), 5), pick(("critical", "important", "helpful"), 4)
    count = F.size(F.split("text", " +")).cast("long")
    chunks = base.select("archive", "chapter_id", chunk_id.alias("chunk_id"), "sentence_index", F.substring("text", 1, 40).alias("label"), F.col("text").alias("content"), count.alias("words_count"), retention.alias("retention"), importance.alias("importance"))
    from ..operators.graph import chunk_weights

    steps = base.select("archive", "chapter_id", "sentence_index", "n", F.explode(F.array(F.lit(1), F.lit(3))).alias("step")).filter("sentence_index + step < n")
    edges = steps.select("archive", (chunk_id + F.col("step")).alias("from_id"), chunk_id.alias("to_id"), pick(("critical", "important", "helpful"), 4).alias("strength"), F.lit(0.1).alias("weight"))
    return Archive(
        docs.select(F.col("source").alias("archive"), F.col("doc_id").alias("chapter_id"), F.col("doc_id").alias("document_order"), F.concat(F.lit("Chapter "), "doc_id").alias("title")),
        base.select("archive", F.lit("source").alias("kind"), "chapter_id", "sentence_index", "text", count.alias("words_count")),
        mentions, links, proof, chunk_weights(chunks), base.select("archive", chunk_id.alias("chunk_id"), "chapter_id", "sentence_index"), edges,
    )
