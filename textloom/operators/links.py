"""Links and edges by chapter and by sets of ids, links with their evidence, names that nothing uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import Archive

#: Entries of an array of evidence at most.
BLOCK = 1_000


def links_of_chapter(a: Archive, chapter_id: int) -> DataFrame:
    """The links with an end in a chapter, either one. ``archive, link_id, predicate, source_id, target_id, source_chapter, target_chapter``.

    A link whose mention is gone is left out.
    """
    end = lambda side: a.mentions.select("archive", F.col("mention_id").alias(f"{side}_id"), F.col("chapter_id").alias(f"{side}_chapter"))
    both = a.links.join(end("source"), ["archive", "source_id"]).join(end("target"), ["archive", "target_id"])
    near = (F.col("source_chapter") == chapter_id) | (F.col("target_chapter") == chapter_id)
    return both.filter(near).select("archive", "link_id", "predicate", "source_id", "target_id", "source_chapter", "target_chapter")


def with_evidence(links: DataFrame, evidence: DataFrame, block: int = BLOCK) -> DataFrame:
    """All links with ``block, evidence``: arrays of ``chapter_id, sentence_index`` in their order; an empty one for a link without any.

    A link with more than ``block`` pieces of evidence has a row for each block of them, so that no array grows with a hot link.
    ``links`` and ``evidence``: archive, link_id and their own.
    """
    keys = ["archive", "link_id"]
    own = evidence.select(*keys, "chapter_id", "sentence_index").distinct()
    placed = own.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("chapter_id", "sentence_index")) - 1) / block))
    blocks = placed.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("chapter_id", "sentence_index"))).alias("evidence"))
    none = F.array().cast(blocks.schema["evidence"].dataType)
    kept = links.join(blocks, keys, "left")
    return kept.select(*[F.col(c) for c in links.columns], F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("evidence", none).alias("evidence"))


def edges_within(edges: DataFrame, ids: DataFrame, ends: tuple[str, str] = ("from_id", "to_id")) -> DataFrame:
    """The edges both ends of which are among ``ids`` (one column)."""
    some, columns = ids.toDF("_id").distinct(), edges.columns
    for end in ends:
        edges = edges.join(some.withColumnRenamed("_id", end), end, "left_semi")
    return edges.select(*columns)


def cluster_edges_of_chapter(edges: DataFrame, clusters: DataFrame, chapter_id: int) -> DataFrame:
    """The edges between clusters of one chapter. ``edges``: from_id, to_id and their own; ``clusters``: cluster_id, chapter_id."""
    return edges_within(edges, clusters.filter(F.col("chapter_id") == chapter_id).select("cluster_id"))


def unused(names: DataFrame, used: list[DataFrame]) -> DataFrame:
    """The names (one column) that no row of ``used`` (one column each; nulls don't count) has: predicates, parameters."""
    column = names.columns[0]
    for u in used:
        names = names.join(u.toDF(column), column, "left_anti")
    return names.distinct()
