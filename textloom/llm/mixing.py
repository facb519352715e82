"""Operator 6, mixing sources to target weights: a time-varying curriculum with token targets.

Each source has a weight schedule, linear in the training time u from 0 to 1. Its integral is the source's cumulative
token demand; over the whole run it comes to the source's target. A document's place in its source's token sequence is
inverted through that demand to a training position, and a range sort by position gives the training order.

Sources are cut into sub-ranges of about ``rows_per_range`` documents (a hash of the id), so that a source with a
third of all rows is many tasks; running sums are taken in a sub-range and over the small table of sub-ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_mark, table, word_count
from .sharding import hash60

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_REPEATS = 2
ROWS_PER_RANGE = 2_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` from the rows ``source, source_size``, one for each source.

    Weights repeat over the sources by code point, null last. The wanted total is shared by weight; no target goes over
    ``repeats`` times its source's size, and the excess is shared again by weight. In closed form: with the sources by
    ascending cap/weight, the capped ones are a prefix, and the rest get ``level * weight``. If all are capped, all get
    their cap. One row a source is all that the windows see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything) * percent / 100.0)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rated.select("source", "source_size", "weight", target.alias("target"))


def start_weight(source_rank: Column) -> Column:
    """Schedule: a source's share of the demand at u = 0, against 1 on average. Every third source starts strong, every third weak."""
    return F.element_at(F.array(F.lit(1.5), F.lit(1.0), F.lit(0.5)), (source_rank % 3 + 1).cast("int"))


def training_time(fraction: Column, start: Column) -> Column:
    """Invert cumulative demand: demand to time u is ``start*u + (1-start)*u^2`` of a source's target (its weight runs
    linearly from ``start`` to ``2-start``); returns the u at which it comes to ``fraction``."""
    slope = 1.0 - start
    root = F.sqrt(F.greatest(start * start + 4.0 * slope * fraction, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, fraction).otherwise((root - start) / (2.0 * slope))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE, **shares: object) -> DataFrame:
    """One row a document: ``key``, ``source``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words used,
    repeats counted), ``position`` (training time of its first use in 0..1, null if it isn't used) and ``positions`` (the
    training time of each use; a further use comes a whole round of its source's words later).

    A source is read in an order given by a hash of the key, round and round until its target is met: ``taken`` is the
    document's part of the first ``target`` words of that endless sequence, so a source's sum is its target, rounded
    down to a word. No document goes over ``repeats`` times its size. Null texts have size 0, null sources are
    a source of their own, repeated keys are ordered by size. Reruns give the same rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    rows = checkpointed(rows)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    largest = totals.agg(F.max("n")).first()[0] or 1
    ranges = max(1, math.ceil(largest / rows_per_range))
    shuffled = hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    rows = rows.withColumn("_h", shuffled).withColumn("_range", F.floor(F.col("_h") / 2.0**60 * ranges).cast("int"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("part"))
    by_source = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_range", F.coalesce(F.sum("part").over(by_source), F.lit(0)).alias("offset"))
    targets = source_targets(totals.select("source", "source_size"), **shares)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    plan = targets.select(F.col("source").alias("_s"), "source_size", "target", start_weight(rank).alias("start"))
    ranged = starts.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("_s"), F.col("_range").alias("_r"), "offset", "source_size", "target", "start")
    within = Window.partitionBy("source", "_range").orderBy("_h", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(ranged, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_from", F.col("offset") + F.col("_before"))
    )
    wanted = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), wanted - rounds * F.col("source_size") - F.col("_from")))
    taken = (rounds * F.col("size") + rest).cast("long")

    def time_of(use: Column) -> Column:
        place = use * F.col("source_size") + F.col("_from")
        return training_time(F.when(F.col("target") > 0, F.least(F.lit(1.0), place / F.col("target"))).otherwise(F.lit(0.0)), F.col("start"))

    last = F.ceil(taken / F.col("size")).cast("int") - 1
    return placed.select(
        F.col("_key").alias(key),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        taken.alias("taken"),
        F.when(taken > 0, time_of(F.lit(0))).alias("position"),
        F.when(taken > 0, F.transform(F.sequence(F.lit(0), last), time_of)).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def training_order(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, a row for each use of a document, range-sorted by the training position of that use.

    A document is used ``ceil(taken / size)`` times: the last use may be the one that the target cuts. Rows that repeat a
    key are used as often, and at the same positions, as the one with most uses.
    """
    own, m = docs.columns, fresh_mark(docs.columns)
    most = F.max(F.struct(F.size("positions"), -F.col("position"), "positions"))["positions"]
    used = mixed.filter(F.col("taken") > 0).groupBy(F.col(key).alias(f"{m}mixed_key")).agg(most.alias(f"{m}positions"))
    joined = docs.join(used, F.col(f"`{key}`").eqNullSafe(F.col(f"{m}mixed_key")))
    joined = joined.select(*(F.col(f"`{c}`") for c in own), F.posexplode(f"{m}positions").alias(f"{m}use", f"{m}position"))
    order = (f"{m}position", f"{m}use", F.col(f"`{key}`"))
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in own))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    order = (F.col("position").asc_nulls_last(), F.col("doc_id"))  # documents in the order of training; those that aren't used come last
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS total FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), v AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (
  SELECT source, source_size, k, CASE WHEN v.level IS NULL THEN cap ELSE least(cap, v.level * weight) END AS target FROM l, v
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, [1.5, 1.0, 0.5][t.k % 3 + 1]::DOUBLE AS start,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS words_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds FROM p
), r AS (
  SELECT *, (rounds * size + greatest(0, least(size, floor(target)::BIGINT - rounds * source_size - words_before)))::BIGINT AS taken,
         CASE WHEN target > 0 THEN least(1.0, words_before / target) ELSE 0.0 END AS f FROM q
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN start = 1 THEN f
         ELSE (sqrt(greatest(start * start + 4.0::DOUBLE * (1 - start) * f, 0.0)) - start) / (2.0::DOUBLE * (1 - start)) END END AS position
FROM r
"""
