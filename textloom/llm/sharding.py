"""Operator 1, sharding [native]: rows are placed on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, ``offset + j * skip (mod size)``.
Shards take turns; in its turn a shard claims the first free slot of its permutation. The filled table
has ``size`` rows whatever the data, so it is broadcast, and a row is placed by one hash lookup:
``slot = hash(key) mod size``. Slot counts of two shards differ by one at most; when a shard leaves,
almost all keys of the others stay where they were.

The fill is one ``aggregate`` over the turns, inside Spark; there is no Python in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Prime; about 128 slots for each of 16 shards, so that no shard has over 0.8 % more slots than another.
TABLE_SIZE = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def hash60(value: Column) -> Column:
    """60 bits of the MD5 of a value as text; a null hashes as the empty text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Rows ``slot, shard``: the table that the shards fill in turns. ``size`` must be a prime over the number of shards."""
    names = list(dict.fromkeys(shards))
    if not names:
        raise ValueError("at least one shard is needed")
    if size <= len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime over the number of shards")
    n = len(names)
    shard, at, skip = F.element_at(F.array(*map(F.lit, names)), F.col("id").cast("int") + 1), F.col("at"), F.col("skip")
    permutations = (
        spark.range(n)
        .select("id", hash60(F.concat(shard, F.lit(":offset"))).alias("at"), hash60(F.concat(shard, F.lit(":skip"))).alias("skip"))
        .select("id", (at % size).alias("at"), (skip % (size - 1) + 1).alias("skip"))
        .select("id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"), "at", "skip")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("j", ((at + F.col("j") * skip) % size).alias("slot"))))["slot"].alias("slots"))
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("id", "slots")))["slots"].alias("permutations"))
    )
    claims = F.aggregate(  # the slots in the order in which they are claimed
        F.sequence(F.lit(0), F.lit(size - 1)),
        F.array().cast("array<bigint>"),
        lambda claimed, turn: F.array_append(claimed, F.array_except(F.col("permutations")[turn % n], claimed)[0]),
    )
    return (
        permutations.select(claims.alias("claims"))
        .select(F.posexplode("claims").alias("turn", "slot"))
        .select("slot", F.array(*map(F.lit, names))[F.col("turn") % n].alias("shard"))
    )


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row; nothing is shuffled.

    Null keys are placed as the empty text. Equal keys go to the same shard. Columns of the input with these
    two names are replaced. An empty table stays empty.
    """
    placed = df.drop("slot", "shard").withColumn("slot", hash60(F.col(f"`{key}`")) % size)
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, size)), "slot", "left").select(
        *[F.col(f"`{c}`") for c in placed.columns if c != "slot"], "slot", "shard"
    )


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write one folder for each shard; ``files_per_shard`` salts the exchange so that a shard isn't one task."""
    placed = assign_shards(df, key, shards, size)
    salt = (hash60(F.concat(F.lit("file:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))) % files_per_shard).alias("salt")
    placed.repartition(len(set(shards)) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id").select("doc_id", "slot", "shard")


_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
OP1_SQL = f"""
WITH RECURSIVE names AS (
  SELECT list_transform(range(0, {len(SHARDS)}), lambda i: 'shard-' || lpad(i::VARCHAR, 2, '0')) AS n
), pref AS (
  SELECT n, list_transform(n, lambda s: {_H.format("s || ':offset'")} % {TABLE_SIZE}) AS o,
         list_transform(n, lambda s: {_H.format("s || ':skip'")} % {TABLE_SIZE - 1} + 1) AS k FROM names
), fill(turn, owners) AS (
  SELECT 0, list_transform(range(0, {TABLE_SIZE}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(owners, lambda x, i: CASE WHEN i - 1 = free THEN turn % {len(SHARDS)} ELSE x END)
  FROM (SELECT turn, owners,
          list_filter(list_transform(range(0, {TABLE_SIZE}), lambda j: (o[turn % {len(SHARDS)} + 1] + j * k[turn % {len(SHARDS)} + 1]) % {TABLE_SIZE}),
                      lambda s: owners[s + 1] < 0)[1] AS free
        FROM fill, pref WHERE turn < {TABLE_SIZE})
)
SELECT doc_id, {_H.format("doc_id::VARCHAR")} % {TABLE_SIZE} AS slot,
       n[owners[{_H.format("doc_id::VARCHAR")} % {TABLE_SIZE} + 1] + 1] AS shard
FROM documents, pref, (SELECT owners FROM fill WHERE turn = {TABLE_SIZE})
"""
