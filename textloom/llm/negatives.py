"""Operator 12, hard-negative mining by bit-sliced integer products.

Vectors are integers, ``floor(scale * x)`` a component. The index holds each as bit-planes (two's complement): plane j has
bit j of every component. A score is the sum of an anchor's products with the planes, each times its power of two (the
sign's plane negative). ``_scan`` takes the planes most significant first. After each one a score is known to an interval:
what the planes so far add up to, plus at least the sum of the anchor's negative components and at most that of its positive
ones, times the highest value of the bits to come. A candidate is dropped once its interval shows that it can't be among the
best: for the positives if it ends under the fifth best lower bound, for the negatives if it misses every positive's window or
ends under the fifth best lower bound of those that are surely inside it. What is left at the last plane is exact.

All rows are candidates. They are dealt by a hash of the id into chunks of about ``CHUNK`` rows, anchors into blocks of
``BLOCK``; a task gets one chunk and one block, and returns the few best of each anchor, which are ranked together. So neither a
common label nor a common vector gathers in one task, no list of pairs is made, and memory is bounded by a chunk.

Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those with an integer over
2^26, as scores must fit a long. Vectors of different lengths have no product and don't meet. A row with an anchor's id is no
candidate of it; anchors that repeat an id count once (the smallest label and vector), candidates that repeat one count each.
Ties go to the smaller id. A positive under zero has an empty window. An empty table gives an empty one; other columns are
left out, whatever they are called. Zero vectors take part, with scores of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CHUNK, BLOCK = 8_192, 2_048
MOST = 1 << 26
#: Anchors that are multiplied at once, and the leading planes for which that is done: hardly a candidate is dropped there.
TOGETHER, LEADING = 64, 5
POSITIVE = "anchor_id long, vec_id long, score long"
NEGATIVE = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vector: Column) -> Column:
    """All components are there, finite, and small enough once scaled."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (x.cast("double") > float("-inf")) & (x.cast("double") < float("inf"))), F.lit(False))


def _sliced(bits: int):
    """``mapInArrow``: a row's integers as bit-planes, most significant first, each plane packed to whole bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            planes = []
            for row in batch.column(batch.num_columns - 1).to_pylist():
                whole = np.array(row, dtype=np.int64)
                planes.append(b"".join(np.packbits(((whole >> j) & 1).astype(np.uint8)).tobytes() for j in range(bits - 1, -1, -1)))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(planes, pa.binary())], names=["id", "label", "dim", "chunk", "planes"])

    return run


def _planes(packed, dim: int, bits: int, dtype):
    """(bits, rows, dim) of zeros and ones."""
    import numpy as np

    width = -(-dim // 8)
    rows = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), bits, width)
    return np.unpackbits(rows, axis=2)[:, :, :dim].transpose(1, 0, 2).astype(dtype)


def _weights(bits: int) -> list[int]:
    return [-(1 << (bits - 1)), *(1 << j for j in range(bits - 2, -1, -1))]


def _nth_largest(values, n: int):
    """The n-th largest value; below all numbers if there are fewer."""
    import numpy as np

    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def _refined(planes, leading, vector, alive, drop):
    """Those of ``alive`` that ``drop`` never drops, and their exact products with ``vector``.

    ``leading``: the products of the first planes with all rows. ``drop(low, high)``: which can't qualify, by their intervals.
    """
    import numpy as np

    below, above = int(vector[vector < 0].sum()), int(vector[vector > 0].sum())
    bits, so_far = len(planes), np.zeros(len(alive), dtype=planes.dtype)
    for j, weight in enumerate(_weights(bits)):
        so_far = so_far + weight * (leading[j][alive] if j < len(leading) else planes[j][alive] @ vector)
        rest = (1 << (bits - 1 - j)) - 1
        stays = ~drop(so_far + rest * below, so_far + rest * above)
        alive, so_far = alive[stays], so_far[stays]
    return alive, so_far


def _exact_type(dim: int, largest: int, bits: int):
    """The fastest type in which every sum and bound is exact."""
    import numpy as np

    most = 2 * max(dim, 1) * max(largest, 1) << bits
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _scan(bits: int, search, names: list[str]):
    """For ``cogroup``: ``search(candidates' ids and labels, an anchor, refine)`` for each anchor of a block against a chunk.

    ``refine(chosen, drop)`` gives the exact scores of the chosen candidates that are left.
    """

    def run(candidates, anchors):
        import numpy as np
        import pyarrow as pa

        found: list[tuple] = []
        if candidates.num_rows and anchors.num_rows:
            dim, rows = candidates.column("dim")[0].as_py(), anchors.to_pylist()
            kind = _exact_type(dim, max((abs(x) for r in rows for x in r["vector"]), default=0), bits)
            planes = _planes(candidates.column("planes").to_pylist(), dim, bits, kind)
            ids, labels = candidates.column("id").to_numpy(), candidates.column("label").to_numpy()
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                vectors = np.array([r["vector"] for r in some], dtype=kind).reshape(len(some), dim)
                leading = [vectors @ planes[j].T for j in range(min(LEADING, bits))]
                for i, row in enumerate(some):
                    found += search(ids, labels, row, lambda alive, drop, i=i: _refined(planes, [p[i] for p in leading], vectors[i], alive, drop))  # noqa: B023
        return pa.table({name: pa.array([row[i] for row in found], pa.int32() if name == "place" else pa.int64()) for i, name in enumerate(names)})

    return run


def _positives(n: int):
    """The n best rows of the anchor's label."""

    def search(ids, labels, anchor, refine):
        import numpy as np

        same = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]))
        alive, scores = refine(same, lambda low, high: high < _nth_largest(low, n))
        return [(anchor["id"], int(ids[alive[i]]), int(scores[i])) for i in np.lexsort((ids[alive], -scores))[:n]]

    return search


def _negatives(n: int, share: int):
    """For each positive the n best rows of other labels from ``share`` percent of its score up to its score."""

    def search(ids, labels, anchor, refine):
        import numpy as np

        windows = [(p, -(-share * p["score"] // 100), p["score"]) for p in anchor["positives"] if p["score"] >= 0]

        def drop(low, high):
            stays = np.zeros(len(low), dtype=bool)
            for _, least, most in windows:
                inside = (low >= least) & (high <= most)
                stays |= (high >= max(least, _nth_largest(low[inside], n))) & (low <= most)
            return ~stays

        found = []
        alive, scores = refine(np.flatnonzero(labels != anchor["label"]), drop)
        for positive, least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for i in inside[np.lexsort((ids[alive[inside]], -scores[inside]))[:n]]:
                found.append((anchor["id"], positive["place"], positive["id"], positive["score"], int(ids[alive[i]]), int(scores[i])))
        return found

    return search


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``RESULT`` for the rows of ``rows`` (``id, label, vector``) that meet ``anchors``, a condition on ``id`` and ``label``."""
    spark = rows.sparkSession
    typed = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = typed.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    whole = whole.withColumn("vector", integers(F.col("vector"), scale)).withColumn("largest", F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0)))
    whole = whole.filter(F.col("largest") <= MOST).withColumn("dim", F.size("vector"))
    n, asked, largest = whole.agg(F.count("*"), F.count_if("anchor"), F.max("largest")).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    bits, chunks, blocks = int(largest).bit_length() + 1, -(-n // chunk), -(-asked // block)
    salted = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    index = written(whole.select("id", "label", "dim", salted(chunks).alias("chunk"), "vector").mapInArrow(_sliced(bits), "id long, label long, dim int, chunk int, planes binary"), "bit-slices")
    asking = whole.filter("anchor").groupBy("id").agg(F.min_by(F.struct("label", "dim", "vector"), F.struct("label", "vector")).alias("row")).select("id", "row.*")
    asking = written(asking.withColumn("block", salted(blocks)), "anchors")
    keys = ("dim", "chunk", "block")

    def scanned(anchors: DataFrame, search, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        left, right = index.withColumn("block", every(blocks)), anchors.withColumn("chunk", every(chunks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(bits, search, names), schema)

    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = scanned(asking, _positives(positives), POSITIVE).withColumn("place", place).filter(F.col("place") <= positives)
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("place", F.col("vec_id").alias("id"), "score")).alias("positives"))  # ``positives`` at most
    found = scanned(asking.join(best, F.col("id") == F.col("anchor_id")).drop("anchor_id"), _negatives(negatives, share), NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select([c.split()[0] for c in RESULT.split(", ")])


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH whole AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.id AS a, c.id AS c, a.label = c.label AS same, CAST(list_sum(list_transform(a.v, lambda x, i: x * c.v[i])) AS BIGINT) AS s
    FROM whole a JOIN whole c ON a.id % 100 = 0 AND a.id <> c.id),
positives AS (SELECT a, c AS p, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.c) AS INTEGER) AS rank,
       n.c AS negative_id, p.ps AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON p.a = n.a AND NOT n.same AND 80 * p.ps <= 100 * n.s AND 100 * n.s <= 100 * p.ps
QUALIFY rank <= 5
"""
