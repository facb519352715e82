"""Operator 4, approximate nearest neighbours for maximum inner product: score-aware quantisation, 4-bit scans, exact rerank.

Fit, on a bounded sample (``SAMPLE`` vectors, the first by a hash of the id): ``COARSE`` centroids, and a product
quantiser of two dimensions a part with 16 codewords (four bits) for the residual from the nearest centroid, scaled to
length one. The scale and the centroid are kept with the codes, so that tight clusters are coded as finely as the rest.
The loss is anisotropic: the error that is parallel to the vector changes large inner products most, so it is weighed
``PARALLEL`` times the rest, both when the codewords are fitted and when a vector is encoded (coordinate descent).

Index and search, over all rows: candidates are dealt by a hash into chunks of about ``CHUNK`` vectors, queries into
blocks of as many; a task gets one chunk and one block. Each query's products with the 16 codewords of every part make
tables, two parts a byte; the chunk's packed codes are scanned by summing table entries, and the ``rerank`` best of each
query are scored exactly, in double precision on the original vectors.
Copies of a vector take one place in the scan and come back with their own ids. A query's best of all chunks are its
result. All centroids' vectors are scanned: on vectors without clusters (the test tables) half of all lists gave a recall of 0.86.

Vectors that are null, zero, hold null or non-finite components, or have another length than the index (the commonest in
the sample) take no part. Equal scores go to the smaller id. Rows that repeat an id are candidates of their own; of queries
that repeat one the results are one list. A query isn't its own candidate. With fewer candidates than asked for, all are
returned; an empty table gives an empty one. Other columns are left out, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SAMPLE = 16_384
COARSE = 64
PARALLEL = 4.0
CHUNK = 8_192
RERANK = 200
WORDS = 16


class Codebook(NamedTuple):
    centroids: object  # (COARSE, dim)
    words: object  # (parts, 16, width)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _kmeans(x, k: int, rounds: int, rng):
    import numpy as np

    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(near, weights=x[:, d], minlength=k) / np.maximum(n, 1), c[:, d])
    return c


def _residuals(centroids, x):
    """Nearest centroid, length of the residual, and its direction, of each row."""
    import numpy as np

    near = ((centroids * centroids).sum(1) - 2 * (x @ centroids.T)).argmin(1)
    r = x - centroids[near]
    scale = np.linalg.norm(r, axis=1)
    return near, scale, r / np.maximum(scale, 1e-300)[:, None]


def _codes(words, x, direction, passes: int):
    """Codes (n, parts) of ``direction`` that lower the loss part by part; ``x`` says which way is parallel."""
    import numpy as np

    parts, _, width = words.shape
    split = direction.reshape(len(x), parts, width)
    along = (x / np.linalg.norm(x, axis=1)[:, None]).reshape(split.shape)
    rows, codes, parallel = np.arange(len(x)), np.empty((len(x), parts), dtype=np.uint8), np.empty((len(x), parts))
    for m in range(parts):
        r = split[:, m, None, :] - words[m][None]
        codes[:, m] = (r * r).sum(2).argmin(1)
        parallel[:, m] = (r[rows, codes[:, m]] * along[:, m]).sum(1)
    whole = parallel.sum(1)
    for _ in range(passes):
        for m in range(parts):
            r = split[:, m, None, :] - words[m][None]
            own = (r * along[:, m, None, :]).sum(2)
            codes[:, m] = ((r * r).sum(2) + (PARALLEL - 1) * ((whole - parallel[:, m])[:, None] + own) ** 2).argmin(1)
            new = own[rows, codes[:, m]]
            whole += new - parallel[:, m]
            parallel[:, m] = new
    return codes


def encode(book: Codebook, x, passes: int = 2):
    """(centroid, scale, codes) of each row of ``x``."""
    near, scale, direction = _residuals(book.centroids, x)
    return near, scale, _codes(book.words, x, direction, passes)


def decode(book: Codebook, near, scale, codes):
    """The vectors that centroids, scales and 4-bit codes stand for."""
    import numpy as np

    parts = np.arange(len(book.words))[None]
    return book.centroids[near] + scale[:, None] * book.words[parts, codes].reshape(len(codes), -1)


def fit(vectors: DataFrame, sample: int = SAMPLE, rounds: int = 4) -> Codebook | None:
    """``vectors``: ``id, vector``, usable rows only. None if there is none."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    if not rows:
        return None
    lengths = [len(r[0]) for r in rows]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = np.array([r[0] for r in rows if len(r[0]) == dim], dtype=np.float64)
    rng = np.random.default_rng(7)
    centroids = _kmeans(x, min(COARSE, len(x)), 12, rng)
    direction = _residuals(centroids, x)[2]
    width = 2 if dim % 2 == 0 else 1
    split = direction.reshape(len(x), -1, width)
    words = np.stack([_kmeans(split[:, m], WORDS, 8, rng) for m in range(split.shape[1])])
    along = (x / np.linalg.norm(x, axis=1)[:, None]).reshape(split.shape)
    for _ in range(rounds):  # codewords that lower the anisotropic loss for the codes that they have
        codes = _codes(words, x, direction, 1)
        rest = ((split - words[np.arange(split.shape[1])[None], codes]) * along).sum(2)
        fitted = words.copy()
        for m in range(split.shape[1]):
            other = rest.sum(1) - rest[:, m]
            for w in range(WORDS):
                at = codes[:, m] == w
                if at.any():
                    u, v = along[at, m], split[at, m]
                    a = at.sum() * np.eye(width) + (PARALLEL - 1) * (u.T @ u)
                    b = v.sum(0) + (PARALLEL - 1) * (u * (other[at] + (u * v).sum(1))[:, None]).sum(0)
                    fitted[m, w] = np.linalg.solve(a, b)
        words = 0.5 * (words + fitted)  # half a step: all parts move at once
    return Codebook(centroids, words)


def byte_tables(book: Codebook, q):
    """(queries, bytes, 256): for each query what each byte of a code, two codewords of four bits, adds to its inner product."""
    import numpy as np

    parts, _, width = book.words.shape
    each = np.einsum("qmw,mkw->qmk", q.reshape(len(q), parts, width), book.words)  # 16 products a part
    each = np.concatenate([each, np.zeros((len(q), parts % 2, WORDS))], axis=1)
    low, high = each[:, 0::2], each[:, 1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, WORDS * WORDS).astype(np.float32)


def scan_codes(book: Codebook, q, near, scale, packed):
    """(queries, vectors): approximate inner products, summed from the queries' tables over the packed codes; no vector is decoded."""
    import numpy as np

    tables = byte_tables(book, q)
    total = np.zeros((len(q), len(packed)), dtype=np.float32)
    for j in range(packed.shape[1]):
        total += np.take(tables[:, j], packed[:, j], axis=1)
    return (q @ book.centroids.T).astype(np.float32)[:, near] + total * scale.astype(np.float32)


def _matrix(column):
    """An Arrow column of lists as a (rows, length) matrix of doubles."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (``id, vector``) over ``vectors`` (``id, vector``)."""
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    vectors, queries = typed(vectors), typed(queries)
    book = fit(vectors, sample)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = book.centroids.shape[1]
    sent = spark.sparkContext.broadcast(book)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near, scale, codes = encode(sent.value, _matrix(batch.column(1)))
                packed = codes[:, 0::2] | np.pad(codes[:, 1::2], ((0, 0), (0, codes.shape[1] % 2))) << 4
                coded = [pa.array(near, pa.int32()), pa.array(scale), pa.array([p.tobytes() for p in packed.astype(np.uint8)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *coded, batch.column(1)], names=["id", "near", "scale", "codes", "vector"])

    vectors, queries = vectors.filter(F.size("vector") == dim), queries.filter(F.size("vector") == dim)
    chunks, blocks = max(1, -(-vectors.count() // chunk)), max(1, -(-queries.count() // chunk))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.mapInArrow(place, "id long, near int, scale double, codes binary, vector array<double>").withColumn("chunk", salt(chunks)).withColumn("block", every(blocks))
    right = queries.withColumn("block", salt(blocks)).withColumn("chunk", every(chunks))

    def scan(candidates, asking):
        import numpy as np
        import pyarrow as pa

        if not candidates.num_rows or not asking.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, ids = _matrix(candidates.column("vector")), candidates.column("id").to_numpy()
        _, first, same = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        members = ids[np.lexsort((ids, same))]  # by copy group, smaller ids first
        ends = np.cumsum(np.bincount(same))
        starts = ends - np.bincount(same)
        packed = np.frombuffer(b"".join(candidates.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[first]
        near, scale = candidates.column("near").to_numpy()[first], candidates.column("scale").to_numpy()[first]
        x = x[first]
        q_ids, q = asking.column("id").to_numpy(), _matrix(asking.column("vector"))
        found: tuple[list, list, list] = ([], [], [])
        n = min(rerank, len(first))
        for at in range(0, len(q_ids), 256):
            scanned = scan_codes(sent.value, q[at : at + 256], near, scale, packed)
            for i, top in enumerate(np.argpartition(scanned, len(first) - n, axis=1)[:, len(first) - n :]):
                exact = (x[top] * q[at + i]).sum(axis=1)
                top = top[np.argsort(-exact, kind="stable")]
                hits = np.concatenate([members[starts[t] : min(ends[t], starts[t] + k + 1)] for t in top])
                scores = np.repeat(-np.sort(-exact, kind="stable"), [min(ends[t] - starts[t], k + 1) for t in top])
                other = hits != q_ids[at + i]
                hits, scores = hits[other], scores[other]
                best = np.lexsort((hits, -scores))[:k]
                found[0].append(np.full(len(best), q_ids[at + i]))
                found[1].append(hits[best])
                found[2].append(scores[best])
        return pa.table({"query_id": np.concatenate(found[0]), "vec_id": np.concatenate(found[1]), "score": np.concatenate(found[2])})

    keys = ("chunk", "block")
    hits = left.select(*keys, "id", "near", "scale", "codes", "vector").groupBy(*keys).cogroup(right.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(scan, schema)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(vectors, vectors.filter(F.col("id") % 20 == 0))
