"""Operator 10, LM scoring: stupid-backoff scores from n-gram counts over the whole corpus.

``S(w | u v) = c(u v w) / c(u v)`` if ``c(u v w) >= MIN_COUNT``, else ``BACKOFF * S(w | v)``, down to ``c(w) / N``. A
document's score is the sum of ln S over its words; the first words have shorter contexts.

The count tables are parted by n-gram hash and joined with the documents' n-grams in blocks, not row by row, because a
row for each (document, n-gram) would be five times the corpus. A chunk is about ``CHUNK_WORDS`` words of whole documents.

1. Chunks: word hashes of the documents, as an index into the chunk's distinct words; written once to the shared folder.
2. Each chunk sends its distinct n-grams and their counts to the buckets of their hashes (a row for each chunk and bucket
   that it has n-grams of). An n-gram comes once from a chunk, however frequent, so no bucket is hot.
3. A bucket sums the counts over all chunks and answers each chunk in the order of its question.
4. Words and pairs are asked for at once, then order by order. An n-gram (n >= 3) that holds an (n-1)-gram seen once in the
   corpus has been seen once itself, so it isn't asked for; that spares most of the shuffle.
5. A chunk joins the answers with its n-grams and sums over each document.

N-grams are known by a 60-bit hash of lower-cased words. Null and blank texts have 0 words and score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
CHUNK_WORDS = 1 << 21
BUCKET_WORDS = 1 << 20
BITS = 60


def _pack(values) -> bytes:
    """Non-negative whole numbers, by byte planes, compressed; small numbers in short arrays cost little."""
    import numpy as np
    import zstandard

    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _mixed(a, b):
    """A 60-bit hash of two hashes; order matters."""
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x >> np.uint64(64 - BITS)


def word_hashes(text: str | None) -> list[int]:
    from xxhash import xxh64_intdigest as h

    return [h(w) >> (64 - BITS) for w in text.lower().encode("utf-8", "surrogatepass").split()] if text else []


def ngrams(words, sizes, order: int):
    """For n = 1 .. order: (hashes of the n-grams, place of the last word of each); none spans two documents."""
    import numpy as np

    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, at = words, np.arange(len(words))
    yield hashes, at
    for n in range(2, order + 1):
        # hashes[i] is the n-1-gram that ends at at[i]; the next word of the same document makes it an n-gram
        fits = at + 1 < len(words)
        fits[fits] = start[at[fits] + 1] == start[at[fits]]
        hashes, at = _mixed(hashes[fits], words[at[fits] + 1]), at[fits] + 1
        yield hashes, at


def chunks_of(df: DataFrame, key: str, text: str, chunk_words: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        keys: list = []
        parts: list = []
        sizes: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            distinct, index = np.unique(flat, return_inverse=True)
            row = [
                pa.array([uuid.uuid4().hex]),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([_pack(np.array(sizes))], pa.binary()),
                pa.array([_pack(np.diff(distinct, prepend=np.uint64(0)))], pa.binary()),
                pa.array([_pack(index)], pa.binary()),
                pa.array([len(flat)], pa.int64()),
            ]
            for x in (keys, parts, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "keys", "sizes", "words", "index", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = word_hashes(t)
                keys.append(k)
                sizes.append(len(found))
                if found:
                    parts.append(np.array(found, dtype=np.uint64))
                held += len(found)
                if held >= chunk_words:
                    yield close()
                    held = 0
        if keys:
            yield close()

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "chunk string, keys array<long>, sizes binary, words binary, index binary, n long"), "lm-chunks")


def _open(row: dict):
    import numpy as np

    words = np.cumsum(_unpack(row["words"]), dtype=np.uint64)[_unpack(row["index"]).astype(np.int64)]
    return words, _unpack(row["sizes"]).astype(np.int64)


def _first_hash(bucket: int, buckets: int) -> int:
    return -(-(bucket << BITS // 2) // buckets) << BITS // 2


def _bucket_of(hashes, buckets: int):
    """Buckets are ranges of hashes, numbered in their order."""
    import numpy as np

    return (hashes >> np.uint64(BITS // 2)) * np.uint64(buckets) >> np.uint64(BITS // 2)


def looked_up(words, sizes, told: dict, order: int):
    """For n = 1 .. order: (places, the distinct n-grams to ask for, their counts here, corpus counts by place in ``told``).

    ``told[n]`` has the corpus counts of the n-grams asked for, in their order; the others' count is one.
    """
    import numpy as np

    seen = None
    for n, (hashes, at) in enumerate(ngrams(words, sizes, order), 1):
        asked = np.ones(len(at), dtype=bool) if n < 3 else (seen[at] > 1) & (seen[at - 1] > 1)
        distinct, same, own = np.unique(hashes[asked], return_inverse=True, return_counts=True)
        counts = seen = None
        if n in told:
            counts, seen = np.ones(len(at), dtype=np.uint64), np.ones(len(words), dtype=np.uint64)
            counts[asked] = told[n][same]
            seen[at] = counts
        yield at, distinct, own, counts


def _told(answers, done: int) -> dict:
    """Answers to one chunk, joined over the buckets, for n = 1 .. done."""
    import numpy as np

    parts: dict[int, list] = {n: [] for n in range(1, done + 1)}
    for r in sorted(answers.to_pylist(), key=lambda r: (r["n"], r["bucket"])):
        parts[r["n"]].append(_unpack(r["totals"]))
    return {n: np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for n, x in parts.items()}


def _questions(row: dict, told: dict, last: int, buckets: int):
    """Record batches of a chunk's n-grams and counts, for each n up to ``last`` that isn't in ``told``."""
    import numpy as np
    import pyarrow as pa

    words, sizes = _open(row)
    for n, (_, distinct, own, counts) in enumerate(looked_up(words, sizes, told, last), 1):
        if counts is not None:
            continue
        bucket = _bucket_of(distinct, buckets)
        starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        used, parts = bucket[starts].tolist(), [slice(a, b) for a, b in zip(starts, [*starts[1:], len(distinct)])]
        columns = [
            pa.array([row["chunk"]] * len(used), pa.string()),
            pa.array([n] * len(used), pa.int32()),
            pa.array(used, pa.int32()),
            pa.array([_pack(np.diff(distinct[p], prepend=np.uint64(_first_hash(b, buckets)))) for b, p in zip(used, parts)], pa.binary()),
            pa.array([_pack(own[p]) for p in parts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n", "bucket", "hashes", "counts"])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``key, n_words, log_score`` (sum of ln S) ``, mean_log_score`` (null without words): one row an input row."""
    chunks = chunks_of(df, key, text, chunk_words)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_words))

    question = "chunk string, n int, bucket int, hashes binary, counts binary"

    def ask(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _questions(batch.slice(i, 1).to_pylist()[0], {}, min(order, 2), buckets)

    def ask_next(n: int):
        def run(chunk, answers):
            import pyarrow as pa

            told = _told(answers, n - 1)
            return pa.Table.from_batches([x for row in chunk.to_pylist() for x in _questions(row, told, n, buckets)])

        return run

    def answer(asked):
        import numpy as np
        import pyarrow as pa

        rows = asked.to_pylist()
        hashes = [np.cumsum(_unpack(r["hashes"]), dtype=np.uint64) + np.uint64(_first_hash(r["bucket"], buckets)) for r in rows]
        distinct, same = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(same, weights=np.concatenate([_unpack(r["counts"]) for r in rows]), minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(h) for h in hashes])
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.string()),
                "n": pa.array([r["n"] for r in rows], pa.int32()),
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "totals": pa.array([_pack(counts[same[e - len(h) : e]]) for e, h in zip(ends, hashes)], pa.binary()),
            }
        )

    def answered(asked: DataFrame) -> DataFrame:
        return written(asked.groupBy("n", "bucket").applyInArrow(answer, "chunk string, n int, bucket int, totals binary"), "lm-counts")

    def join(chunk, answers):
        import numpy as np
        import pyarrow as pa

        keys: list = []
        out: list = [[], []]
        told = _told(answers, order)
        for row in chunk.to_pylist():
            words, sizes = _open(row)
            s = context = None
            for n, (at, _, _, counts) in enumerate(looked_up(words, sizes, told, order), 1):
                counts = counts.astype(np.float64)
                if n == 1:
                    s = np.log(counts / total)
                else:  # c(context) is the count of the shorter n-gram that ends a word before
                    ratio = np.log(counts) - np.log(context[at - 1])
                    s[at] = np.where(counts >= min_count, ratio, s[at] + math.log(backoff))
                context = np.ones(len(words))
                context[at] = counts
            keys.extend(row["keys"])
            out[0].append(sizes)
            out[1].append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=s, minlength=len(sizes)) if len(words) else np.zeros(len(sizes)))
        sums = np.concatenate(out[1]) if out[1] else np.zeros(0)
        return pa.table({"key": pa.array(keys, pa.int64()), "n_words": pa.array(np.concatenate(out[0]) if out[0] else [], pa.int64()), "log_score": pa.array(sums, pa.float64())})

    plain = chunks.select("chunk", "sizes", "words", "index")
    answers = answered(plain.mapInArrow(ask, question))
    for n in range(3, order + 1):
        asked = plain.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_next(n), question)
        answers = answers.unionAll(answered(asked))
    scored = chunks.select("chunk", "sizes", "words", "index", "keys").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, "key long, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("key").alias(key), "n_words", "log_score", mean.alias("mean_log_score"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
