"""Operator 8, SimHash near-dedup: fingerprints joined with themselves by a pairwise descent of a binary trie.

Fingerprints are made in Arrow batches. Equal fingerprints are one leaf, held by its smallest document id, so a group of
exact copies costs one row. ``trie_join`` walks pairs of trie nodes level by level: a pair (a, b, differing bits) is
joined with the children of ``a``, meets those children of ``b`` whose new bits differ in no more than what is left of
the error budget, and is dropped as soon as the budget is exceeded. A node with one leaf is compared in full at once.
A node has at most 2**step children, so no join key is hot. Every level is written to the shared folder.

Components are found by alternating large-star and small-star steps on the links, with reliable checkpoints.

Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id are the same document.
Keys must be whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, written

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: MinHash values of a text's shingles.
HUBS = 4
#: Shingles that are hashed at once; bounds memory in very long texts.
BLOCK = 1 << 20


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of a text: ``words`` words, A-Z lower-cased, joined by a space; repeats included."""
    from xxhash import xxh64_intdigest as h

    w = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if len(w) <= words:
        return [h(b" ".join(w), SEED)] if w else []
    return [h(b" ".join(g), SEED) for g in zip(*(w[i:] for i in range(words)))]


def _bit_counts(hashes, owner, n: int, lanes: int):
    """For each of n documents and each of 64 * lanes bits, in how many of its hashes the bit is set."""
    import numpy as np

    counts = np.zeros((n, 64 * lanes), dtype=np.int64)
    bits = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
    base = owner.astype(np.int64) * 256
    for lane in range(lanes):
        if lane:  # another 64 bits from the same hash: a multiply-xorshift mix with an odd constant of the lane's own
            x = hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 1)) & (2**64 - 1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        else:
            x = hashes
        octets = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(base + octets[:, k], minlength=n * 256).reshape(n, 256)
            counts[:, 64 * lane + 8 * k : 64 * lane + 8 * k + 8] += (seen @ bits).astype(np.int64)
    return counts


def _batch_fingerprints(texts: Sequence[str | None], words: int, lanes: int, hashed: Callable = shingle_hashes):
    """(len(texts), lanes) unsigned words; a bit is one if it is set in over half of the text's hashes, as ``hashed`` gives them."""
    import numpy as np

    out = np.zeros((len(texts), lanes), dtype=np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def close(first: int, lists: list) -> None:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        total = np.zeros((len(lists), 64 * lanes), dtype=np.int64)
        flat = np.fromiter((h for x in lists for h in x), dtype=np.uint64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(lists)), sizes)
        for at in range(0, len(flat), BLOCK):
            total += _bit_counts(flat[at : at + BLOCK], owner[at : at + BLOCK], len(lists), lanes)
        majority = 2 * total > sizes[:, None]
        out[first : first + len(lists)] = (majority.reshape(len(lists), lanes, 64) * powers).sum(axis=2, dtype=np.uint64)

    lists, held, first = [], 0, 0
    for i, text in enumerate(texts):
        lists.append(hashed(text, words))
        held += len(lists[-1])
        if held >= BLOCK // 8 or len(lists) >= 256:
            close(first, lists)
            lists, held, first = [], 0, i + 1
    if lists:
        close(first, lists)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """``key, f0 .. f<lanes-1>``: 64 fingerprint bits in each lane, as signed longs."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = _batch_fingerprints(batch.column(1).to_pylist(), words, lanes).view("int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, i]) for i in range(lanes))], names=[key, *names])

    rows = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, " + ", ".join(f"{n} long" for n in names))


def shingle_set(text: str | None, words: int) -> list[int]:
    """The distinct hashes of a text's shingles, ascending."""
    return sorted(set(shingle_hashes(text, words)))


def _digest(shingles) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), SEED)


def _marked_sets(df: DataFrame, key: str, text: str, words: int, lanes: int) -> DataFrame:
    """``key, digest, size, hubs, f0 ..``: digest, size, least hashes in four orders (none of an empty set) and fingerprint of each text's
    set of distinct shingles."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            digests, sizes, hubs = [], [], []

            def hashed(t: str | None, n: int) -> list[int]:
                found = shingle_set(t, n)
                own = np.array(found, dtype=np.uint64)
                mixed = own * np.uint64(0x9E3779B97F4A7C15)
                digests.append(_digest(own))  # noqa: B023
                hubs.append([x.astype(np.int64) for x in (own[0], own[-1], mixed.min(), mixed.max())] if found else [])  # noqa: B023
                sizes.append(len(found))  # noqa: B023
                return found

            made = _batch_fingerprints(batch.column(1).to_pylist(), words, lanes, hashed).view("int64")
            columns = [pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(hubs, pa.list_(pa.int64())), *(pa.array(made[:, i]) for i in range(lanes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "digest", "size", "hubs", *names])

    rows = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, digest long, size long, hubs array<long>, " + ", ".join(f"{n} long" for n in names))


def _digested(rows: DataFrame, words: int) -> DataFrame:
    """``digest, shingles``: the set of each text of the rows ``key, text``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(lists: list) -> pa.RecordBatch:
            starts = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            digests = pa.array(np.array([_digest(x) for x in lists], dtype=np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([digests, pa.ListArray.from_arrays(starts, pa.array(np.concatenate(lists).view(np.int64)))], names=["digest", "shingles"])

        for batch in batches:
            lists, held = [], 0
            for t in batch.column(1).to_pylist():
                lists.append(np.array(shingle_set(t, words), dtype=np.uint64))
                held += len(lists[-1])
                if held >= BLOCK // 4:
                    yield out(lists)
                    lists, held = [], 0
            if lists:
                yield out(lists)

    return rows.mapInArrow(run, "digest long, shingles array<long>")


def _prefix(code: Column, bits: int, depth: int) -> Column:
    """The first ``depth`` of a code's ``bits`` bits."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(code, bits - depth)


def _masks(bits: int, most: int) -> list[int]:
    """All ``bits``-bit words with at most ``most`` ones."""
    found = {0}
    for _ in range(most):
        found |= {m | 1 << i for m in found for i in range(bits)}
    return sorted(found)


def trie_join(leaves: DataFrame, bits: int, budget: int, depths: Sequence[int], start: int = 0) -> DataFrame:
    """Pairs ``a < b`` (unsigned order) of codes that agree in their first ``start`` bits and differ in at most ``budget`` bits.

    ``leaves`` has one row for each distinct ``code`` (long, ``bits`` bits). ``depths`` are the levels that are visited,
    ascending, the last being ``bits``.
    """

    def children(upper: int, lower: int) -> DataFrame:
        """Nodes at depth ``lower``: their parent at ``upper``, how many leaves they hold and, for one leaf, that leaf."""
        return leaves.groupBy(_prefix(F.col("code"), bits, upper).alias("parent"), _prefix(F.col("code"), bits, lower).alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.min("code").alias("leaf")
        )

    roots = leaves.select(_prefix(F.col("code"), bits, start).alias("a")).distinct()
    frontier = roots.select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    found, upper = [], start
    for lower in depths:
        step = lower - upper
        masks = F.array(*(F.array(*(F.lit(m).cast("long") for m in _masks(step, left))) for left in range(budget + 1)))
        nodes = children(upper, lower)
        left = nodes.select(F.col("parent").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"), F.col("leaf").alias("la"))
        low = F.lit((1 << step) - 1).cast("long")
        met = (
            frontier.join(left, "a")
            .withColumn("m", F.explode(F.element_at(masks, budget - F.col("d") + 1)))
            .select("a", "b", F.col("d") + F.bit_count("m"), "ca", "na", "la", F.shiftleft("b", step).bitwiseOR(F.col("ca").bitwiseAND(low).bitwiseXOR(F.col("m"))))
            .toDF("a", "b", "d", "ca", "na", "la", "cb")
            .filter((F.col("a") != F.col("b")) | _unsigned_less("ca", "cb") | ((F.col("ca") == F.col("cb")) & (F.col("na") > 1)))
            .drop("a", "b")
        )
        right = nodes.select(F.col("node").alias("cb"), F.col("n").alias("nb"), F.col("leaf").alias("lb"))
        single = (F.col("na") == 1) & (F.col("nb") == 1)
        level = written(met.join(right, "cb").filter(~single | (F.bit_count(F.col("la").bitwiseXOR(F.col("lb"))) <= budget)), "trie")
        found.append(level.filter(single).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        frontier, upper = level.filter(~single).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "d"), lower
        if frontier.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    return links


def _unsigned_less(a: str, b: str) -> Column:
    flip = F.lit(-(2**63)).cast("long")
    return F.col(a).bitwiseXOR(flip) < F.col(b).bitwiseXOR(flip)


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``v, component``: for every endpoint of the links ``u, v`` (longs), the smallest endpoint that it reaches.

    Large-star and small-star steps; each is a minimum by key and a join back, so no neighbour list is gathered.
    """
    u, v = F.col("u"), F.col("v")
    edges = checkpointed(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u != v).distinct())
    sign = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(edges)
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(v.alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter(u != v).distinct())
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components didn't settle")
    own = edges.select(u.alias("v"), v.alias("component"))
    return own.unionAll(edges.select("v", F.col("v").alias("component")).distinct())


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """``key, fingerprint`` (16 hex digits)``, component_id`` (smallest id reachable by links of ``budget`` bits or fewer), one row an input row."""
    marked = written(fingerprints(df, key, text, words), "simhash")
    leaves = written(marked.groupBy(F.col("f0").alias("code")).agg(F.min(key).alias("leaf")), "leaves")
    links = trie_join(leaves.select("code"), 64, budget, (12, 24, 36, 48, 64))
    by_id = links.join(leaves.toDF("a", "u"), "a").join(leaves.toDF("b", "v"), "b").select("u", "v")
    parts = connected_components(by_id).toDF("leaf", "component")
    classes = leaves.join(parts, "leaf", "left").select("code", F.coalesce("component", "leaf").alias("component_id"))
    return marked.join(classes, F.col("f0") == F.col("code")).select(key, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _meeting(k, leaf, size, part, prints, segments: int, bits: int, budget: int, most: int, least: float, chunk: int = 1 << 20) -> Iterator:
    """Pairs of leaves within the rows of some keys that meet, as arrays ``u < v``; each pair only in its first segment.

    A row's key ``k`` is (segment, part) above the code's bits of that part. All rows of a code are paired with each other
    and with all rows of the codes that differ in at most ``budget`` bits outside the part, ``chunk`` pairs at a time; rows of the
    same ``part`` aren't, and take no time.
    """
    import numpy as np

    def code(f, i: int):
        lane, at = divmod(i * bits, 64)
        value = f[:, lane] >> np.uint64(at)
        if at + bits > 64:
            value = value | f[:, lane + 1] << np.uint64(64 - at)
        return value & np.uint64((1 << bits) - 1)

    edges = [i * bits // (budget + 1) for i in range(budget + 2)]
    parts = [(1 << edges[p + 1]) - (1 << edges[p]) for p in range(budget + 1)]
    for group in np.unique(k >> bits):
        i, p = divmod(int(group), budget + 1)
        at = np.flatnonzero(k >> bits == group)
        codes = code(prints[at], i).astype(np.int64)
        rank = np.unique(part[at], return_inverse=True)[1]
        width = int(rank.max()) + 1
        order = np.argsort(codes * width + rank, kind="stable")
        codes, rank, own, large, f = codes[order], rank[order], leaf[at][order], size[at][order], prints[at][order]
        runs = codes * width + rank
        known, first, sizes = np.unique(codes, return_index=True, return_counts=True)
        for m in _masks(bits, budget):
            if m & parts[p] or not all(m & parts[q] for q in range(p)):
                continue  # the part agrees, and no part before it does
            if m:
                found = np.minimum(np.searchsorted(known, known ^ m), len(known) - 1)
                hit = np.flatnonzero((known[found] == known ^ m) & (known < known ^ m))
                rows = np.repeat(first[hit] - np.cumsum(sizes[hit]) + sizes[hit], sizes[hit]) + np.arange(sizes[hit].sum())
                starts = np.repeat(first[found[hit]], sizes[hit])
                stops = starts + np.repeat(sizes[found[hit]], sizes[hit])
                same = (codes[rows] ^ m) * width + rank[rows]
                before, after = np.searchsorted(runs, same), np.searchsorted(runs, same, "right")
                rows, starts, counts = np.tile(rows, 2), np.concatenate([starts, after]), np.concatenate([before - starts, stops - after])
            else:
                rows = np.arange(len(codes))
                starts = np.searchsorted(runs, runs, "right")
                counts = np.repeat(first + sizes, sizes) - starts
            ends = np.cumsum(counts)
            done = 0
            while done < len(rows):
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + chunk, "right")))
                n = counts[done:to]
                x = np.repeat(rows[done:to], n)
                y = np.repeat(starts[done:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
                done = to
                alike = np.minimum(large[x], large[y]) >= least * np.maximum(large[x], large[y])
                x, y = x[alike], y[alike]
                differing = sum(np.bitwise_count(f[x, j] ^ f[y, j]).astype(np.int32) for j in range(f.shape[1]))
                near = differing <= most
                x, y = x[near], y[near]
                earlier = np.zeros(len(x), bool)
                for j in range(i):
                    earlier |= np.bitwise_count(code(f[x] ^ f[y], j)) <= budget
                u, v = own[x[~earlier]], own[y[~earlier]]
                if len(u):
                    yield np.minimum(u, v), np.maximum(u, v)


def meeting_pairs(leaves: DataFrame, segments: int, bits: int, budget: int, most: int, least: float = 0.0, rows_per_task: int = 500_000) -> DataFrame:
    """``u, v``: all pairs of leaves that differ in at most ``budget`` bits in any segment and ``most`` bits in all.

    ``leaves`` has ``leaf, f0, f1, ..``, and may have ``size``: then the smaller size must be ``least`` times the larger.
    It may have ``part`` (long): pairs of the same part are left out, and aren't made. Codes that differ in ``budget`` bits agree on one of ``budget + 1`` parts, so a leaf
    goes once to each part of each segment, and the pairs of a part's value are judged in the task that holds them: none is
    left out, and only those that pass are rows. Judged pairs of unrelated texts grow with the square of the leaves, as
    segments * leaves^2 / 2 times the share of codes within the budget (20 bits, one bit: 1 in 50,000).
    """
    import math

    names = [c for c in leaves.columns if c not in ("leaf", "size", "part")]
    part = F.col("part") if "part" in leaves.columns else F.col("leaf").alias("part")
    size = F.col("size") if "size" in leaves.columns else F.lit(1).cast("long").alias("size")
    edges = [i * bits // (budget + 1) for i in range(budget + 2)]

    def key(i: int, p: int) -> Column:
        lane, at = divmod(i * bits, 64)
        value = F.shiftrightunsigned(F.col(names[lane]), at)
        if at + bits > 64:
            value = value.bitwiseOR(F.shiftleft(F.col(names[lane + 1]), 64 - at))
        part = F.lit((1 << edges[p + 1]) - (1 << edges[p])).cast("long")
        return value.bitwiseAND(part).bitwiseOR(F.lit((i * (budget + 1) + p) << bits).cast("long"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        batches = list(batches)
        if batches:
            held = pa.Table.from_batches(batches)
            k, leaf, size, part, *prints = (held.column(i).to_numpy() for i in range(held.num_columns))
            for u, v in _meeting(k, leaf, size, part, np.stack(prints, 1).view(np.uint64), segments, bits, budget, most, least):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    keys = F.explode(F.array(*(key(i, p) for i in range(segments) for p in range(budget + 1)))).alias("k")
    tasks = max(leaves.sparkSession.sparkContext.defaultParallelism, math.ceil(leaves.count() * segments * (budget + 1) / rows_per_task))
    return leaves.select(keys, "leaf", size, part, *names).repartition(tasks, "k").mapInArrow(run, "u long, v long")


def _star_pairs(leaves: DataFrame, names: Sequence[str], most: int, least: float) -> DataFrame:
    """``u, v``: each leaf with one that has the same value among its ``hubs`` or the same two of them, if their sizes and bits may do.

    The one is the first by a hash that differs between the values: near copies share most values, and would meet a single text otherwise,
    which many of them may not be similar to.
    """
    twos = [F.xxhash64(F.get("hubs", F.lit(i)), F.get("hubs", F.lit(j))) for i, j in combinations(range(HUBS), 2)]
    values = F.when(F.size("hubs") == HUBS, F.concat("hubs", F.array(*twos))).otherwise(F.col("hubs"))
    rows = leaves.select("digest", "size", *names, F.posexplode(values).alias("order", "value"))
    first = rows.groupBy("order", "value").agg(F.min(F.struct(F.xxhash64("digest", "order").alias("rank"), "digest", "size", *names)).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hub = lambda c: F.col("hub").getField(c)
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(hub(c))) for c in names), F.lit(0))
    near = rows.join(first, ["order", "value"]).filter(F.col("digest") != hub("digest")).filter(bits <= most)
    near = near.filter(F.least("size", hub("size")) >= F.lit(least) * F.greatest("size", hub("size")))
    return near.select(F.least("digest", hub("digest")).alias("u"), F.greatest("digest", hub("digest")).alias("v")).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, segment_bits: int = 20, lanes: int = 7, budget: int = 1
) -> DataFrame:
    """``key, component_id``: classes of texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Candidates come from SimHash, made of each text's distinct shingles. At a similarity of 0.8 about 15 % of the bits of two
    fingerprints differ, too many for one 64-bit word. So fingerprints have 64 * ``lanes`` bits, cut into segments of
    ``segment_bits``, and every pair that differs in at most ``budget`` bits in any segment is a candidate if all bits differ
    by no more than such a pair's share and four standard deviations. With 22 segments of 20 bits and one bit, 98 % of the
    pairs at exactly 0.8 meet, and 99.7 % at 0.85, whatever the size of the corpus; of texts with under ten shingles fewer
    (87 % of four shingles against five), as ties are a large part of their bits.

    Candidates are then checked on the two sets of shingles (64-bit hashes), so no pair under ``similarity`` is linked.

    Before that, each text meets one other for each of four MinHash values and each two of them, another one for each if there are
    several. What these stars link, after the same check, is one part, inside which no pair is made any more: near copies that are
    linked so cost about 10n rows, not n squared. Only pairs of different parts go on to the SimHash candidates, so no class is lost.
    """
    import math

    cosine = 2 * similarity / (1 + similarity)
    total = 64 * lanes
    share = max(math.acos(cosine) / math.pi, 3 / 16)  # four shingles against five: 3/8 of the bits are ties, half of them broken
    most = int(total * (share + 4 * math.sqrt(share * (1 - share) / total)))
    names = [f"f{i}" for i in range(lanes)]
    marked = written(_marked_sets(df, key, text, words, lanes), "simhash-wide")
    leaves = written(marked.groupBy("digest").agg(F.min(key).alias("leaf"), *(F.first(c).alias(c) for c in ("size", "hubs", *names))), "leaves-wide")
    texts = df.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those pairs ``u, v`` of digests whose sets are similar enough."""
        ends = pairs.select(F.col("u").alias("digest")).unionAll(pairs.select("v")).distinct()
        wanted = leaves.join(ends, "digest", "left_semi").select("leaf").distinct()
        again = texts.join(wanted, F.col("_key") == F.col("leaf"), "left_semi").select("_key", "_text")
        sets = written(_digested(again, words).join(ends, "digest", "left_semi").dropDuplicates(["digest"]), "sets-wide")
        side = lambda name: sets.select(F.col("digest").alias(name), F.col("shingles").alias(f"s{name}"))
        common = F.size(F.array_intersect("su", "sv"))
        checked = pairs.join(side("u"), "u").join(side("v"), "v")
        return written(checked.filter(common >= F.lit(similarity) * (F.size("su") + F.size("sv") - common)).select("u", "v"), "links-wide")

    stars = linked(written(_star_pairs(leaves, names, most, similarity), "stars-wide"))
    parts = connected_components(stars).toDF("digest", "component")
    parted = leaves.join(parts, "digest", "left").select(F.col("digest").alias("leaf"), "size", F.coalesce("component", "digest").alias("part"), *names)
    met = meeting_pairs(written(parted, "parts-wide"), total // segment_bits, segment_bits, budget, most, similarity)
    checked = stars.unionAll(linked(written(met, "pairs-wide")))
    least = leaves.select("digest", "leaf")
    links = checked.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(links).toDF("leaf", "component")
    classes = least.join(parts, "leaf", "left").select("digest", F.coalesce("component", "leaf").alias("component_id"))
    return marked.join(classes, "digest").select(key, "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
