"""Operator 9, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Fit. A bounded sample of the labelled rows (``TOXIC_EXAMPLES`` and ``CLEAN_EXAMPLES``, the first by a hash of the id; the
bound is a parameter) is the index's collection, and all its words span the vector space. A word weighs
(1 + ln tf) * idf, times the root of the log-likelihood ratio of the two classes: a factor, not a cut, so that words that
tell the classes apart count most and those that don't count little. Vectors have length one. Words are known by XXH64.

Search. Examples lie in blocks of ``BLOCK``. Words in under a share ``COMMON`` of the examples are rare: each has postings, cut by
blocks, and for each of its blocks the largest weight. The others, ``MOST_COMMON`` at most, are in nearly every block; their
part of all cosines, for ``TOGETHER`` texts at a time, is one product with a dense table. The sum of a text's weights times the maxima, plus the largest such part in the block, bounds the
cosine with any example of the block. Blocks are visited by falling bound: ``FIRST`` of them, then those whose bound reaches
the k-th best cosine so far, or the k-th best part of the common words, which no cosine is below; other blocks' postings aren't
read. Where that part alone leaves a third of the blocks or fewer, they are visited at once. Where over a third of the blocks can, or
where the bounds are level, postings are read in one piece. The table has single precision, so what it finds is within some ``SLACK`` of a cosine: examples
that can be among the nearest get their common words' part once more, in double precision. The k nearest are exact; ties
go to the smaller example id.

Score. Cosine-weighted votes of the k nearest, each class weighted by its share of all training labels, are calibrated by
isotonic regression on the examples' own votes. Of the examples with the very same text as the scored one, the first (by
id) has no vote, in calibration and in scoring: a training text doesn't vouch for itself, and a score depends on nothing
but the text. The evidence is the voting neighbours with their cosines and labels.

The index is bounded by the sample, whatever the corpus, so it is sent to the tasks; the corpus is scored in one pass
without a shuffle. Texts that share no word with the examples, empty and null ones included, get the toxic share of all
training labels, and no evidence. Of a training document with several texts the smallest is taken. Repeated rows get
equal scores; other columns than the named ones are left out, whatever they are called; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hand_back, table, written

TOXIC_EXAMPLES, CLEAN_EXAMPLES = 4_000, 8_000
NEIGHBOURS = 15
BLOCK = 128
FIRST = 3
#: Words in this share of the examples or more are common: the commonest so many at most, as they have a dense table.
COMMON = 0.04
MOST_COMMON = 1_024
#: Texts that are multiplied with that table at once.
TOGETHER = 512
#: Twice what single precision can be off, at most, for each product in a sum that is one at most.
SLACK = 2.0**-23
#: Where over a third of the blocks have a bound of this share of the largest one, no few blocks are visited first.
LEVEL = 0.5
CUT = 0.7
#: Weight of the base rate beside the votes, as the cosine of one more neighbour.
PRIOR = 0.05
_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def digest(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))


class Index(NamedTuple):
    terms: object  # (terms,) hashes of the words, ascending
    weight: object  # (terms,) idf times how the word tells the classes apart
    ids: object  # (examples,)
    toxic: object  # (examples,) bool
    texts: object  # digests of the examples' texts, ascending, each once
    first: object  # the example with that text whose id is smallest
    common: object  # (terms,) place among the common words, or -1
    n_common: int
    term_starts: object  # (terms + 1,) into the cuts of the postings of rare words
    cut_block: object
    cut_max: object
    cut_starts: object  # (cuts + 1,) into the postings
    postings: object  # examples
    posting_weights: object
    fast: object  # (examples filled up to whole blocks, common words) weights in single precision
    own_starts: object  # (examples filled up + 1,) into the common words of the examples
    own_common: object
    own_weights: object

    @property
    def table(self):
        """(common words, examples filled up to whole blocks) weights, in double precision."""
        import numpy as np

        dense = np.zeros((self.n_common, len(self.fast)))
        dense[self.own_common, np.repeat(np.arange(len(self.fast)), np.diff(self.own_starts))] = self.own_weights
        return dense


def spans(starts, stops):
    """``starts[i] .. stops[i] - 1`` for all i, one after another, as places to take."""
    import numpy as np

    sizes = stops - starts
    ends = np.cumsum(sizes, dtype=np.int64)
    places = np.repeat(starts - (ends - sizes), sizes)
    places += np.arange(len(places))
    return places


def likelihood_ratio(a, b, n1: int, n0: int):
    """How far from chance it is that ``a`` of ``n1`` and ``b`` of ``n0`` examples have a word."""
    import numpy as np

    n, every = n1 + n0, a + b

    def part(x, row, col):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x * n / (row * col)), 0.0)

    if not n1 or not n0:
        return np.zeros(len(a))
    return np.maximum(2 * (part(a, every, n1) + part(b, every, n0) + part(n1 - a, n - every, n1) + part(n0 - b, n - every, n0)), 0.0)


def weighed(tf, weight):
    """Unit vector of term frequencies under the terms' weights; zeros if no term has a weight."""
    import numpy as np

    w = (1.0 + np.log(tf)) * weight
    length = np.sqrt((w * w).sum())
    return w / length if length > 0 else w * 0.0


def build(ids, toxic, texts, lists: list, counts: list, block: int = BLOCK, terms=None) -> Index:
    """The index of examples: their ids, labels, digests of texts, and each one's hashes of words and term frequencies; with ``terms``
    (ascending) places among these in place of hashes."""
    import numpy as np

    ids, toxic, texts = np.asarray(ids, dtype=np.int64), np.asarray(toxic, dtype=bool), np.asarray(texts, dtype=np.uint64)
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    if terms is None:
        terms, term = np.unique(np.concatenate([np.asarray(x, dtype=np.uint64) for x in lists]) if len(lists) else np.zeros(0, dtype=np.uint64), return_inverse=True)
    else:
        term = np.concatenate(lists) if len(lists) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(ids)), sizes)
    df = np.bincount(term, minlength=len(terms)).astype(np.float64)
    with_toxic = np.bincount(term, weights=toxic[owner].astype(np.float64), minlength=len(terms))
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    weight = (np.log((1 + n1 + n0) / (1 + df)) + 1) * np.sqrt(likelihood_ratio(with_toxic, df - with_toxic, n1, n0))
    ends = np.cumsum(sizes)
    value = np.concatenate([weighed(np.asarray(c, dtype=np.float64), weight[term[e - n : e]]) for c, e, n in zip(counts, ends, sizes)]) if len(ids) else np.zeros(0)
    # examples of one class that share their heaviest word lie together, so that the blocks' maxima are tight
    heaviest = np.array([term[e - n + value[e - n : e].argmax()] if n else -1 for e, n in zip(ends, sizes)], dtype=np.int64)
    order = np.lexsort((ids, heaviest, ~toxic))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    owner, ids, toxic, texts = place[owner], ids[order], toxic[order], texts[order]
    blocks = -(-len(ids) // block)
    is_common = df >= max(COMMON * len(ids), 2, np.sort(df)[-MOST_COMMON] if len(terms) > MOST_COMMON else 0)
    if is_common.sum() > MOST_COMMON:  # words as common as the last that has room
        is_common[np.flatnonzero(is_common)[np.argsort(-df[is_common], kind="stable")[MOST_COMMON:]]] = False
    common = np.where(is_common, np.cumsum(is_common) - 1, -1).astype(np.int32)

    rare = np.flatnonzero(~is_common[term] & (value > 0))
    rare = rare[np.lexsort((owner[rare], term[rare]))]
    key = term[rare] * max(blocks, 1) + owner[rare] // block
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    cut_terms = term[rare][cuts]
    cut_max = np.maximum.reduceat(value[rare], cuts) if len(cuts) else np.zeros(0)
    wide = np.flatnonzero(is_common[term])
    fast = np.zeros((blocks * block, int(is_common.sum())), dtype=np.float32)
    fast[owner[wide], common[term[wide]]] = value[wide]
    wide = wide[np.argsort(owner[wide], kind="stable")]
    own_starts = np.append(0, np.cumsum(np.bincount(owner[wide], minlength=blocks * block)))
    by_text = np.lexsort((ids, texts))
    known, at = np.unique(texts[by_text], return_index=True)
    return Index(
        terms, weight, ids, toxic, known, by_text[at], common, int(is_common.sum()),
        np.searchsorted(cut_terms, np.arange(len(terms) + 1)).astype(np.int32), (owner[rare][cuts] // block).astype(np.int32), cut_max,
        np.append(cuts, len(rare)).astype(np.int32), owner[rare].astype(np.int32), value[rare],
        fast, own_starts, common[term[wide]], value[wide],
    )


def common_parts(index: Index, vectors: list[tuple[object, object]]) -> list:
    """For each text (its terms and their weights), about what the common words give to its cosine with each example."""
    import numpy as np

    found = []
    for first in range(0, len(vectors), TOGETHER):
        some = vectors[first : first + TOGETHER]
        asked = np.zeros((len(some), index.n_common), dtype=np.float32)
        for row, (at, weights) in zip(asked, some):
            places = index.common[at]
            row[places[places >= 0]] = weights[places >= 0]
        found.extend(asked @ index.fast.T)
    return found


def common_exact(index: Index, at, weights, examples):
    """What the common words give to the cosines with these examples, in double precision."""
    import numpy as np

    asked, places = np.zeros(index.n_common), index.common[at]
    asked[places[places >= 0]] = weights[places >= 0]
    starts, stops = index.own_starts[examples], index.own_starts[examples + 1]
    read_at = spans(starts, stops)
    values = asked.take(index.own_common.take(read_at)) * index.own_weights.take(read_at)
    return np.bincount(np.repeat(np.arange(len(examples)), stops - starts), weights=values, minlength=len(examples))


def nearest(index: Index, at, weights, k: int, without: int = -1, block: int = BLOCK, shared=None) -> tuple[list[tuple[float, int]], int]:
    """The k nearest examples with a cosine over zero, (cosine, place in the index), nearest first, exact; and how many blocks were read.

    ``at`` and ``weights``: the text's terms, ascending, and its unit vector. ``shared``: its row of ``common_parts``, if known.
    """
    import numpy as np

    is_rare = index.common[at] < 0
    rare, own = at[is_rare], weights[is_rare]
    if shared is None:
        shared = common_parts(index, [(at, weights)])[0]
    starts, stops = index.term_starts[rare], index.term_starts[rare + 1]
    ends = np.cumsum(stops - starts)
    cuts = spans(starts, stops)
    blocks, gains = index.cut_block.take(cuts), np.repeat(own, stops - starts)
    gains *= index.cut_max.take(cuts)
    bounds = np.bincount(blocks, weights=gains, minlength=len(shared) // block) + shared.reshape(-1, block).max(axis=1, initial=0.0)
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    slack = (len(at) - len(rare) + 4) * SLACK
    # rare words only add to a cosine, so the k-th best common part is a bound on the k-th best cosine
    sure = np.partition(shared, len(shared) - k - 1)[len(shared) - k - 1] - slack if len(shared) > k else 0.0  # one more, as one may have no part
    few = 3 * np.count_nonzero(bounds >= sure) <= len(bounds)
    first_few = 0 if few or 3 * np.count_nonzero(bounds >= LEVEL * bounds.max(initial=0.0)) > len(bounds) else FIRST
    held, found, edge, read = [], [], max(0.0, sure), 0
    for visited in (order[:first_few], order[first_few:]):
        visited = visited[bounds[visited] >= edge - slack]
        if not len(visited):
            continue
        read += len(visited)
        if 3 * len(visited) > len(bounds):  # so many that a word's postings are read in one piece
            first, last, share = index.cut_starts[starts], index.cut_starts[stops], own
        else:
            live = np.zeros(len(bounds), dtype=bool)
            live[visited] = True
            mine = np.flatnonzero(live[blocks])
            first, last, share = index.cut_starts[cuts[mine]], index.cut_starts[cuts[mine] + 1], own[np.searchsorted(ends, mine, "right")]
        read_at, values = spans(first, last), np.repeat(share, last - first)
        values *= index.posting_weights.take(read_at)
        of_rare = np.bincount(index.postings.take(read_at), weights=values, minlength=len(shared))
        part = of_rare + shared
        if without >= 0:
            part[without] = 0.0
        part = part.reshape(-1, block)[visited]
        least = np.partition(part, part.size - k, axis=None)[part.size - k] - 2 * slack if part.size > k else 0.0
        row, column = np.nonzero((part >= max(edge - slack, least)) & (part > 0))
        near = visited[row] * block + column
        held.append(near)
        found.append(np.round(of_rare[near] + common_exact(index, at, weights, near), 12))
        best = np.concatenate(found)
        edge = max(edge, np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else edge
    if not held:
        return [], read
    near, found = np.concatenate(held), np.concatenate(found)
    best = np.lexsort((index.ids[near], -found))[:k]
    best = best[found[best] > 1e-12]
    return list(zip(found[best].tolist(), near[best].tolist())), read


def packed(ids, toxic, texts, lists: list, counts: list) -> bytes:
    """Some examples as compressed bytes: the terms that they have, ascending, and each example's terms as steps among these."""
    import pickle
    import zlib

    import numpy as np

    flat = np.concatenate([np.asarray(x, dtype=np.uint64) for x in lists]) if len(lists) else np.zeros(0, dtype=np.uint64)
    terms, term = np.unique(flat, return_inverse=True)
    sizes, parts, tf = [len(x) for x in lists], [], []
    for e, n, c in zip(np.cumsum(sizes), sizes, counts):  # ascending terms as differences
        own = term[e - n : e]
        order = np.argsort(own)
        parts.append(np.diff(own[order], prepend=0))
        tf.append(np.asarray(c)[order])
    whole = [np.concatenate(x).astype(np.uint32) if x else np.zeros(0, dtype=np.uint32) for x in (parts, tf)]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T) for x in whole]
    return zlib.compress(pickle.dumps((np.asarray(ids), np.asarray(toxic), np.asarray(texts), terms, sizes, planes)), 6)


class Packed:
    """The sampled examples as ``packed`` parts, some megabytes in all; a Python worker builds the index from them once."""

    def __init__(self, data: list[bytes]):
        self.data = data

    def index(self) -> Index:
        import pickle
        import zlib

        import numpy as np

        if not hasattr(self, "_index"):
            parts = [pickle.loads(zlib.decompress(x)) for x in self.data]
            terms = np.unique(np.concatenate([x[3] for x in parts])) if parts else np.zeros(0, dtype=np.uint64)
            ids, toxic, texts = ([y for x in parts for y in x[c].tolist()] for c in range(3))
            lists, counts = [], []
            for *_, own, sizes, planes in parts:
                steps, tf = (np.ascontiguousarray(p.T).view(np.uint32).ravel() for p in planes)
                place, cuts = np.searchsorted(terms, own), np.cumsum(sizes)[:-1]
                lists += [place[np.cumsum(x)] for x in np.split(steps.astype(np.int64), cuts)]
                counts += np.split(tf, cuts)
            del parts
            self._index = build(ids, toxic, np.array(texts, dtype=np.uint64), lists, counts, terms=terms)
            del lists, counts
            hand_back()
        return self._index

    def __getstate__(self):
        return {"data": self.data}


class Model(NamedTuple):
    examples: object  # broadcast of ``Packed``
    n_examples: int
    class_weight: tuple[float, float]
    base: float
    knots: tuple[object, object]  # raw vote -> calibrated score


def vote(index: Index, near: list[tuple[float, int]], class_weight: tuple[float, float], base: float) -> float:
    """Cosine-weighted share of toxic neighbours, classes weighted as in all training labels, with the base rate beside them."""
    yes = sum(c * class_weight[1] for c, j in near if index.toxic[j])
    no = sum(c * class_weight[0] for c, j in near if not index.toxic[j])
    prior = PRIOR * min(class_weight)
    return (yes + prior * base) / (yes + no + prior)


def isotonic(x, y, w) -> tuple[list[float], list[float]]:
    """Weighted isotonic regression by pooling adjacent violators; returns (mean x, fitted y) of each pool."""
    pools: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x, y, w)):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]


def held_out() -> Column:
    """Rows whose labels aren't learnt: crc32 of ``doc_id`` as text is 1 modulo 3. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(labels: DataFrame, docs: DataFrame, toxic: int = TOXIC_EXAMPLES, clean: int = CLEAN_EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """The examples ``doc_id, toxic, text`` and the number of training labels of each class.

    Held-out rows' labels aren't read. A document with several labels counts as toxic if one of them says so.
    """
    own = labels.filter(~held_out()).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    totals = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}
    first = lambda c, n: own.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, toxic).unionAll(first(0, clean))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = picked.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(picked, "examples"), totals


def _packed_examples(batches: Iterator) -> Iterator:
    """A partition's examples ``doc_id, toxic, text`` as one row: ``n_clean, n_toxic`` and the ``packed`` bytes; none, if there are none."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    ids, toxic, texts, lists, counts = [], [], [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        toxic += [t == 1 for t in batch.column(1).to_pylist()]
        for text in batch.column(2).to_pylist():
            found = words_in(text)
            texts.append(digest(text))
            lists.append(np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found], dtype=np.uint64))
            counts.append(np.array(list(found.values()), dtype=np.uint32))
    if ids:
        columns = [pa.array([len(ids) - sum(toxic)]), pa.array([sum(toxic)]), pa.array([packed(ids, toxic, np.array(texts, dtype=np.uint64), lists, counts)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["n_clean", "n_toxic", "data"])
    del ids, toxic, texts, lists, counts
    hand_back()


def fit(labels: DataFrame, docs: DataFrame, k: int = NEIGHBOURS, toxic: int = TOXIC_EXAMPLES, clean: int = CLEAN_EXAMPLES) -> Model:
    import numpy as np

    context = docs.sparkSession.sparkContext
    examples, totals = training_sample(labels, docs, toxic, clean)
    # the tasks hash, count and pack, so that the driver gets no more than the bytes that it sends on
    parts = examples.mapInArrow(_packed_examples, "n_clean long, n_toxic long, data binary").collect()
    sent, n = Packed([bytes(r["data"]) for r in parts]), (sum(r["n_clean"] for r in parts), sum(r["n_toxic"] for r in parts))
    del parts
    every = sum(totals.values())
    weight = tuple(totals.get(c, 0) / n[c] if n[c] else 1.0 for c in (0, 1))
    model = Model(context.broadcast(sent), sum(n), weight, totals.get(1, 0) / every if every else 0.0, ((0.0, 1.0), (0.0, 1.0)))
    if not sum(n):
        return model
    raw = score(examples.repartition(context.defaultParallelism, "doc_id"), model, ("toxic",), k=k).select("toxic", "score").toArrow()
    labels_of = raw.column("toxic").to_pylist()
    x, y = isotonic(raw.column("score").to_pylist(), [float(t) for t in labels_of], [weight[t] for t in labels_of])
    return model._replace(knots=(np.array(x), np.clip(np.array(y), 0.001, 0.999)))


def score(df: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",), text: str = "text", k: int = NEIGHBOURS, most: int = 8_192, words: int = 200_000) -> DataFrame:
    """``columns, score, evidence``: one row an input row; evidence is an array of (example id, cosine, toxic), nearest first.

    The named columns pass through the batches as they are; a ``score`` or ``evidence`` among them would clash and is an error.
    A task keeps the results of the last ``most`` distinct texts and the places of ``words`` words.
    """
    if {"score", "evidence"} & set(columns):
        raise ValueError("the columns can't be named score or evidence")
    sent, class_weight, base, knots = model.examples, model.class_weight, model.base, model.knots

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        hand_back()
        index, places, cached = sent.value.index(), {}, {}

        def evidence(proofs: list):
            cosines = np.array([c for near in proofs for c, _ in near], dtype=np.float64)
            at = np.array([j for near in proofs for _, j in near], dtype=np.int64)
            ends = np.cumsum([0, *map(len, proofs)])
            parts = pa.StructArray.from_arrays([pa.array(index.ids[at]), pa.array(cosines), pa.array(index.toxic[at])], names=["example", "cosine", "toxic"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

        def learn(unknown: list[str]) -> None:
            hashes = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in unknown], dtype=np.uint64)
            at = np.minimum(np.searchsorted(index.terms, hashes), max(len(index.terms) - 1, 0))
            known = index.terms[at] == hashes if len(index.terms) else np.zeros(len(unknown), dtype=bool)
            places.update(zip(unknown, np.where(known, at, -1).tolist()))

        def vector(counts: Counter) -> tuple:
            """The terms of a text with these words, ascending, and its unit vector."""
            at = np.fromiter(map(places.__getitem__, counts), dtype=np.int64, count=len(counts))
            tf = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            tf, at = tf[at >= 0], at[at >= 0]
            order = np.argsort(at)
            tf, at = tf[order], at[order]
            return at, weighed(tf, index.weight[at])

        def judge(mark: int, at, weights, shared):
            if not weights.any():
                return base, []
            same = np.searchsorted(index.texts, np.uint64(mark))
            without = int(index.first[same]) if same < len(index.texts) and index.texts[same] == mark else -1
            near, _ = nearest(index, at, weights, k, without, shared=shared)
            return float(np.interp(vote(index, near, class_weight, base), *knots)), near

        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            marks = [digest(t) for t in texts]
            unknown = {m: t for m, t in zip(marks, texts) if m not in cached}
            new = {}
            for some in (list(unknown.items())[i : i + TOGETHER] for i in range(0, len(unknown), TOGETHER)):
                counted = [words_in(t) for _, t in some]
                if len(places) > words:
                    places.clear()
                learn(list({w for counts in counted for w in counts if w not in places}))
                vectors = list(map(vector, counted))
                new |= {m: judge(m, *v, part) for (m, _), v, part in zip(some, vectors, common_parts(index, vectors))}
            known = {m: cached[m] for m in marks if m in cached} | new
            if len(cached) + len(new) > most:
                cached.clear()
            cached.update(new)
            scores, proofs = [known[m][0] for m in marks], [known[m][1] for m in marks]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(scores, pa.float64()), evidence(proofs)], names=[*columns, "score", "evidence"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    name = "text" + "_" * (1 + max(map(len, columns), default=0))  # longer than any of the columns
    rows = df.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").cast("string").alias(name))
    return rows.mapInArrow(run, f"{kinds}score double, evidence array<struct<example: bigint, cosine: double, toxic: boolean>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(table(spark, sf_dir, "labels"), docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), F.size("evidence").alias("n_evidence"))
