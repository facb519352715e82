"""Operator 5, SentencePiece encoding and decoding, by a relational lattice over distinct words.

Text is normalised as the model says (a space before it, spaces written as U+2581) and cut into words: before runs of
U+2581, at line ends, between a letter and a sign that no piece has behind one, and in words that are not ASCII between any
two characters that no piece has side by side. No piece spans two words, so each distinct word of the corpus
is encoded once:

1. its substrings of bounded length are exploded and equi-joined to the piece table (a broadcast: the vocabulary is fixed);
2. the edges are grouped by word again, without a shuffle, as the words are still parted by word;
3. one ``aggregate`` folds the edges to the word's ids. In a unigram model that is Viterbi over the end positions. The one
   public SentencePiece file here is a BPE model, for which Viterbi over its scores (ranks) does not give the library's
   ids; there the fold goes over the edges by rank, and takes away the boundary between two neighbouring segments that an
   edge joins, which is SentencePiece's BPE. An edge can only come too late for its turn if its piece has a part of worse
   rank; words with such an edge left over are folded again, taking the best of all edges in each step. Boundaries are
   bits of one long.

Words over 62 characters don't fit a long, and pieces of blanks alone share a rank; such words take the same two algorithms
in Python. Characters without a piece become byte pieces, or the unknown id.

Texts are then encoded from the word table, by one plan for all sizes. The commonest words, ``HEAD_WORDS`` of them at most
(words are cut by a step of their count, so the bound holds whatever the corpus), are broadcast and looked up in place. A
text's other words are rare by definition; they go to the word table by a join, and back to their text by another one: texts
travel as numbers of words, ``CHUNK`` texts a row. A word may be as hot as it likes: it is either in the broadcast or has few rows.

Null and empty texts have no ids and decode to the empty text. Rows that repeat an id, a text or both have a result each;
other columns of the input are left out, whatever they are called. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice
from operator import add
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hand_back, release, table, written

SPACE = "▁"
LONGEST = 62
#: Bound of the broadcast word table: about 12 MB sent, 25 MB in a Python worker.
HEAD_WORDS = 1 << 19
#: Steps of the count, per doubling, by which the head is cut off.
STEPS = 8
#: Texts that travel in one row.
CHUNK = 64
#: So many words of a task have their edges grouped by hash (about 1 KB a word); beyond that Spark goes on by sorting.
GROUPED_WORDS = 1 << 17


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]  # text, score, kind: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    unigram: bool
    prefix: bool

    def known(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, kind) in enumerate(self.pieces) if kind == 1}

    def openers(self) -> str:
        """Signs that no piece has behind a letter: a word can be cut between a letter and one of these."""
        behind = {b for p in self.known() for a, b in zip(p, p[1:]) if a.isalpha()}
        return "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" if c not in behind)

    def cutter(self) -> Callable[[str], list[str]]:
        """A function that cuts a text, with spaces for U+2581 and the first one in its place, into words."""
        signs = "".join(f"\\{c}" for c in self.openers())
        odd = "".join(sorted({c for p in self.known() for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = rf"[^\W\d_{odd}]"  # of what the class has beside letters, no other character is in a piece
        first = f" *(?:(?!{letter})[^ \n])*{letter}++(?=[{signs}])|" if signs else ""
        return re.compile(f"{first} *[^ \n]+| +|\n").findall

    def pairs(self) -> set[str]:
        """Pairs of characters that are side by side in a piece: a word can be cut between any others."""
        return {a + b for p in self.known() for a, b in zip(p, p[1:])}

    def late(self) -> set[str]:
        """Pieces with a part (of two or more characters) of worse score: their turn by rank can come before their parts'."""
        known = self.known()
        score = lambda part: known[part][1] if len(part) > 1 else float("inf")
        return {
            p
            for p, (_, s) in known.items()
            if any(a in known and b in known and min(score(a), score(b)) <= s for a, b in ((p[:i], p[i:]) for i in range(1, len(p))))
        }

    @property
    def byte_base(self) -> int | None:
        ids = [i for i, x in enumerate(self.pieces) if x[2] == 6]
        return ids[0] if len(ids) == 256 and ids == list(range(ids[0], ids[0] + 256)) else None

    @property
    def unknown(self) -> int:
        return next((i for i, x in enumerate(self.pieces) if x[2] == 2), 0)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        elif tag & 7 == 2:
            n, at = number(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
        yield tag >> 3, value


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Model:
    """Read a SentencePiece model file: unigram or BPE, without a character map, keeping extra blanks."""
    with open(path or default_model(), "rb") as f:
        message = list(_fields(f.read()))
    pieces = []
    for field, value in message:
        if field == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode(), float(x.get(2, 0.0)), x.get(3, 1)))
    trainer = dict(_fields(next((v for f, v in message if f == 2), b"")))
    normal = dict(_fields(next((v for f, v in message if f == 3), b"")))
    if trainer.get(3, 1) not in (1, 2) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or any(k == 4 for _, _, k in pieces):
        raise ValueError("only unigram and BPE models without a character map, blank removal and user-defined pieces")
    if any("\n" in p and len(p) > 1 or SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == 1):
        raise ValueError("a piece spans words")
    if len(pieces) > 1 << 15:
        raise ValueError("at most 32768 pieces: ids are kept as 16-bit numbers")
    return Model(pieces, trainer.get(3, 1) == 1, bool(normal.get(3, 1)))


def fallback(model: Model, char: str) -> list[int]:
    base = model.byte_base
    return [model.unknown] if base is None else [base + b for b in char.encode("utf-8", "replace")]


def bpe_word(model: Model, known: dict[str, tuple[int, float]], word: str) -> list[int]:
    """Merge the best-scored neighbouring pair, leftmost first, with a heap."""
    import heapq

    parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (hit := known.get(parts[i] + parts[j])):
            heapq.heappush(heap, (-hit[1], i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = a + b, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for p in parts if p for x in ([known[p][0]] if p in known else fallback(model, p))]


def unigram_word(model: Model, known: dict[str, tuple[int, float]], word: str) -> list[int]:
    """Viterbi: the segmentation with the largest sum of scores; a character without a piece costs the least score less 10."""
    longest, lost = max(map(len, known), default=1), min((s for _, s in known.values()), default=0.0) - 10
    best: list = [(0.0, 0, None)]
    for e in range(1, len(word) + 1):
        ways = [(best[s][0] + known[p][1], -s, p) for s in range(max(0, e - longest), e) if (p := word[s:e]) in known]
        if word[e - 1] not in known:
            ways.append((best[e - 1][0] + lost, 1 - e, None))
        score, s, p = max(ways, key=lambda w: (w[0], w[1]))
        best.append((score, -s, p))
    out, e = [], len(word)
    while e:
        _, s, p = best[e]
        out.append([known[p][0]] if p else fallback(model, word[s:e]))
        e = s
    return [i for x in reversed(out) for i in x]


#: An edge is a long: rank, lateness, start, end, id + 1 (0: no piece). Boundaries are bits 0..n of ``mask``; ``outer`` has
#: an edge's two ends, ``inner`` what lies between. The sign bit is set if a late edge was passed over with its ends in place.
_ONCE = """
aggregate(merges, shiftleft(1L, n + 1) - 1L, (mask, x) -> CASE WHEN (mask & x.outer) <> x.outer THEN mask
  WHEN bit_count(mask & x.inner) = 1 THEN mask & ~x.inner WHEN x.late THEN mask | -9223372036854775808L ELSE mask END)
"""
#: Each step finds the first edge (best rank, leftmost) that joins two segments, and takes their boundary away.
_AGAIN = """
aggregate(sequence(1, n - 1), shiftleft(1L, n + 1) - 1L, (mask, i) -> mask & ~aggregate(merges, 0L,
  (hit, x) -> CASE WHEN hit <> 0 THEN hit WHEN (mask & x.outer) = x.outer AND bit_count(mask & x.inner) = 1 THEN mask & x.inner ELSE 0L END))
"""
#: Viterbi over end positions: the state has, for each end so far, the best sum of scores and the last edge's start; then
#: the ends on the best path are collected backwards, as bits.
_VITERBI = """
aggregate(sequence(1, n), array(named_struct('best', 0.0D, 's', 0)), (paths, e) -> array_append(paths,
  aggregate(filter(edges, x -> x.e = e), named_struct('best', CAST('-Infinity' AS DOUBLE), 's', 0), (b, x) ->
    CASE WHEN paths[x.s].best + x.score > b.best THEN named_struct('best', paths[x.s].best + x.score, 's', x.s) ELSE b END)))
"""
_BACK = """
aggregate(sequence(1, n), named_struct('mask', shiftleft(1L, n), 'e', n), (b, i) ->
  CASE WHEN b.e = 0 THEN b ELSE named_struct('mask', b.mask | shiftleft(1L, paths[b.e].s), 'e', paths[b.e].s) END).mask
"""


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """``word, ids`` and the other columns of ``words``, which has one row for each distinct ``word``; the lattice of the module's docstring."""
    spark, known = words.sparkSession, model.known()
    rest = [c for c in words.columns if c != "word"]
    words = words.select("word", F.struct(*rest).alias("own")) if rest else words
    own = ["own"] if rest else []
    rank = {s: i for i, s in enumerate(sorted({s for _, s in known.values()}, reverse=True))}
    lost = min((s for _, s in known.values()), default=0.0) - 10
    longest, late = max(map(len, known), default=1), set() if model.unigram else model.late()
    rows = [(p, (rank[s] << 35 | (p in late) << 34 | i + 1), s) for p, (i, s) in known.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, code long, score double"))
    fits = (F.length("word") <= LONGEST) & ~F.contains(F.col("word"), F.lit(SPACE * 2))  # pieces of blanks alone have one rank
    last, widest = F.when(fits, F.length("word") - 1).otherwise(0), F.least(F.lit(longest), F.length("word") - F.col("s"))
    # a word that doesn't fit has one empty span, so that all words go through one grouping
    spans = (
        words.withColumn("s", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("k", F.explode(F.when(fits, F.sequence(F.lit(1), widest)).otherwise(F.array(F.lit(0)))))
        .withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("k")))
    )
    edges = spans.join(pieces, "piece", "left").filter(F.col("code").isNotNull() | (F.col("k") <= 1))
    place = F.shiftleft(F.col("s").cast("long"), 27) + F.shiftleft((F.col("s") + F.col("k")).cast("long"), 20)
    code = F.coalesce("code", F.lit(len(rank) << 35).cast("long")) + place
    start, end, inner = "CAST(shiftright(x, 27) & 127 AS INT)", "CAST(shiftright(x, 20) & 127 AS INT)", "shiftleft(1L, {e}) - shiftleft(1L, {s} + 1)"
    n = F.when(fits, F.length("word")).otherwise(2).alias("n")
    if model.unigram:
        edge = F.struct(F.col("s").cast("int").alias("s"), (F.col("s") + F.col("k")).cast("int").alias("e"), F.coalesce("score", F.lit(lost)).alias("score"))
        lattice = edges.groupBy("word", *own).agg(F.collect_list(code).alias("codes"), F.sort_array(F.collect_list(edge)).alias("edges")).select("*", n)
        cut = lattice.withColumn("paths", F.expr(_VITERBI)).withColumn("mask", F.expr(_BACK))
    else:
        lattice = edges.groupBy("word", *own).agg(F.sort_array(F.collect_list(code)).alias("codes")).select("*", n)
        ends = f"named_struct('s', {start}, 'e', {end}, 'late', (shiftright(x, 34) & 1) = 1)"
        merge = f"named_struct('outer', shiftleft(1L, x.s) | shiftleft(1L, x.e), 'inner', {inner.format(s='x.s', e='x.e')}, 'late', x.late)"
        lattice = lattice.withColumn("merges", F.expr(f"transform(filter(transform(codes, x -> {ends}), x -> x.e - x.s > 1), x -> {merge})"))
        cut = lattice.withColumn("mask", F.expr(_ONCE)).withColumn("mask", F.expr(f"CASE WHEN mask < 0 THEN {_AGAIN} ELSE mask END"))
    inside = inner.format(s=start, e=end)
    joined = f"(mask & shiftleft(1L, {start})) <> 0 AND (mask & shiftleft(1L, {end})) <> 0 AND (mask & ({inside})) = 0"
    taken = cut.select("word", *own, F.expr(f"sort_array(transform(filter(codes, x -> {joined}), x -> (x & 17179869183L)))").alias("taken"))
    base = model.byte_base
    char = f"hex(encode(substring(word, {start} + 1, 1), 'utf-8'))"
    octets = f"array({model.unknown})" if base is None else f"transform(sequence(1, length({char}), 2), i -> {base} + CAST(conv(substring({char}, i, 2), 16, 10) AS INT))"
    plain = "transform(taken, x -> CAST(x & 1048575 AS INT) - 1)"
    ids = F.expr(f"CASE WHEN forall(taken, x -> (x & 1048575) > 0) THEN {plain} ELSE flatten(transform(taken, x -> CASE WHEN (x & 1048575) > 0 THEN array(CAST(x & 1048575 AS INT) - 1) ELSE {octets} END)) END")

    @F.arrow_udf("array<int>")
    def by_hand(word: pa.Array) -> pa.Array:
        known = model.known() if word.null_count < len(word) else {}
        one = unigram_word if model.unigram else bpe_word
        return pa.array([None if w is None else one(model, known, w) for w in word.to_pylist()], pa.list_(pa.int32()))

    return taken.select("word", *(f"own.`{c}`" for c in rest), F.when(fits, ids).otherwise(by_hand(F.when(~fits, F.col("word")))).alias("ids"))


def _numbers(column, kind):
    import numpy as np

    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=kind)


def _slices(batch, column: str | int, most: int = 1 << 19) -> Iterator:
    """Row ranges of a batch whose lists in ``column`` hold about ``most`` elements or, if one list is longer, that one."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = _numbers(pc.fill_null(pc.list_value_length(batch.column(column)), 0), np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a), sizes[a:b]


class Cutter:
    """Cuts texts into words. Parts of a text that are parted by single spaces are cut alone, so that each distinct one is cut once."""

    def __init__(self, model: Model):
        self.cut, self.start = model.cutter(), " " if model.prefix else ""
        self.pairs = {p.replace(SPACE, " ") for p in model.pairs()}

    def parts(self, text: str) -> list[str]:
        """The parts of a text: the first one and those with more than one space before them are kept behind a NUL as they are."""
        text = self.start + text.replace(SPACE, " ")
        if "  " in text or text[-1] == " " or "\0" in text:
            return ["\0" + w for w in self.cut(text)]
        parts = text.split(" ")
        return parts[1:] if self.start else ["\0" + parts[0], *parts[1:]]

    def words(self, part: str) -> list[str]:
        if part.isalpha():
            return [" " + part] if part.isascii() else self.apart(" " + part)
        words = [part[1:]] if part[:1] == "\0" and len(part) > 1 and self.start else self.cut(part[1:] if part[:1] == "\0" else " " + part)
        return words if part.isascii() else [x for w in words for x in self.apart(w)]

    def apart(self, word: str) -> list[str]:
        """A word, cut between characters that no piece has side by side. ASCII words hardly have such a place, and aren't looked through."""
        if word.isascii() or self.pairs.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


def _texts(batches: Iterator, column: int, rows: int = 256) -> Iterator:
    """(part of a batch, its texts), a few rows at a time, so that few texts are held as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(column).to_pylist()


def _count_words(model: Model, most: int = 1 << 16):
    """A function over batches of texts: ``word, n`` of a partition, in parts of about ``most`` distinct words."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter


        hand_back()
        cutter, parts = Cutter(model), Counter()

        def out() -> pa.RecordBatch:
            seen: dict[str, int] = {}
            for part, n in parts.items():
                for word in cutter.words(part):
                    seen[word] = seen.get(word, 0) + n
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.replace(" ", SPACE) for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for _, texts in _texts(batches, 0):
            for text in texts:
                if text:
                    parts.update(cutter.parts(text))
            if len(parts) >= most:
                yield out()
        yield out()

    return run


def head_of(known: DataFrame, most: int) -> Column:
    """A condition on ``n`` that at most ``most`` rows of ``known`` meet: the words of the largest counts, cut at a step."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    left, least = most, 1 << 30
    for at, n in sorted(((r[0], r[1]) for r in known.groupBy(step).count().collect()), reverse=True):  # at most 64 * STEPS rows
        left -= n
        if left < 0:
            break
        least = at
    return step >= least


class Head:
    """The commonest words with their ids as an Arrow stream; a Python worker opens it once."""

    def __init__(self, stream: bytes):
        self.stream = stream

    def opened(self) -> tuple:
        """(this worker's hashes of the words, ascending, their places, the words, starts, lengths, ids); the last three have an element more."""
        import numpy as np

        if not hasattr(self, "_opened"):
            table = pa.ipc.open_stream(self.stream).read_all()
            words, ids = (table.column(c).combine_chunks() for c in ("word", "ids"))
            hashes = np.empty(len(words), dtype=np.int64)
            for at in range(0, len(words), 1 << 16):
                some = words.slice(at, 1 << 16).to_pylist()
                hashes[at : at + len(some)] = list(map(hash, some))
            order, offsets = np.argsort(hashes).astype(np.int32), _numbers(ids.offsets, np.int32)
            self._opened = (hashes[order], order, words, offsets, np.append(np.diff(offsets), 0).astype(np.int16), np.append(_numbers(ids.values, np.int16), np.int16(0)))
            del self.stream
            pa.default_memory_pool().release_unused()
        return self._opened

    def find(self, words: list[str]):
        """The place of each word, or -1."""
        import numpy as np
        import pyarrow.compute as pc

        hashes, places, known, *_ = self.opened()
        if not len(hashes) or not words:
            return np.full(len(words), -1)
        asked = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        at = places[np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)]
        same = pc.equal(known.take(pa.array(at)), pa.array(words, pa.string()))
        return np.where(same.to_numpy(zero_copy_only=False), at, -1)


class Coder:
    """Looks up the parts of texts, and keeps what distinct parts come to: a number for each word, its place in the head and one, or 0 outside."""

    def __init__(self, model: Model, head: Head, most: int = 1 << 16):
        self.cutter, self.head, self.most = Cutter(model), head, most
        self.places: dict[str, int] = {}
        self.outside: dict[int, list[str]] = {}
        self.starts, self.sizes, self.words, self.used = [], [], [], 0

    def _forget(self) -> None:
        """Keep the parts that were seen first, half of what is kept at most: common parts are among them."""
        kept = self.most // 2
        self.places = dict(islice(self.places.items(), kept))
        self.outside = {p: words for p, words in self.outside.items() if p < kept}
        self.starts, self.sizes = [self.starts[0][:kept].copy()], [self.sizes[0][:kept].copy()]
        self.used = int(self.sizes[0].sum())
        self.words = [self.words[0][: self.used].copy()]

    def _learn(self, parts: list[str]) -> None:
        import numpy as np

        words = list(map(self.cutter.words, parts))
        flat = [w for x in words for w in x]
        at = (self.head.find(flat) + 1).astype(np.int32)
        sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        ends = np.cumsum(sizes)
        base = len(self.places)
        self.places.update(zip(parts, range(base, base + len(parts))))
        missing = np.flatnonzero(at == 0)
        for p, i in zip(np.searchsorted(ends, missing, "right").tolist(), missing.tolist()):
            self.outside.setdefault(base + p, []).append(flat[i])
        self.starts.append(ends - sizes + self.used)
        self.sizes.append(sizes)
        self.words.append(at)
        self.used += len(at)

    def __call__(self, parts: list[str]):
        """(numbers of all words, number of words of each part, place of each part)"""
        import numpy as np

        if len(self.places) > self.most:
            self._forget()
        found = list(map(self.places.get, parts))
        missing = [i for i, p in enumerate(found) if p is None]
        if missing:
            self._learn(list(dict.fromkeys([parts[i] for i in missing])))
            for i in missing:
                found[i] = self.places[parts[i]]
        if len(self.starts) > 1:
            self.starts, self.sizes, self.words = ([np.concatenate(x)] for x in (self.starts, self.sizes, self.words))
        places = np.array(found, dtype=np.int64)
        if not len(parts):
            return np.zeros(0, np.int32), places, places
        n = self.sizes[0][places].astype(np.int64)
        ends = np.cumsum(n)
        return self.words[0][np.repeat(self.starts[0][places] - (ends - n), n) + np.arange(ends[-1])], n, places


def encode(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, decoded: bool = False) -> DataFrame:
    """``key, ids``: every text's ids, one row an input row; with ``decoded`` the text of the ids as well, in the same pass."""
    model = model or load()
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_count_words(model), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with _grouped_by_hash(spark):
        known = written(encode_words(counted, model), "words")
    del counted
    release(spark)
    known = known.select(F.translate("word", SPACE, " ").alias("word"), "ids", "n")
    in_head = head_of(known, head_words)
    sent = _sent(spark, known.filter(in_head).select("word", F.col("ids").cast("array<smallint>").alias("ids"), "n"))

    def look_up(batches: Iterator) -> Iterator:
        hand_back()
        coder = Coder(model, sent.value)
        for part, texts in _texts(batches, 1):
            yield from _looked_up(part, texts, coder)

    # both readers of this exchange take all of its columns, so that it is made once
    coded = rows.mapInArrow(look_up, f"mark long, keys array<{kind}>, sizes array<int>, words binary, rest binary").repartition("mark")
    asked = coded.mapInArrow(_rest_words, "mark long, place int, word string")
    tail = known.filter(~in_head).select("word", F.col("ids").cast("array<smallint>").alias("ids"))
    answered = asked.join(tail, "word").groupBy("mark").agg(F.collect_set(F.struct("place", "ids")).alias("told"))
    whole = coded.join(answered.hint("shuffle_hash"), "mark", "left")  # a column left out here would be left out before the exchange as well, and make it a second one
    texts = _decoder(spark, model, "ids") if decoded else None

    def fill(batches: Iterator) -> Iterator:
        hand_back()
        filled = (_filled(batch, at, sent.value, key) for batch in batches for at in range(batch.num_rows))
        yield from texts(filled) if texts else filled

    return whole.mapInArrow(fill, f"`{key}` {kind}, ids array<int>" + (", decoded string" if decoded else ""))


@contextmanager
def _grouped_by_hash(spark: SparkSession) -> Iterator[None]:
    """Lists of a task are collected by hash for ``GROUPED_WORDS`` keys, where Spark sorts all rows after 128."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(GROUPED_WORDS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sent(spark: SparkSession, head: DataFrame):
    """The head as a broadcast Arrow stream; at most ``head_words`` short rows."""

    table = head.toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns("n")  # so that common words have small places
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return spark.sparkContext.broadcast(Head(sink.getvalue().to_pybytes()))


def _small(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(data)


def _pressed(numbers) -> bytes:
    """Numbers under 2**24, byte by byte, compressed: a text's words take about 13 bits each."""
    import numpy as np

    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return _small(np.ascontiguousarray(planes).tobytes())


def _unpressed(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(3, -1)
    return planes[0] + (planes[1].astype(np.int32) << 8) + (planes[2].astype(np.int32) << 16)


def _looked_up(batch, texts: list, coder: Coder, most: int = 1 << 17) -> Iterator:
    """Rows ``mark, keys, sizes`` (words of each text)``, words`` (numbers; behind the head's, the place in ``rest`` of a word outside)``, rest``
    of ``CHUNK`` texts at most.

    ``mark`` is a hash of the row, so that copies of a text are spread. Rows that share one share their answers: that is harmless.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    first, parts, sizes, behind = 0, [], [], len(coder.head.opened()[2]) + 1

    def out() -> Iterator:
        words, n, places = coder(parts)
        rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[rows].astype(np.int64)
        odd = np.isin(places, np.fromiter(coder.outside, dtype=np.int64, count=len(coder.outside)))
        for at in range(0, len(sizes), CHUNK):
            to = min(at + CHUNK, len(sizes))
            some, own, (a, b) = words[ends[at] : ends[to]].copy(), {}, rows[[at, to]]
            some[some == 0] = [behind + own.setdefault(w, len(own)) for p in places[a:b][odd[a:b]].tolist() for w in coder.outside[p]]
            keys, counts, numbers = batch.column(0).slice(first + at, to - at), np.diff(ends[at : to + 1]).astype(np.int32), _pressed(some)
            rest = _small(json.dumps(list(own)).encode()) if own else None
            mark = np.array([xxh64_intdigest(b"%b %b %b %b" % (numbers, rest or b"", counts.tobytes(), str(keys.to_pylist()).encode("utf-8", "replace")))], dtype=np.uint64)
            columns = [pa.array(mark.view(np.int64)), _listed(keys), _listed(pa.array(counts)), pa.array([numbers], pa.binary()), pa.array([rest], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "keys", "sizes", "words", "rest"])

    for i, text in enumerate(texts):
        found = coder.cutter.parts(text) if text else []
        parts.extend(found)
        sizes.append(len(found))
        if len(parts) >= most or i + 1 == len(texts):
            yield from out()
            first, parts, sizes = i + 1, [], []


def _listed(values):
    """An array with one list that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rest_words(batches: Iterator) -> Iterator:
    """``mark, place, word``: each row's distinct words outside the head."""
    import zstandard

    opened = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for mark, rest in zip(*(batch.column(c).to_pylist() for c in ("mark", "rest"))):
            words = json.loads(opened(rest)) if rest else []
            yield pa.RecordBatch.from_arrays([pa.array([mark] * len(words), pa.int64()), pa.array(range(len(words)), pa.int32()), pa.array(words, pa.string())], names=["mark", "place", "word"])


def _filled(batch, row: int, head: Head, key: str):
    """``key, ids`` of the texts of a row: the ids of their words, from the head or from the row's answers."""
    import numpy as np

    *_, words, starts, lengths, flat = head.opened()
    told = sorted((t["place"], t["ids"]) for t in batch.column("told")[row].as_py() or [])
    assert [t[0] for t in told] == list(range(len(told)))
    own = np.array([i for _, ids in told for i in ids], dtype=np.int32)
    more = np.fromiter((len(ids) for _, ids in told), dtype=np.int64, count=len(told))
    at = _unpressed(batch.column("words")[row].as_py()) - 1
    outside = np.flatnonzero(at >= len(words))
    places = at[outside] - len(words)
    at[outside] = len(words)
    n, begins = lengths[at].astype(np.int64), starts[at].astype(np.int64)
    n[outside], begins[outside] = more[places], len(flat) + (np.cumsum(more) - more)[places]
    ends = np.concatenate([[0], np.cumsum(n)])
    taken = np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])
    answered = taken >= len(flat)
    ids = flat[np.where(answered, 0, taken)].astype(np.int32)
    ids[answered] = own[taken[answered] - len(flat)]
    offsets = ends[np.concatenate([[0], np.cumsum(batch.column("sizes")[row].as_py())]).astype(np.int64)]
    return pa.RecordBatch.from_arrays([batch.column("keys")[row].values, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])


def _decoder(spark: SparkSession, model: Model, ids: str):
    """A function that adds the text of the ids to record batches."""
    octets = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(SPACE, " ").encode() for p, _, kind in model.pieces]
    sent, prefix = spark.sparkContext.broadcast(octets), model.prefix

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        pieces = pa.array(sent.value, pa.large_binary())
        for batch, sizes in (part for whole in batches for part in _slices(whole, ids)):
            found = batch.column(ids)
            data = pieces.take(found.flatten())  # the pieces' bytes one after another; a row's text is one range of them
            _, starts, octets = data.buffers()
            starts = np.frombuffer(starts, dtype=np.int64)[data.offset :]
            ends = starts[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            octets = memoryview(octets) if octets else memoryview(b"")
            texts = [str(octets[a:b], "utf-8", "replace") if known else None for a, b, known in zip(ends, ends[1:], found.is_valid().to_pylist())]
            texts = [t[1:] if prefix and t and t[0] == " " else t for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(df: DataFrame, model: Model | None = None, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` to every row: the text of its ids. Broken byte sequences become U+FFFD; null ids give a null."""
    df = df.drop("decoded")
    run = _decoder(df.sparkSession, model or load(), ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids``, and a hash of the text that the ids decode to."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.xxhash64("decoded").alias("decoded_hash"))
