"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, licenses, lm, mixing, pieces, quality, sharding, simhash, tokens, toxicity

TEXTS = [
    None, "", " ", "\n\t", "one", "The cat sat on the mat.\nThe cat sat on the mat.\nA dog\n\n", "Released under the MIT License.", "word " * 3000,
    "a  b   c\td é 漢字 😀 <|endoftext|> x\r\ny", "### ### *** spam %%%", "the quick brown fox jumps over the lazy dog and runs away " * 4,
    "the quick brown fox jumps over the lazy dog and runs away " * 4, "=" * 200,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_shards_take_turns(spark, docs, none):
    table = [r["shard"] for r in sharding.lookup_table(spark, ["x", "y", "z"], 101).orderBy("slot").collect()]
    assert len(table) == 101 and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    clash = docs.withColumn("shard", F.lit("old"))
    assert sharding.assign_shards(clash, "doc_id").count() == len(TEXTS)
    assert sharding.assign_shards(none, "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, ["x"], 100)
    kept = sharding.assign_shards(spark.range(2000), "id", [f"s{i}" for i in range(10)], 1009).withColumnRenamed("shard", "a")
    less = sharding.assign_shards(spark.range(2000), "id", [f"s{i}" for i in range(9)], 1009).withColumnRenamed("shard", "b")
    moved = kept.join(less, "id").filter("a != 's9' and a != b").count()
    assert moved < 400


def test_licenses(docs, none):
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert found[6][0]["license"] == "mit/notice" and found[6][0]["dice"] == 1.0
    assert all(not v for k, v in found.items() if k != 6)
    assert licenses.scan(none).count() == 0


def test_quality_counts(docs, none):
    for r in quality.quality_rules(docs.withColumn("kept", F.lit(3))).collect():
        w, text = [x.decode() for x in words(TEXTS[r["doc_id"]])], TEXTS[r["doc_id"]] or ""
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(none).count() == 0


def test_mixing_meets_targets(spark, docs, none):
    for r in mixing.mix(docs, rows_per_range=2).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r["t"] - r["w"]) <= 1 and r["over"] <= 0
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0
    ordered = mixing.training_order(docs, mixing.mix(docs))
    assert ordered.columns == docs.columns and ordered.count() >= 5
    start, done = mixing.training_time(F.lit(0.0), F.lit(1.5)), mixing.training_time(F.lit(1.0), F.lit(1.5))
    assert spark.range(1).select(start, done).first() == (0.0, 1.0)


def test_each_use_has_its_own_position(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), "en", "abc"[min(2, i % 7)], 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = mixing.mix(docs, rows_per_range=20).collect()
    want = []
    for k, source in enumerate("abc"):
        own, start, place = sorted((r for r in made if r["source"] == source), key=lambda r: mixing_hash(r["doc_id"])), (1.5, 1.0, 0.5)[k], 0
        for use in range(2):
            for r in own:
                if place < int(r["target"]):
                    f = place / r["target"]
                    u = f if start == 1 else (math.sqrt(start * start + 4 * (1 - start) * f) - start) / (2 * (1 - start))
                    want.append((u, use, r["doc_id"]))
                    assert abs(r["positions"][use] - u) < 1e-12
                place += r["size"]
    assert len(want) == sum(len(r["positions"]) for r in made) and any(use and u > 0.9 for u, use, _ in want)
    got = [r["doc_id"] for r in mixing.training_order(docs, mixing.mix(docs, rows_per_range=20)).collect()]
    assert Counter(got) == Counter(i for _, _, i in want)
    at = {(r["doc_id"], use): u for r in made for use, u in enumerate(r["positions"])}
    seen = Counter()
    places = [at[i, (seen.update([i]), seen[i] - 1)[1]] for i in got]
    assert places == sorted(places)


def mixing_hash(key):
    return int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:15], 16)


def brute_components(marks, near):
    parent = {i: i for i in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in marks:
        for j in marks:
            if j < i and near(marks[i], marks[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in marks}


def test_simhash_components(spark, none):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(30)]
    texts = TEXTS + base + [t.replace("a", "b", 1) for t in base] + base[:5]
    found = simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def mark(text):
        h = simhash.shingle_hashes(text, 3)
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    marks = {i: mark(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    assert simhash.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_trie_join_is_whole(spark):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(200)}
    codes |= {c ^ 1 << rng.randrange(64) for c in codes} | {c ^ 3 << rng.randrange(62) for c in codes}
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    pairs = simhash.trie_join(spark.createDataFrame([(c,) for c in signed], "code long"), 64, 2, (12, 24, 36, 48, 64)).collect()
    found = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in pairs}
    assert len(found) == len(pairs)
    assert found == {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2}


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [" ".join(str(rng.randrange(5000)) for _ in range(300)) for _ in range(40)]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "new"
        return " ".join(w)

    texts = base + [edited(t, 3) for t in base] + [edited(t, 120) for t in base[:10]]
    found = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert sum(found[40 + i] == i for i in range(40)) >= 39
    assert all(found[80 + i] == 80 + i for i in range(10))


def test_meeting_pairs_are_whole(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(448) for _ in range(60)]  # codes of 6 bits are shared by many unrelated leaves
    prints = [b ^ sum(1 << i for i in rng.sample(range(448), k)) for b in base for k in (0, 20, 60, 90)]
    rows = [(i, *((f >> 64 * j) % 2**64 - (2**64 if (f >> 64 * j) % 2**64 >> 63 else 0) for j in range(7))) for i, f in enumerate(prints)]
    leaves = spark.createDataFrame(rows, "leaf long, " + ", ".join(f"f{j} long" for j in range(7)))
    for bits, budget in ((6, 1), (20, 1), (20, 2), (20, 0)):
        segments = 448 // bits
        found = [tuple(r) for r in simhash.meeting_pairs(leaves, segments, bits, budget, 130).collect()]
        want = {
            (i, j) for j in range(len(prints)) for i in range(j)
            if (x := prints[i] ^ prints[j]).bit_count() <= 130 and any((x >> s * bits & (1 << bits) - 1).bit_count() <= budget for s in range(segments))
        }
        assert len(want) > 50 and len(found) == len(set(found)) and set(found) == want


def test_near_duplicates_in_crowded_codes(spark):
    rng = random.Random(12)
    base = [" ".join(str(rng.randrange(5000)) for _ in range(300)) for _ in range(150)]
    texts = base + [" ".join(["new", *t.split()[1:-1], "new"]) for t in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(simhash.near_duplicates(df, segment_bits=4).collect())  # as in a corpus with many more texts than codes
    assert all(found[150 + i] == i for i in range(150))


def test_near_copies_take_no_pairs(spark):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(words[:100] + [f"own{i}"] + words[100:])) for i in range(400)]  # each differs from each in five of about 150 shingles
    df = spark.createDataFrame([*rows, (1000, "nothing to do with them at all, truly")], "doc_id long, text string")
    made = []
    kept = simhash.meeting_pairs

    def counted(*args):
        made.append(kept(*args).count())
        return kept(*args)

    simhash.meeting_pairs = counted
    try:
        found = dict(simhash.near_duplicates(df).collect())
    finally:
        simhash.meeting_pairs = kept
    assert found == {**{i: 0 for i in range(400)}, 1000: 1000} and made[0] < 400


def test_near_duplicates_around_the_limit(spark):
    rng = random.Random(21)
    new = (f"n{i}" for i in range(10**6))
    base = [[next(new) for _ in range(204)] for _ in range(120)]
    # a tail of k other words gives (200 - k) / (200 + k): 0.835, 0.802, 0.794, 0.762
    texts = [" ".join(b) for b in base] + [" ".join([*b[: 204 - k], *(next(new) for _ in range(k))]) for i, b in enumerate(base) for k in [(18, 22, 23, 27)[i % 4]]]
    texts += [" ".join([*base[0], *(base[0][:5] * 400)]), " ".join(base[1][:5] * 400), "x y z " * 300, "x y z " * 200, None, " ", "a b", "a  b\n"]
    texts += ["word " * 900 + " ".join(next(new) for _ in range(20)) for _ in range(2)]  # one bit pattern, different sets
    sets = [frozenset(simhash.shingle_hashes(t, 5)) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = brute_components(dict(enumerate(sets)), near)
    found = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert found.keys() == want.keys()
    assert not [i for i in want if want[i] == i and found[i] != i]  # nothing clean is taken
    assert sum(found[i] != want[i] for i in want) <= 4  # 60 pairs over the limit, of which 2 % needn't meet
    assert all(found[i] == want[i] for i in range(240, len(texts)))


def test_inner_products(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[50:60] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = ann.search(df, df.filter("id % 20 = 0"), chunk=200).collect()
    hit = 0
    for q in range(0, 600, 20):
        exact = sorted(((-float((x[i] * x[q]).sum()), i) for i in range(600) if i != q))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(abs(g[2] - float((x[g[1]] * x[q]).sum())) < 1e-12 for g in got)
        hit += len({i for _, i in exact} & {g[1] for g in got})
    assert hit >= 0.9 * 20 * 30 and {r["query_id"] for r in found} == set(range(0, 600, 20))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, [1.0, 0.0])], "id long, vector array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, few.filter("id = 2")).orderBy("rank").collect()]
    assert got == [(1, 1, 2.0), (2, 1, 1.0), (3, 5, 1.0), (4, 3, 0.0)]


def test_code_scan_equals_decoded_vectors():
    import numpy as np

    rng = np.random.default_rng(5)
    for dim in (6, 7, 16):
        width = 2 if dim % 2 == 0 else 1
        book = ann.Codebook(rng.normal(size=(5, dim)), rng.normal(size=(dim // width, 16, width)))
        near, scale, codes = ann.encode(book, rng.normal(size=(50, dim)))
        packed = codes[:, 0::2] | np.pad(codes[:, 1::2], ((0, 0), (0, codes.shape[1] % 2))) << 4
        q = rng.normal(size=(4, dim))
        assert np.allclose(ann.scan_codes(book, q, near, scale, packed), q @ ann.decode(book, near, scale, codes).T, atol=1e-4)


def test_token_file_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    path = str(tmp_path / "ids")
    tokens.write_ids(docs, path)
    start = 0
    read = {r["doc_id"]: r for r in tokens.read_ids(spark, path).collect()}
    crc = {r["doc_id"]: r["ids_crc32"] for r in tokens.read_ids(spark, path, digest=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert read[i]["ids"] == ids and (read[i]["start"], read[i]["n_tokens"]) == (start, len(ids))
        assert crc[i] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        start += len(ids)
    tokens.write_ids(none, str(tmp_path / "none"))
    assert tokens.read_ids(spark, str(tmp_path / "none")).count() == 0
    shard = spark.read.parquet(path).filter("n_docs > 0").first().asDict()
    doc_ids = tokens.decoded_shard(shard)[0]
    assert tokens.decode_document(shard, len(doc_ids) - 1).tolist() == read[doc_ids[-1]]["ids"]


def test_repair_shortens_and_expands():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, 40_000).astype(np.int32)
    lengths = np.full(400, 100)
    g = tokens.repair(ids, lengths, 6, pairs=16)
    assert len(g.sequence) < 25_000 and len(g.starts) == 400
    assert (tokens.expanded(g.sequence.astype(np.int64), *tokens.flattened(g.rules, g.expansions, 6)) == ids).all()


def test_repair_goes_on_until_no_pair_is_there_twice(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    for high, n, room in ((6, 3_000, 1 << 17), (300, 3_000, 1 << 17), (1, 40, 1 << 17), (300, 3_000, 8)):
        monkeypatch.setattr(tokens, "AT_ONCE", room)
        ids = rng.integers(0, high, n).astype(np.int32)
        ids[-n // 4 :] = ids[: n // 4]  # copies of documents
        lengths = np.full(n // 20, 20)
        g = tokens.repair(ids, lengths, high)
        starts, sizes, flat = tokens.flattened(g.rules, g.expansions, high)
        assert (tokens.expanded(g.sequence.astype(np.int64), starts, sizes, flat) == ids).all()
        own = np.split(g.sequence, g.starts[1:])
        assert [int(sizes[x].sum()) for x in own] == lengths.tolist()
        pairs = [p for x in own for p in zip(x.tolist(), x[1:].tolist())]
        assert len(set(pairs)) == len(pairs) and len(g.rules)
    g = tokens.repair(np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 0], dtype=np.int32), np.array([10]), 5)
    assert g.rules.tolist() == [[1, 2], [5, 3]] and g.sequence.tolist() == [6, 5, 4, 6, 0]
    assert not len(tokens.repair(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), 5).sequence)


def test_piece_ids_match_the_library(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    twice = docs.unionAll(docs.limit(8)).withColumn("key", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("word", F.lit("x"))  # repeated rows, clashing names
    for limit in (10**6, 5, 0):
        assert sorted(pieces.encode(docs, head_words=limit, decoded=True).collect()) == sorted(pieces.decode(pieces.encode(docs, head_words=limit)).collect())
        got = pieces.decode(pieces.encode(twice, head_words=limit)).collect()
        assert len(got) == len(TEXTS) + 8
        for r in got:
            text = TEXTS[r["doc_id"]] or ""
            assert r["ids"] == library.encode(text) and r["decoded"] == text
    keyless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(map(str, pieces.encode(keyless, head_words=3).select("ids").collect())) == sorted(map(str, pieces.encode(docs, head_words=3).select("ids").collect()))
    assert pieces.encode(none).count() == 0


def test_words_are_cut_where_no_piece_goes_on():
    model = pieces.load()
    cutter = pieces.Cutter(model)
    for part in ("lich\u00df\u00e4heit", "\u00e9\u00e8oi,***", "\u00e4%%%"):
        words = cutter.words(part)
        assert "".join(words) == " " + part and len(words) > 1
        assert all(a + b in model.pairs() for w in words for a, b in zip(w.replace(" ", pieces.SPACE), w.replace(" ", pieces.SPACE)[1:]) if not w.isascii())
        assert [i for w in words for i in pieces.bpe_word(model, model.known(), w.replace(" ", pieces.SPACE))] == pieces.bpe_word(model, model.known(), pieces.SPACE + part)


def test_texts_travel_many_in_a_row():
    import pyarrow as pa
    import sentencepiece

    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [None, "", *(f"the word w{i} \u00e9\u00df x{i % 7}\n and" for i in range(198))]
    ids_of = lambda word: pieces.bpe_word(model, model.known(), word.replace(" ", pieces.SPACE))
    for common in ([], [" the", " word", " and"]):
        sink, table = pa.BufferOutputStream(), pa.table({"word": pa.array(common, pa.string()), "ids": pa.array([ids_of(w) for w in common], pa.list_(pa.int16()))})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        head = pieces.Head(sink.getvalue().to_pybytes())
        coder = pieces.Coder(model, head, most=50)
        rows = list(pieces._looked_up(pa.record_batch({"key": pa.array(range(200), pa.int64())}), texts, coder))
        assert sum(r.num_rows for r in rows) == -(-200 // pieces.CHUNK)
        asked = list(pieces._rest_words(rows))
        assert all(len(set(x.column("word").to_pylist())) == x.num_rows for x in asked)
        told = [[{"place": p, "ids": ids_of(w)} for p, w in zip(x.column("place").to_pylist(), x.column("word").to_pylist())] for x in asked]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("ids", pa.list_(pa.int16()))]))
        got = [pieces._filled(r.append_column("told", pa.array([t], kind)), 0, head, "key") for r, t in zip(rows, told)]
        assert [i for x in got for i in x.column("key").to_pylist()] == list(range(200))
        assert [i for x in got for i in x.column("ids").to_pylist()] == [library.encode(t or "") for t in texts]
        assert len(coder.places) <= 50 + len({p for t in texts if t for p in coder.cutter.parts(t)})


def test_near_copies_meet_several_texts(spark):
    n = 40
    leaves = spark.createDataFrame([(i, 10, [1, 2, 3, 4], 0) for i in range(n)] + [(n, 0, [], 0)], "digest long, size long, hubs array<long>, f0 long")
    pairs = [tuple(r) for r in simhash._star_pairs(leaves, ["f0"], 64, 0.8).collect()]
    degree = {i: sum(i in p for p in pairs) for i in range(n + 1)}
    assert sum(d >= n - 1 for d in degree.values()) > 3 and min(degree[i] for i in range(n)) > 1 and not degree[n]
    assert len(pairs) <= 10 * n


def test_head_is_bounded(spark):
    known = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(3000)], "word string, n long")
    for most in (0, 1, 10, 500, 2999, 3000):
        assert known.filter(pieces.head_of(known, most)).count() <= most
    assert known.filter(pieces.head_of(known, 3000)).count() == 3000


def test_viterbi_fold(spark):
    model = pieces.Model([("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.7, 1), ("ab", -3.1, 1), ("▁a", -4.0, 1), ("ba", -3.3, 1), ("▁abab", -7.9, 1)], True, True)
    rng = random.Random(4)
    made = ["".join(rng.choices("aabbc", k=rng.randint(1, 12))) for _ in range(60)]
    words = spark.createDataFrame([("▁" + w,) for w in dict.fromkeys(made)], "word string")
    for word, ids in pieces.encode_words(words, model).collect():
        assert ids == pieces.unigram_word(model, model.known(), word), word


def test_lm_scores(spark, docs, none):
    for r in lm.score(docs, chunk_words=500, bucket_words=300).collect():
        counts, total = Counter(), 0
        for t in TEXTS:
            w = words((t or "").lower())
            total += len(w)
            counts.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

        def s(g):
            return counts[g] / total if len(g) == 1 else counts[g] / counts[g[:-1]] if counts[g] >= 2 else 0.4 * s(g[1:])  # noqa: B023

        w = words((TEXTS[r["doc_id"]] or "").lower())
        want = sum(math.log(s(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))
        assert r["n_words"] == len(w) and abs(r["log_score"] - want) < 1e-9 * max(1, abs(want))
    assert lm.score(none).count() == 0


def test_toxicity_learns_held_out(spark, none):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        w = [f"w{rng.randrange(3000)}" for _ in range(60)] + ([rng.choice(["scumbag", "vermin", "idiotic"])] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(9998, None), (9999, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.fit(marks, docs)
    scored = toxicity.score(docs, index).withColumn("held", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [(r["score"] >= toxicity.CUT, truth[r["doc_id"]] == 1) for r in scored if r["held"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, toxicity.fit(marks.limit(0), none)).count() == 0


def test_toxicity_learns_from_few_examples(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    rows = [(i, f"some plain words {i}" + (" vermin" if n < 6 else "")) for n, i in enumerate(ids)]  # ten toxic ones, six of them with the word
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(spark.createDataFrame([(i, int(n < 10)) for n, i in enumerate(ids)], "doc_id long, toxic int"), docs)
    scores = dict(toxicity.score(docs, index).select("doc_id", "score").collect())
    assert min(scores[i] for i in ids[:6]) > max(scores[i] for i in ids[6:])


def brute_toxicity(examples, totals, texts, k):
    """(score, evidence) of each text from the definitions, without an index. Examples: (id, toxic, text)."""
    n1, n0 = sum(t for _, t, _ in examples), sum(1 - t for _, t, _ in examples)
    df, dt = Counter(), Counter()
    for _, toxic, text in examples:
        df.update(toxicity.words_in(text).keys())
        if toxic:
            dt.update(toxicity.words_in(text).keys())

    def weight(w):
        n, a, b = n1 + n0, dt[w], df[w] - dt[w]
        part = lambda x, row, col: x * math.log(x * n / (row * col)) if x else 0.0
        llr = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, n - a - b, n1) + part(n0 - b, n - a - b, n0))
        return (math.log((1 + n) / (1 + df[w])) + 1) * math.sqrt(max(llr, 0.0))

    def vector(text):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in toxicity.words_in(text).items() if df[w]}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    vectors = [(i, t, text, vector(text)) for i, t, text in sorted(examples)]
    shares = [totals[0] / n0, totals[1] / n1]
    base = totals[1] / sum(totals)

    def near(text):
        q, out, skipped = vector(text), [], False
        for i, t, other, v in vectors:
            if other == text and not skipped:
                skipped = True
                continue
            cosine = round(sum(x * v.get(w, 0.0) for w, x in q.items()), 12)
            if cosine > 1e-12:
                out.append((-cosine, i, t))
        return sorted(out)[:k]

    def raw(text):
        if not vector(text):
            return base
        found = near(text)
        yes, no = (sum(-c * shares[x] for c, _, t in found if t == x) for x in (1, 0))
        prior = toxicity.PRIOR * min(shares)
        return (yes + prior * base) / (yes + no + prior)

    pools = []
    for x, t in sorted((raw(text), t) for _, t, text in examples):
        pools.append([x * shares[t], t * shares[t], shares[t]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    knots = [(p[0] / p[2], min(max(p[1] / p[2], 0.001), 0.999)) for p in pools]

    def calibrated(x):
        if x <= knots[0][0]:
            return knots[0][1]
        for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
            if x <= x1:
                return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        return knots[-1][1]

    return [(calibrated(raw(t)) if vector(t) else base, [(i, -c) for c, i, _ in near(t)] if vector(t) else []) for t in texts]


def test_toxicity_against_brute_force(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(60))] + (rng.choices(["vermin", "scum", "idiot"], k=2) if toxic and i % 12 else [])
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic)), (i, 0)]  # two labels: one says toxic
    rows[8], rows[20], rows[21] = (8, rows[4][1]), (20, None), (21, "")
    rows += [(1000 + j, rows[j][1]) for j in range(0, 40, 3)] + [(2000, "vermin " * 4000), (2001, "never seen"), (2002, "VERMIN, scum!"), rows[2], rows[2]]  # copies, long texts, repeated rows
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, evidence int")
    index = toxicity.fit(spark.createDataFrame(labels, "doc_id long, toxic int"), docs, k=7)
    own = {i: max(t for j, t in labels if j == i) for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    examples = [(i, own[i], rows[i][1] or "") for i in own]
    want = brute_toxicity(examples, [list(own.values()).count(0), list(own.values()).count(1)], [t or "" for _, t in rows], 7)
    got = toxicity.score(docs, index, k=7).collect()
    assert len(got) == len(rows)
    by_id = {i: w for (i, _), w in zip(rows, want)}
    for r in got:
        score, near = by_id[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-9, r["doc_id"]
        assert [(e["example"], round(e["cosine"], 9)) for e in r["evidence"]] == [(i, round(c, 9)) for i, c in near]


def random_index(rng, n, block):
    lists = [sorted({int(rng.zipf(1.3)) % 3000 for _ in range(rng.integers(1, 60))}) for _ in range(n)]
    for j in range(n):
        if j % 3 == 0:
            lists[j] = sorted({*lists[j], 4000 + j % 5})
    counts = [rng.integers(1, 4, len(x)) for x in lists]
    return toxicity.build(range(n), [j % 3 == 0 for j in range(n)], range(n), lists, counts, block)


def test_block_max_is_exact_and_skips():
    import numpy as np

    rng = np.random.default_rng(6)
    index = random_index(rng, 1000, 16)
    dense = np.zeros((1000, len(index.terms)))
    rare = np.repeat(np.arange(len(index.terms)), np.diff(index.cut_starts[index.term_starts]))
    dense[index.postings, rare] = index.posting_weights
    dense[:, np.flatnonzero(index.common >= 0)] = index.table[:, :1000].T
    assert np.allclose((dense * dense).sum(1), 1)
    read = []
    for _ in range(60):
        at = np.unique(np.concatenate([rng.choice(len(index.terms), 12), np.searchsorted(index.terms, [4000 + rng.integers(5)])]))
        q = toxicity.weighed(rng.integers(1, 4, len(at)).astype(float), index.weight[at])
        sims = np.round(dense[:, at] @ q, 12)
        without = int(rng.integers(-1, 1000))
        want = sorted((-s, index.ids[i]) for i, s in enumerate(sims) if s > 1e-12 and i != without)[:7]
        near, visited = toxicity.nearest(index, at, q, 7, without, 16)
        assert [(round(-c, 9), i) for c, i in want] == [(round(c, 9), index.ids[j]) for c, j in near]
        read.append(visited)
    blocks = index.table.shape[1] // 16
    assert sum(read) < 0.8 * 60 * blocks and sum(2 * r < blocks for r in read) >= 15


def test_common_words_have_no_postings_and_ties_are_exact():
    import numpy as np

    rng = np.random.default_rng(8)
    lists = [np.unique(np.concatenate([rng.choice(600, 40), [1000 + j % 3]])) for j in range(900)]
    for j in range(300, 900):  # six or more copies of many examples, with other ids
        lists[j] = lists[j % 100]
    counts = [np.ones(len(x), dtype=np.int64) for x in lists]
    index = toxicity.build(range(900), [j % 3 == 0 for j in range(900)], range(900), lists, counts)
    again = toxicity.build(range(900), [j % 3 == 0 for j in range(900)], range(900), [np.searchsorted(index.terms, x.astype(np.uint64)) for x in lists], counts, terms=index.terms)
    assert all(np.array_equal(a, b) for a, b in zip(index, again))
    n = np.bincount(np.searchsorted(index.terms, np.concatenate(lists).astype(np.uint64)))
    assert (index.common[n >= 0.04 * 900] >= 0).all() and index.n_common > 256
    table = index.table
    for j in range(0, 900, 50):
        at = np.searchsorted(index.terms, lists[j].astype(np.uint64))
        q = toxicity.weighed(counts[j].astype(float), index.weight[at])
        whole = np.zeros(len(index.terms))
        whole[at] = q
        exact = table.T @ whole[np.flatnonzero(index.common >= 0)]
        np.add.at(exact, index.postings, index.posting_weights * np.repeat(whole, np.diff(index.cut_starts[index.term_starts])))
        want = sorted((-round(c, 12), index.ids[i]) for i, c in enumerate(exact) if c > 1e-12)[:15]
        near, _ = toxicity.nearest(index, at, q, 15)
        assert [(round(-c, 9), i) for c, i in want] == [(round(c, 9), index.ids[i]) for c, i in near]


def test_clashing_names(spark, docs):
    extra = "_text _words _norm _units _best _lines _windows _sorted _starts _uses _use _position _positions _mixed_key key text_ n rank licenses score_ a.b".split()
    odd = docs
    for c in extra:
        odd = odd.withColumn(c, F.lit(1))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(quality.quality_rules(odd).select("doc_id", "n_repeat_words", "kept")) == plain(quality.quality_rules(docs).select("doc_id", "n_repeat_words", "kept"))
    assert plain(licenses.scan(odd).select("doc_id", "licenses")) == plain(licenses.scan(docs).select("doc_id", "licenses"))
    assert plain(mixing.training_order(odd, mixing.mix(odd)).select(*docs.columns)) == plain(mixing.training_order(docs, mixing.mix(docs)))
    assert sharding.assign_shards(odd, "a.b").select("shard").distinct().count() == 1
    assert plain(simhash.dedup(odd)) == plain(simhash.dedup(docs)) and plain(simhash.near_duplicates(odd)) == plain(simhash.near_duplicates(docs))
    assert plain(lm.score(odd)) == plain(lm.score(docs))
    nulls = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    assert quality.quality_rules(nulls).count() == licenses.scan(nulls).count() == mixing.mix(nulls).count() == sharding.assign_shards(nulls, "doc_id").count() == len(TEXTS)


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    nulls = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        for given in (docs, none, docs.unionAll(docs), nulls):
            out = stage(spark, given, str(tmp_path))
            assert given is not none or out.count() == 0
            assert set(r["doc_id"] for r in out.collect()) <= set(r["doc_id"] for r in given.collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
        docs = out
    assert docs.count() > 100


def test_pipeline_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    import corpus_pipeline

    clash = ["score", "evidence", "kept", "n_words", "base_failed", "component_id", "a.b", "c0", "taken", "position", "_text", "digest"]
    wide = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in clash))
    spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, docs, str(tmp_path)), stage(spark, wide, str(tmp_path))
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in plain.collect()), name
        if name != "sentencepiece":
            assert out.columns == wide.columns
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in out.collect() for c in clash), name


def test_toxicity_fit_leaves_word_lists_to_the_tasks(spark):
    import tracemalloc

    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(vocabulary, 3000))) for i in range(0, 300)], "doc_id long, text string").repartition(3).cache()
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs.count()
    tracemalloc.start()
    model = toxicity.fit(marks, docs)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 8e6  # of some 600,000 words, 7 MB of hashes and counts
    assert model.n_examples == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))


def test_packed_parts_make_the_index_of_all_examples():
    import numpy as np

    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 2**63, 5).astype(np.uint64) % np.uint64(97)) for _ in range(40)] + [np.zeros(0, dtype=np.uint64)]
    counts = [rng.integers(1, 9, len(x)).astype(np.uint32) for x in lists]
    toxic, texts = [i % 4 == 0 for i in range(41)], np.arange(41, dtype=np.uint64) * np.uint64(7)
    want = toxicity.build(range(41), toxic, texts, lists, counts)
    part = lambda a, b: toxicity.packed(range(a, b), toxic[a:b], texts[a:b], lists[a:b], counts[a:b])
    got = toxicity.Packed([part(20, 41), part(0, 7), part(7, 20)]).index()
    for name, a, b in zip(want._fields, want, got):
        assert np.array_equal(a, b), name


def test_common_words_alone_bound_the_blocks():
    import numpy as np

    rng = np.random.default_rng(12)
    index = random_index(rng, 1000, 16)
    common, read = np.flatnonzero(index.common >= 0), []
    for _ in range(40):
        at = np.sort(rng.choice(common, 4, replace=False))
        q = toxicity.weighed(rng.integers(1, 4, len(at)).astype(float), index.weight[at])
        sims = np.round(q @ index.table[index.common[at], :1000], 12)
        without = int(rng.integers(-1, 1000))
        want = sorted((-s, index.ids[i]) for i, s in enumerate(sims) if s > 1e-12 and i != without)[:7]
        near, visited = toxicity.nearest(index, at, q, 7, without, 16)
        assert [(round(-c, 9), i) for c, i in want] == [(round(c, 9), index.ids[j]) for c, j in near]
        read.append(visited)
    assert sum(read) < 0.2 * 40 * (index.table.shape[1] // 16)


def test_repair_gives_its_memory_back():
    import os
    import subprocess
    import sys

    code = """
import re
import numpy as np
from textloom.llm import tokens
from textloom.llm.common import hand_back
rng = np.random.default_rng(2)
ids, lengths = np.minimum(rng.zipf(1.3, 400_000), 20_000).astype(np.int32), np.full(400, 1000)
held = []
for _ in range(5):
    tokens.repair(ids, lengths, 20_001)
    hand_back()
    held.append(sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024)
print(held[4] - held[1])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"TOKENIZERS_PARALLELISM": "false"})
    assert float(out.stdout) < 9, out.stdout  # MB that three more shards leave in the process
