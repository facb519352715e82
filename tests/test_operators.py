"""Ranges, graph, search, views, stores, texts and streams against hand-computed values and brute force."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import grounding as GR
from textloom.operators import index_store as X
from textloom.operators import library as L
from textloom.operators import links as K
from textloom.operators import markup as M
from textloom.operators import paths as P
from textloom.operators import planning as PL
from textloom.operators import ranges as R
from textloom.operators import search as S
from textloom.operators import sessions as SE
from textloom.operators import views as V
from textloom.sources import metadata, model, packages, store, texts
from textloom.streaming import events
from textloom.streaming import text as stream_text

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- ranges


def random_ranges(rng, n):
    made = [(rng.randrange(3), s := rng.randrange(40), s + rng.randrange(4), rng.choice([None, round(rng.random(), 3)]), i) for i in range(n)]
    return made


def test_ranges_merge(spark):
    rng = random.Random(2)
    made = random_ranges(rng, 60)
    df = spark.createDataFrame(made, "chapter_id long, start long, end long, score double, rank long")
    groups = []
    for c in range(3):
        for r in sorted((x for x in made if x[0] == c), key=lambda x: (x[1], x[2])):
            if groups and groups[-1][0] == c and r[1] <= groups[-1][2] + 1:
                g = groups[-1]
                g[2] = max(g[2], r[2])
                g[3].append(r)
            else:
                groups.append([c, r[1], r[2], [r]])
    best = lambda g: max((r[3] for r in g[3] if r[3] is not None), default=None)
    assert sorted(map(tuple, R.merge_ranges(df).collect()), key=str) == sorted(((g[0], g[1], g[2], best(g)) for g in groups), key=str)
    got = sorted(map(tuple, R.merge_in_order(df, "rank").collect()))
    assert sorted((g[0], min(r[4] for r in g[3]), g[1], g[2], best(g)) for g in groups) == sorted((c, rank, s, e, b) for c, rank, s, e, b in got)


def test_offsets_and_places(spark):
    lines = [(1, 0, "abc"), (1, 1, ""), (1, 2, "defgh"), (2, 0, "x")]
    df = spark.createDataFrame(lines, "chapter_id long, sentence_index int, text string")
    assert rows(R.offsets(df), "chapter_id", "sentence_index", "start_offset", "end_offset") == [(1, 0, 0, 3), (1, 1, 4, 4), (1, 2, 5, 10), (2, 0, 0, 1)]
    at = spark.createDataFrame([(1, o) for o in (0, 3, 4, 5, 10, 99)], "chapter_id long, offset long")
    assert rows(R.sentence_at(at, df), "offset", "sentence_index") == [(0, 0), (3, 0), (4, 1), (5, 2), (10, 2), (99, 2)]
    strict = {r["offset"]: r["sentence_index"] for r in R.sentence_at(at, df, strict=True).collect()}
    assert strict == {0: 0, 3: 1, 4: 2, 5: 2, 10: None, 99: None}
    spans = spark.createDataFrame([(1, 2, 6), (1, 3, 4)], "chapter_id long, span_start long, span_end long")
    assert rows(R.overlapping(spans, df), "span_start", "sentence_index") == [(2, 0), (2, 1), (2, 2)]  # 3 to 4 is the character between two
    assert rows(R.neighbour_texts(df.filter("chapter_id = 1")), "sentence_index", "before_text", "after_text") == [(0, "", ""), (1, "abc", "defgh"), (2, "", "")]


def test_windows_hold_near_mentions(spark):
    lengths = spark.createDataFrame([(1, 80), (2, 5), (3, 0)], "chapter_id long, n int")
    windows = R.hopping_windows(lengths, 20, 7)
    assert rows(windows.filter("chapter_id = 2")) == [(2, 0, 5)]
    mentions = spark.createDataFrame([(1, f"m{i:02d}", i, i + 1) for i in range(80)], "chapter_id long, mention_id string, range_start long, range_end long")
    found = [set(r["mentions"]) for r in R.mentions_in_windows(windows, mentions).collect()]
    assert all(any({f"m{i:02d}", f"m{j:02d}"} <= w for w in found) for i in range(80) for j in range(i + 1, min(80, i + 7)))


def test_fragments(spark):
    words = [300, 301, 700, 1, 599, 600, 1]
    df = spark.createDataFrame([(1, i, "x", w) for i, w in enumerate(words)], "chapter_id long, sentence_index long, text string, words_count long")
    cut = R.fragments(df)
    assert rows(cut, "sentence_index", "fragment_id") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6)]
    assert rows(R.fragment_counts(cut)) == [(1, sum(words), 6)]
    assert [tuple(r)[1:] for r in R.fragment_neighbours(cut).orderBy("fragment_id").collect()][:2] == [(0, None, 1), (1, 0, 2)]
    blank = spark.createDataFrame([(1, 0, " ", 5), (1, 1, "a", 5)], "chapter_id long, sentence_index long, text string, words_count long")
    assert R.fragments(blank, skip_blank=True).count() == 1


def test_page_hits_coalesce(spark):
    page = spark.createDataFrame([(1, "source", 4, 0.1, 1), (1, "source", 5, 0.9, 2), (1, "summary", 5, 0.5, 3), (1, "source", 9, 0.2, 4)], "chapter_id long, kind string, sentence_index long, score double, rank long")
    assert rows(R.coalesced_hits(page), "rank", "start", "end", "score") == [(1, 4, 5, 0.9), (3, 5, 5, 0.5), (4, 9, 9, 0.2)]


# --- graph


def chunks(spark, made):
    return spark.createDataFrame(made, "chapter_id long, chunk_id long, sentence_index long, label string, words_count long, retention string, importance string, weight double, generation long")


def edges(spark, made):
    return spark.createDataFrame(made, "from_id long, to_id long, strength string, weight double")


def test_weights(spark):
    made = chunks(spark, [(1, 1, 0, "a", 8, "verbatim", "critical", 0.0, 0), (1, 2, 1, "b", 5, "relevant", "helpful", 0.0, 0), (1, 3, 2, "c", 5, None, None, 0.0, 0)])
    assert rows(G.chunk_weights(made), "chunk_id", "weight") == [(1, 36.0), (2, 2.0), (3, 0.0)]
    given = spark.createDataFrame([(1, 10.0), (2, 6.0), (3, 4.0)], "chunk_id long, weight double")
    got = dict(((r[0], r[1]), r[2]) for r in G.edge_weights(edges(spark, [(1, 2, "critical", 0.0), (1, 3, None, 0.0)]), given).collect())
    assert got == {(1, 2): 10 * 9 / 10 + 6, (1, 3): 10 * 1 / 10 + 4}


def test_incisions(spark):
    made = chunks(spark, [(1, 1, 1, "a", 1, None, None, 5.0, 0), (1, 2, 2, "b", 1, None, None, 5.0, 0)])
    segments = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "chapter_id long, start_sentence_index long, words_count long")
    alone = G.normalize_incisions(G.incisions(segments, made, edges(spark, [])))
    assert rows(alone) == [(1, 1, 10, 0, 0), (1, 2, 20, 0, 0)]
    joined = G.incisions(segments, made, edges(spark, [(1, 2, None, 2.0)]))
    assert rows(joined) == [(1, 1, 10, 0.0, 5.0), (1, 2, 20, 5.0, 0.0)]
    assert rows(G.normalize_incisions(joined)) == [(1, 1, 10, 0, 10), (1, 2, 20, 10, 0)]
    many = spark.createDataFrame([(1, i, 1, float(i + 1), 0.0) for i in range(100)], "chapter_id long, start_sentence_index long, words_count long, start_incision double, end_incision double")
    levels = [r["start_incision"] for r in G.normalize_incisions(many).orderBy("start_sentence_index").collect()]
    want = [10 if v >= 99 else max(1, min(10, math.floor(1 + math.log(v) / math.log(98) * 9 + 0.5))) for v in range(1, 101)]
    assert levels == want


def test_groups(spark):
    info = lambda made: spark.createDataFrame([(1, *m) for m in made], "chapter_id long, start_sentence_index long, words_count long, start_incision double, end_incision double")
    plain = info([(i, 40, 0.0, 0.0) for i in (1, 2, 3)])
    assert rows(G.segment_groups(plain, 100), "start_sentence_index", "end_sentence_index") == [(1, 2), (3, 3)]
    strong = info([(1, 20, 0.0, 1.0), (2, 20, 0.0, 9.0), (3, 20, 9.0, 0.0), (4, 20, 0.0, 0.0)])
    assert rows(G.segment_groups(strong, 60), "start_sentence_index", "end_sentence_index") == [(1, 2), (3, 4)]
    rng = random.Random(4)
    for _ in range(200):
        n, budget = rng.randint(1, 9), rng.randint(1, 60)
        words, a, b = ([rng.choice([0, 1, 5, 30]) for _ in range(n)] for _ in range(3))
        cuts = G.split_points(words, a, b, budget)
        assert [i for x, y in cuts for i in range(x, y + 1)] == list(range(n))
        assert all(sum(words[x : y + 1]) <= budget or x == y or not any(b[i] + a[i + 1] > 0 for i in range(x, y)) for x, y in cuts)


def test_clusters(spark):
    rng = random.Random(8)
    made = [(1, i, i, f"l{i}", rng.randint(30, 90), rng.choice(["verbatim", None]), rng.choice(["critical", None]), rng.random() * 9, 0) for i in range(24)]
    links = [(i, j, rng.choice(["critical", "helpful", None]), 1.0) for i in range(24) for j in range(i) if rng.random() < 0.12 and i // 12 == j // 12]
    c, e = chunks(spark, made).withColumn("group_id", F.lit(0).cast("long")), edges(spark, links)
    parts = dict(rows(G.components(c, e), "chunk_id", "component"))
    changed, want = True, {i: i for i in range(24)}
    while changed:
        changed = False
        for a, b, *_ in links:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert parts == want
    found = G.snakes(c, e)
    clusters: dict[int, list] = {}
    for i, local, at in sorted(rows(found, "chunk_id", "local_id", "position"), key=lambda r: r[1:]):
        clusters.setdefault(local, []).append(i)
    assert sorted(i for ids in clusters.values() for i in ids) == list(range(24))
    assert all(sum(made[i][4] for i in ids) <= G.SNAKE_WORDS or len(ids) == 1 for ids in clusters.values())
    assert all(len({parts[i] for i in ids}) == 1 and ids == sorted(ids) for ids in clusters.values())
    records = {r["local_id"]: r for r in G.snake_records(found, c).collect()}
    assert all(records[k]["size"] == len(ids) and records[k]["first_label"] == f"l{ids[0]}" and records[k]["last_label"] == f"l{ids[-1]}" for k, ids in clusters.items())
    owner = {i: k for k, ids in clusters.items() for i in ids}
    sums: dict = {}
    for a, b, _, w in links:
        if owner[a] != owner[b]:
            pair = tuple(sorted((owner[a], owner[b]), key=lambda k: clusters[k][0]))
            sums[pair] = sums.get(pair, 0) + w
    assert {(r["from_local"], r["to_local"]): r["weight"] for r in G.snake_edges(found, c, e).collect()} == sums
    merged = G.clues(found, c, most=4).collect()
    assert len(merged) <= 4 and abs(sum(r["weight"] for r in merged) - 1) < 1e-9 and sorted(s for r in merged for s in r["sources"]) == sorted(clusters)
    prints = G.Component([dict(zip(("chapter_id", "chunk_id", "sentence_index", "label", "words_count", "retention", "importance", "weight"), m)) for m in made], [dict(zip(("from_id", "to_id", "strength"), x)) for x in links]).fingerprint(0)
    assert abs(sum(prints.values()) - 1) < 1e-9 and set(prints) == {i for i in range(24) if want[i] == want[0]}


def test_paths_and_neighbours(spark):
    e = edges(spark, [(1, 2, None, 1.0), (1, 3, None, 1.0), (2, 4, None, 1.0), (3, 4, None, 1.0), (4, 5, None, 1.0), (5, 1, None, 1.0), (9, 9, None, 1.0)])
    assert P.shortest_path(e, 1, 5) == [1, 2, 4, 5] and P.shortest_path(e, 1, 1) == [1] and P.shortest_path(e, 1, 9) == []
    assert rows(G.neighbours(e, "in").filter("node = 4"), "other") == [(2,), (3,)] and G.neighbours(e).count() == 14
    assert rows(G.oriented_edges(e)) == [(2, 1), (3, 1), (4, 2), (4, 3), (5, 1), (5, 4)]


def breadth_first(links, start, end):
    before, queue = {start: None}, [start]
    for x in queue:
        for y in sorted({b for a, b in links if a == x}):
            if y not in before:
                before[y] = x
                queue.append(y)
    path = [end] if end in before else []
    while path and path[0] != start:
        path.insert(0, before[path[0]])
    return path


@pytest.mark.parametrize(("span", "most"), [(4096, 100_000), (7, 5)])
def test_shortest_paths_against_breadth_first(spark, span, most):
    rng = random.Random(span)
    graphs = {g: [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.choice((25, 45, 90)))] for g in range(5)}  # cycles, loops, ties, no way
    graphs[5] = [(0, i) for i in range(1, 25)] + [(i, 25) for i in range(1, 25)]  # a hub
    pairs = [(i, g, rng.randrange(26), rng.randrange(26)) for i, g in enumerate(sorted(graphs) * 3)] + [(99, 5, 0, 25), (100, 0, 3, 3), (101, 77, 1, 1), (102, 77, 1, 2)]
    e = spark.createDataFrame([(g, a, b) for g, links in graphs.items() for a, b in links] + [(0, None, 3)], "group long, from_id long, to_id long")
    got = {}
    for r in P.shortest_paths(e, spark.createDataFrame(pairs, "path long, group long, start long, end long"), span, most).orderBy("path", "position").collect():
        got.setdefault(r["path"], []).append(r["node"])
    assert {p: breadth_first(graphs.get(g, []), a, b) for p, g, a, b in pairs} == {p: got.get(p, []) for p, *_ in pairs}


def test_shortest_path_has_no_longest_length(spark):
    links = [(i, i + 1) for i in range(1000)] + [(i, i - 3) for i in range(3, 1000)]
    e = spark.createDataFrame(links, "from_id long, to_id long")
    assert P.shortest_path(e, 0, 1000) == list(range(1001))


def test_attention(spark):
    near = {4: [2, 3], 2: [1], 3: [1]}
    forward = G.spread([4], near, {4: 1.0})
    assert forward == {4: 1.0, 2: 0.5, 3: 0.5, 1: 1.0}
    assert G.attended([(1, 0), (2, 0), (3, 1), (4, 2)], [4], near, 2, 0.5)[0] in (1, 2)
    assert G.attended([(1, 0), (2, 0)], [], {}, 1, 0.5) == [1]
    c = chunks(spark, [(1, i, i, "l", 5, None, None, 0.0, (i - 1) // 2) for i in range(1, 5)])
    got = G.working_memory(c, edges(spark, [(4, 2, None, 1.0), (3, 1, None, 1.0), (2, 1, None, 1.0)]), capacity=1)
    assert [(g, k) for g, _, k in rows(got, "generation", "chunk_id", "kind")] == [(0, "previous"), (0, "previous"), (1, "extra"), (1, "previous"), (1, "previous")]


# --- an archive


@pytest.fixture(scope="module")
def wiki(spark):
    lines = ["An LLM Wiki exposes pages, links, and source fragments to agents.", "维基百科的图谱可以被检索。", "Source-only archives should be searchable."]
    t = lambda data, schema: spark.createDataFrame(data, schema)
    return model.Archive(
        t([("w", 1, 1, "Introduction")], "archive string, chapter_id long, document_order long, title string"),
        t([("w", "source", 1, i, x, len(x.split())) for i, x in enumerate(lines)] + [("w", "summary", 1, 0, "A summary of wiki pages.", 5)], "archive string, kind string, chapter_id long, sentence_index int, text string, words_count long"),
        t([("w", "m1", 1, 0, 0, "LLM Wiki", "Q1"), ("w", "m2", 1, 0, 1, "agents", "Q2"), ("w", "m3", 1, 2, 0, "archives", "Q3"), ("w", "m4", 1, 2, 1, "wiki", "Q1")], "archive string, mention_id string, chapter_id long, sentence_index int, position int, surface string, qid string"),
        t([("w", "l1", "m1", "m2", "serves"), ("w", "l2", "m3", "m4", "part_of"), ("w", "l3", "m1", "m1", "is")], "archive string, link_id string, source_id string, target_id string, predicate string"),
        t([("w", "l1", 1, 0), ("w", "l2", 1, 2), ("w", "l3", 1, 0)], "archive string, link_id string, chapter_id long, sentence_index int"),
        t([("w", 1, 100, 0, "Wiki pages", lines[0], 7, None, None, 1.0), ("w", 1, 101, 2, "Source search", lines[2], 7, None, None, 2.0)], "archive string, chapter_id long, chunk_id long, sentence_index int, label string, content string, words_count long, retention string, importance string, weight double"),
        t([("w", 100, 1, 0), ("w", 101, 1, 2)], "archive string, chunk_id long, chapter_id long, sentence_index int"),
        t([("w", 101, 100, "critical", 0.1)], "archive string, from_id long, to_id long, strength string, weight double"),
    )


@pytest.fixture(scope="module")
def index(wiki):
    return S.build(S.projection(wiki))


def found(hits):
    return [(r["kind"], r["sentence_index"], r["level"]) for r in hits.collect()]


def test_search_levels(wiki, index):
    assert index.n == 1 + 4 + 4 + 4
    assert {(k, l) for k, _, l in found(S.search(index, "pages"))} == {("source", 1), ("summary", 1), ("chunk-label", 1), ("chunk-content", 1)}
    assert ("source", 2, 2) in found(S.search(index, "archiving"))  # by its stem
    assert [k for k in found(S.search(index, "维基百科", records="text"))] == [("source", 1, 1)]
    assert found(S.search(index, "科", records="text")) == [("source", 1, 3)]
    both = S.search(index, "wiki pages", match="all", records="text")
    assert found(both.orderBy(*S.ORDER)) == [("summary", 0, 1), ("source", 0, 1)]  # the shorter text first
    assert found(S.search(index, "wiki searchable", match="all", records="text")) == []
    ranks = [(r["level"], r["rank"]) for r in S.search(index, "wiki pages searchable", limit=99).collect()]
    assert ranks == sorted(ranks)
    first = S.search(index, "wiki pages", limit=1).collect()[0]
    rest = S.search(index, "wiki pages", after=tuple(first[c] for c in S.ORDER))
    assert rest.count() == S.search(index, "wiki pages").count() - 1
    assert S.search(index, "the of").count() == 0 and S.search(index, "").count() == 0
    assert S.query_terms(wiki.chapters.sparkSession, "Wiki Pages wiki") == ["wiki", "pages", "pag"]


def test_bm25(wiki, index):
    hit = {(r["kind"], r["sentence_index"]): r for r in S.search(index, "searchable", records="text").collect()}[("source", 2)]
    every = S.projection(wiki).select(*S.RECORD, F.col("text")).collect()
    df = sum("searchable" in r["text"].lower() for r in every)
    length = index.postings.filter("record = 'text' AND sentence_index = 2").first()["length"]
    idf = max(1e-6, math.log((index.n - df + 0.5) / (df + 0.5)))
    assert abs(-hit["rank"] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / index.mean_length))) < 1e-9


def test_views(wiki, index):
    hits = V.find(wiki, index, "wiki").orderBy(*V.search_order()).collect()
    assert [h["type"] for h in hits][:1] == ["entity"] and hits[0]["id"] == "Q1"  # entities come before nodes, nodes before sentences
    assert [h["type"] for h in hits] == sorted((h["type"] for h in hits), key=lambda t: V.SEARCH_BUCKETS[t])
    assert V.displayed(wiki, V.find(wiki, index, "wiki"), "wiki").count() == len(hits)
    got, after = V.page(V.collection(wiki), V.list_order(), limit=2)
    assert (got[0]["id"], got[0]["title"]) == ("Q1", "LLM Wiki") and V.parse_cursor(after) == 2
    rest = V.page(V.collection(wiki), V.list_order(), limit=50, after=after)
    assert rest[1] is None and len(rest[0]) == V.collection(wiki).count() - 2
    with pytest.raises(ValueError):
        V.parse_cursor("nonsense")
    back = V.collection(wiki, ["node"]).orderBy(*V.list_order("doc-desc")).collect()
    assert [r["id"] for r in back] == ["101", "100"]
    assert rows(V.related_to_entity(wiki, "Q1"), "id", "role") == [("Q1/is/Q1", "self"), ("Q1/serves/Q2", "subject"), ("Q3/part_of/Q1", "object")]
    assert rows(V.related_to_entity(wiki, "Q1", "subject"), "id") == [("Q1/serves/Q2",)]
    assert [tuple(r) for r in V.related_to_node(wiki, 100).collect()] == [("in", 2.0, 101, "Source search")]
    assert rows(V.related_by_query(wiki, index, "Q1", "wiki agents"), "id")  # its own surface doesn't count, agents does
    assert rows(V.triples_by_query(wiki, "part"), "link_id") == [("l2",)]
    assert rows(V.backlinks(wiki, 1, 0, 0), "type", "id") == [("entity", "Q1"), ("entity", "Q2"), ("node", "100"), ("triple", "Q1/is/Q1"), ("triple", "Q1/serves/Q2")]
    spans = V.evidence_of(wiki, "entity", "Q1")
    assert rows(spans, "start", "end") == [(0, 0), (2, 2)]
    page, after = V.evidence_page(wiki.only("w"), spans, context=0, limit=1)
    assert page[0]["text"].startswith("An LLM Wiki") and after is not None
    whole, none = V.evidence_page(wiki, spans, context=1)
    assert len(whole) == 1 and (whole[0]["start"], whole[0]["end"]) == (0, 2) and none is None
    shown, total = V.evidence_preview(wiki, spans, limit=1, context=0)
    assert total == 2 and len(shown) == 1
    assert rows(V.scored_ranges(spans, index, "searchable"), "start") == [(2,)]
    assert V.object_page(wiki, "node", "100")["title"] == "Wiki pages" and V.object_page(wiki, "node", "7") is None
    assert V.object_page(wiki, "source", "source/1#1..3")["text"].count(".") == 2
    made = V.pack(wiki, "entity", "Q1", budget=9)
    assert made["budget"] == 9 and made["evidence"]["total"] == 2 and len(made["related"]) == 3
    assert rows(V.counts(wiki)) == [("w", 2, 1, 1)]
    assert rows(S.grep(wiki, " WIKI pages "), "type", "id") == [("node", "100"), ("summary", "1:0")]
    assert rows(S.lexical_mentions(wiki.mentions, "wiki"), "mention_id") == [("m1",), ("m4",)]
    assert S.lexical_mentions(wiki.mentions, "w_k%").count() == 0
    assert rows(S.triples_matching(S.triples_of(wiki), **S.parse_triple_pattern("triple/_/part_of")), "link_id") == [("l2",)]
    with pytest.raises(ValueError):
        S.parse_triple_pattern("triple/a/b/c/d")


def test_hit_filters_and_pages(spark):
    hits = spark.createDataFrame([("chapter-title", "w", "1", 1, None, 1, None, 1), ("entity", "w", "a", 1, 2, 1, 0.5, 1), ("entity", "w", "b", None, 1, 1, 0.5, 1)], "type string, archive string, id string, chapter_id long, sentence_index int, document_order long, score double, match_count int")
    assert rows(V.of_types(hits, ["chapter"]), "id") == [("1",)] and rows(V.with_ids(hits, chapters=[1]), "id") == [("1",), ("a",)]
    assert [r["id"] for r in V.keyset(hits.filter("type = 'entity'"), ["score", "archive", "id"], ["score"], None, 1).collect()] == ["a"]
    assert [r["id"] for r in V.keyset(hits.filter("type = 'entity'"), ["score", "archive", "id"], ["score"], (0.5, "w", "a")).collect()] == ["b"]
    titles, entities = hits.filter("type = 'chapter-title'"), hits.filter("type = 'entity'")
    assert [r["id"] for r in V.bucket_page([titles, entities], V.search_order(), 2).collect()] == ["1", "a"]  # b has no chapter
    many = spark.createDataFrame([("e", "w", "a", 1, i, 1, s, 1, [t]) for i, (s, t) in enumerate([(0.2, "x"), (0.9, "y"), (0.1, "x")])], "type string, archive string, id string, chapter_id long, sentence_index int, document_order long, score double, match_count int, matched_terms array<string>")
    one = V.grouped_hits(many).first()
    assert one["sentence_index"] == 1 and one["matched_terms"] == ["x", "y"] and one["score"] > 0.9


def test_index_store(spark, wiki, tmp_path):
    records = S.projection(wiki)
    kept = X.IndexStore(spark, f"file://{tmp_path}/index")
    assert kept.status() == "missing"
    with pytest.raises(RuntimeError):
        kept.index()
    assert kept.rebuild(records) and kept.status() == "current" and not kept.rebuild(records)
    before = found(S.search(kept.index(), "wiki", limit=99))
    kept.mark_dirty([("w", 1)])
    assert kept.status() == "dirty" and kept.refresh(records) == 1 and found(S.search(kept.index(), "wiki", limit=99)) == before


def test_library(spark, wiki, index):
    other = model.Archive(**{n: df.withColumn("archive", F.lit("v")) for n, df in vars(wiki).items()})
    both = L.union([wiki, other])
    assert rows(L.archives_with(both, "entity", "Q3")) == [("v",), ("w",)] and rows(L.archives_with(both, "triple", "Q1/serves/Q2")) == [("v",), ("w",)]
    joint = S.build(S.projection(both))
    assert [r["archive"] for r in L.find(both, joint, "wiki", limit=4).collect()] == ["v", "v", "w", "w"]
    assert {r["type"] for r in L.find(both, joint, "wiki").collect()} == {"entity", "node"}
    assert rows(L.find(both, joint, "", pattern="triple/Q1"), "archive", "id") == [(a, f"Q1/{x}") for a in "vw" for x in ("is/Q1", "serves/Q2")]
    assert "source" not in {r["type"] for r in L.listed(both).collect()} and "source" in {r["type"] for r in L.listed(both, with_text=True).collect()}
    labels = spark.createDataFrame([("w", "Wiki")], "archive string, label string")
    assert rows(L.sources(both.chapters, labels)) == [("v", "library-archive:v"), ("w", "Wiki")]
    prints = dict(rows(L.fingerprints(S.projection(both))))
    assert len(set(prints.values())) == 2 and prints == dict(rows(L.fingerprints(S.projection(both).repartition(3))))
    assert [r["archive"] for r in L.evidence(both, "entity", "Q3").collect()] == ["v", "w"] and L.related(both, "Q1").count() == 6


def test_library_scan(spark):
    files = spark.createDataFrame([("a", "t1"), ("c", "t2"), ("d", "t3"), ("e", "t4"), ("f", None)], "relative_path string, token string")
    known = [(1, "a", "t9"), (2, "b", "t2"), (3, "g", "t3"), (4, "h", "t3"), (5, "gone", "t5")]
    register = spark.createDataFrame(known, "archive_id long, relative_path string, token string")
    got = {(r["archive_id"], r["relative_path"]): r["status"] for r in L.reconciled(files, register).collect()}
    assert got == {(1, "a"): "present", (2, "c"): "present", (None, "d"): "conflict", (None, "e"): "present", (None, "f"): "present", (3, "g"): "missing", (4, "h"): "missing", (5, "gone"): "missing"}


# --- stores and texts


def test_stores(spark, wiki):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    fresh = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n long")
    assert rows(store.upsert(old, fresh, ["k"], "n")) == [(1, "a"), (2, "d"), (3, "e")]
    left = store.without_chapters(wiki, spark.createDataFrame([(1,)], "chapter_id long"))
    assert all(df.count() == 0 for df in vars(left).values())
    meta = spark.createDataFrame([("chunk", "100", "k", "1"), ("chunk", "9", "k", "1"), ("entity", "Q9", "k", "1"), ("triple", "Q1/serves/Q2", "k", "1"), ("triple", "x", "k", "1")], "kind string, owner_id string, key string, value string")
    assert rows(store.dangling_metadata(meta, wiki), "owner_id") == [("9",), ("Q9",), ("x",)]
    parameters = spark.createDataFrame([("a",), ("b",)], "hash string")
    assert rows(store.unreferenced(parameters, spark.createDataFrame([("a", None)], "x string, y string"), "hash", ["x", "y"])) == [("b",)]
    relations = spark.createDataFrame([("m1", "m2", "Part of", [1]), ("m1", "m2", "part-of", [1]), ("m1", "m1", "x", [1]), ("m1", "m9", "x", [1]), ("m1", "m2", "mentions", [1])], "source_id string, target_id string, predicate string, evidence array<long>")
    assert rows(store.valid_relations(relations, wiki.mentions)) == [("m1", "m2", "part_of", [1])]
    table = spark.createDataFrame([("o", "a", "1")], "owner string, key string, value_json string")
    table = store.put(table, "o", "b", '{"x": 2}')
    assert store.get(table, "o") == {"a": 1, "b": {"x": 2}} and store.get(store.delete(table, "o", "a"), "o") == {"b": {"x": 2}} and store.get(store.replace_map(table, "o", {"c": "3"}), "o") == {"c": 3}
    with pytest.raises(ValueError):
        store.put(table, "o", "b", "{")


def test_trees(spark):
    tree = spark.createDataFrame([(1, None, 0, "a", "A", 1), (2, 1, 0, "x", "X", 2), (3, 1, 1, "y", "Y", None), (4, None, 1, "b", "B", 3), (5, 3, 0, "z", "Z", 4)], "node_id long, parent_id long, ord long, key string, title string, chapter_id long")
    flat = store.flattened_tree(tree)
    assert [r["path"] for r in flat.orderBy("place").collect()] == ["a", "a/x", "a/y", "a/y/z", "b"]
    assert rows(store.subtree(flat, "a/y"), "node_id") == [(3,), (5,)] and rows(store.remove_node(tree, flat, "a"), "node_id") == [(4,)]
    with pytest.raises(ValueError):
        store.move_node(tree, flat, "a", "a/y")
    moved = store.flattened_tree(store.move_node(tree, flat, "a/y", None, 1))
    assert [r["path"] for r in moved.orderBy("place").collect()] == ["a", "a/x", "y", "y/z", "b"]
    assert store.rename_node(tree, 4, "C").filter("title = 'C'").count() == 1


def test_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a guide.md").write_text("# T\r\nx")
    assert rows(texts.plain_texts(spark, f"file://{tmp_path}/in"), "title", "text") == [("a guide", "# T\nx")]
    page = "<html><style>p</style><h1 id='s'>A &amp; B</h1><p>one<br>two</p><script>no()</script><div><p>three</p></div><p id=t>four</p>"
    assert texts.html_sections(page) == ["A & B\n\none\n\ntwo\n\nthree\n\nfour"]
    assert texts.html_sections(page, ["s", "t"]) == ["A & B\n\none\n\ntwo\n\nthree", "four"]
    assert spark.createDataFrame([(page,), (None,)], "html string").select(texts.page_text(F.col("html")).alias("t")).collect()[1]["t"] is None
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="o" xmlns:d="d"><metadata><d:title>Book</d:title><d:creator>Me</d:creator></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c1" href="c1.xhtml"/><item id="c2" href="c2.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="c1"/><itemref idref="c2"/></spine></package>')
        z.writestr("o/nav.xhtml", '<html xmlns="h" xmlns:e="e"><body><nav e:type="toc"><ol><li><a href="c1.xhtml">One</a><ol><li><a href="c1.xhtml#b">Two</a></li></ol></li></ol></nav></body></html>')
        z.writestr("o/c1.xhtml", "<p>alpha</p><p id='b'>beta</p>")
        z.writestr("o/c2.xhtml", "<p>gamma</p>")
    book = texts.import_plan(texts.epub_sections(spark, f"file://{tmp_path}/b.epub")).orderBy("chapter_id").collect()
    assert [(r["chapter_id"], r["section_title"], r["text"]) for r in book] == [(1, "One", "alpha"), (2, "Two", "beta"), (3, "", "gamma")] and book[0]["authors"] == ["Me"]
    out = f"file://{tmp_path}/export"
    texts.export_text(spark.createDataFrame([(2, 1, "B", "two"), (1, 0, "A", "one")], "document_order long, depth int, title string, text string").coalesce(1), out)
    assert "\n".join(r["value"] for r in spark.read.text(out).collect()).split("\n")[:5] == ["# A", "", "one", "", "## B"]


def test_object_streams(spark, tmp_path):
    lines = [
        {"type": "meta", "schemaVersion": 1, "chapterId": 1, "stream": "knowledge-graph"}, {"type": "mention", "id": "a", "rangeStart": 0, "rangeEnd": 3, "surface": "x", "qid": "Q1"},
        {"type": "mention-link", "id": "l", "sourceMentionId": "a", "targetMentionId": "b", "predicate": "p", "evidenceSentenceIndexes": [0, 9]}, {"type": "odd"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    read = texts.read_objects(spark, f"file://{tmp_path}/s.jsonl")
    faults = {tuple(r) for r in texts.object_faults(read, sentences=5).collect()}
    assert faults == {("odd", None, "unknown type"), ("mention-link", "b", "unknown targetMentionId"), ("mention-link", "l", "evidence outside the chapter"), ("end", None, "not one end record")}
    texts.write_objects(read.filter("type = 'mention'"), f"file://{tmp_path}/out")
    back = texts.read_objects(spark, f"file://{tmp_path}/out")
    assert rows(back, "type", "id") == [("end", None), ("mention", "a")] and texts.object_faults(back).count() == 0
    (tmp_path / "bad.jsonl").write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        texts.read_objects(spark, f"file://{tmp_path}/bad.jsonl").collect()


# --- streams


def streamed(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_streamed_sentences(spark, tmp_path):
    whole = "One two. Three 3.5 now!\nFour 维基。再 end"
    pieces = [(1, i, whole[i * 5 : i * 5 + 5], False) for i in range(9)]
    schema = "text_id long, seq long, piece string, last boolean"
    for i in range(0, 9, 3):
        spark.createDataFrame(pieces[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, 9, "", True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streamed(stream_text.sentences(stream), "sentences_out")
    assert [r["text"].strip() for r in got.orderBy("sentence_index").collect()] == ["One two.", "Three 3.5 now!", "Four 维基。", "再 end"]
    spark.createDataFrame([(1, i, 200) for i in range(5)], "text_id long, sentence_index long, words_count long").coalesce(1).write.parquet(f"{tmp_path}/words")
    cut = streamed(stream_text.fragments(spark.readStream.schema("text_id long, sentence_index long, words_count long").parquet(f"{tmp_path}/words"), 400), "fragments_out")
    assert rows(cut, "sentence_index", "fragment_id") == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]


def test_event_log(spark, tmp_path):
    lines = [{"seq": i, "job_id": "j", "type": "step", "done_words": 10 * i, "total_words": 40, "input_tokens": 5} for i in range(1, 4)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    path = f"file://{tmp_path}/log"
    assert events.last_seen(spark, path) == 3
    got = streamed(events.progress(events.log(spark, path)), "progress_out", "complete").first()
    assert (got["done_words"], got["percent"], got["input_tokens"], got["last_seq"]) == (30, 75.0, 15, 3)
    assert streamed(events.log(spark, path, seen=2), "tail_out").count() == 1


def test_index_follows_changes(spark, wiki, tmp_path):
    kept = X.IndexStore(spark, f"file://{tmp_path}/index")
    kept.rebuild(S.projection(wiki))
    spark.createDataFrame([("w", 1)], "archive string, chapter_id long").coalesce(1).write.parquet(f"{tmp_path}/changes")
    changed = model.Archive(**{**vars(wiki), "chapters": wiki.chapters.withColumn("title", F.lit("Zebras"))})
    query = events.follow(spark.readStream.schema("archive string, chapter_id long").parquet(f"{tmp_path}/changes"), kept, lambda: S.projection(changed), f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    assert kept.status() == "current" and found(S.search(kept.index(), "zebras")) == [("chapter-title", None, 1)]


def test_model_of_documents(spark):
    a = model.from_documents(spark, SF)
    assert a.sentences.count() > 1000 and a.mentions.select("mention_id").distinct().count() == a.mentions.count()
    assert a.links.count() == S.triples_of(a).count() and "WindowGroupLimit" not in a.mentions._jdf.queryExecution().toString()
    groups, records, links = G.topology(a.chunks.filter("chapter_id < 3"), a.edges, a.sentences.filter("chapter_id < 3").select("chapter_id", F.col("sentence_index").alias("start_sentence_index"), "words_count"), group_words=200)
    assert groups.count() > 0 and records.agg(F.max("size")).first()[0] >= 1


def test_model_shells(spark):
    from textloom.operators import models as M

    seen = []

    def write(text, remarks):
        seen.append(len(remarks))
        return text[: 10 - len(seen)]

    answers = [[{"severity": "major", "weight": 1.0}], [{"severity": "minor", "weight": 1.0}], [{"severity": "minor", "weight": 1.0}], []]
    assert M.compressed("abcdefghijkl", write, lambda v: answers[len(seen) - 1]) == ("abcdef", 0.0, 4) and seen == [0, 1, 1, 1]
    groups = spark.createDataFrame([(1, 0, "Aa bb", 2), (1, 1, "Cc", 1), (2, 0, "Dd", 1)], "chapter_id long, group_id long, text string, fragments long")
    assert rows(M.summaries(groups, lambda t, r: t.upper(), lambda v: [])) == [(1, "AA BB\n\nCC"), (2, "Dd")]
    sentences = spark.createDataFrame([(1, i, 5 + i) for i in range(4)], "chapter_id long, sentence_index long, words_count long")
    given = [("b1", 1, "x", "L", "C", [2, 0]), ("b1", 1, "y", "L", "C", [1]), ("b2", 1, "x", " ", "C", [1]), ("b3", 1, "x", "L", "C", [9]), ("b4", 1, "x", "L", "C", [])]
    chunks, rejected = M.accepted_chunks(spark.createDataFrame(given, "batch_id string, chapter_id long, temp_id string, label string, content string, sentence_indexes array<long>"), sentences)
    assert rows(chunks, "batch_id", "temp_id", "sentence_index", "words_count") == [("b1", "x", 2, 12), ("b1", "y", 1, 6)] and rows(rejected) == [("b2",), ("b3",), ("b4",)]
    links = spark.createDataFrame([("b1", "x", "y"), ("b1", "x", "z")], "batch_id string, from_temp string, to_temp string")
    assert rows(M.accepted_links(links, chunks), "to_temp") == [("y",)]
    assert M.by_batches(groups, lambda pdf: pdf[["chapter_id"]], "chapter_id long").count() == 3


# --- the index store over time


def random_records(spark, rng, chapters, words=("fox", "dogs", "running", "tree", "维基百科")):
    made = [("a" if c % 2 else None, "text", "source", c, i, None, f"{c}:{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for c in chapters for i in range(rng.randrange(4))]
    return made


def as_records(spark, made):
    return spark.createDataFrame(made, "archive string, record string, kind string, chapter_id long, sentence_index long, owner_id string, record_id string, text string")


def answers(index):
    return {q: sorted(((r["record_id"], r["level"], round(r["rank"], 9)) for r in S.search(index, q).collect()), key=str) for q in ("fox dog", "run 维基百科")}


def test_index_refreshes_equal_full_builds(spark, tmp_path):
    rng = random.Random(11)
    by_chapter = {c: random_records(spark, rng, [c]) for c in range(12)}
    now = lambda: as_records(spark, [r for rows in by_chapter.values() for r in rows])
    kept = X.IndexStore(spark, f"file://{tmp_path}/index", segments=3)
    with pytest.raises(RuntimeError):
        kept.refresh(now())
    kept.rebuild(now())
    sizes = []
    for turn in range(4):
        changed = rng.sample(sorted(by_chapter), 3)
        for c in changed:
            by_chapter[c] = [] if turn == 1 else random_records(spark, rng, [c])
        by_chapter[20 + turn] = random_records(spark, rng, [20 + turn])
        kept.mark_dirty([("a" if c % 2 else None, c) for c in (*changed, 20 + turn)])
        assert kept.status() == "dirty" and kept.refresh(now()) == 4 and kept.status() == "current"
        full, index = S.build(now()), kept.index()
        assert (index.n, round(index.mean_length, 9)) == (full.n, round(full.mean_length, 9)) and answers(index) == answers(full)
        state = kept.state()
        assert [state["n"], state["total"], state["mixed"]] == X.fingerprint(now())
        sizes.append(len(state["segments"]))
    assert max(sizes) <= 3 and kept.folder.names("marks") == []
    held = {s["name"] for name in kept.folder.names("state") for s in kept.folder.read(f"state/{name}")["segments"]}
    assert set(kept.folder.names("segments")) == held and len(kept.folder.names("state")) == 2
    before = answers(kept.index())
    kept.merge(everything=True)
    assert len(kept.state()["segments"]) == 1 and answers(kept.index()) == before and not kept.rebuild(now())


def test_marks_made_meanwhile_stay(spark, tmp_path, monkeypatch):
    kept = X.IndexStore(spark, f"file://{tmp_path}/index")
    first = as_records(spark, [(None, "text", "source", c, 0, None, str(c), f"word{c}") for c in range(3)])
    then = first.withColumn("text", F.concat(F.lit("new"), "text"))
    kept.rebuild(first)
    kept.mark_dirty([(None, 1)])
    real, late = kept._segment, []

    def slow(*args):
        made = real(*args)
        if not late:
            late.append(kept.mark_dirty([(None, 2)]))  # while the refresh runs
        return made

    monkeypatch.setattr(kept, "_segment", slow)
    assert kept.refresh(then) == 1 and kept.status() == "dirty"
    assert kept.refresh(then) == 1 and kept.status() == "current"
    assert [[r["record_id"] for r in S.search(kept.index(), q).collect()] for q in ("newword1", "newword2", "word1", "word0")] == [["1"], ["2"], [], ["0"]]


def test_second_driver_starts_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    one, two = X.IndexStore(spark, path), X.IndexStore(spark, path)
    records = as_records(spark, [(None, "text", "source", c, 0, None, str(c), f"word{c}") for c in range(3)])
    one.rebuild(records)
    one.mark_dirty([(None, 1)])
    real, done = one._segment, []

    def overtaken(*args):
        made = real(*args)
        if not done:
            done.append(two.refresh(records))
        return made

    monkeypatch.setattr(one, "_segment", overtaken)
    assert one.refresh(records) == 0 and done == [1] and one.status() == "current"
    held = {s["name"] for name in one.folder.names("state") for s in one.folder.read(f"state/{name}")["segments"]}
    assert set(one.folder.names("segments")) == held
    assert [r["record_id"] for r in S.search(one.index(), "word1").collect()] == ["1"]


def test_two_mentions_of_one_entity_are_two_records(spark, wiki):
    twice = model.Archive(**{**vars(wiki), "mentions": wiki.mentions.unionByName(wiki.mentions.filter("mention_id = 'm1'").withColumn("mention_id", F.lit("m9")))})
    index = S.build(S.projection(twice))
    hits = S.search(index, "llm", kinds=["entity-surface"]).collect()
    assert len(hits) == 2 and len({r["rank"] for r in hits}) == 1 and index.n == S.build(S.projection(wiki)).n + 1


def test_caps_hold_for_pages_only(spark, wiki, index, monkeypatch):
    monkeypatch.setattr(S, "HIT_CAP", 1)
    assert S.search(index, "wiki", limit=5).count() == 1 and S.search(index, "wiki").count() > 1


# --- clue markup


def test_clue_markup(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    words = "a b c d e f g h i j".split()
    sentences = t([(1, i, w) for i, w in enumerate(words)], "chapter_id long, sentence_index long, text string")
    segments = t([(1, 0, "first"), (1, 3, " middle "), (1, 5, None), (1, 6, "more"), (1, 8, "end")], "chapter_id long, start_sentence_index long, summary string")
    chunks = t([(1, "X", "focused", "helpful"), (2, "Y", "verbatim", None), (3, "X", None, "critical"), (4, None, None, None), (5, "Z", "relevant", "important")], "chunk_id long, label string, retention string, importance string")
    covers = t([(1, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 2), (3, 1, 8), (4, 1, 9), (5, 1, 9), (1, 1, 77)], "chunk_id long, chapter_id long, sentence_index long")
    members = t([(1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 3, 2), (1, 0, 4, 3), (1, 0, 5, 4), (1, 1, 4, 0), (1, 2, 9, 0)], "chapter_id long, clue_id long, chunk_id long, place long")
    got = {m: dict(rows(M.rendered_clues(members, chunks, covers, sentences, segments, m), "clue_id", "markup")) for m in ("full", "retention", "plain")}
    assert got["plain"] == {0: "a b c\n\nmiddle more\n\ni j", 1: "i j"}
    assert got["full"][0] == (
        '<chunk label="X" retention="focused" importance="helpful">a b</chunk> <chunk label="Y" retention="verbatim" importance="critical">c</chunk>\n\nmiddle more\n\n'
        '<chunk label="X" importance="critical">i</chunk> <chunk label="Z" retention="relevant" importance="important">j</chunk>'
    )
    assert got["full"][1] == 'i <chunk label="">j</chunk>' and got["retention"][0] == 'a b <chunk retention="verbatim">c</chunk>\n\nmiddle more\n\ni j'
    ties = t([(1, 0, "P", "detailed", None), (1, 1, "Q", "detailed", "critical"), (2, 0, "P", None, None)], "k long, place long, label string, retention string, importance string")
    assert rows(M.merged_attributes(ties, ["k"])) == [(1, "P", "detailed", "critical"), (2, "P", None, None)]


# --- grounding


def brute_grounding(candidates, options, decide):
    """The rounds by their definition, candidate by candidate. ``candidates``: (chapter, id, place, surface)."""
    stats, recalls, shown, pages, closed, accepted, figures = {}, {}, {}, {}, set(), [], []
    asked, number = [c for c in sorted(candidates, key=lambda c: (c[0], c[2]))], 0
    while True:
        page = []
        for c, i, _, s in asked:
            if i in closed:
                continue
            score = lambda o: sum(recalls.get((c, s, q), 0) for q in (o[1], *o[2]))  # noqa: B023, E731
            left = [o[1] for o in sorted(options[i], key=lambda o: (-score(o), o[0])) if o[1] not in shown.setdefault(i, set())]
            st = stats.setdefault((c, s), [0, 0, 0, 0])
            budgets = GR.PRIOR_BUDGETS if GR.has_prior(*st) else GR.BUDGETS
            now = left[: budgets[min(pages.get(i, 0), len(budgets) - 1)]]
            if not now:
                closed.add(i)
                continue
            shown[i] |= set(now)
            if len(now) == len(left):
                closed.add(i)
            st[0] += 1
            page.append((c, i, s, pages.get(i, 0), now))
            pages[i] = pages.get(i, 0) + 1
        if not page:
            return sorted(accepted), figures
        figures.append({"pages": len(page), "options": sum(len(p[4]) for p in page)})
        going = []
        for c, i, s, k, qids in page:
            decision, qid = decide(i, k, qids)
            st = stats[(c, s)]
            if decision == "accept":
                accepted.append((i, c, s, qid, number))
                closed.add(i)
                st[1] += 1
                recalls[(c, s, qid)] = recalls.get((c, s, qid), 0) + 1
            elif decision == "continue":
                going.append(i)
                st[2] += 1
            else:
                closed.add(i)
                st[3] += 1
        asked, number = [x for x in asked if x[1] in going], number + 1


def decide(candidate, page, qids):
    k = (int(candidate[1:]) * 7 + page) % 5
    return ("accept", qids[k % len(qids)]) if k < 2 else ("continue", None) if k < 4 else ("skip_this_time", None)


def test_grounding_rounds_against_brute_force(spark):
    rng = random.Random(8)
    candidates = [(k % 2, f"c{k}", k, rng.choice("xyz")) for k in range(40)]
    options = {i: [(p, f"q{p * (1 + int(i[1:]) % 2)}", [f"q{rng.randrange(20)}"] if rng.random() < 0.3 else None) for p in range(rng.choice((0, 2, 6, 18, 60, 90)))] for _, i, _, _ in candidates}
    c = spark.createDataFrame(candidates, "chapter_id long, candidate_id string, place long, surface string")
    o = spark.createDataFrame([(i, *x) for i, made in options.items() for x in made], "candidate_id string, place long, qid string, linked array<string>")

    def judge(rows):
        import pandas as pd

        assert sum(map(len, rows["qids"])) <= 50 or len(rows) == 1
        made = [(i, *decide(i, k, list(q))) for i, k, q in zip(rows["candidate_id"], rows["page"], rows["qids"])]
        return pd.DataFrame(made, columns=["candidate_id", "decision", "qid"])

    found, figures = GR.grounded(c, o, judge)
    want, rounds = brute_grounding(candidates, {i: [(p, q, x or []) for p, q, x in made] for i, made in options.items()}, decide)
    assert rows(found) == want and figures == rounds and len(rounds) > 2


def test_screening_keeps_what_the_model_keeps(spark):
    made = [(1, f"c{i}", i, "often" if i < 9 else f"s{i}") for i in range(20)] + [(2, "d", 0, "rare")]
    c = spark.createDataFrame(made, "chapter_id long, candidate_id string, place long, surface string")
    assert rows(GR.frequent_surfaces(c)) == [(1, "often", 9), (2, "rare", 1)]
    got = GR.screened(c, lambda b: b[b["surface"] == "rare"][["chapter_id", "surface"]])
    assert {r["surface"] for r in got.collect()} == {f"s{i}" for i in range(9, 20)} | {"rare"}


def test_streamed_counters_equal_the_table(spark, tmp_path):
    from textloom.streaming import grounding as stream

    rng = random.Random(9)
    made = [(k % 2, "xy"[k % 3 % 2], k, f"c{rng.randrange(4)}", rng.choice(("page", "page", "accept", "continue", "close")), rng.choice(("skip_this_time", "never_recall", "later", None))) for k in range(90)]
    schema = "chapter_id long, surface string, seq long, candidate_id string, kind string, decision string"
    for part in range(3):
        spark.createDataFrame(made[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    spark.conf.set(*stream.STATE_STORE)
    try:
        events_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        query = stream.surface_statistics(events_in).writeStream.format("memory").queryName("counters").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset(stream.STATE_STORE[0])
    got = sorted(map(tuple, spark.table("counters").collect()), key=str)
    want = sorted(map(tuple, GR.surface_statistics(spark.createDataFrame(made, schema)).collect()), key=str)
    assert got == want and len(want) == 90 and {r[-1] for r in want} >= {None, 3, 5, 10}


# --- sessions


def test_sessions_live_and_go(spark, tmp_path):
    now = [1000.0]
    kept = SE.Sessions(spark, f"file://{tmp_path}/sessions", most=3, seconds=50, clock=lambda: now[0])
    hits = spark.createDataFrame([(f"h{i}", float(i % 4)) for i in range(10)], "id string, score double")
    calls = []
    scope = {"archive_key": "w", "terms": ["wiki"], "types": ["node", "entity"], "chapters": [2, 1, 2], "revision": "r1"}
    make = lambda: calls.append(1) or hits
    order = [F.desc("score"), "id"]
    one = kept.find(make, order, **scope)
    assert kept.find(make, order, **{**scope, "types": ["entity", "node", "node"], "chapters": [1, 2]}) == one and len(calls) == 1
    assert kept.find(make, order, **{**scope, "revision": "r2"}) != one and len(calls) == 2
    found, cursor = kept.page(one, 4, types=["entity", "node"])
    assert [r["id"] for r in found] == ["h3", "h7", "h2", "h6"]
    then, cursor = kept.after(cursor, 4)
    last, end = kept.after(cursor, 4)
    assert [r["id"] for r in (*then, *last)] == ["h1", "h5", "h9", "h0", "h4", "h8"] and end is None
    for types in (["node"], ["node", "triple"], ["entity", "node", "triple"], []):
        with pytest.raises(ValueError):
            kept.after(cursor, 4, types)
    with pytest.raises(ValueError):
        kept.after("nonsense", 4)
    for i, t in enumerate((1010.0, 1020.0)):
        now[0] = t
        kept.page(one, 1)  # used last, so that the other goes
        kept.keep(hits, order, archive_key="v", terms=[str(i)])
    assert len(kept.folder.names("known")) == 3 == len(kept.folder.names("rows")) and kept.rows(one) is not None
    now[0] = 1051.0
    assert kept.page(one, 1) is None and kept.collect_garbage(dry_run=True) == {"scanned": 3, "removed": 1} and kept.collect_garbage()["removed"] == 1
    assert kept.forget_archive("v") == 2 and kept.folder.names("rows") == [] and kept.collect_garbage(force=True)["scanned"] == 0


def test_revisions_are_part_of_the_scope(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "chapter_id long, revision long")
    b = spark.createDataFrame([(2, 7), (1, 5)], "chapter_id long, revision long")
    assert SE.revision_scope(a) == SE.revision_scope(a.orderBy("revision", ascending=False)) != SE.revision_scope(b)
    assert SE.revision_scope(a, [1, 3, 1]) == SE.revision_scope(b, [3, 1]) == '{"scope": "chapters", "chapters": [[1, 5], [3, 0]]}'
    assert SE.session_id(terms=["a"], query="A") == SE.session_id(terms=["a"], query="a") != SE.session_id(terms=["b"])


def test_the_501st_session_goes(spark, tmp_path):
    now = [0.0]
    kept = SE.Sessions(spark, f"file://{tmp_path}/sessions", clock=lambda: now[0])
    for i in range(501):
        kept.folder.create(f"known/s{i:03}", {"accessed": float(i), "created": 0.0, "expires": 1e9 if i else 5.0, "archive_key": "w", "types": None})
    assert kept.collect_garbage() == {"scanned": 501, "removed": 1} and "s000" not in kept.folder.names("known")
    now[0] = 8 * 24 * 3600.0
    kept._tell("s001", {"accessed": 0.0, "created": 0.0, "expires": float(SE.SECONDS), "archive_key": "w", "types": None})
    assert kept.collect_garbage()["removed"] == 1


# --- fingerprints and scans of archives


def test_fingerprints_are_of_the_order(spark):
    rng = random.Random(12)
    made = [(rng.choice("vw"), "text", "source", i % 5, i, None, str(i), f"t{i}") for i in range(300)] + [("w", "text", "source", 1, None, None, None, None)]
    df = as_records(spark, made)
    first = dict(rows(L.fingerprints(df)))
    for shuffled in (df.repartition(7), df.orderBy(F.desc("record_id")), as_records(spark, rng.sample(made, len(made)))):
        spark.conf.set("spark.sql.shuffle.partitions", rng.choice(("1", "3", "9")))
        assert dict(rows(L.fingerprints(shuffled))) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    swapped = [r if r[4] not in (10, 15) else (*r[:4], 25 - r[4], *r[5:]) for r in made]  # two sentences of a chapter change places
    assert dict(rows(L.fingerprints(as_records(spark, swapped)))) != first and dict(rows(L.fingerprints(as_records(spark, made[1:])))) != first
    assert L.fingerprints(df.limit(0)).count() == 0 and first["w"].split("-")[0] == str(sum(r[0] == "w" for r in made))


def test_scan_reads_relative_paths_and_tokens(spark, tmp_path):
    for name, token in (("a/x.wikg", "t1"), ("b/x.wikg", " t2\n"), ("b/c d/y.wikg", None), ("top.wikg", "")):
        path = tmp_path / "library" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            if token is not None:
                z.writestr(packages.TOKEN, token)
            z.writestr("manifest.json", "{}")
            z.writestr("text/1.txt", name)
    (tmp_path / "library/broken.wikg").write_text("no archive")
    (tmp_path / "library/skipped.txt").write_text("x")
    for path in (f"{tmp_path}/library", f"file://{tmp_path}/library/"):
        got = {r["relative_path"]: (r["token"], r["size"] > 0) for r in L.scanned(spark, path).collect()}
        assert got == {"a/x.wikg": ("t1", True), "b/x.wikg": ("t2", True), "b/c d/y.wikg": (None, True), "top.wikg": (None, True), "broken.wikg": (None, True)}
    read = packages.archive_entries(spark, f"{tmp_path}/library", ["text/*", "none"]).collect()
    assert sorted((r["relative_path"], r["entry"], bytes(r["content"]).decode()) for r in read if r["entry"]) == [(n, "text/1.txt", n) for n in ("a/x.wikg", "b/x.wikg", "top.wikg")]
    assert {r["relative_path"] for r in read if r["fault"]} == {"b/c d/y.wikg", "broken.wikg"}
    assert {r["entry"] for r in packages.archive_entries(spark, f"{tmp_path}/library", first=None).collect() if r["relative_path"] == "b/c d/y.wikg"} == {"manifest.json", "text/1.txt"}
    register = spark.createDataFrame([(1, "a/x.wikg", "t1"), (2, "old/x.wikg", "t2")], "archive_id long, relative_path string, token string")
    assert (2, "b/x.wikg", "present") in {tuple(r) for r in L.reconciled(L.scanned(spark, f"{tmp_path}/library"), register).select("archive_id", "relative_path", "status").collect()}


# --- links, planning, buckets, states, metadata


def test_links_keep_their_evidence_in_blocks(spark):
    links = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "a")], "archive string, link_id string")
    evidence = spark.createDataFrame([("w", "a", 1, i % 7) for i in range(20)] + [("w", "x", 1, 1)], "archive string, link_id string, chapter_id long, sentence_index long")
    got = {(r["archive"], r["link_id"], r["block"]): [tuple(e) for e in r["evidence"]] for r in K.with_evidence(links, evidence, block=3).collect()}
    assert got == {("w", "a", 0): [(1, 0), (1, 1), (1, 2)], ("w", "a", 1): [(1, 3), (1, 4), (1, 5)], ("w", "a", 2): [(1, 6)], ("w", "b", 0): [], ("v", "a", 0): []}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "from_id long, to_id long")
    assert rows(K.edges_within(e, spark.createDataFrame([(1,), (3,), (4,), (4,)], "k long"))) == [(3, 1), (4, 4)]
    clusters = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "cluster_id long, chapter_id long")
    assert rows(K.cluster_edges_of_chapter(e, clusters, 7)) == [(1, 2)]
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "name string")
    assert rows(K.unused(names, [spark.createDataFrame([("a",), (None,)], "x string"), spark.createDataFrame([("b",)], "y string")])) == [("c",)]


def test_planning(spark):
    chapters = spark.createDataFrame([("w", 351, True), ("w", 0, None), ("v", None, False)], "archive string, words long, covered boolean")
    cost = {(r["archive"], r["task"]): r for r in PL.task_costs(chapters, ["archive"]).collect()}
    assert tuple(cost["w", "knowledge-graph"])[2:] == (2, 351, 11, 38, 78, 28080, 21060, 8775)  # two batches of six calls
    assert tuple(cost["w", "reading-graph"])[2:7] == (2, 351, 3, 49, 139) and cost["v", "reading-summary"]["calls"] == 1
    total = {r["archive"]: r for r in PL.total_costs(PL.task_costs(chapters, ["archive"]), ["archive"]).collect()}
    assert total["w"]["calls"] == 11 + 3 + 4
    assert {r["archive"]: tuple(r)[1:] for r in PL.coverage(chapters, ["archive"]).collect()} == {"w": (1, 2, 351, 351, "100%"), "v": (0, 1, 0, 0, "n/a")}
    third = spark.createDataFrame([("u", 1, True), ("u", 2, False)], chapters.schema)
    assert PL.coverage(third, ["archive"]).first()["percent"] == "33.3%"


def test_pages_bucket_by_bucket(wiki, index, monkeypatch):
    whole = [tuple(r) for r in V.find(wiki, index, "wiki").orderBy(*V.search_order()).collect()]
    got, at, calls, real = [], 0, [], V.find
    monkeypatch.setattr(V, "find", lambda a, i, q, m, types: calls.append(types) or real(a, i, q, m, types))
    while at is not None:
        page, at = V.find_by_buckets(wiki, index, "wiki", limit=2, skip=at)
        got += [tuple(r) for r in page]
        if len(got) == 2:
            assert len(calls) < 4  # later buckets weren't searched
    assert got == whole and (V.bucket_window(5), V.bucket_window(50), V.text_window(200), V.library_window(20)) == (100, 151, 201, 400)
    assert {r["type"] for r in V.find_by_buckets(wiki, index, "wiki", types=["source", "summary"])[0]} == {"source", "summary"}


def test_states_and_pages(spark, wiki):
    more = model.Archive(**{**vars(wiki), "chapters": wiki.chapters.unionByName(spark.createDataFrame([("w", 2, 2, "Empty")], wiki.chapters.schema))})
    assert rows(V.chapter_states(more)) == [("w", 1, "summarized", 3, 17, 1, 2, 4), ("w", 2, "planned", 0, 0, 0, 0, 0)]
    assert V.object_page(more, "chapter-state", "2")["stage"] == "planned" and V.object_page(more, "summary", "1")["text"] == "A summary of wiki pages."
    assert V.object_page(more, "summary", "2") is None and V.object_page(more, "chapter-title", "2")["title"] == "Empty" and V.object_page(more, "chapter-state", "9") is None


def test_metadata(spark):
    meta = spark.createDataFrame([("w", "Old", ["A", "Bea"], "P", None), ("v", None, None, None, "x")], "archive string, title string, authors array<string>, publisher string, description string")
    patches = [("w", 1, "title", "First"), ("w", 2, "title", "Second"), ("w", 3, "publisher", None), ("u", 1, "authors", '["C", "D"]')]
    got = metadata.patched(meta, spark.createDataFrame(patches, "archive string, ord long, field string, value string"))
    assert {r["archive"]: tuple(r)[1:] for r in got.collect()} == {"w": ("Second", ["A", "Bea"], None, None), "v": (None, None, None, "x"), "u": (None, ["C", "D"], None, None)}
    shown = {r["archive"]: (r["s"], r["t"]) for r in meta.select("archive", metadata.summary().alias("s"), metadata.as_text().alias("t")).collect()}
    assert shown == {"w": ("Old / A, Bea / P", "title: Old\nauthors: A, Bea\npublisher: P"), "v": ("", "title: Archive metadata\ndescription: x")}
    assert rows(metadata.grep(meta, " be "), "archive", "field", "snippet") == [("w", "authors", "Bea")] and metadata.grep(meta, " ").count() == 0
    assert rows(metadata.hits(meta), "archive", "title") == [("v", "Archive metadata"), ("w", "Old")] and metadata.hits(meta).columns == [*V.HIT, "title"]
    with pytest.raises(Exception, match="no metadata field"):
        metadata.patched(meta, spark.createDataFrame([("w", 1, "titel", "x")], "archive string, ord long, field string, value string")).collect()


def test_index_for_one_query_equals_the_whole_one(wiki, index):
    for query, match in (("wiki pages", "any"), ("wiki pages", "all"), ("sources", "any"), ("资料 archives", "all"), ("nowhere", "any"), ("", "any")):
        own = S.build_for(S.projection(wiki), query, match)
        assert (own.n, own.mean_length) == (index.n, index.mean_length)
        found = lambda i: sorted(map(str, S.search(i, query, match).withColumn("rank", F.round("rank", 9)).collect()))  # noqa: E731, B023
        assert found(own) == found(index)
        assert not any(r["found"] for r in own.postings.groupBy("token").agg((F.count("*") == 0).alias("found")).collect())
    with pytest.raises(ValueError):
        S.search(S.build_for(S.projection(wiki), "wiki"), "pages")


def test_sentences_are_counted_once_a_document(spark, tmp_path):
    docs = [(1, "a", "One. Two\n\nthree. " + "x. " * 50), (2, "a", " \n"), (3, None, "no stop")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = model.materialized(spark, str(tmp_path))
    assert rows(made.groupBy("chapter_id").agg(F.min("n"), F.max("n"), F.count("*"))) == [(1, 53, 53, 53), (3, 1, 1, 1)]


def test_each_edge_is_valued_once_from_each_end(monkeypatch):
    """Clusters offer the same edges again and again as they grow; the distance of two fingerprints stays what it was."""
    chunks = [{"chunk_id": i, "sentence_index": i, "words_count": 9 + i % 5, "retention": None, "importance": "helpful", "weight": 1.0 + i % 7} for i in range(40)]
    group, asked = G.Component(chunks, [{"from_id": i + s, "to_id": i, "strength": "important"} for i in range(40) for s in (1, 3) if i + s < 40]), []
    monkeypatch.setattr(G.pd, "notna", lambda x: asked.append(x) or x is not None)
    assert sorted(i for ids in group.snakes(60) for i in ids) == list(range(40))
    assert 0 < len(asked) <= 2 * 4 * len(group.strength)
