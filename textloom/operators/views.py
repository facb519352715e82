"""What a user asks of an archive: find, list, related, evidence, backlinks, pages, packs; with order, paging and cursors.

A hit is ``type, archive, id, chapter_id, sentence_index, document_order, score, match_count`` and what its kind adds.
Pages are a sort and a limit (Spark keeps each task's best rows only); texts are joined to the page, not to all hits.
"""

from __future__ import annotations

import base64
import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import collect_top, evidence_score
from ..sources.model import Archive
from ..sources.scratch import written
from . import ranges as R
from . import search as S

#: Buckets of types in searches and lists, the order of types, a page's length, a position that nothing reaches.
SEARCH_BUCKETS = {"chapter-title": 0, "entity": 1, "triple": 1, "node": 2, "source": 3, "summary": 3}
LIST_BUCKETS = {"entity": 0, "triple": 0, "node": 1, "summary": 2, "source": 3, "fragment": 3, "chapter-title": 4, "chapter": 4, "chapter-tree": 4, "meta": 4}
TYPE_ORDER = {"meta": 0, "chapter-title": 1, "chapter": 1, "entity": 2, "triple": 3, "node": 4, "summary": 5, "source": 6}
PAGE, FAR = 20, 2**53 - 1
HIT = ["type", "archive", "id", "chapter_id", "sentence_index", "document_order", "score", "match_count"]


def _of(values: dict[str, int], default: int = FAR) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))
    return F.coalesce(F.element_at(table, F.col("type")), F.lit(default))


def _position(order: str) -> list[Column]:
    far = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(FAR))
    columns = [far("document_order"), far("chapter_id"), far("sentence_index"), _of(TYPE_ORDER), F.col("archive"), F.col("id")]
    return [c.asc() if order == "doc-asc" else c.desc() for c in columns]


def search_order(order: str = "doc-asc") -> list[Column]:
    """Bucket, falling score, falling number of matches, then position; the direction turns the position only."""
    return [_of(SEARCH_BUCKETS).asc(), F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("match_count", F.lit(0)).desc(), *_position(order)]


def list_order(order: str = "doc-asc") -> list[Column]:
    """Bucket; entities and triples by falling score; then position."""
    bucket = _of(LIST_BUCKETS)
    return [bucket.asc(), F.when(bucket == 0, F.coalesce("score", F.lit(0.0))).desc(), *_position(order)]


# --- filters of hits


def of_types(hits: DataFrame, types: list[str] | None) -> DataFrame:
    """Hits of these types; ``chapter`` stands for chapter titles too."""
    if types is None:
        return hits
    return hits.filter(F.col("type").isin([*types, *(["chapter-title"] if "chapter" in types else [])]))


def with_ids(hits: DataFrame, ids: list[str] | None = None, chapters: list[int] | None = None) -> DataFrame:
    """Hits with these ids and in these chapters; a hit without a chapter is in none."""
    hits = hits if ids is None else hits.filter(F.col("id").isin(ids))
    return hits if chapters is None else hits.filter(F.col("chapter_id").isin(chapters))


# --- pages


def cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "v": 1}).encode()).decode().rstrip("=")


def parse_cursor(text: str | None) -> int:
    if text is None:
        return 0
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if found["v"] == 1 and isinstance(found["offset"], int) and found["offset"] >= 0:
            return found["offset"]
    except (ValueError, KeyError, TypeError):
        pass
    raise ValueError(f"not a cursor: {text}")


def page(hits: DataFrame, order: list[Column], limit: int = PAGE, after: str | None = None) -> tuple[list, str | None]:
    """(rows, next cursor or None): one page, which is all that is collected."""
    at = parse_cursor(after)
    rows = hits.orderBy(*order).offset(at).limit(limit + 1).collect()
    return rows[:limit], cursor(at + limit) if len(rows) > limit else None


def keyset(hits: DataFrame, columns: list[str], falling: list[str], after: tuple | None, limit: int = PAGE) -> DataFrame:
    """The ``limit`` hits behind ``after`` in the order of ``columns``, of which the ``falling`` numbers go down."""
    key = F.struct(*((-F.col(c) if c in falling else F.col(c)).alias(c) for c in columns))
    if after is not None:
        kinds = {f.name: f.dataType for f in hits.select(key.alias("k")).schema["k"].dataType}
        hits = hits.filter(key > F.struct(*(F.lit(-v if c in falling else v).cast(kinds[c]).alias(c) for c, v in zip(columns, after))))
    return hits.orderBy(*(F.desc(c) if c in falling else F.asc(c) for c in columns)).limit(limit)


def bucket_page(buckets: list[DataFrame], order: list[Column], limit: int = PAGE) -> DataFrame:
    """The first ``limit`` hits over buckets in their order: each bucket's own first rows, then the union's."""
    firsts = [b.orderBy(*order).limit(limit).withColumn("bucket", F.lit(i)) for i, b in enumerate(buckets)]
    whole = firsts[0]
    for b in firsts[1:]:
        whole = whole.unionByName(b, allowMissingColumns=True)
    return whole.orderBy("bucket", *order).limit(limit)


def grouped_hits(hits: DataFrame) -> DataFrame:
    """One hit an object: its best row, the most matches, all its terms, and the evidence score of its scores."""
    keys = ["archive", "type", "id"]
    best = hits.groupBy(*keys).agg(
        F.max_by(F.struct("chapter_id", "sentence_index", "document_order"), F.struct("score", -F.col("document_order"), -F.col("sentence_index"))).alias("b"), F.max("match_count").alias("match_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_terms")))).alias("matched_terms"),
    )
    scores = collect_top(hits, keys, "score").withColumn("score", evidence_score(F.col("scores")))
    return best.join(scores, keys).select("type", "archive", "id", "b.*", "score", "match_count", "matched_terms")


# --- collections


def entity_collection(a: Archive) -> DataFrame:
    """Entities with their first place, number of mentions as score and label: the commonest surface, of equal ones the first by code point."""
    counts = a.mentions.groupBy("archive", "qid", "surface").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chapter_id", "sentence_index", "position")).alias("first"))
    got = counts.groupBy("archive", "qid").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min(F.struct((-F.col("n")).alias("m"), "surface"))["surface"].alias("title"))
    return got.select(F.lit("entity").alias("type"), "archive", F.col("qid").alias("id"), "first.chapter_id", "first.sentence_index", F.col("first.chapter_id").alias("document_order"), F.col("n").cast("double").alias("score"), F.lit(None).cast("int").alias("match_count"), "title")


def triple_collection(a: Archive, triples: DataFrame | None = None) -> DataFrame:
    """Triples with their first place and number of links as score."""
    found = S.triples_of(a) if triples is None else triples
    got = found.groupBy("archive", "s", "predicate", "o").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chapter_id", "sentence_index")).alias("first"))
    return got.select(F.lit("triple").alias("type"), "archive", S.triple_id().alias("id"), "first.chapter_id", "first.sentence_index", F.col("first.chapter_id").alias("document_order"), F.col("n").cast("double").alias("score"), F.lit(None).cast("int").alias("match_count"), F.concat_ws(" ", "s", "predicate", "o").alias("title"), "s", "predicate", "o")


def node_collection(a: Archive) -> DataFrame:
    return a.chunks.select(F.lit("node").alias("type"), "archive", F.col("chunk_id").cast("string").alias("id"), "chapter_id", "sentence_index", F.col("chapter_id").alias("document_order"), F.col("weight").alias("score"), F.lit(None).cast("int").alias("match_count"), F.col("label").alias("title"))


def chapter_collection(a: Archive) -> DataFrame:
    return a.chapters.select(F.lit("chapter-title").alias("type"), "archive", F.col("chapter_id").cast("string").alias("id"), "chapter_id", F.lit(None).cast("int").alias("sentence_index"), "document_order", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("match_count"), "title")


COLLECTIONS = {"chapter-title": chapter_collection, "entity": entity_collection, "node": node_collection, "triple": triple_collection}


def collection(a: Archive, types: list[str] | None = None) -> DataFrame:
    """All objects of the types (by default all) as hits with ``title``; sort by ``list_order`` and page."""
    parts = [make(a).select(*HIT, "title") for t, make in COLLECTIONS.items() if types is None or t in types or t == "chapter-title" and "chapter" in types]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def counts(a: Archive) -> DataFrame:
    """``archive, nodes, edges, summarized_chapters``"""
    nodes = a.chunks.groupBy("archive").agg(F.count(F.lit(1)).alias("nodes"))
    edges = a.edges.groupBy("archive").agg(F.count(F.lit(1)).alias("edges"))
    done = a.sentences.groupBy("archive").agg(F.count_distinct(F.when(F.col("kind") == "summary", F.col("chapter_id"))).alias("summarized_chapters"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return done.join(nodes, "archive", "full").join(edges, "archive", "full").select("archive", *map(zero, ("nodes", "edges", "summarized_chapters")))


# --- search


def _places(a: Archive, found: DataFrame, reached: DataFrame, types: list[str]) -> DataFrame:
    """The collection of ``types`` as far as objects in ``reached`` (``archive, type, id``) need it for their places: entities by their
    mentions, triples by the mentions of the two entities of a triple that a hit in ``found`` is evidence of; nodes are one row each."""
    entity = reached.filter("type = 'entity'").select("archive", F.col("id").alias("qid"))
    mentions = a.mentions.join(entity, ["archive", "qid"], "left_semi")
    lines = found.filter("record = 'text'").select("archive", "chapter_id", "sentence_index")
    near = a.link_evidence.join(lines, ["archive", "chapter_id", "sentence_index"], "left_semi").select("archive", "link_id")
    triples = written(S.triples_of(a, a.links.join(near, ["archive", "link_id"], "left_semi")).select("archive", "s", "predicate", "o"), "near-triples")
    ends = a.mentions.join(triples.select("archive", F.explode(F.array("s", "o")).alias("qid")), ["archive", "qid"], "left_semi")
    parts = []
    if "entity" in types:
        parts.append(entity_collection(replace(a, mentions=mentions)))
    if "node" in types:
        parts.append(node_collection(a))
    if "triple" in types:
        parts.append(triple_collection(a, S.triples_of(replace(a, mentions=ends)).join(triples, ["archive", "s", "predicate", "o"], "left_semi")))
    return reduce(DataFrame.unionByName, [p.select(*HIT) for p in parts])


def find(a: Archive, index: S.Index, query: str, match: str = "any", types: list[str] | None = None, chapters: list[int] | None = None) -> DataFrame:
    """Hits of a query with scores, over all asked types, one row an object or sentence; sort by ``search_order`` and page.

    Titles and sentences score by their rank, entities, nodes and triples by the scores that reach them as properties and as evidence.
    """
    found = written(S.search(index, query, match, chapters=chapters), "hits")
    asked = set(types or SEARCH_BUCKETS)
    score = T.rank_to_score(F.col("rank"))
    title = (F.col("kind") == "chapter-title") & F.lit(bool(asked & {"chapter-title", "chapter"}))
    direct = found.filter(title | F.col("kind").isin([t for t in ("source", "summary") if t in asked])).select(
        F.col("kind").alias("type"), "archive", F.coalesce("owner_id", F.concat_ws(":", "chapter_id", "sentence_index")).alias("id"), "chapter_id", "sentence_index", F.col("chapter_id").alias("document_order"), score.alias("score"), F.lit(1).alias("match_count")
    )
    reached = written(S.object_scores(a, found).filter(F.col("type").isin(list(asked))), "reached")
    places = _places(a, found, reached, [t for t in ("entity", "node", "triple") if t in asked] or ["node"]).drop("score", "match_count")
    objects = places.join(reached.select("archive", "type", "id", "score"), ["archive", "type", "id"]).withColumn("match_count", F.lit(1)).select(*HIT)
    return direct.select(*HIT).unionByName(objects)


def text_window(limit: int) -> int:
    """How many hits a search of sentences alone looks at for a page."""
    return max(limit + 1, 100)


def bucket_window(limit: int) -> int:
    """How many hits of each bucket a search looks at for a page."""
    return max(limit + 1, 3 * limit + 1, 100)


def library_window(limit: int) -> int:
    return max(20 * limit, 100)


def find_by_buckets(a: Archive, index: S.Index, query: str, match: str = "any", types: list[str] | None = None, limit: int = PAGE, skip: int = 0) -> tuple[list, int | None]:
    """(a page's hits, where the next page begins or None): bucket by bucket (titles; entities and triples; nodes; sentences),
    and a bucket is only searched if those before it don't fill the page.

    Each bucket is a search of its own whose first ``bucket_window`` hits count; scores are as in ``find``.
    """
    rows, before, window = [], 0, text_window(skip + limit) if types and set(types) <= {"source", "summary"} else bucket_window(skip + limit)
    for bucket in sorted(set(SEARCH_BUCKETS.values())):
        own = [t for t, b in SEARCH_BUCKETS.items() if b == bucket and (types is None or t in types or t == "chapter-title" and "chapter" in types)]
        if not own:
            continue
        found = find(a, index, query, match, own).orderBy(*search_order()).limit(window).collect()  # one bucket's window
        rows += found[max(0, skip - before) :]
        before += len(found)
        if len(rows) > limit:
            return rows[:limit], skip + limit
    return rows, None


def displayed(a: Archive, rows: DataFrame, needle: str | None = None) -> DataFrame:
    """A page's hits with ``title`` and ``snippet``; a hit whose object is gone drops out. Broadcasts nothing but the page."""
    keys = rows.select("archive", "type", "id", "chapter_id", "sentence_index")
    lines = a.sentences.select("archive", F.col("kind").alias("type"), "chapter_id", "sentence_index", F.lit("").alias("title"), F.col("text").alias("body"))
    of_line = keys.filter(F.col("type").isin("source", "summary")).join(lines, ["archive", "type", "chapter_id", "sentence_index"]).select("archive", "type", "id", "title", "body")
    named = [a.chunks.select("archive", F.lit("node").alias("type"), F.col("chunk_id").cast("string").alias("id"), F.col("label").alias("title"), F.col("content").alias("body"))]
    named.append(a.chapters.select("archive", F.lit("chapter-title").alias("type"), F.col("chapter_id").cast("string").alias("id"), "title", F.col("title").alias("body")))
    named.append(entity_collection(a).select("archive", "type", "id", "title", F.col("title").alias("body")))
    named.append(triple_collection(a).select("archive", "type", "id", "title", F.col("title").alias("body")))
    shown = of_line
    for n in named:
        shown = shown.unionByName(n.join(keys.select("archive", "type", "id"), ["archive", "type", "id"], "left_semi"))
    return rows.join(shown, ["archive", "type", "id"]).withColumn("snippet", T.snippet(F.col("body"), needle)).drop("body")


# --- related objects


def with_role(triples: DataFrame, qid: str, role: str = "any") -> DataFrame:
    """Triples of an entity with ``role``: subject, object, or self if it is both; self is neither of the others."""
    s, o = F.col("s") == qid, F.col("o") == qid
    marked = triples.filter(s | o).withColumn("role", F.when(s & o, "self").when(s, "subject").otherwise("object"))
    return marked if role == "any" else marked.filter(F.col("role") == role)


def related_to_entity(a: Archive, qid: str, role: str = "any") -> DataFrame:
    """The triples of an entity as hits with ``role``; their score is the number of links."""
    got = triple_collection(a, with_role(S.triples_of(a), qid, role))
    s, o = F.col("s") == qid, F.col("o") == qid
    return got.withColumn("role", F.when(s & o, "self").when(s, "subject").otherwise("object"))


def related_to_node(a: Archive, chunk_id: int, direction: str = "any") -> DataFrame:
    """The nodes that edges join to a node: ``direction, weight, chunk_id, label``, incoming ones first."""
    from .graph import neighbours, node_order

    near = neighbours(a.edges, direction).filter(F.col("node") == chunk_id)
    weights = a.chunks.select(F.col("chunk_id").alias("other"), "label", "weight")
    return node_order(near.join(weights, "other")).select("direction", "weight", F.col("other").alias("chunk_id"), "label")


def related_by_query(a: Archive, index: S.Index, qid: str, query: str) -> DataFrame:
    """Triples of an entity by how well the query meets their other end's names or their sentences: hits with the evidence score.

    The entity's own surfaces don't count.
    """
    triples = with_role(S.triples_of(a), qid).withColumn("other", F.when(F.col("s") == qid, F.col("o")).otherwise(F.col("s")))
    found = S.search(index, query).withColumn("score", T.rank_to_score(F.col("rank")))
    names = found.filter("kind = 'entity-surface'").select("archive", F.col("owner_id").alias("other"), "chapter_id", "score").filter(F.col("other") != qid)
    by_name = triples.join(names, ["archive", "other", "chapter_id"]).select("archive", S.triple_id().alias("id"), "score")
    lines = found.filter("record = 'text'").select("archive", "chapter_id", "sentence_index", "score")
    by_line = triples.join(lines, ["archive", "chapter_id", "sentence_index"]).select("archive", S.triple_id().alias("id"), "score")
    return collect_top(by_name.unionByName(by_line), ["archive", "id"], "score").select("archive", "id", evidence_score(F.col("scores")).alias("score"))


def triples_by_query(a: Archive, query: str) -> DataFrame:
    """Triples whose subject, object or predicate the query meets, with ``match_score``: the best of the three."""
    scored = lambda c: T.score_lexical_text(F.col(c), query)["score"]
    best = F.greatest(scored("s"), scored("o"), T.score_lexical_text(F.replace("predicate", F.lit("_"), F.lit(" ")), query)["score"])
    return S.triples_of(a).withColumn("match_score", best).filter("match_score IS NOT NULL")


# --- evidence


def evidence_of(a: Archive, kind: str, object_id: str) -> DataFrame:
    """``archive, chapter_id, start, end, score``: a node's sentences as one range a chapter; an entity's mentions and a triple's links, one each."""
    if kind == "node":
        own = a.chunk_sentences.filter(F.col("chunk_id") == int(object_id))
        return own.groupBy("archive", "chapter_id").agg(F.min("sentence_index").alias("start"), F.max("sentence_index").alias("end")).withColumn("score", F.lit(None).cast("double"))
    if kind == "entity":
        rows = a.mentions.filter(F.col("qid") == object_id).select("archive", "chapter_id", "sentence_index")
    elif kind == "triple":
        own = S.triples_matching(S.triples_of(a), *object_id.split("/"))
        rows = a.link_evidence.join(own.select("archive", "link_id"), ["archive", "link_id"], "left_semi").select("archive", "chapter_id", "sentence_index")
    else:
        raise ValueError(f"no evidence of a {kind}")
    return rows.distinct().select("archive", "chapter_id", F.col("sentence_index").alias("start"), F.col("sentence_index").alias("end"), F.lit(None).cast("double").alias("score"))


def source_lines(a: Archive) -> DataFrame:
    return a.sentences.filter("kind = 'source'")


def scored_ranges(ranges: DataFrame, index: S.Index, query: str) -> DataFrame:
    """Ranges that a hit of the query lies in, with the best score."""
    hits = S.search(index, query, records="text").withColumn("score", T.rank_to_score(F.col("rank")))
    return R.best_in_ranges(ranges.drop("score"), hits).withColumnRenamed("best", "score")


def evidence_order(query: bool = False, order: str = "doc-asc") -> list[Column]:
    """By position in the given direction; with a query by falling score, then by position."""
    at = [F.col(c) for c in ("chapter_id", "start", "end")]
    return [F.desc("score"), *(c.asc() for c in at)] if query else [c.asc() if order == "doc-asc" else c.desc() for c in at]


def evidence_page(a: Archive, ranges: DataFrame, limit: int = PAGE, after: str | None = None, context: int = R.CONTEXT, query: bool = False) -> tuple[list, str | None]:
    """A page of evidence with text: ranges get their context and are merged before the page is cut."""
    ranked = R.with_context(ranges, source_lines(a), context).withColumn("rank", F.row_number().over(Window.orderBy(*evidence_order(query))))  # the evidence of one object
    merged = R.merge_in_order(ranked, "rank", ("archive", "chapter_id"))
    at = parse_cursor(after)
    cut = merged.orderBy("rank").offset(at).limit(limit + 1)
    rows = R.rendered(source_lines(a), cut).orderBy("rank").collect()
    return rows[:limit], cursor(at + limit) if len(rows) > limit else None


def evidence_preview(a: Archive, ranges: DataFrame, limit: int = 3, context: int = R.CONTEXT, query: bool = False) -> tuple[list, int]:
    """(rows, number of all ranges): the first ranges, which get their context only then."""
    total = ranges.count()
    cut = ranges.orderBy(*evidence_order(query)).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*evidence_order(query))))
    merged = R.merge_in_order(R.with_context(cut, source_lines(a), context), "rank", ("archive", "chapter_id"))
    return R.rendered(source_lines(a), merged).orderBy("rank").collect(), total


def backlinks(a: Archive, chapter_id: int, start: int, end: int) -> DataFrame:
    """``type, archive, id, score``: the nodes, entities and triples with a sentence in a source range; entities and triples by how often."""
    inside = (F.col("chapter_id") == chapter_id) & F.col("sentence_index").between(start, end)
    nodes = a.chunk_sentences.filter(inside).select("archive", F.col("chunk_id").cast("string").alias("id")).distinct()
    entities = a.mentions.filter(inside).groupBy("archive", F.col("qid").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    proof = a.link_evidence.filter(inside).select("archive", "link_id").distinct()
    triples = S.triples_of(a).join(proof, ["archive", "link_id"], "left_semi").groupBy("archive", S.triple_id().alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    tag = lambda df, t: df.select(F.lit(t).alias("type"), "archive", "id", "score")
    return tag(nodes.withColumn("score", F.lit(None).cast("double")), "node").unionByName(tag(entities, "entity")).unionByName(tag(triples, "triple"))


# --- pages of one object


def chapter_states(a: Archive) -> DataFrame:
    """``archive, chapter_id, stage, sentences, words, summary_sentences, nodes, mentions`` of every chapter, also of empty ones.

    ``stage``: summarized, graphed (it has nodes), sourced, or planned.
    """
    keys = ["archive", "chapter_id"]
    counted = lambda df, *sums: df.groupBy(*keys).agg(*sums)
    source = F.col("kind") == "source"
    lines = counted(a.sentences, F.count_if(source).alias("sentences"), F.sum(F.when(source, F.col("words_count"))).alias("words"), F.count_if(F.col("kind") == "summary").alias("summary_sentences"))
    nodes, mentions = counted(a.chunks, F.count(F.lit(1)).alias("nodes")), counted(a.mentions, F.count(F.lit(1)).alias("mentions"))
    whole = a.chapters.select(*keys)
    for part in (lines, nodes, mentions):
        same = whole["archive"].eqNullSafe(part["archive"]) & (whole["chapter_id"] == part["chapter_id"])
        whole = whole.join(part, same, "left").select(*[whole[c] for c in whole.columns], *[F.coalesce(part[c], F.lit(0)).alias(c) for c in part.columns if c not in keys])
    return whole.select(*keys, T.chapter_stage(F.col("summary_sentences"), F.col("nodes") > 0, F.col("sentences")).alias("stage"), "sentences", "words", "summary_sentences", "nodes", "mentions")


def object_page(a: Archive, kind: str, object_id: str) -> dict | None:
    """The fields of a chapter, its state, a node, entity or triple, or the text of a summary or a ``source`` range (its URI); None if it isn't there."""
    if kind == "source":
        place = a.sentences.sparkSession.range(1).select(T.parse_range_uri(F.lit(object_id)).alias("p")).first()["p"]
        own = a.sentences.filter((F.col("chapter_id") == place["chapter_id"]) & F.col("sentence_index").between(place["start"], place["end"]) & (F.col("kind") == "source"))
        lines = own.orderBy("sentence_index").select("text").collect()  # the asked range
        return {"type": kind, "id": object_id, "text": " ".join(r[0] for r in lines)} if lines else None
    if kind == "summary":
        lines = a.sentences.filter((F.col("chapter_id") == int(object_id)) & (F.col("kind") == "summary")).orderBy("sentence_index").select("text").collect()  # one chapter's summary
        return {"type": kind, "id": object_id, "text": " ".join(r[0] for r in lines)} if lines else None
    if kind == "chapter-state":
        row = chapter_states(a).filter(F.col("chapter_id") == int(object_id)).first()
        return {"type": kind, "id": object_id, **row.asDict()} if row else None
    made = {"chapter-title": chapter_collection, "chapter": chapter_collection, "node": node_collection, "entity": entity_collection, "triple": triple_collection}
    if kind not in made:
        raise ValueError(f"no page of a {kind}")
    row = made[kind](a).filter(F.col("id") == object_id).first()
    return row.asDict() if row else None


def pack(a: Archive, kind: str, object_id: str, evidence: int = 3, related: int = PAGE, budget: int | None = None) -> dict | None:
    """An object's page, its first pieces of evidence and its related objects; ``budget`` is carried along, not enforced."""
    own = object_page(a, kind, object_id)
    if own is None:
        return None
    shown, total = evidence_preview(a, evidence_of(a, kind, object_id), evidence) if kind in ("node", "entity", "triple") else ([], 0)
    near = related_to_entity(a, object_id).orderBy(*list_order()).limit(related).collect() if kind == "entity" else related_to_node(a, int(object_id)).limit(related).collect() if kind == "node" else []
    return {"page": own, "evidence": {"shown": [r.asDict() for r in shown], "total": total}, "related": [r.asDict() for r in near], "budget": budget}
