"""Full-text search over an archive's sentences and objects: a tiered inverted index, BM25 with a weight for each tier.

A record is a sentence (source or summary) or a property of an object (chapter title, chunk label and content, mention
surface). Its tokens come from ``functions.text.token_plan``; the postings have one row for each token, tier and record,
with the record's position, so that a query is one filter on tokens and one aggregate. Nothing is collected but the query's
own tokens and the index's two totals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import object_hits
from ..sources.model import Archive
from ..sources.scratch import written

#: Weights of the tiers, the usual BM25 constants, the floor of an idf, the most hits that a page is cut from.
TIER_WEIGHTS = {1: 1.0, 2: 0.45, 3: 0.08}
K1, B, LEAST_IDF, HIT_CAP = 1.2, 0.75, 1e-6, 32_000
RECORD = ["archive", "record", "kind", "chapter_id", "sentence_index", "owner_id", "record_id"]
ORDER = ["level", "rank", "archive", "chapter_id", "sentence_index", "kind", "owner_id", "record_id"]
POSTING = ["token", "tier", "head", *RECORD, "length"]


def projection(a: Archive) -> DataFrame:
    """All that is indexed: ``archive, record`` (text or object) ``, kind, chapter_id, sentence_index, owner_id, record_id, text``.

    An object has one record for each of its properties, an entity one for each of its mentions.
    """
    none, text, thing = F.lit(None).cast("string"), F.lit("text"), F.lit("object")
    one = lambda df, record, kind, at, owner, key, value: df.select("archive", record.alias("record"), kind.alias("kind"), "chapter_id", at.cast("long").alias("sentence_index"), owner.cast("string").alias("owner_id"), key.cast("string").alias("record_id"), value.alias("text"))
    no, place = F.lit(None), F.concat_ws(":", "chapter_id", "sentence_index")
    parts = [
        one(a.chapters, thing, F.lit("chapter-title"), no, F.col("chapter_id"), F.col("chapter_id"), F.col("title")),
        one(a.sentences, text, F.col("kind"), F.col("sentence_index"), none, place, F.col("text")),
        one(a.chunks, thing, F.lit("chunk-label"), F.col("sentence_index"), F.col("chunk_id"), F.col("chunk_id"), F.col("label")),
        one(a.chunks, thing, F.lit("chunk-content"), F.col("sentence_index"), F.col("chunk_id"), F.col("chunk_id"), F.col("content")),
        one(a.mentions, thing, F.lit("entity-surface"), F.col("sentence_index"), F.col("qid"), F.col("mention_id"), F.col("surface")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # POSTING; one of a record's rows is its head
    n: int
    mean_length: float
    tokens: frozenset[str] | None = None  # of an index for some queries only; None: all


def postings_of(records: DataFrame, dictionary=None) -> DataFrame:
    planned = T.with_tokens(records.select(*RECORD, "text"), dictionary)
    listed = F.concat(*(F.transform(F.col(kind), lambda t: F.struct(t.alias("raw"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"))) for kind, tier in T.TIERS.items()))  # noqa: B023
    length = reduce(Column.__add__, (F.size(kind) for kind in T.TIERS))
    each = planned.select(*RECORD, length.alias("length"), listed.alias("listed")).select(*RECORD, "length", F.posexplode("listed").alias("at", "t"))
    mark = F.element_at(F.create_map(*(F.lit(x) for pair in T.PREFIXES.items() for x in pair)), F.col("t.kind"))
    token = F.concat(mark, F.substring(F.sha2(F.col("t.raw").cast("binary"), 256), 1, 20))
    return each.select(token.alias("token"), "t.tier", (F.col("at") == 0).alias("head"), *RECORD, "length")


def build(records: DataFrame, dictionary=None) -> Index:
    """An index for this session: the postings are made once and written, each file in the order of tokens, so that a query reads
    its own tokens' row groups. ``index_store.IndexStore`` keeps one between sessions."""
    return with_totals(written(postings_of(records, dictionary).sortWithinPartitions("token"), "postings"))


def build_for(records: DataFrame, query: str, match: str = "any", dictionary=None) -> Index:
    """An index for one query: every record is read once and counts in the totals, but only the query's own postings are kept, so that
    nothing is sorted and what is written besides them is a number for each record. Another query raises an error."""
    asked = _query_plan(records.sparkSession, query, match, dictionary)
    kinds = {mark: kind for kind, mark in T.PREFIXES.items()}
    planned = T.with_tokens(records.select(*RECORD, "text"), dictionary)
    wanted = sorted({(token, raw, tier) for token, raw, tier, _ in asked})
    met = [F.when(F.array_contains(kinds[token[:2]], F.lit(raw)), F.struct(F.lit(token).alias("token"), F.lit(tier).alias("tier"))) for token, raw, tier in wanted]
    found = F.array_compact(F.array(*met)) if met else F.array().cast("array<struct<token:string,tier:int>>")
    length = reduce(Column.__add__, (F.size(kind) for kind in T.TIERS))
    counted = planned.select(*RECORD, length.alias("length"), found.alias("found"))
    scanned = written(counted.select("length", F.when(F.size("found") > 0, F.struct(*RECORD, "found")).alias("hit")), "lengths")
    n, tokens = scanned.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
    postings = scanned.filter("hit IS NOT NULL").select("hit.*", "length").select(F.explode("found").alias("t"), *RECORD, "length").select("t.*", *RECORD, "length")
    return Index(postings, n, tokens / n if n else 0.0, frozenset(token for token, _, _ in wanted))


def with_totals(postings: DataFrame) -> Index:
    """Records without any token have no postings and don't count."""
    n, tokens = postings.agg(F.count_if("head"), F.count(F.lit(1))).first()
    return Index(postings, n, tokens / n if n else 0.0)


def _query_plan(spark: SparkSession, query: str, match: str, dictionary) -> set[tuple[str, str, int, int]]:
    """(token, raw, tier, group)"""
    parts = [query] if match == "any" else query.split()
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)] or [(0, "")], "g int, q string").select("g", T.token_plan(F.col("q"), dictionary).alias("p")).collect()
    return {(t["encoded"], t["raw"], tier, r["g"]) for r in rows for tier in (1, 2, 3) for t in r["p"][f"tier{tier}"]}


def query_tokens(spark: SparkSession, query: str, match: str = "any", dictionary=None) -> list[tuple[str, int, int]]:
    """(token, tier, group) of a query: one group, or with ``all`` one for each part between blanks that has tokens."""
    return sorted({(token, tier, g) for token, _, tier, g in _query_plan(spark, query, match, dictionary)})


def query_terms(spark: SparkSession, query: str, dictionary=None) -> list[str]:
    """The raw tokens of a query over all tiers, each once."""
    return spark.range(1).select(T.plan_terms(T.token_plan(F.lit(query), dictionary))).first()[0]


def search(
    index: Index, query: str, match: str = "any", kinds: list[str] | None = None, records: str | None = None, chapters: list[int] | None = None, after: tuple | None = None, limit: int | None = None
) -> DataFrame:
    """``RECORD, level, rank`` of all records that match; rank is negative, as smaller is better. With a limit the best, in order.

    A record's level is the first of tier 1, tiers 1 and 2, tiers 1 to 3 at which it matches, and its rank is that of the
    tokens up to that level. With ``any`` one token is enough; with ``all`` every group that has tokens up to the level must
    match. ``kinds``, ``records`` (text or object) and ``chapters`` filter the postings. ``after`` (the values of
    ``ORDER``) goes on behind a hit.
    """
    spark = index.postings.sparkSession
    tokens = query_tokens(spark, query, match)
    rows = index.postings
    every = index.postings
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(kinds))
    if records is not None:
        rows = rows.filter(F.col("record") == records)
    if chapters is not None:
        rows = rows.filter(F.col("chapter_id").isin(chapters))
    wanted = sorted({t for t, _, _ in tokens})
    if index.tokens is not None and not index.tokens.issuperset(wanted):
        raise ValueError("the index was built for another query")
    # document counts come from the whole index, whatever the filters
    df = every.filter(F.col("token").isin(wanted)).groupBy("token", "tier").agg(F.count(F.lit(1)).alias("df"))
    asked = spark.createDataFrame(tokens or [("", 0, 0)], "token string, tier int, g int")
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = F.broadcast(asked.join(df, ["token", "tier"]).select("token", "tier", "g", idf.alias("idf")))  # as many rows as the query has tokens
    weight = F.element_at(F.create_map(*(F.lit(x) for p in TIER_WEIGHTS.items() for x in p)), F.col("tier"))
    part = F.col("idf") * weight * (K1 + 1) / (weight + K1 * (1 - B + B * F.col("length") / (index.mean_length or 1.0)))
    met = rows.filter(F.col("token").isin(wanted)).join(weighed, ["token", "tier"]).withColumn("part", part)
    upto = lambda level, value: F.when(F.col("tier") <= level, value)
    groups = {level: len({g for _, tier, g in tokens if tier <= level}) for level in (1, 2, 3)}
    summed = met.groupBy(*RECORD).agg(
        *(F.sum(upto(i, F.col("part"))).alias(f"s{i}") for i in (1, 2, 3)), *(F.count_distinct(upto(i, F.col("g"))).alias(f"g{i}") for i in (1, 2, 3))
    )
    level = F.coalesce(*(F.when((F.col(f"g{i}") >= (groups[i] if match == "all" else 1)) & F.lit(groups[i] > 0), i) for i in (1, 2, 3)))
    hits = summed.withColumn("level", level).filter("level IS NOT NULL")
    hits = hits.withColumn("rank", -F.element_at(F.array("s1", "s2", "s3"), F.col("level"))).select(*RECORD, "level", "rank")
    if after is not None:
        hits = hits.filter(F.struct(*ORDER) > F.struct(*(F.lit(x).cast(hits.schema[c].dataType) for c, x in zip(ORDER, after))))
    return hits if limit is None else hits.orderBy(*ORDER).limit(min(limit, HIT_CAP))


# --- without an index


def like_any(column: Column, terms: list[str]) -> Column:
    """Case-insensitive containment of any of the terms; no character of a term is a wildcard."""
    low, found = F.lower(column), F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t.lower()))
    return found


def lexical_mentions(mentions: DataFrame, query: str) -> DataFrame:
    """Mentions whose surface holds a term of the query, with ``match`` as ``score_lexical_text`` gives it."""
    parsed = T.lexical_query(query)
    terms = parsed[1] if parsed else []
    return mentions.filter(like_any(F.col("surface"), terms)).withColumn("match", T.score_lexical_text(F.col("surface"), query)).filter("match IS NOT NULL")


def required_terms(hits: DataFrame, phrases: list[str], matched: str = "matched_terms") -> DataFrame:
    """Hits that matched every phrase."""
    known = F.array(*map(F.lit, phrases)) if phrases else F.array().cast("array<string>")
    return hits.filter(F.forall(known, lambda p: F.array_contains(F.col(matched), p)))


def grep(a: Archive, needle: str) -> DataFrame:
    """``type, archive, id, chapter_id, snippet`` of titles, sentences and nodes that hold the exact phrase, in any case."""
    low = needle.strip().lower()
    holds = lambda c: F.contains(F.lower(F.col(c)), F.lit(low)) & F.lit(low != "")
    shown = lambda c: T.snippet(F.col(c), low).alias("snippet")
    titles = a.chapters.filter(holds("title")).select(F.lit("chapter-title").alias("type"), "archive", F.col("chapter_id").cast("string").alias("id"), "chapter_id", shown("title"))
    place = F.concat_ws(":", "chapter_id", "sentence_index").alias("id")
    lines = a.sentences.filter(holds("text")).select(F.col("kind").alias("type"), "archive", place, "chapter_id", shown("text"))
    nodes = a.chunks.filter(holds("label") | holds("content")).select(F.lit("node").alias("type"), "archive", F.col("chunk_id").cast("string").alias("id"), "chapter_id", shown("content"))
    return titles.unionByName(lines).unionByName(nodes)


# --- from sentences to objects


def propagated(a: Archive, hits: DataFrame) -> DataFrame:
    """``archive, type, id, kind, score``: the score of each hit as evidence of the entities, chunks and triples of its sentence,
    and as a property of the object that it belongs to. Of several hits of one sentence the last (by rank) counts."""
    by_sentence = Window.partitionBy("archive", "chapter_id", "sentence_index").orderBy(F.desc("level"), F.desc("rank"))
    scored = hits.withColumn("score", T.rank_to_score(F.col("rank")))
    last = scored.filter("record = 'text'").withColumn("r", F.row_number().over(by_sentence)).filter("r = 1").select("archive", "chapter_id", "sentence_index", "score")
    keys, evidence = ["archive", "chapter_id", "sentence_index"], F.lit("evidence").alias("kind")
    entities = a.mentions.join(last, keys).select("archive", F.lit("entity").alias("type"), F.col("qid").alias("id"), evidence, "score")
    chunks = a.chunk_sentences.join(last, keys).select("archive", F.lit("node").alias("type"), F.col("chunk_id").cast("string").alias("id"), evidence, "score")
    proof = a.link_evidence.join(last, keys).select("archive", "link_id", "score")
    # only the links with evidence meet the mentions
    triples = triples_of(a, a.links.join(proof.select("archive", "link_id"), ["archive", "link_id"], "left_semi")).join(proof, ["archive", "link_id"]).select("archive", F.lit("triple").alias("type"), triple_id().alias("id"), evidence, "score")
    kind = F.when(F.col("kind") == "entity-surface", "entity").when(F.col("kind").startswith("chunk"), "node")
    own = scored.filter("record = 'object'").select("archive", kind.alias("type"), F.col("owner_id").alias("id"), F.lit("property").alias("kind"), "score").filter("type IS NOT NULL")
    return entities.unionByName(chunks).unionByName(triples).unionByName(own)


def object_scores(a: Archive, hits: DataFrame) -> DataFrame:
    """``archive, type, id, property_score, evidence_score, score`` of every object that the hits reach."""
    return object_hits(propagated(a, hits), ["archive", "type", "id"])


def triples_of(a: Archive, links: DataFrame | None = None) -> DataFrame:
    """Links (by default all) with their ends: ``archive, link_id, predicate, s, o, chapter_id, sentence_index``; both ends lie in one chapter."""
    end = lambda n, c: a.mentions.select("archive", F.col("mention_id").alias(f"{c}_id"), F.col("qid").alias(n), F.col("chapter_id").alias(f"_{n}"), F.col("sentence_index").alias(f"at_{n}"))
    both = (a.links if links is None else links).join(end("s", "source"), ["archive", "source_id"]).join(end("o", "target"), ["archive", "target_id"])
    return both.filter("_s = _o").select("archive", "link_id", "predicate", "s", "o", F.col("_s").alias("chapter_id"), F.col("at_s").alias("sentence_index"))


def triple_id() -> Column:
    return F.concat_ws("/", "s", "predicate", "o")


def triples_matching(triples: DataFrame, s: str | None = None, predicate: str | None = None, o: str | None = None) -> DataFrame:
    """A triple pattern; ``_`` or nothing stands for anything."""
    for column, value in (("s", s), ("predicate", predicate), ("o", o)):
        if value not in (None, "_"):
            triples = triples.filter(F.col(column) == value)
    return triples


def parse_triple_pattern(text: str) -> dict[str, str | None]:
    """``triple/S/P/O`` as arguments of ``triples_matching``; parts left out at the end stand for anything."""
    head, *parts = text.split("/")
    if head != "triple" or len(parts) > 3:
        raise ValueError(f"not a triple pattern: {text}")
    return {k: None if v in ("", "_") else v for k, v in zip(("s", "predicate", "o"), [*parts, "", "", ""])}
