"""Archive queries as SQL: text that Spark and DuckDB both read, over the relations of ``sources.archive``.

``QUERIES[name]`` is one text, or a pair (Spark, DuckDB) where the dialects differ.
"""

from __future__ import annotations

_RW = "CASE retention WHEN 'verbatim' THEN 27 WHEN 'detailed' THEN 9 WHEN 'focused' THEN 3 WHEN 'relevant' THEN 1 ELSE 0 END"
_IW = "CASE importance WHEN 'critical' THEN 9 WHEN 'important' THEN 3 WHEN 'helpful' THEN 1 ELSE 0 END"
_SW = "CASE strength WHEN 'critical' THEN 9.0 WHEN 'important' THEN 3.0 ELSE 1.0 END"
_SCORE = "CAST(length(qid) AS DOUBLE) / (1 + wpos)"


#: best + sum of s_i * factor / log2(i + 2) over the ten best positive scores; ten equal scores come to 1.3 times one.
_EVIDENCE = """
WITH_SCORED scored AS (SELECT qid, sc, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, chapter_id, sentence_index, wpos) AS r
  FROM (SELECT *, {score} AS sc FROM mentions) t WHERE sc > 0)
SELECT qid, CAST(sum(sc * CASE WHEN r = 1 THEN 1.0 ELSE {factor} / log2(r + 1) END) AS DOUBLE) AS score FROM scored WHERE r <= 10 GROUP BY qid
"""


def _factor() -> float:
    import math

    return 0.3 / sum(1 / math.log2(r + 1) for r in range(2, 11))


QUERIES: dict[str, str | tuple[str, str]] = {
    # aggregates
    "chapter_entities": "SELECT chapter_id, qid, count(*) AS n FROM mentions GROUP BY chapter_id, qid",
    "book_entities": "SELECT qid, CAST(sum(n) AS BIGINT) AS n FROM (SELECT chapter_id, qid, count(*) AS n FROM mentions GROUP BY chapter_id, qid) t GROUP BY qid",
    "chapter_entity_relations": "SELECT chapter_id, s, p, o, count(*) AS n FROM links GROUP BY chapter_id, s, p, o",
    "book_entity_relations": "SELECT s, p, o, count(*) AS n FROM links GROUP BY s, p, o",
    "entity_collection": """SELECT qid, first_at // 16777216 AS first_chapter, first_at % 16777216 AS first_sentence, score
        FROM (SELECT qid, min(chapter_id * 16777216 + sentence_index) AS first_at, count(*) AS score FROM mentions GROUP BY qid) t""",
    "prefix_labels": """SELECT qid6, label, n FROM (SELECT substr(qid, 1, 6) AS qid6, qid AS label, count(*) AS n,
        row_number() OVER (PARTITION BY substr(qid, 1, 6) ORDER BY count(*) DESC, qid) AS r FROM mentions GROUP BY substr(qid, 1, 6), qid) t WHERE r = 1""",
    "triple_collection": """SELECT s, p, o, n, first_chapter FROM (SELECT s, p, o, count(*) AS n, min(chapter_id) AS first_chapter FROM links GROUP BY s, p, o) t""",
    "evidence_scores": _EVIDENCE.replace("WITH_SCORED", "WITH").format(score=_SCORE, factor=_factor()),
    "dcg_scores": f"""SELECT qid, CAST(sum(sc / log2(r + 1)) AS DOUBLE) AS score FROM (
        SELECT qid, sc, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, chapter_id, sentence_index, wpos) AS r FROM (SELECT *, {_SCORE} AS sc FROM mentions) a) b WHERE r <= 10 GROUP BY qid""",
    "parity_hits": f"""SELECT qid, CAST(sum(CASE WHEN kind = 0 THEN sc / log2(r + 1) ELSE 0 END) + sum(CASE WHEN kind = 1 THEN sc / log2(r + 1) ELSE 0 END) AS DOUBLE) AS score FROM (
        SELECT qid, kind, sc, row_number() OVER (PARTITION BY qid, kind ORDER BY sc DESC, chapter_id, sentence_index, wpos) AS r
        FROM (SELECT *, sentence_index % 2 AS kind, {_SCORE} AS sc FROM mentions) a) b WHERE r <= 10 GROUP BY qid""",
    "archive_counts": """SELECT (SELECT count(*) FROM chunks) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT chapter_id) FROM sentences) AS n_chapters""",
    "next_sentence_index": "SELECT chapter_id, coalesce(max(sentence_index), -1) + 1 AS next_index FROM sentences GROUP BY chapter_id",
    "distinct_archives": "SELECT DISTINCT archive, qid FROM mentions",
    "chunk_weights": f"SELECT chunk_id, CAST({_RW} + {_IW} AS DOUBLE) AS weight FROM chunks",
    "edge_weights": f"""WITH_CTE w AS (SELECT chunk_id, CAST({_RW} + {_IW} AS DOUBLE) AS weight FROM chunks), e AS (SELECT from_id, to_id, CAST({_SW} AS DOUBLE) AS sw FROM edges),
        t AS (SELECT id, sum(sw) AS total FROM (SELECT from_id AS id, sw FROM e UNION ALL SELECT to_id AS id, sw FROM e) u GROUP BY id)
        SELECT e.from_id, e.to_id, CAST(greatest(0.1, wf.weight * (sw / tf.total) + wt.weight * (sw / tt.total)) AS DOUBLE) AS weight
        FROM e JOIN w wf ON wf.chunk_id = e.from_id JOIN w wt ON wt.chunk_id = e.to_id JOIN t tf ON tf.id = e.from_id JOIN t tt ON tt.id = e.to_id""",
    "weight_levels": f"""WITH_CTE c AS (SELECT chapter_id, chunk_id, {_RW} + {_IW} + words_count AS v FROM chunks),
        r AS (SELECT chapter_id, v, row_number() OVER (PARTITION BY chapter_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY chapter_id) AS n FROM c WHERE v > 0),
        t AS (SELECT chapter_id, max(v) AS threshold FROM r WHERE i = least(CAST(floor(n * 0.98) AS BIGINT), n - 1) GROUP BY chapter_id),
        m AS (SELECT r.chapter_id, min(ln(v)) AS lo, max(ln(v)) AS hi FROM r JOIN t ON t.chapter_id = r.chapter_id WHERE v < threshold GROUP BY r.chapter_id)
        SELECT chunk_id, CAST(CASE WHEN v = 0 THEN 0 WHEN lo IS NULL OR v >= threshold THEN 10
          ELSE greatest(1, least(10, floor(round(1 + (ln(greatest(v, 1)) - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 9, 9) + 0.5))) END AS BIGINT) AS incision
        FROM c LEFT JOIN t ON t.chapter_id = c.chapter_id LEFT JOIN m ON m.chapter_id = c.chapter_id""",
    "long_chapter_share": """SELECT archive, count(*) AS chapters, count(CASE WHEN words > 300 THEN 1 END) AS covered, CAST(sum(words) AS BIGINT) AS words,
        CAST(100.0 * count(CASE WHEN words > 300 THEN 1 END) / count(*) AS DOUBLE) AS percent
        FROM (SELECT archive, chapter_id, CAST(sum(words_count) AS BIGINT) AS words FROM chunks GROUP BY archive, chapter_id) t GROUP BY archive""",
    "cost_plan": """SELECT archive, CAST(greatest(chapters, ceil(words / 160.0)) AS BIGINT) AS calls, CAST(ceil(greatest(chapters, ceil(words / 160.0)) / 1.0) * 15 + words * 0.01 AS DOUBLE) AS least_seconds,
        CAST(words * 25 AS BIGINT) AS input_tokens, CAST(words * 4 AS BIGINT) AS output_tokens
        FROM (SELECT archive, count(DISTINCT chapter_id) AS chapters, CAST(sum(words_count) AS BIGINT) AS words FROM chunks GROUP BY archive) t""",
    "clue_weights": f"""SELECT chunk_id, CAST(CASE WHEN total = 0 THEN 0 ELSE w / total END AS DOUBLE) AS share FROM (
        SELECT chunk_id, CAST({_RW} + {_IW} AS DOUBLE) AS w, sum(CAST({_RW} + {_IW} AS DOUBLE)) OVER (PARTITION BY chapter_id) AS total FROM chunks) t""",
    "archive_fingerprint": (
        "SELECT archive, sha2(array_join(transform(array_sort(collect_list(struct(chapter_id, sentence_index, text))), x -> concat(x.chapter_id, ':', x.sentence_index, ':', x.text)), '|'), 256) AS fingerprint FROM sentences GROUP BY archive, chapter_id",
        "SELECT archive, sha256(string_agg(chapter_id || ':' || sentence_index || ':' || text, '|' ORDER BY chapter_id, sentence_index)) AS fingerprint FROM sentences GROUP BY archive, chapter_id",
    ),
    # filters and predicates
    "lookup_equal": "SELECT chapter_id, sentence_index, wpos FROM mentions WHERE qid = 'worthless'",
    "lookup_in": "SELECT chapter_id, sentence_index, qid FROM mentions WHERE qid IN ('worthless', 'pathetic', 'disgusting')",
    "like_terms": "SELECT chapter_id, sentence_index, qid FROM mentions WHERE lower(qid) LIKE '%tion%' OR lower(qid) LIKE '%ering%'",
    "range_scan": "SELECT chapter_id, sentence_index, text FROM sentences WHERE sentence_index BETWEEN 3 AND 6",
    "grep_exact": "SELECT chapter_id, sentence_index, text FROM sentences WHERE instr(lower(text), 'of the') > 0",
    "match_terms": """SELECT chapter_id, sentence_index, matched, CAST(matched AS DOUBLE) / 3 AS score FROM (SELECT chapter_id, sentence_index,
        CASE WHEN instr(lower(text), 'the') > 0 THEN 1 ELSE 0 END + CASE WHEN instr(lower(text), 'ation') > 0 THEN 1 ELSE 0 END + CASE WHEN instr(lower(text), 'ering') > 0 THEN 1 ELSE 0 END AS matched FROM sentences) t WHERE matched > 0""",
    "matched_fields": """SELECT chunk_id, instr(lower(label), 'the') > 0 AS in_label, instr(lower(content), 'the') > 0 AS in_content FROM chunks WHERE instr(lower(content), 'the') > 0""",
    "triple_pattern": "SELECT chapter_id, sentence_index, s, p, o FROM links WHERE p = 'follows' AND o LIKE 'th%'",
    "role_filter": """SELECT chapter_id, sentence_index, s, o, CASE WHEN s = o THEN 'self' WHEN s = 'worthless' THEN 'subject' ELSE 'object' END AS role FROM links WHERE s = 'worthless' OR o = 'worthless'""",
    "snippets": """SELECT chapter_id, sentence_index, CASE WHEN length(text) > 180 THEN concat(substr(text, 1, 177), '...') ELSE text END AS snippet FROM sentences""",
    "snippet_needle": """SELECT chapter_id, sentence_index, concat(CASE WHEN a = 0 THEN '' ELSE '...' END, substr(text, a + 1, b - a), CASE WHEN b = length(text) THEN '' ELSE '...' END) AS snippet FROM (
        SELECT *, greatest(0, instr(lower(text), 'tion') - 1 - 60) AS a, least(length(text), instr(lower(text), 'tion') - 1 + 4 + 120) AS b FROM sentences WHERE instr(lower(text), 'tion') > 0) t""",
    "object_uris": "SELECT chunk_id, concat('chunk/', CAST(chapter_id AS VARCHAR(20)), '/', CAST(sentence_index + 1 AS VARCHAR(20))) AS uri FROM chunks",
    # joins
    "link_hydration": """SELECT c.chunk_id, l.s, l.p, l.o FROM links l JOIN chunks c ON c.chapter_id = l.chapter_id AND c.sentence_index = l.sentence_index WHERE l.p = 'follows'""",
    "evidence_arrays": (
        "SELECT s, o, array_sort(collect_list(chapter_id * 16777216 + sentence_index)) AS evidence FROM links GROUP BY s, o HAVING count(*) > 1",
        "SELECT s, o, list_sort(list(chapter_id * 16777216 + sentence_index)) AS evidence FROM links GROUP BY s, o HAVING count(*) > 1",
    ),
    "edges_of_chapter": """SELECT e.chapter_id, e.from_id, e.to_id, f.words_count AS from_words, t.words_count AS to_words FROM edges e JOIN chunks f ON f.chunk_id = e.from_id JOIN chunks t ON t.chunk_id = e.to_id""",
    "chapters_with_state": """SELECT d.doc_id AS chapter_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS has_state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "evidence_propagation": """SELECT c.retention, m.qid, count(*) AS n FROM mentions m JOIN chunks c ON c.chapter_id = m.chapter_id AND c.sentence_index = m.sentence_index WHERE c.retention IS NOT NULL GROUP BY c.retention, m.qid""",
    "interval_containment": """SELECT m.chapter_id, m.sentence_index, m.wpos, g.g AS group_id FROM mentions m
        JOIN (SELECT DISTINCT chapter_id, CAST(floor(sentence_index / 10.0) AS BIGINT) AS g FROM sentences) g ON g.chapter_id = m.chapter_id AND m.sentence_index >= g.g * 10 AND m.sentence_index < g.g * 10 + 10""",
    "as_of_segment": """SELECT chapter_id, sentence_index, max(CASE WHEN sentence_index % 4 = 0 THEN sentence_index END) OVER (PARTITION BY chapter_id ORDER BY sentence_index) AS segment_start FROM sentences""",
    "range_max_score": """SELECT r.chapter_id, r.start_at, max(m.sc) AS best FROM (SELECT chapter_id, start_at, start_at + k AS sentence_index
        FROM (SELECT DISTINCT chapter_id, sentence_index AS start_at FROM sentences WHERE sentence_index % 7 = 0) s CROSS JOIN (VALUES (0), (1), (2)) t(k)) r
        JOIN (SELECT chapter_id, sentence_index, CAST(max(length(qid)) AS BIGINT) AS sc FROM mentions GROUP BY chapter_id, sentence_index) m
        ON m.chapter_id = r.chapter_id AND m.sentence_index = r.sentence_index GROUP BY r.chapter_id, r.start_at""",
    "backlinks": """SELECT c.chunk_id FROM chunks c WHERE EXISTS (SELECT 1 FROM mentions m WHERE m.chapter_id = c.chapter_id AND m.sentence_index = c.sentence_index AND m.qid LIKE 'th%')""",
    "dangling_metadata": """SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.chapter_id = l.doc_id)""",
    "terms_never_subjects": """SELECT DISTINCT o FROM links x WHERE NOT EXISTS (SELECT 1 FROM links y WHERE y.s = x.o)""",
    "neighbours": """SELECT from_id AS node, to_id AS other, 'out' AS direction FROM edges UNION ALL SELECT to_id AS node, from_id AS other, 'in' AS direction FROM edges""",
    "disjunctive_triples": """SELECT l.chapter_id, l.sentence_index, l.s, l.p, l.o FROM links l WHERE l.s LIKE 'thi%' OR l.o LIKE 'thi%' OR l.p = 'none'""",
    # windows and folds
    "sentence_offsets": """SELECT chapter_id, sentence_index, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY chapter_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM sentences""",
    "neighbour_sentences": """SELECT chapter_id, sentence_index, coalesce(lag(text) OVER (PARTITION BY chapter_id ORDER BY sentence_index), '') AS before_text, coalesce(lead(text) OVER (PARTITION BY chapter_id ORDER BY sentence_index), '') AS after_text FROM sentences""",
    "islands": """SELECT chapter_id, island, min(sentence_index) AS first_sentence, max(sentence_index) AS last_sentence, max(sc) AS score FROM (
        SELECT *, sum(opens) OVER (PARTITION BY chapter_id ORDER BY sentence_index) AS island FROM (
          SELECT chapter_id, sentence_index, sc, CASE WHEN sentence_index > coalesce(lag(sentence_index) OVER (PARTITION BY chapter_id ORDER BY sentence_index), -9) + 1 THEN 1 ELSE 0 END AS opens
          FROM (SELECT chapter_id, sentence_index, max(length(qid)) AS sc FROM mentions WHERE qid LIKE '%ing%' GROUP BY chapter_id, sentence_index) a) b) c GROUP BY chapter_id, island""",
    "context_ranges": """SELECT m.chapter_id, m.sentence_index, greatest(0, m.sentence_index - 2) AS from_sentence, least(t.last_index, m.sentence_index + 2) AS to_sentence
        FROM (SELECT DISTINCT chapter_id, sentence_index FROM mentions WHERE qid LIKE 'wor%') m JOIN (SELECT chapter_id, max(sentence_index) AS last_index FROM sentences GROUP BY chapter_id) t ON t.chapter_id = m.chapter_id""",
    "hopping_windows": (
        "SELECT chapter_id, w AS window_start, least(n, w + 1800) AS window_end FROM (SELECT doc_id AS chapter_id, length(text) AS n, explode(sequence(0, length(text) - 1, 1100)) AS w FROM documents WHERE length(text) > 0) t WHERE w = 0 OR w + 700 < n",
        "SELECT chapter_id, w::INT AS window_start, least(n, w + 1800)::INT AS window_end FROM (SELECT doc_id AS chapter_id, length(text) AS n, unnest(range(0, length(text), 1100)) AS w FROM documents WHERE length(text) > 0) t WHERE w = 0 OR w + 700 < n",
    ),
    "top_ten_mentions": """SELECT chapter_id, qid, n FROM (SELECT chapter_id, qid, count(*) AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY count(*) DESC, qid) AS r FROM mentions GROUP BY chapter_id, qid) t WHERE r <= 10""",
    # sets
    "union_terms": "SELECT s AS term FROM links UNION SELECT o AS term FROM links",
    "keep_first_tier": """SELECT qid, tier FROM (SELECT qid, tier, row_number() OVER (PARTITION BY qid ORDER BY tier) AS r FROM (SELECT s AS qid, 1 AS tier FROM links UNION ALL SELECT o AS qid, 2 AS tier FROM links UNION ALL SELECT qid, 3 AS tier FROM mentions) u) t WHERE r = 1""",
    "candidate_difference": "SELECT qid FROM mentions EXCEPT SELECT s AS qid FROM links",
    # scalar functions
    "words_to_score": "SELECT chunk_id, CAST(r / (1 + r) AS DOUBLE) AS score FROM (SELECT chunk_id, CAST(words_count AS DOUBLE) * 167772160 AS r FROM chunks) t",
    "predicate_normalised": "SELECT DISTINCT label, lower(regexp_replace(replace(replace(trim(label), ' ', '_'), '-', '_'), '_+', '_'{g})) AS predicate FROM chunks",
    "length_stage": """SELECT doc_id AS chapter_id, CASE WHEN n_chars > 5000 THEN 'summarized' WHEN n_chars > 2000 THEN 'graphed' WHEN n_chars > 0 THEN 'sourced' ELSE 'planned' END AS stage FROM documents""",
    "event_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    # lists and pages
    "list_order": """SELECT qid, n, r FROM (SELECT qid, n, row_number() OVER (ORDER BY n DESC, at_place, qid) AS r FROM (
        SELECT qid, count(*) AS n, min(chapter_id * 16777216 + sentence_index) AS at_place FROM mentions GROUP BY qid ORDER BY n DESC, at_place, qid LIMIT 40) t) u WHERE r > 20""",
    "index_projection": """SELECT 'title' AS kind, doc_id AS owner_id, source AS value FROM documents UNION ALL SELECT 'sentence', chapter_id * 16777216 + sentence_index, text FROM sentences
        UNION ALL SELECT 'chunk', chunk_id, label FROM chunks UNION ALL SELECT 'mention', chapter_id * 16777216 + sentence_index, qid FROM mentions""",
    "library_entities": "SELECT archive, qid, count(*) AS n, count(DISTINCT chapter_id) AS chapters FROM mentions GROUP BY archive, qid",
    "dialogue_turns": """SELECT conv_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS previous_role, role FROM conversations""",
    "related_triples": """SELECT s, p, o, CASE WHEN s = o THEN 'self' WHEN s = 'worthless' THEN 'subject' ELSE 'object' END AS role, count(*) AS frequency, min(chapter_id * 16777216 + sentence_index) AS first_position
        FROM links WHERE s = 'worthless' OR o = 'worthless' GROUP BY s, p, o""",
    "chunk_evidence": "SELECT chapter_id, qid, min(sentence_index) AS first_sentence, max(sentence_index) AS last_sentence FROM mentions GROUP BY chapter_id, qid",
}
#: BM25 with k1 = 1.2, b = 0.75 and a floor of 1e-6 on idf, over mentions as tokens, in one column; ``archive_queries.search_any`` has all tokens and tiers.
QUERIES["mention_bm25"] = """WITH_CTE tok AS (SELECT chapter_id, sentence_index, qid AS token, count(*) AS tf FROM mentions GROUP BY chapter_id, sentence_index, qid),
  dl AS (SELECT chapter_id, sentence_index, CAST(sum(tf) AS DOUBLE) AS len FROM tok GROUP BY chapter_id, sentence_index),
  st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avgdl FROM dl),
  q AS (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM tok WHERE token IN ('worthless', 'pathetic', 'disgusting', 'threere', 'theentint') GROUP BY token)
  SELECT tok.chapter_id, tok.sentence_index, CAST(sum(greatest(1e-6, ln((st.n - q.df + 0.5) / (q.df + 0.5))) * tok.tf * 2.2 / (tok.tf + 1.2 * (0.25 + 0.75 * dl.len / st.avgdl))) AS DOUBLE) AS score
  FROM tok JOIN q ON q.token = tok.token JOIN dl ON dl.chapter_id = tok.chapter_id AND dl.sentence_index = tok.sentence_index CROSS JOIN st GROUP BY tok.chapter_id, tok.sentence_index"""
