"""Operator 3, quality rules [native]: a threshold table compiled into one Spark projection.

Measures of a text (length, symbol, stop-word and line ratios, repetition) are built-in expressions over its word
and line arrays. ``RULES`` is the threshold table: each row bounds one measure. ``quality_rules`` compiles the table
into one projection; a document is kept if it meets every bound. No user functions, no shuffle.

A null text counts as an empty one; very long ones are measured whole. Ties can't occur: each row is judged alone, and
repeated rows get equal results. Other columns pass through; those named like a measure or verdict are replaced. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_mark, table, words_of

#: The commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be at by this not or from but they we you he his her she "
    "le la les de des du et un une en est que qui dans pour pas au aux par sur il elle se ce avec "
    "der die das und zu den von mit ist ein eine im dem nicht auf für sich als auch es an aus bei "
    "el los las y del con una por para su al lo como más o pero sus ha si no"
).split()

WINDOW = 8
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """``low <= measure <= high`` must hold in texts of at least ``min_words`` words; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


RULES = (
    Rule("n_words", 20, None),
    Rule("repeat_percent", None, 30.0),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("marks_per_word", None, 0.2),
    Rule("upper_share", None, 0.4),
    Rule("stop_word_share", 0.01, None, 100),
    Rule("dup_line_share", None, 0.5),
)

MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "repeat_percent": lambda: 100.0 * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "marks_per_word": lambda: F.col("n_marks") / F.greatest(F.col("n_words"), F.lit(1)),
    "upper_share": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    "stop_word_share": lambda: F.col("n_stop_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
}


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the counts that the rules need to every row; see the module's docstring for nulls.

    ``n_repeat_words`` is the number of words inside any window of eight words that occurs twice or more in the text.
    Windows are compared by a 64-bit hash, built by doubling. Each step is a projection of its own, so that an array is built once.
    """
    own, m = [F.col(f"`{c}`") for c in df.columns], fresh_mark(df.columns)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = df.select(*own, t.alias(f"{m}text"), words_of(F.col(f"`{text}`")).alias(f"{m}words"))
    drop = lambda pattern: F.regexp_replace(F.col(f"{m}text"), pattern, "")
    step = step.select(
        *own,
        F.size(f"{m}words").cast("long").alias("n_words"),
        F.length(drop(r"[\x20\x09-\x0D]+")).cast("long").alias("word_chars"),
        (F.length(f"{m}text") - F.length(F.translate(f"{m}text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(f"{m}text") - F.length(F.translate(f"{m}text", "!?", ""))).cast("long").alias("n_marks"),
        F.length(drop(r"[^\p{Lu}]+")).cast("long").alias("n_upper"),
        F.size(F.filter(f"{m}words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter(F.split(f"{m}text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "").alias(f"{m}lines"),
        F.transform(f"{m}words", lambda w: F.xxhash64(w)).alias(f"{m}windows"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_stop_words"]
    for reach in (1, 2, 4):  # the hashes of 2, 4 and then 8 words from each word on
        joined = F.transform(f"{m}windows", lambda h, i: F.xxhash64(h, F.get(F.col(f"{m}windows"), i + reach)))  # noqa: B023
        if 2 * reach == WINDOW:
            joined = F.slice(joined, F.lit(1), F.greatest(F.size(f"{m}windows") - (WINDOW - 1), F.lit(0)))
        step = step.select(*own, *counts, f"{m}lines", joined.alias(f"{m}windows"))
    repeated = F.size(F.array_distinct(f"{m}windows")) < F.size(f"{m}windows")
    keyed = F.transform(f"{m}windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(
        *own,
        *counts,
        F.size(f"{m}lines").cast("long").alias("n_lines"),
        (F.size(f"{m}lines") - F.size(F.array_distinct(f"{m}lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, F.sort_array(keyed)).alias(f"{m}sorted"),
    )
    counts += ["n_lines", "n_dup_lines"]
    at = lambda i: F.get(F.col(f"{m}sorted"), i)["h"]
    twice = F.filter(f"{m}sorted", lambda s, i: F.coalesce(at(i - 1) == s["h"], F.lit(False)) | F.coalesce(at(i + 1) == s["h"], F.lit(False)))
    step = step.select(*own, *counts, F.sort_array(twice["i"]).alias(f"{m}starts"))
    covers = F.transform(f"{m}starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(f"{m}starts"), i + 1) - p, F.lit(WINDOW))))
    step = step.select(*own, *counts, F.coalesce(F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"))
    return step


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The threshold table as one boolean expression over the columns of ``measures``."""
    kept = F.lit(True)
    for rule in rules:
        value, bounds = MEASURES[rule.measure](), F.lit(True)
        if rule.low is not None:
            bounds = bounds & (value >= rule.low)
        if rule.high is not None:
            bounds = bounds & (value <= rule.high)
        kept = kept & ((F.col("n_words") < rule.min_words) | bounds)
    return kept


def quality_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measures, ``base_failed`` (too short, or mostly repetition) and ``kept`` to every row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    measured = measures(df.drop(*(c for c in df.columns if c in {*counts, "base_failed", "kept"} and c != text)), text)
    own = [F.col(f"`{c}`") for c in measured.columns if c not in counts]
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # a one-row generator: a later filter on its columns isn't pushed into the projections, whose arrays it would copy
    judged = F.inline(F.array(F.struct(*counts, base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))))
    return measured.select(*own, judged)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), rep AS (
  SELECT doc_id, sum(c)::BIGINT AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND word_chars / n_words::DOUBLE BETWEEN 2 AND 12 AND n_symbols / n_words::DOUBLE <= 0.1 AND n_marks / n_words::DOUBLE <= 0.2
       AND n_upper / greatest(word_chars, 1)::DOUBLE <= 0.4 AND (n_words < 100 OR n_stop / n_words::DOUBLE >= 0.01)
       AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept
FROM m
"""
