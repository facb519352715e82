"""Evidence by anchors: a range of sentences from the one that a start anchor names to the one that an end anchor names.

Sentences that equal an anchor are found by a join on chapter and text; an anchor without one is held against every sentence of its
chapter, and only where that doesn't decide are all windows of the sentences scored, in Python. The end is looked for from the start's sentence on.
Lengths count code points.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from ..sources.scratch import written
from .evidence import first_best, windows
from .text import split_sentences

#: Fixed values of the scores and of the decision.
SUBSTRING_BASE, SUBSTRING_SHARE, AROUND_BASE, AROUND_SHARE, AROUND_MOST, NORMALIZED = 0.75, 0.25, 0.78, 0.14, 0.92, 0.995
NGRAMS, SEQUENCE, EDIT, LENGTH, LEAST_ALPHABET = 0.35, 0.35, 0.2, 0.1, 0.35
BONUS, BONUS_FROM = 0.08, 12
HEAD_TAIL_BASE, HEAD_TAIL_SHARE, OUT_OF_ORDER = 0.82, 0.18, 0.85
LEAST_SCORE, TRUSTED, LEAST_GAP, VERY_HIGH, LONG, SHOWN = 0.55, 0.9, 0.07, 0.97, 8, 3
HYPHENS = "‐‑‒–—―"

CANDIDATES = "array<struct<rank:int,sentence_index:bigint,score:double>>"
MATCH = StructType().add("score", DoubleType()).add("start", IntegerType()).add("end", IntegerType())


def _latin(c: str) -> bool:
    return c.isalpha() and unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN", "FEMININE ORD", "MASCULINE ORD", "KELVIN", "ANGSTROM"))


def anchor_form(text: str) -> str:
    """Without punctuation and symbols; blanks only between Latin letters, which are lower case and without marks; a hyphen with a
    blank behind it, between Latin letters, goes."""
    kept: list[str] = []
    flat = " ".join(text.split())
    for i, c in enumerate(flat):
        if c == " ":
            after = flat[i + 1]
            if len(kept) > 1 and kept[-1] in HYPHENS and _latin(kept[-2]) and _latin(after):
                kept.pop()
            elif kept and _latin(kept[-1]) and _latin(after):
                kept.append(c)
        else:
            kept.append(c)
    bare = (c for c in kept if unicodedata.category(c)[0] not in "PS")
    return "".join("".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x)[0] != "M") if _latin(c) else c for c in bare)


def bonus(label: str, query: int, candidate: int, start: int, end: int) -> float:
    """What a match at the anchor's own edge of the sentence is worth more. ``query``, ``candidate``: lengths."""
    if query < BONUS_FROM or start < 0 or end < 0 or (label == "start_anchor" and start) or (label == "end_anchor" and end != candidate):
        return 0.0
    return BONUS * (0.5 + 0.5 * min(1.0, query / max(1, candidate)))


def fuzzy(query: str, candidate: str, label: str) -> tuple[float, int, int]:
    """(score, start, end) of the best window, for normal forms of which neither holds the other."""
    import numpy as np

    m, n = len(query), len(candidate)
    most = min(n, max(m, int(m * 1.2)))
    least = min(most, max(1, int(m * 0.8)))
    t, sizes = windows(query, candidate, least, most), np.arange(least, most + 1)
    larger = np.maximum(m, sizes)
    score = NGRAMS * t["dice"] + SEQUENCE * 2 * t["run"] / (m + sizes) + EDIT * (1 - t["edit"] / larger) + LENGTH * (1 - np.abs(m - sizes) / larger)
    starts = np.arange(len(score))[:, None]
    if m >= BONUS_FROM:
        edge = starts == 0 if label == "start_anchor" else starts + sizes == n if label == "end_anchor" else t["inside"]
        score = score + np.where(edge, BONUS * (0.5 + 0.5 * min(1.0, m / max(1, n))), 0.0)
    return first_best(np.where(t["inside"] & (t["alphabet"] >= LEAST_ALPHABET), np.minimum(1.0, score), -1.0), least)


def score_text(query: str, candidate: str, label: str) -> tuple[float, int, int]:
    """(score, start, end) of a candidate for a whole anchor."""
    q, c = anchor_form(query), anchor_form(candidate)
    if not q or not c:
        return 0.0, -1, -1
    if query.strip() == candidate.strip():
        return 1.0, 0, len(c)
    if q == c:
        return NORMALIZED, 0, len(c)
    if (at := c.find(q)) >= 0:
        return min(1.0, SUBSTRING_BASE + SUBSTRING_SHARE * len(q) / len(c) + bonus(label, len(q), len(c), at, at + len(q))), at, at + len(q)
    if c in q:
        return min(AROUND_MOST, AROUND_BASE + AROUND_SHARE * len(c) / len(q)), 0, len(c)
    return fuzzy(q, c, label)


def score_head_tail(head: str, tail: str, candidate: str) -> tuple[float, int, int, bool]:
    """(score, start, end, exact) of a candidate for the two ends of an anchor whose middle is left out."""
    h, t, c = anchor_form(head), anchor_form(tail), anchor_form(candidate)
    if not h or not t:
        return 0.0, -1, -1, False
    first, last = c.find(h), c.rfind(t)
    if 0 <= first <= last:
        return HEAD_TAIL_BASE + HEAD_TAIL_SHARE * min(1.0, (len(h) + len(t)) / max(1, len(c))), first, last + len(t), True
    a, b = score_text(head, candidate, "start_anchor"), score_text(tail, candidate, "end_anchor")
    return (a[0] + b[0]) / 2 * (1.0 if a[1] <= b[1] else OUT_OF_ORDER), min(a[1], b[1]), max(a[2], b[2]), False


@F.pandas_udf(StringType())
def _form(text: pd.Series) -> pd.Series:
    return text.map(anchor_form, na_action="ignore")


@F.pandas_udf(DoubleType())
def _fuzzy(query: pd.Series, candidate: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([fuzzy(q, c, x)[0] if q and c else None for q, c, x in zip(query, candidate, label, strict=True)], dtype="float64")


@F.pandas_udf(MATCH)
def _head_tail(head: pd.Series, tail: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([score_head_tail(*(x or "" for x in row))[:3] for row in zip(head, tail, candidate, strict=True)], columns=["score", "start", "end"])


def normalize_anchor(text: Column) -> Column:
    """The form in which anchors and sentences are compared."""
    return _form(text)


def head_tail_score(head: Column, tail: Column, sentence: Column) -> Column:
    """``score, start, end`` of a sentence for the two ends of an anchor."""
    return _head_tail(head, tail, sentence)


def boundary_text(anchor: Column, label: str) -> Column:
    """What of a given anchor is looked for: of ``head ... tail`` the anchor's own side, and of several sentences the outer one.

    A blank anchor gives an empty text.
    """
    parts = F.filter(F.transform(F.split(F.trim(anchor), re.escape("...")), lambda p: F.trim(p)), lambda p: p != "")
    side = F.when(F.contains(anchor, F.lit("...")) & (F.size(parts) > 1), F.element_at(parts, 1 if label == "start_anchor" else -1)).otherwise(F.trim(anchor))
    sentences = F.transform(split_sentences(side), lambda x: F.trim(x))
    return F.when(F.size(sentences) > 1, F.element_at(sentences, 1 if label == "start_anchor" else -1)).otherwise(side)


def resolve_anchor(anchors: DataFrame, sentences: DataFrame, label: str) -> DataFrame:
    """``anchor_id, sentence_index, score, strategy, code, candidates`` of each anchor of ``anchors`` (``anchor_id, chapter_id, anchor``,
    and ``least``: the first sentence to look at).

    A decision, in this order: the one sentence that equals the anchor; of those that hold it (for anchors of ``LONG``
    characters or more) and then of those equal in normal form the only one, or the best if it is good and well before the next;
    the best of all if it is the only one, or very good, or good and well before the next. Else ``code`` says why there is
    none (invalid, none, low_confidence, ambiguous_...) and ``candidates`` shows the best ones.
    """
    asked = anchors.withColumn("query", boundary_text(F.col("anchor"), label)).withColumn("q", normalize_anchor(F.col("query")))
    texts = sentences.select("chapter_id", "sentence_index", "text").withColumn("c", normalize_anchor(F.col("text")))
    q, c = F.col("q"), F.col("c")
    usable = (q != "") & (c != "")
    met = asked.filter("query <> ''").join(texts, "chapter_id").filter(F.col("least").isNull() | (F.col("sentence_index") >= F.col("least")))
    met = met.withColumn("raw", usable & (F.trim("query") == F.trim("text"))).withColumn("equal", usable & (q == c))
    met = met.withColumn("at", F.when(usable & ~F.col("equal"), F.position(q, c) - 1).otherwise(-1)).withColumn("holds", F.col("raw") | (F.col("at") >= 0))
    # one exchange: all that follows is by anchor
    every = Window.partitionBy("anchor_id")
    counts = {"n": F.count(F.lit(1)), "n_raw": F.count_if("raw"), "n_holds": F.count_if("holds"), "n_equal": F.count_if("equal")}
    met = met.withColumns({k: v.over(every) for k, v in counts.items()})
    long = F.length("q") >= LONG
    decided = (F.col("n_raw") > 0) | ((F.col("n_holds") > 0) & long) | (F.col("n_equal") > 0)
    m, n = F.length("q"), F.length("c")
    end = F.col("at") + m
    edge = F.col("at") == 0 if label == "start_anchor" else end == n if label == "end_anchor" else F.lit(True)
    extra = F.when((m >= BONUS_FROM) & edge, BONUS * (0.5 + 0.5 * F.least(F.lit(1.0), m / n))).otherwise(0.0)
    known = (
        F.when(~usable, 0.0).when(F.col("raw"), 1.0).when(F.col("equal"), NORMALIZED).when(F.col("at") >= 0, F.least(F.lit(1.0), SUBSTRING_BASE + SUBSTRING_SHARE * m / n + extra))
        .when(F.contains(q, c), F.least(F.lit(AROUND_MOST), AROUND_BASE + AROUND_SHARE * n / m))
    )
    met = met.withColumn("known", known)
    open_ = F.col("known").isNull() & ~decided
    met = met.withColumn("score", F.coalesce("known", _fuzzy(F.when(open_, q), F.when(open_, c), F.lit(label)), F.lit(0.0)))
    order = [F.desc("score"), F.desc("raw"), F.desc("holds"), F.desc("equal"), "sentence_index"]
    ranked = met.withColumn("rank", F.row_number().over(every.orderBy(*order)))
    for kind in ("holds", "equal"):
        ranked = ranked.withColumn(f"rank_{kind}", F.when(F.col(kind), F.row_number().over(Window.partitionBy("anchor_id", kind).orderBy(*order))))
    one = F.struct("sentence_index", "score")
    nth = lambda rank, k: F.max(F.when(F.col(rank) == k, one))
    shown = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("rank", "sentence_index", "score"))))
    kept = ranked.filter((F.col("rank") <= SHOWN) | (F.col("rank_holds") <= SHOWN) | (F.col("rank_equal") <= SHOWN))
    got = kept.groupBy("anchor_id").agg(
        *(F.first(k).alias(k) for k in counts), F.first(long).alias("long"), nth("rank", 1).alias("top"), nth("rank", 2).alias("second"), nth("rank_holds", 1).alias("held"), nth("rank_holds", 2).alias("held2"),
        nth("rank_equal", 1).alias("same"), nth("rank_equal", 2).alias("same2"), shown(F.col("rank") <= SHOWN).alias("best"), shown(F.col("rank_holds") <= SHOWN).alias("holding"), shown(F.col("rank_equal") <= SHOWN).alias("equals"),
    )
    clear = lambda a, b: (F.col(a)["score"] >= TRUSTED) & (F.col(a)["score"] - F.coalesce(F.col(b)["score"], F.lit(0.0)) >= LEAST_GAP)
    # (condition, strategy or code, what is taken)
    chain = [
        (F.col("n_raw") == 1, "exact_raw", "top"), (F.col("n_raw") > 1, "ambiguous_exact_raw", None),
        ((F.col("n_holds") == 1) & F.col("long"), "exact_substring", "held"), ((F.col("n_holds") > 1) & F.col("long") & clear("held", "held2"), "exact_substring_scored", "held"),
        ((F.col("n_holds") > 1) & F.col("long"), "ambiguous_exact_substring", None),
        (F.col("n_equal") == 1, "exact_normalized", "same"), ((F.col("n_equal") > 1) & clear("same", "same2"), "exact_normalized_scored", "same"), (F.col("n_equal") > 1, "ambiguous_exact_normalized", None),
        (F.col("top")["score"] < LEAST_SCORE, "low_confidence", None), (F.col("n") == 1, "auto_top1_single_candidate", "top"), (F.col("top")["score"] >= VERY_HIGH, "auto_top1_very_high", "top"),
        (clear("top", "second"), "auto_top1", "top"),
    ]

    def folded(value, last):
        out = last
        for condition, name, taken in reversed(chain):
            out = F.when(condition, value(name, taken)).otherwise(out)
        return out

    strategy = folded(lambda name, taken: F.lit(name), F.lit("ambiguous_ranked"))
    taken = folded(lambda name, taken: F.col(taken) if taken else F.lit(None), F.lit(None))
    joined = asked.select("anchor_id", "query").join(got.withColumn("strategy", strategy).withColumn("taken", taken), "anchor_id", "left")
    candidates = F.when(F.col("strategy") == "ambiguous_exact_substring", F.col("holding")).when(F.col("strategy") == "ambiguous_exact_normalized", F.col("equals")).otherwise(F.col("best"))
    code = F.when(F.coalesce("query", F.lit("")) == "", "invalid_anchor").when(F.col("n").isNull(), "none").when(F.col("taken").isNotNull(), "resolved").otherwise(F.col("strategy"))
    none = F.array().cast(CANDIDATES)
    return joined.select(
        "anchor_id", F.col("taken")["sentence_index"].cast("long").alias("sentence_index"), F.col("taken")["score"].alias("score"), F.when(F.col("taken").isNotNull(), F.col("strategy")).alias("strategy"), code.alias("code"),
        F.when(F.col("taken").isNotNull(), none).otherwise(F.coalesce(candidates.cast(CANDIDATES), none)).alias("candidates"),
    )


def _exact(asked: DataFrame, sentences: DataFrame) -> DataFrame:
    """``anchor_id, label, at``: the places of the sentences that equal an anchor of ``asked`` (``anchor_id, chapter_id, label,
    query``), by one join on chapter and text; anchors whose normal form is empty have none."""
    texts = sentences.select("chapter_id", "sentence_index", F.trim("text").alias("_trimmed"))
    usable = asked.withColumn("_trimmed", F.trim("query")).filter((F.col("query") != "") & (normalize_anchor(F.col("query")) != ""))
    met = usable.join(texts, ["chapter_id", "_trimmed"])
    return met.groupBy("anchor_id", "label").agg(F.sort_array(F.collect_list(F.col("sentence_index").cast("long"))).alias("at"))


def _resolved(anchors: DataFrame, sentences: DataFrame, exact: DataFrame, label: str) -> DataFrame:
    """As ``resolve_anchor``, without candidates. Sentences that equal an anchor (``exact``) decide, one or several; only anchors
    without any are held against all sentences of their chapters."""
    own = anchors.join(exact.filter(F.col("label") == label).select("anchor_id", "at"), "anchor_id", "left")
    own = own.withColumn("at", F.filter("at", lambda i: F.col("least").isNull() | (i >= F.col("least"))))
    own = written(own.withColumn("n", F.coalesce(F.when(F.col("at").isNotNull(), F.size("at")), F.lit(0))), "anchors")
    one = F.col("n") == 1
    known = own.filter("n > 0").select(
        "anchor_id", F.when(one, F.col("at")[0]).alias("sentence_index"), F.when(one, 1.0).alias("score"),
        F.when(one, "exact_raw").alias("strategy"), F.when(one, "resolved").otherwise("ambiguous_exact_raw").alias("code"),
    )
    rest = own.filter("n = 0").select("anchor_id", "chapter_id", "anchor", "least")
    if rest.isEmpty():
        return known
    some = sentences.join(rest.select("chapter_id").distinct(), "chapter_id", "left_semi")
    return known.unionByName(resolve_anchor(rest, some, label).drop("candidates"))


def resolve_ranges(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    """``anchor_id, start, end, confidence, code, field, strategy`` of evidence given as ``anchor_id, chapter_id, start_anchor,
    end_anchor`` (null: one sentence). ``code`` is ``resolved``, or the failure of the anchor that ``field`` names.
    """
    kept = written(anchors.select("anchor_id", "chapter_id", "start_anchor", "end_anchor"), "asked-anchors")
    side = lambda label: kept.select("anchor_id", "chapter_id", F.lit(label).alias("label"), boundary_text(F.col(label), label).alias("query"))
    exact = written(_exact(side("start_anchor").unionByName(side("end_anchor")), sentences), "exact-anchors")
    first = _resolved(kept.select("anchor_id", "chapter_id", F.col("start_anchor").alias("anchor"), F.lit(None).cast("long").alias("least")), sentences, exact, "start_anchor")
    first = first.select("anchor_id", *(F.col(c).alias(f"s_{c}") for c in ("sentence_index", "score", "strategy", "code")))
    begun = kept.join(first, "anchor_id")
    asked = begun.filter("end_anchor IS NOT NULL AND s_code = 'resolved'").select("anchor_id", "chapter_id", F.col("end_anchor").alias("anchor"), F.col("s_sentence_index").alias("least"))
    last = _resolved(asked, sentences, exact, "end_anchor").select("anchor_id", *(F.col(c).alias(f"e_{c}") for c in ("sentence_index", "score", "strategy", "code")))
    both = begun.join(last, "anchor_id", "left")
    # a blank end is a fault of the evidence, whatever its start
    blank = F.col("end_anchor").isNotNull() & (F.trim("end_anchor") == "")
    failed = F.when(F.col("s_code") == "invalid_anchor", "start_anchor").when(blank, "end_anchor").when(F.col("s_code") != "resolved", "start_anchor").when(F.coalesce("e_code", F.lit("resolved")) != "resolved", "end_anchor")
    both = both.withColumn("field", failed)
    fine, single = F.col("field").isNull(), F.col("end_anchor").isNull()
    return both.select(
        "anchor_id", F.when(fine, F.col("s_sentence_index")).alias("start"), F.when(fine, F.when(single, F.col("s_sentence_index")).otherwise(F.col("e_sentence_index"))).alias("end"),
        F.when(fine, F.least("s_score", F.coalesce("e_score", "s_score"))).alias("confidence"),
        F.when(fine, "resolved").when(F.col("field") == "start_anchor", F.col("s_code")).when(blank, "invalid_anchor").otherwise(F.col("e_code")).alias("code"), "field",
        F.when(fine, F.when(single, F.col("s_strategy")).otherwise(F.concat_ws("+", "s_strategy", "e_strategy"))).alias("strategy"),
    )
