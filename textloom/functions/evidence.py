"""Fuzzy matching of quotes to sentences, and the choice of a quote's evidence.

Texts are compared in a normal form (separators as spaces, case folded, marks stripped). A quote that isn't a part of the
sentence is held against every window of the sentence, of 0.72 to 2.25 times its length. All windows that start at one
place share one table of edit distances and common subsequences, and all places are worked at once in numpy.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from .text import strip_markup

#: Fixed values of the scores and of the decision.
NORMALIZED_EXACT, SUBSTRING_BASE, SUBSTRING_BONUS, SUBSTRING_MOST = 0.995, 0.95, 0.04, 0.99
LEAST_WINDOW, MOST_WINDOW = 0.72, 2.25
WEIGHTS = {"edit": 0.2, "substring": 0.18, "subsequence": 0.24, "ordered": 0.2, "ngram": 0.08, "length": 0.05, "unordered": 0.05}
UNORDERED_FROM, ORDERED_UNDER, PENALTY = 0.75, 0.45, 0.65
TRUSTED, TRUSTED_SUBSTRING, LEAST_GAP, LOW_CONFIDENCE, CANDIDATES = 0.72, 0.95, 0.15, 0.45, 5

SCORE = (
    StructType().add("score", DoubleType()).add("start", IntegerType()).add("end", IntegerType()).add("strategy", StringType())
    .add("exact_raw", BooleanType()).add("exact_substring", BooleanType()).add("exact_normalized", BooleanType())
)


def _separated(text: str) -> str:
    return "".join(" " if c not in "+#&" and (c.isspace() or unicodedata.category(c)[0] in "ZP" or c in "|") else c for c in text)


def _ignorable(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️" or "᠋" <= c <= "᠏"


def display_form(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", "".join(c for c in text if not _ignorable(c))).split())


def match_form(text: str) -> str:
    compatible = unicodedata.normalize("NFKC", "".join(c for c in _separated(text) if not _ignorable(c)))
    folded = compatible.lower().replace("ß", "ss").replace("ς", "σ")
    bare = "".join(c for c in unicodedata.normalize("NFD", folded) if unicodedata.category(c)[0] != "M")
    return " ".join(_separated(bare).split())


def _grams(text: str, n: int) -> set[str]:
    return ({text} if text else set()) if len(text) <= n else {text[i : i + n] for i in range(len(text) - n + 1)}


def windows(quote: str, sentence: str, least: int, most: int) -> dict:
    """Measures of all windows of ``least`` to ``most`` characters of ``sentence`` against ``quote``, as (starts, sizes) tables.

    ``edit`` (distance), ``run`` (longest common substring), ``common`` (longest common subsequence), ``dice`` (of the sets of two
    and of three characters, averaged), ``met`` (characters of the quote that the window has, repeats counted), ``alphabet``
    (Jaccard similarity of the sets of characters), and ``inside``: which windows end inside the sentence.
    """
    import numpy as np

    m, n = len(quote), len(sentence)
    q = np.array([ord(c) for c in quote])
    padded = np.concatenate([np.array([ord(c) for c in sentence]), np.full(most, -1)])
    starts = np.arange(n - least + 1)
    text = padded[starts[:, None] + np.arange(most)]  # (starts, most)
    # one table for each start; column j is the window of j characters
    edit = np.tile(np.arange(most + 1.0), (len(starts), 1))
    common = np.zeros((len(starts), most + 1))
    run, longest = np.zeros((len(starts), most + 1)), np.zeros((len(starts), most + 1))
    columns = np.arange(most + 1)
    for i in range(m):
        same = text == q[i]
        replaced = np.minimum(edit[:, 1:] + 1, edit[:, :-1] + ~same)
        row = np.concatenate([np.full((len(starts), 1), i + 1.0), replaced], axis=1)
        edit = np.minimum.accumulate(row - columns, axis=1) + columns  # insertions from the left
        grown = np.where(same, common[:, :-1] + 1, common[:, 1:])
        common = np.maximum.accumulate(np.concatenate([np.zeros((len(starts), 1)), grown], axis=1), axis=1)
        run = np.concatenate([np.zeros((len(starts), 1)), np.where(same, run[:, :-1] + 1, 0)], axis=1)
        longest = np.maximum(longest, run)
    longest = np.maximum.accumulate(longest, axis=1)
    sizes = np.arange(least, most + 1)
    dice, met, alphabet = (np.zeros((len(starts), len(sizes))) for _ in range(3))
    own, letters = {k: _grams(quote, k) for k in (2, 3)}, set(quote)
    for s in range(len(starts)):
        left: dict[str, int] = {}
        for c in quote:
            left[c] = left.get(c, 0) + 1
        hit, seen, hits, other = 0, {2: set(), 3: set()}, {2: 0, 3: 0}, set()
        for w in range(1, min(most, n - s) + 1):
            c = sentence[s + w - 1]
            other.add(c)
            if left.get(c, 0) > 0:
                left[c] -= 1
                hit += 1
            for k in (2, 3):
                if w >= k and (g := sentence[s + w - k : s + w]) not in seen[k]:
                    seen[k].add(g)
                    hits[k] += g in own[k]
            if w >= least:
                met[s, w - least] = hit
                alphabet[s, w - least] = len(letters & other) / len(letters | other)
                for k in (2, 3):
                    size, found = (len(seen[k]), hits[k]) if w >= k else (1, int(sentence[s : s + w] in own[k]))
                    dice[s, w - least] += found / (len(own[k]) + size)
    return {"edit": edit[:, sizes], "run": longest[:, sizes], "common": common[:, sizes], "dice": dice, "met": met, "alphabet": alphabet, "inside": starts[:, None] + sizes <= n}


def first_best(score, least: int) -> tuple[float, int, int]:
    """(score, start, end) of the best window of a (starts, sizes) table: of equal ones the shortest, then the first."""
    at = int(score.T.argmax())  # by size, then by start
    size, start = least + at // len(score), at % len(score)
    top = float(score[start, size - least])
    return (top, int(start), int(start + size)) if top > 0 else (0.0, -1, -1)


def best_window(quote: str, sentence: str) -> tuple[float, int, int]:
    """(score, start, end) of the window of ``sentence`` that is most like ``quote``: of equal ones the shortest, then the first."""
    import numpy as np

    m, n = len(quote), len(sentence)
    least = max(1, int(m * LEAST_WINDOW))
    most = min(n, max(least, -int(-m * MOST_WINDOW // 1)))
    if most < least:
        return 0.0, -1, -1
    t, sizes = windows(quote, sentence, least, most), np.arange(least, most + 1)
    larger = np.maximum(m, sizes)
    e = 1 - t["edit"] / larger
    sub, seq, ordered = 2 * t["run"] / (m + sizes), 2 * t["common"] / (m + sizes), t["common"] / m
    length, grams, unordered = 1 - np.abs(m - sizes) / larger, t["dice"], t["met"] / m
    score = sum(WEIGHTS[k] * x for k, x in zip(WEIGHTS, (e, sub, seq, ordered, grams, length, unordered)))
    best = np.maximum(np.maximum(e, sub), np.maximum(seq, ordered))
    score = np.clip(np.where((unordered >= UNORDERED_FROM) & (best < ORDERED_UNDER), score * PENALTY, score), 0, 1)
    return first_best(np.where(t["inside"], score, -1.0), least)


def quote_score(quote: str, sentence: str) -> tuple:
    """(score, start, end, strategy, exact raw, exact substring, exact normalised); both without markup."""
    quote, sentence = quote.strip(), sentence.strip()
    q, s = match_form(quote), match_form(sentence)
    if not q or not s:
        return 0.0, -1, -1, "empty", False, False, False
    if quote == sentence:
        return 1.0, 0, len(s), "exact", True, True, True
    if q == s:
        return NORMALIZED_EXACT, 0, len(s), "normalized_exact", False, True, True
    if (at := s.find(q)) >= 0:
        return min(SUBSTRING_MOST, SUBSTRING_BASE + SUBSTRING_BONUS * len(q) / len(s)), at, at + len(q), "normalized_substring", False, True, False
    score, start, end = best_window(q, s)
    return score, start, end, "fuzzy_window" if score > 0 else "empty", False, False, False


@F.pandas_udf(StringType())
def _display(text: pd.Series) -> pd.Series:
    return text.map(display_form, na_action="ignore")


@F.pandas_udf(StringType())
def _match(text: pd.Series) -> pd.Series:
    return text.map(match_form, na_action="ignore")


@F.pandas_udf(SCORE)
def _scored(quote: pd.Series, sentence: pd.Series) -> pd.DataFrame:
    rows = [quote_score(q or "", s or "") for q, s in zip(quote, sentence)]
    return pd.DataFrame(rows, columns=["score", "start", "end", "strategy", "exact_raw", "exact_substring", "exact_normalized"])


def normalize_display(text: Column) -> Column:
    return _display(text)


def normalize_match(text: Column) -> Column:
    return _match(text)


def score_quote(quote: Column, sentence: Column) -> Column:
    """How like a quote a sentence is, as a struct ``score, start, end, strategy, exact_..``; nulls count as empty."""
    return _scored(strip_markup(quote), strip_markup(sentence))


def quote_candidates(quotes: DataFrame, sentences: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The ``limit`` best sentences of each quote: score, exact matches, then the sentence's place.

    ``quotes``: ``quote_id, chapter_id, quote, sentence_id`` (null: none named); ``sentences``: ``chapter_id, sentence_index, text``.
    A quote meets the sentences of its own chapter only.
    """
    met = quotes.join(sentences.select("chapter_id", "sentence_index", "text"), "chapter_id").withColumn("s", score_quote(F.col("quote"), F.col("text")))
    met = met.select("quote_id", "chapter_id", "sentence_id", "sentence_index", "s.*")
    order = [F.desc("score"), F.desc("exact_raw"), F.desc("exact_substring"), F.desc("exact_normalized"), "sentence_index"]
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("quote_id").orderBy(*order)))
    return ranked.filter((F.col("rank") <= limit) | (F.col("sentence_index") == F.col("sentence_id")))


def resolve_quotes(quotes: DataFrame, sentences: DataFrame) -> DataFrame:
    """``quote_id, sentence_index, confidence, code`` (resolved, low_confidence, ambiguous, none or invalid) ``, strategy``.

    A sentence that the quote names is taken if it holds the quote, or if it is good enough and not far behind the best one.
    Else the best one is taken if it is good enough and well before the second.
    """
    found = quote_candidates(quotes, sentences)
    named = F.col("sentence_index") == F.col("sentence_id")
    one = F.struct("sentence_index", "score", "exact_substring", "strategy")
    got = found.groupBy("quote_id").agg(
        F.max(F.when(named, one)).alias("own"), F.max(F.when(F.col("rank") == 1, one)).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second")
    )
    joined = quotes.select("quote_id", "quote").join(got, "quote_id", "left")
    own, top = F.col("own"), F.col("top")
    exact = own["exact_substring"] & (own["score"] >= TRUSTED_SUBSTRING)
    near = (own["score"] >= TRUSTED) & ((own["sentence_index"] == top["sentence_index"]) | (top["score"] - own["score"] < LEAST_GAP))
    by_name = F.coalesce(exact | near, F.lit(False))
    by_rank = (top["score"] >= TRUSTED) & (top["score"] - F.col("second") >= LEAST_GAP)
    code = (
        F.when(F.trim(F.coalesce("quote", F.lit(""))) == "", "invalid").when(by_name, "resolved").when(top.isNull(), "none")
        .when(top["score"] < LOW_CONFIDENCE, "low_confidence").when(by_rank, "resolved").otherwise("ambiguous")
    )
    taken = F.when(by_name, own).otherwise(top)
    how = F.when(by_name, F.concat(F.lit("sentence_id+"), own["strategy"])).otherwise(F.concat(F.lit("quote_auto_top1:"), top["strategy"]))
    done = F.col("code") == "resolved"
    return joined.withColumn("code", code).select(
        "quote_id", F.when(done, taken["sentence_index"]).alias("sentence_index"), F.when(done, taken["score"]).alias("confidence"), "code", F.when(done, how).alias("strategy")
    )


def resolve_lists(resolved: DataFrame, owner: str, order: str) -> DataFrame:
    """``owner, sentence_ids, confidence``: owners all of whose quotes are resolved; the ids in order, each once, and the least confidence."""
    got = resolved.groupBy(owner).agg(
        F.bool_and(F.col("code") == "resolved").alias("all"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct(order, "sentence_index")))["sentence_index"].alias("ids")
    )
    return got.filter("all").select(owner, F.array_distinct("ids").alias("sentence_ids"), "confidence")
