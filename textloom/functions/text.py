"""Text functions as column expressions; Python (Arrow) only where Unicode normal forms are needed.

Offsets and lengths count code points. A null text gives a null, unless the function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words and characters that aren't indexed, and the lemmas of irregular verbs.
ENGLISH_STOPWORDS = (
    "a an and are as at be been being by can could did do does for from had has have in is may might of on or should the to "
    "was were will with would"
).split()
CHINESE_STOPWORDS = tuple("的地得了着过和与及或而在是为以于对中上下等")
LEMMAS = {
    "am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do",
}
#: What the kinds of tokens are marked with.
PREFIXES = {"phrase": "hp", "bigram": "h2", "trigram": "h3", "dictionary": "hw", "latin": "le", "stem": "ls", "char": "hc"}

_HAN = r"\p{IsHan}"
_EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(_EMPTY)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


#: Characters that NFKC leaves as they are, whatever stands beside them: ASCII, most of Latin, marks of print, Han.
STABLE = (
    r"\x{00}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{2012}-\x{2016}\x{2018}-\x{2022}\x{2030}\x{2039}\x{203A}\x{3001}-\x{3011}\x{4E00}-\x{9FFF}"
)


def nfkc(text: Column) -> Column:
    """Unicode's NFKC; texts of ``STABLE`` characters don't go through Python."""
    plain = text.rlike(rf"\A[{STABLE}]*+\z")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\x{FEFF}]+", " "))


def normalize_search_text(text: Column) -> Column:
    bare = F.regexp_replace(nfkc(text), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    return collapse(F.regexp_replace(bare, r"[\p{Cc}\p{Cf}]", " "))


def stem_english(token: Column) -> Column:
    """A weak stem: irregular lemmas, then one suffix and one doubled consonant less, for ASCII words of four letters or more."""
    n = F.length(token)
    less = lambda k: F.substring(token, F.lit(1), n - k)
    cut = (
        F.when(token.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), less(3))
        .when(token.endswith("ed") & (n > 4), less(2))
        .when(token.endswith("es") & (n > 4), less(2))
        .when(token.endswith("s") & (n > 4), less(1))
        .otherwise(token)
    )
    single = F.regexp_replace(cut, r"\A(.{2,})([bcdfghjklmnpqrstvwxyz])\2\z", "$1$2")
    lemma = F.element_at(F.create_map(*(F.lit(x) for pair in LEMMAS.items() for x in pair)), token)
    return F.coalesce(lemma, F.when(token.rlike(r"\A[a-z]{4,}\z"), single).otherwise(token))


def latin_tokens(text: Column) -> Column:
    """Runs of Latin letters and digits in lower case, without English stop words; in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsLatin}\p{N}]+"), F.lit(0)), lambda t: ~t.isin(*ENGLISH_STOPWORDS))


def han_grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters inside each Han run; ``size`` 0 stands for the whole runs of two or more."""
    runs = F.regexp_extract_all(text, F.lit(_HAN + "+"), F.lit(0))
    if size == 0:
        return F.filter(runs, lambda r: F.length(r) >= 2)
    long = F.filter(runs, lambda r: F.length(r) >= size)
    grams = F.flatten(F.transform(long, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (size - 1)), lambda i: F.substring(r, i, F.lit(size)))))
    return F.filter(grams, lambda c: ~c.isin(*CHINESE_STOPWORDS)) if size == 1 else grams


def encoded(raw: Column, kind: str) -> Column:
    """A token as the index keeps it: the kind's mark and 20 hexadecimal digits."""
    return F.concat(F.lit(PREFIXES[kind]), F.substring(F.sha2(F.lower(raw).cast("binary"), 256), 1, 20))


def _stems(latin: Column) -> Column:
    """The stems that differ from their tokens, without stop words; few tokens end in a way that stems may change."""
    last = lambda t, i: F.substring(t, -i, 1)
    cut = F.filter(latin, lambda t: t.endswith("s") | t.endswith("ed") | t.endswith("ing") | (last(t, 1) == last(t, 2)) | t.isin(*LEMMAS))
    pairs = F.filter(F.transform(cut, lambda t: F.struct(t.alias("t"), stem_english(t).alias("s"))), lambda x: (x["s"] != x["t"]) & ~x["s"].isin(*ENGLISH_STOPWORDS))
    return pairs["s"]


#: The tier of each kind of tokens.
TIERS = {"phrase": 1, "bigram": 1, "trigram": 1, "dictionary": 1, "latin": 1, "stem": 2, "char": 3}


def with_tokens(rows: DataFrame, dictionary: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with a column for each of ``TIERS``, in place of ``text``: the tokens of ``token_plan`` in lower case, each once.

    Each step is a column of its own, so that none is made twice; in ASCII texts no character counts that normal forms change.
    """
    text, norm, latin, runs = F.col("text"), F.col("_norm"), F.col("latin"), F.col("_runs")
    made = rows.withColumn("_norm", F.when(text.rlike(r"\A\p{ASCII}*+\z"), text).otherwise(normalize_search_text(text)))
    made = made.withColumn("latin", F.array_distinct(latin_tokens(norm))).withColumn("_runs", F.when(norm.rlike(_HAN), F.array_join(F.regexp_extract_all(norm, F.lit(_HAN + "+"), F.lit(0)), " ")))
    grams = lambda size: F.when(runs.isNotNull(), F.array_distinct(han_grams(runs, size))).otherwise(_empty())
    words = F.array_distinct(F.transform(dictionary(norm), F.lower)) if dictionary else _empty()
    columns = {"phrase": grams(0), "bigram": grams(2), "trigram": grams(3), "dictionary": words, "stem": F.array_distinct(_stems(latin)), "char": grams(1)}
    return made.withColumns({k: F.coalesce(v, _empty()) for k, v in columns.items()}).withColumn("latin", F.coalesce("latin", _empty())).drop("text", "_norm", "_runs")


def token_plan(text: Column, dictionary: Callable[[Column], Column] | None = None) -> Column:
    """``tier1, tier2, tier3``, each an array of ``encoded, raw`` without repeats.

    Tier 1 has Han phrases, bigrams, trigrams, the words of ``dictionary`` (a function from text to an array of words; there
    is none built in) and Latin tokens; tier 2 the stems that differ from their token; tier 3 single Han characters.
    """
    norm = normalize_search_text(text)
    made = lambda tokens, kind: F.transform(tokens, lambda t: F.struct(encoded(t, kind).alias("encoded"), F.lower(t).alias("raw")))
    latin = latin_tokens(norm)
    words = [made(dictionary(norm), "dictionary")] if dictionary else []
    tier1 = F.concat(made(han_grams(norm, 0), "phrase"), made(han_grams(norm, 2), "bigram"), made(han_grams(norm, 3), "trigram"), *words, made(latin, "latin"))
    return F.struct(
        F.array_distinct(tier1).alias("tier1"), F.array_distinct(made(_stems(latin), "stem")).alias("tier2"), F.array_distinct(made(han_grams(norm, 1), "char")).alias("tier3")
    )


def plan_terms(plan: Column) -> Column:
    """The raw tokens over all tiers, each once, in order."""
    return F.array_distinct(F.concat(plan["tier1"]["raw"], plan["tier2"]["raw"], plan["tier3"]["raw"]))


# --- lexical scores without an index


def lexical_query(query: str) -> tuple[list[str], list[str]] | None:
    """(phrases, terms) of a query: parts of two characters or more; those, Latin tokens and Han characters, each once. None if there is no term."""
    phrases = list(dict.fromkeys(p for p in query.split() if len(p) > 1))
    latin = [x for x in re.findall(r"[^\W_]+", query.lower()) if not _is_han(x)]
    terms = list(dict.fromkeys([*phrases, *latin, *(c.lower() for c in query.strip() if _is_han(c))]))
    return (phrases, terms) if terms else None


def _is_han(text: str) -> bool:
    import unicodedata

    return all(unicodedata.name(c, "").startswith("CJK") for c in text)


def score_lexical_text(text: Column, query: str) -> Column:
    """``score, match_count, matched_terms, missing_terms, snippet_needle`` of a text; null if no term matches.

    A matched phrase scores 2 and its occurrences, another matched term 1; then come the share of matched terms, and 1 or
    one half if the first occurrences lie within 80 or 240 characters.
    """
    kind = "struct<score: double, match_count: int, matched_terms: array<string>, missing_terms: array<string>, snippet_needle: string>"
    parsed = lexical_query(query)
    if parsed is None:
        return F.lit(None).cast(kind)
    phrases, terms = parsed
    low = F.lower(text)
    tokens = F.regexp_extract_all(low, F.lit(r"[\p{IsLatin}\p{N}]+"), F.lit(0))
    place = {t: F.instr(low, t.lower()) for t in terms}
    hit = {t: place[t] > 0 if t in phrases or _is_han(t) else F.array_contains(tokens, t) for t in terms}
    times = {p: (F.length(low) - F.length(F.replace(low, F.lit(p.lower()), F.lit("")))) / len(p) for p in phrases}
    points = [F.when(hit[t], (2 + times[t]) if t in phrases else F.lit(1.0)).otherwise(0.0) for t in terms]
    listed = lambda wanted: F.array_compact(F.array(*(F.when(hit[t] if wanted else ~hit[t], F.lit(t)) for t in terms)))
    places = F.array_compact(F.array(*(F.when(hit[t] & (place[t] > 0), place[t]) for t in terms)))
    span = F.array_max(places) - F.array_min(places)
    near = F.when(F.size(places) < 2, 0.0).when(span <= 80, 1.0).when(span <= 240, 0.5).otherwise(0.0)
    count = F.size(listed(True))
    longest = sorted(terms, key=lambda t: -len(t))  # stable: the first of the longest
    needle = F.coalesce(*(F.when(hit[t], F.lit(t)) for t in longest))
    score = sum(points, F.lit(0.0)) + count / len(terms) + near
    return F.when(count > 0, F.struct(score.alias("score"), count.alias("match_count"), listed(True).alias("matched_terms"), listed(False).alias("missing_terms"), needle.alias("snippet_needle")))


def match_text(text: Column, terms: Sequence[str], match: str = "any") -> Column:
    """``matched_terms, missing_terms, match_count, score`` (the share of terms that the text contains); null if it doesn't match."""
    low = F.lower(text)
    known = F.array(*map(F.lit, terms)) if terms else _empty()
    found = F.filter(known, lambda t: F.contains(low, t))
    needed = len(terms) if match == "all" else 1
    made = F.struct(found.alias("matched_terms"), F.array_except(known, found).alias("missing_terms"), F.size(found).alias("match_count"), (F.size(found) / max(len(terms), 1)).alias("score"))
    return F.when((F.size(found) >= needed) & (F.size(found) > 0), made)


def snippet(text: Column, needle: Column | str | None = None) -> Column:
    """White space collapsed; up to 180 characters whole, else the first 177 and dots, or 60 before and 120 behind the needle."""
    flat = collapse(text)
    plain = F.when(F.length(flat) > 180, F.concat(F.substring(flat, 1, 177), F.lit("..."))).otherwise(flat)
    if needle is None:
        return plain
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.instr(F.lower(flat), needle) - 1
    start, end = F.greatest(F.lit(0), at - 60), F.least(F.length(flat), at + F.length(needle) + 120)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < F.length(flat), "...").otherwise(""))
    return F.when(at >= 0, cut).otherwise(plain)


def rank_to_score(rank: Column) -> Column:
    """An index rank (the more negative, the better) as a score from 0 to 1."""
    r = F.greatest(F.lit(0.0), -rank) * 1e6
    return r / (1 + r)


# --- sentences and words

#: Ends of sentences: a stop with blanks behind it, a Chinese stop, or line ends.
_SENTENCE = r"[^.!?。！？\n]*(?:[.!?]+(?!\s|\z)[^.!?。！？\n]*)*(?:[.!?]+(?=\s|\z)|[。！？]+|\n|\z)"


def split_sentences(text: Column) -> Column:
    """The sentences of a text as raw spans, in order; blank ones are left out. A documented rule stands for the ICU one."""
    return F.filter(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def count_words(text: Column) -> Column:
    """Storage's count: parts between white space."""
    flat = collapse(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("long")


def count_reader_words(text: Column) -> Column:
    """The reader's count: runs of letters and digits, each Han character by itself; without any, the characters that aren't blank."""
    words = F.size(F.regexp_extract_all(text, F.lit(rf"{_HAN}|[\p{{L}}\p{{N}}&&[^{_HAN}]]+"), F.lit(0)))
    return F.when(words > 0, words).otherwise(F.length(F.regexp_replace(text, r"[\s\p{Z}]", ""))).cast("long")


# --- names, ids, markup


def normalize_predicate(name: Column) -> Column:
    """Blanks and hyphens become one underscore, none at the ends, lower case; null for the empty one and for ``mentions``."""
    joined = F.regexp_replace(F.regexp_replace(F.trim(name), r"[\s-]+", "_"), "_+", "_")
    done = F.lower(F.btrim(joined, F.lit("_")))
    return F.when((done != "") & (done != "mentions"), done)


def strip_markup(text: Column) -> Column:
    """Without the tags ``mention`` and ``quote``."""
    return F.regexp_replace(text, r"(?i)</?(?:mention|quote)\b[^>]*>", "")


def full_width_quotes(text: Column) -> Column:
    """Quotation marks and backslashes as their full-width forms."""
    return F.translate(text, "\"'\\", "＂＇＼")


def match_positions(text: Column, needle: Column) -> Column:
    """All places (from 0) at which the needle starts, overlapping ones too."""
    last = F.length(text) - F.length(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(needle)) == needle)
    return F.when((last >= 0) & (needle != ""), at).otherwise(F.array().cast("array<int>"))


def strip_blank_lines(text: Column) -> Column:
    """Without blank lines at the start and the end."""
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+\z", "")


def compressed_text(answer: Column) -> Column:
    """The section under the heading for the compressed text, up to a rule or a warning, else the whole answer; without a code fence around it."""
    section = F.regexp_extract(answer, r"(?is)##\s*(?:Compressed\s+Text|压缩文本)\s*\n+(.*?)(?:\n+---|\*\*CRITICAL\*\*|\z)", 1)
    headed = answer.rlike(r"(?i)##\s*(?:Compressed\s+Text|压缩文本)\s*\n")
    edges = lambda t: F.regexp_replace(t, r"\A\s+|\s+\z", "")
    body = edges(F.when(headed, section).otherwise(answer))
    fence = r"(?s)\A```(?:\w+)?\s*\n(.*?)\n```\z"
    return F.when(body.rlike(fence), edges(F.regexp_extract(body, fence, 1))).otherwise(body)


def base64url(text: Column) -> Column:
    """Without padding and in one line: ``base64`` puts line ends behind every 76 characters."""
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def short_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that depend on nothing but the parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12)


def chapter_key(title: Column) -> Column:
    """A title as part of a path: lower case, runs of other characters than letters and digits as one hyphen."""
    key = F.btrim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.when(key == "", "chapter").otherwise(key)


#: Language names and codes and the code that stands for them.
LANGUAGES = {"english": "en", "eng": "en", "french": "fr", "fra": "fr", "german": "de", "deu": "de", "spanish": "es", "spa": "es", "chinese": "zh", "zho": "zh", "japanese": "ja", "jpn": "ja"}


def language_code(name: Column) -> Column:
    """A language's code: names and three-letter codes by the table, else the part before a region in lower case."""
    low = F.lower(F.trim(name))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), low)
    return F.coalesce(known, F.when(low.rlike(r"\A[a-z]{2,3}([-_].*)?\z"), F.regexp_extract(low, r"\A([a-z]{2,3})", 1)))


def chapter_stage(summary_sentences: Column, topology_ready: Column, fragments: Column) -> Column:
    return F.when(summary_sentences > 0, "summarized").when(topology_ready, "graphed").when(fragments > 0, "sourced").otherwise("planned")


def canonical_json(*columns: str) -> Column:
    """JSON of the named columns in the order of their names, without nulls; for hashes."""
    return F.to_json(F.struct(*sorted(columns)))


def canonical_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 512)


def uri(kind: str, *parts: Column | str) -> Column:
    """``kind/part/part``; parts are percent-encoded."""
    made = [F.url_encode((F.lit(p) if isinstance(p, str) else p).cast("string")) for p in parts]
    return F.concat_ws("/", F.lit(kind), *made)


def range_uri(chapter: Column, start: Column, end: Column) -> Column:
    """A source range; sentences count from 1 in it."""
    first, last = (start + 1).cast("string"), (end + 1).cast("string")
    return F.concat(F.lit("source/"), chapter.cast("string"), F.lit("#"), first, F.when(start == end, F.lit("")).otherwise(F.concat(F.lit(".."), last)))


def parse_range_uri(text: Column) -> Column:
    """``chapter_id, start, end`` of a range URI, sentences from 0; null if it isn't one."""
    pattern = r"\Asource/(\d+)#(\d+)(?:\.\.(\d+))?\z"
    part = lambda i: F.regexp_extract(text, pattern, i)
    start = part(2).try_cast("long") - 1
    end = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("long") - 1, start)
    return F.when(text.rlike(pattern), F.struct(part(1).try_cast("long").alias("chapter_id"), start.alias("start"), end.alias("end")))
