"""The language of a text by the ranks of its commonest character sequences.

A profile is the ``SIZE`` commonest sequences of one to three characters in the words of a language, with a mark at each end of a word.
A text has the language whose profile its own is nearest to. A text's sequences are counted in its row, so that only its scores,
one for each language, go through an exchange; a language's words are counted before they are cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SIZE, LONGEST = 300, 3
#: A sequence as a number: the code points of its characters, the first one highest, so that numbers are in the order of sequences.
BITS = 21


def gram_key(gram: str) -> int:
    return sum(ord(c) << BITS * (LONGEST - 1 - i) for i, c in enumerate(gram))


def commonest(words: str, size: int) -> np.ndarray:
    """The keys of the ``size`` commonest sequences of the words of a text (parted by blanks), by falling count, then by the sequence."""
    codes = np.frombuffer("".join(f"_{w}_ " for w in words.split()).encode("utf-32-le"), np.uint32).astype(np.int64)
    inside, keys, parts = codes != ord(" "), np.zeros(len(codes), np.int64), []
    for k in range(LONGEST):
        n = max(0, len(codes) - k)
        keys = keys[:n] | codes[k:] << BITS * (LONGEST - 1 - k)
        inside = inside[:n] & (codes[k:] != ord(" "))
        parts.append(keys[inside])
    every = np.sort(np.concatenate(parts))
    every = every[every != gram_key("_")]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    counts = np.diff(first, append=len(every))
    return every[first[np.argsort(-counts, kind="stable")[:size]]]


def _commonest(text: Column, size: int) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def keys(words: pd.Series) -> pd.Series:
        return words.map(lambda t: commonest(t, size), na_action="ignore")

    return keys(F.regexp_replace(F.lower(text), r"\P{L}+", " "))


@F.pandas_udf(LongType())
def _key(gram: pd.Series) -> pd.Series:
    return gram.map(gram_key)


def _ranked(texts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys, gram, rank``: from 1, by falling count, then by the sequence."""
    words = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit("_"), "word", F.lit("_"))

    def grams(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))

    each = counted.select(*keys, "n", F.explode(F.concat(*(grams(k) for k in range(1, LONGEST + 1)))).alias("gram")).filter("gram <> '_'")
    sums = each.groupBy(*keys, "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")))
    return ranked.filter(F.col("rank") <= size).select(*keys, "gram", "rank")


def profiles(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """``lang, gram, rank`` of the languages of ``texts`` (``lang, text``); rows without a language are left out."""
    return _ranked(texts.filter("lang IS NOT NULL"), ["lang"], size)


def detected(texts: DataFrame, profiles: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``key, lang, share``: the nearest profile's language, and how near from 0 to 1; both null for a text without a known sequence.

    A sequence counts ``size`` less the difference of its two ranks; ties go to the smaller code. ``key`` must be unique.
    """
    own = texts.select(key, _commonest(F.col("text"), size).alias("keys"))
    each = own.withColumn("full", F.size("keys") * size).select(key, "full", F.posexplode("keys").alias("at", "key_of_gram"))
    known = F.broadcast(profiles.select("lang", _key(F.col("gram")).alias("key_of_gram"), (F.col("rank") - 1).alias("there")))  # ``size`` rows a language
    met = each.join(known, "key_of_gram").groupBy(key, "full", "lang").agg(F.sum(size - F.abs(F.col("at") - F.col("there"))).alias("score"))
    best = met.groupBy(key).agg(F.min_by(F.struct("lang", "score"), F.struct(-F.col("score"), "lang")).alias("best"), F.first("full").alias("full"))
    named = best.select(key, F.col("best")["lang"].alias("lang"), (F.col("best")["score"] / F.col("full")).alias("share"))
    return texts.select(key).join(named, key, "left")
