"""Operator 11, fill-in-the-middle transformation: a text is cut in three at random unit borders and put in another order.

A unit is a run of words' characters with the white space before it, or white space at the end. ``cut`` is a matcher of
constant memory: its first pass over a text counts the units, its second advances a lazy match iterator to both ranks; no
array of units is kept. All else (the draws, the three parts, their order, digests) is built-in expressions.

The draws come from the SHA-256 of ``seed:key``, so reruns agree whatever the partitioning, and rows that repeat a key get
the same draws. A null text counts as an empty one; empty texts and those that hold a sentinel stay as they are (form
``plain``). A null key draws as an empty one would. Long texts are cut whole. Ties can't occur: each row is judged alone.
Columns named like a result are replaced, all others pass through. An empty table gives an empty one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh_mark, table

#: The sentinels of prefix, suffix and middle, and a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

#: Percent of the texts that are cut, and of those the percent in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number n of units, and the code points before the smaller and the larger rank of first % (n + 1) and second % (n + 1)."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, end, ends = UNIT.finditer(text), 0, []
    for steps in (low, high - low):
        for _ in range(steps):
            end = next(matches).end()
        ends.append(end)
    return n, ends[0], ends[1]


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cut(*row) for row in zip(text, first, second, strict=True)], columns=["n", "first", "second"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; sentinels can't be in the text, so they cut the output safely."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)  # nothing, then the three parts in their order
    one, two, three = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    mark = fresh_mark(docs.columns)
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = lambda c: F.col(f"{mark}{c}")
    kept = [named(c) for c in docs.columns if c.lower() not in RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(key).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.conv(F.substring(own("digest"), 8 * i + 1, F.lit(8)), 16, 10).cast("long"))
    drawn = docs.withColumn(f"{mark}text", F.coalesce(named(text), F.lit(""))).withColumn(f"{mark}digest", digest).withColumn(f"{mark}h", draws)
    h = [F.get(own("h"), i) for i in range(4)]
    matched = drawn.withColumn(f"{mark}cut", cuts(own("text"), h[0], h[1]))
    whole, first, second = own("text"), own("cut")["first"].cast("int"), own("cut")["second"].cast("int")
    plain = (whole == "") | (h[2] % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains(whole, F.lit(sentinel))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(whole, F.lit(1), first), F.substring(whole, first + 1, second - first), F.substring(whole, second + 1, F.char_length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    chars = lambda n: F.when(own("form") != "plain", n.cast("long"))
    return matched.withColumn(f"{mark}form", form).select(
        *kept, own("cut")["n"].alias("n"), own("form").alias("form"), chars(first).alias("prefix_chars"), chars(second - first).alias("middle_chars"),
        F.when(own("form") == "plain", whole).when(own("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents),
drawn AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM cut),
ranked AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM drawn),
parts AS (
    SELECT doc_id, n, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM ranked)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""
