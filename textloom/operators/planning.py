"""What building would cost, and how much of an archive is built: aggregates over chapters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, by task: words of a call, least and most seconds of a call, seconds of a word, tokens of a word (input, cacheable, output).
PROFILES = {
    "knowledge-graph": (35, 15, 35, 0.02, 80, 60, 25),
    "reading-graph": (160, 15, 45, 0.01, 25, 20, 4),
    "reading-summary": (110, 10, 25, 0.01, 55, 45, 4),
}
#: Jobs and requests at a time; a task whose calls follow one another.
JOBS, REQUESTS, SERIAL = 3, 6, "reading-graph"


def task_costs(chapters: DataFrame, keys: list[str], tasks: Iterable[str] = tuple(PROFILES), requests: int = REQUESTS) -> DataFrame:
    """``keys, task, chapters, words, calls, least_seconds, most_seconds, input_tokens, cacheable_tokens, output_tokens``.

    ``chapters``: keys, words; one row a chapter. There is a call for each chapter at least; calls go in batches of ``requests``.
    """
    sums = chapters.groupBy(*keys).agg(F.count(F.lit(1)).alias("chapters"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    names = ("per_call", "least", "most", "word_seconds", "input", "cacheable", "output", "at_once")
    rows = F.array(*(F.struct(F.lit(t).alias("task"), *(F.lit(float(v)).alias(n) for n, v in zip(names, (*PROFILES[t], 1 if t == SERIAL else max(1, requests)), strict=True))) for t in tasks))
    each = sums.withColumn("p", F.explode(rows))
    p = lambda n: F.col("p")[n]
    whole = lambda c: F.ceil(c).cast("long")
    each = each.withColumn("calls", F.greatest(F.col("chapters"), whole(F.col("words") / p("per_call"))))
    seconds = lambda n: whole(F.ceil(F.col("calls") / p("at_once")) * p(n) + F.col("words") * p("word_seconds"))
    tokens = [whole(F.col("words") * p(n)).alias(f"{n}_tokens") for n in ("input", "cacheable", "output")]
    return each.select(*keys, p("task").alias("task"), "chapters", "words", "calls", seconds("least").alias("least_seconds"), seconds("most").alias("most_seconds"), *tokens)


def total_costs(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Costs of all tasks together."""
    return costs.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("calls", "least_seconds", "most_seconds", "input_tokens", "cacheable_tokens", "output_tokens")))


def shown_percent(part: Column, whole: Column) -> Column:
    """A share as text: whole percents without a decimal, others with one, ``n/a`` of nothing."""
    percent = F.try_divide(part.cast("double"), whole) * 100
    shown = F.when(percent == F.floor(percent), F.floor(percent).cast("string")).otherwise(F.format_string("%.1f", percent))
    return F.when(whole != 0, F.concat(shown, F.lit("%"))).otherwise("n/a")


def coverage(chapters: DataFrame, keys: list[str], covered: str = "covered", words: str = "words") -> DataFrame:
    """``keys, covered_chapters, total_chapters, covered_words, total_words, percent`` (of words). ``chapters``: one row each; null is not covered."""
    is_it = F.coalesce(F.col(covered), F.lit(False))
    sums = chapters.groupBy(*keys).agg(
        F.count_if(is_it).alias("covered_chapters"), F.count(F.lit(1)).alias("total_chapters"), F.coalesce(F.sum(F.when(is_it, F.col(words))), F.lit(0)).alias("covered_words"), F.coalesce(F.sum(words), F.lit(0)).alias("total_words")
    )
    return sums.withColumn("percent", shown_percent(F.col("covered_words"), F.col("total_words")))
