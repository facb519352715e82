"""Words of a given dictionary in runs of Han characters, by a lattice that Spark's own expressions fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary_words(words: Sequence[str]) -> Callable[[Column], Column]:
    """A function from text to the array of dictionary words of its Han runs, in order; it fits ``token_plan``.

    Each run is cut into as few parts as can be, a part being a word of the dictionary or one character. Of cuts with as few parts the
    one is taken whose last part is the longest, then the one before it, and so on. Parts of one character aren't returned. The
    words travel as a set in the plan, so a dictionary should have thousands, not millions; words of other scripts are left out.
    """
    known = sorted({w for w in words if len(w) > 1})
    most = max(map(len, known), default=1)

    def cut(run: Column) -> Column:
        # best[i]: (parts, minus the length of the last part) of the first i characters
        def grow(best: Column, i: Column) -> Column:
            def end(size: Column) -> Column:
                fits = (size == 1) | F.substring(run, i - size + 1, size).isin(known) if known else size == 1
                return F.when((size <= i) & fits, F.struct((F.get(best, i - size)["parts"] + 1).alias("parts"), (-size).alias("last")))

            return F.concat(best, F.array(F.array_min(F.transform(F.sequence(F.lit(1), F.lit(most)), end))))

        first = F.array(F.struct(F.lit(0).alias("parts"), F.lit(0).alias("last")))
        best = F.aggregate(F.sequence(F.lit(1), F.length(run)), first, grow)
        # back from the end: the lattice, what is left of the run, and the words so far
        start = F.struct(best.alias("best"), F.length(run).alias("at"), F.array().cast("array<string>").alias("words"))

        def back(state: Column, _: Column) -> Column:
            size = -F.get(state["best"], state["at"])["last"]
            word = F.array(F.substring(run, state["at"] - size + 1, size))
            went = F.struct(state["best"].alias("best"), (state["at"] - size).alias("at"), F.concat(F.when(size > 1, word).otherwise(F.array().cast("array<string>")), state["words"]).alias("words"))
            return F.when(state["at"] > 0, went).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, back, lambda s: s["words"])

    return lambda text: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\p{IsHan}{2,}"), F.lit(0)), cut))
