"""Which options of a mention's surface a model is shown, page by page, and how its answers steer the pages to come.

Counters run for each surface of a chapter: how often it was shown, accepted, continued and rejected. They set how many options
the next page of one of its candidates has. ``surface_statistics`` computes them over a table of events with windows,
``streaming.grounding`` over a stream with state; ``grounded`` runs the rounds around a given model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Options on the pages of a candidate, without and with a prior of its surface; what makes a prior; options of a window.
BUDGETS, PRIOR_BUDGETS, PRIOR_FROM, WINDOW_OPTIONS, SCREENED = (5, 10, 20, 35), (3, 5, 10, 20, 35), 3, 50, 0.1
REJECTIONS = ("skip_this_time", "never_recall")
COUNTERS = ["seen", "recalled", "continued", "rejected"]
SURFACE = ["chapter_id", "surface"]


def has_prior(seen: int, recalled: int, continued: int, rejected: int) -> bool:
    """A surface that was shown often and always answered in one way, or often asked for more."""
    return seen >= PRIOR_FROM and ((recalled >= 2 and not continued) or (rejected >= 2 and not recalled) or continued >= PRIOR_FROM)


def prior(c: Callable[[str], Column] = F.col) -> Column:
    """``has_prior`` as an expression over the counters' columns."""
    often = ((c("recalled") >= 2) & (c("continued") == 0)) | ((c("rejected") >= 2) & (c("recalled") == 0)) | (c("continued") >= PRIOR_FROM)
    return (c("seen") >= PRIOR_FROM) & often


def page_budget(prior: Column, page: Column) -> Column:
    """Options of a candidate's page; ``page`` counts from 0, and the last number holds for all further pages."""
    at = lambda budgets: F.element_at(F.array(*map(F.lit, budgets)), F.least(page + 1, F.lit(len(budgets))).cast("int"))
    return F.when(prior, at(PRIOR_BUDGETS)).otherwise(at(BUDGETS))


def kinds(kind: Column, decision: Column) -> dict[str, Column]:
    """What an event adds to each counter."""
    return {"seen": kind == "page", "recalled": kind == "accept", "continued": kind == "continue", "rejected": (kind == "close") & F.coalesce(decision.isin(*REJECTIONS), F.lit(False))}


def surface_statistics(events: DataFrame) -> DataFrame:
    """``chapter_id, surface, seq, candidate_id, kind``, the counters before each event, and for a page ``page, budget``.

    ``events``: chapter_id, surface, seq (the order in a surface, each once), candidate_id, kind (page, accept, continue or
    close), decision.
    """
    before = lambda *keys: Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda is_it, *keys: F.coalesce(F.count_if(is_it).over(before(*keys)), F.lit(0))
    counted = events.withColumns({name: count(is_it, *SURFACE) for name, is_it in kinds(F.col("kind"), F.col("decision")).items()})
    page = F.when(F.col("kind") == "page", count(F.col("kind") == "page", *SURFACE, "candidate_id"))
    paged = counted.withColumn("page", page).withColumn("budget", F.when(F.col("kind") == "page", page_budget(prior(), F.col("page"))))
    return paged.select(*SURFACE, "seq", "candidate_id", "kind", *COUNTERS, "page", "budget")


# --- the model's rounds


def frequent_surfaces(candidates: DataFrame, share: float = SCREENED) -> DataFrame:
    """``chapter_id, surface, n`` of the most frequent surfaces of each chapter: that share of them, at least one; ties by surface."""
    counts = candidates.groupBy(*SURFACE).agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("chapter_id")
    ranked = counts.withColumn("rank", F.row_number().over(each.orderBy(F.desc("n"), "surface"))).withColumn("all", F.count(F.lit(1)).over(each))
    return ranked.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("all") * share))).select(*SURFACE, "n")


def screened(candidates: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], share: float = SCREENED) -> DataFrame:
    """Candidates without those of frequent surfaces that the model doesn't keep. ``judge`` gets batches of ``chapter_id, surface, n``
    and returns ``chapter_id, surface`` of what stays."""
    often = written(frequent_surfaces(candidates, share), "frequent-surfaces")
    kept = often.mapInPandas(lambda batches: (judge(b) for b in batches), "chapter_id long, surface string")
    gone = often.select(*SURFACE).join(kept, SURFACE, "left_anti")
    return candidates.join(gone, SURFACE, "left_anti")


def windows(pages: DataFrame, most: int = WINDOW_OPTIONS) -> DataFrame:
    """``candidate_id, window``: a chapter's candidates in order, as many together as have ``most`` options; one alone may have more.

    ``pages``: chapter_id, candidate_id, place, n.
    """

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows, window, filled, numbers = rows.sort_values("place"), 0, 0, []
        for n in rows["n"]:
            if filled and filled + n > most:
                window, filled = window + 1, 0
            filled += n
            numbers.append(window)
        return pd.DataFrame({"candidate_id": rows["candidate_id"], "window": numbers})

    return pages.groupBy("chapter_id").applyInPandas(cut, "candidate_id string, window long")


def grounded(candidates: DataFrame, options: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], most: int = WINDOW_OPTIONS) -> tuple[DataFrame, list[dict]]:
    """(accepted ``candidate_id, chapter_id, surface, qid, round``, figures of each round).

    ``candidates``: chapter_id, candidate_id (unique), place, surface. ``options``: candidate_id, place, qid (once a candidate), linked
    (array of related qids). ``judge`` gets one window's options (chapter_id, window, candidate_id, place, surface, page, has_more, qids) and returns
    ``candidate_id, decision, qid``: accept (with a qid), continue, or one of ``REJECTIONS``. In each round every open
    candidate shows its next options, first those that the surface has been recalled with; who is continued and has more goes
    on. A round's tables are written, so that a lost executor repeats no model call of an earlier round.
    """
    spark = candidates.sparkSession
    own = written(candidates.select("chapter_id", "candidate_id", "place", "surface"), "grounding-candidates")
    left = written(options.select("candidate_id", F.col("place").alias("option"), "qid", F.coalesce("linked", F.array().cast("array<string>")).alias("linked")), "grounding-options")
    open_ = own.withColumn("page", F.lit(0))
    stats = spark.createDataFrame([], "chapter_id long, surface string, seen long, recalled long, continued long, rejected long")
    recalls = spark.createDataFrame([], "chapter_id long, surface string, qid string, n long")
    accepted, figures = [], []
    while True:
        asked = left.join(open_, "candidate_id")
        near = asked.select("chapter_id", "surface", "candidate_id", F.col("qid").alias("of"), F.explode(F.concat(F.array("qid"), "linked")).alias("qid")).join(recalls, [*SURFACE, "qid"])
        score = near.groupBy("candidate_id", F.col("of").alias("qid")).agg(F.sum("n").alias("score"))
        scored = asked.join(score, ["candidate_id", "qid"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("score"), "option")))
        # candidates of one surface count as seen one after the other, also on one page
        shown = ranked.groupBy("chapter_id", "candidate_id", "place", "surface", "page").agg(F.count(F.lit(1)).alias("left")).join(stats, SURFACE, "left").fillna(0, COUNTERS)
        shown = shown.withColumn("seen", F.col("seen") + F.row_number().over(Window.partitionBy(*SURFACE).orderBy("place")) - 1)
        shown = shown.withColumn("budget", page_budget(prior(), F.col("page"))).withColumn("has_more", F.col("left") > F.col("budget"))
        chosen = ranked.join(shown.select("candidate_id", "budget", "has_more"), "candidate_id").filter(F.col("rank") <= F.col("budget"))
        chosen = written(chosen.select("chapter_id", "candidate_id", "place", "surface", "page", "has_more", "rank", "qid"), "grounding-chosen")
        if chosen.isEmpty():
            break
        pages = chosen.groupBy("chapter_id", "candidate_id", "place", "surface", "page", "has_more").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "qid")))["qid"].alias("qids"))
        pages = written(pages.join(windows(pages.select("chapter_id", "candidate_id", "place", "n"), most), "candidate_id"), "grounding-pages")
        answers = pages.select("chapter_id", "window", "candidate_id", "place", "surface", "page", "has_more", "qids").groupBy("chapter_id", "window")
        answers = written(answers.applyInPandas(lambda rows: judge(rows.sort_values("place")), "candidate_id string, decision string, qid string"), "grounding-answers")
        told = answers.join(pages.select("candidate_id", "chapter_id", "surface", "has_more", "page"), "candidate_id")
        taken = written(told.filter("decision = 'accept'").select("candidate_id", "chapter_id", "surface", "qid", F.lit(len(figures)).alias("round")), "grounding-accepted")
        accepted.append(taken)
        figures.append(pages.agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("options")).first().asDict())
        is_ = lambda *d: F.count_if(F.col("decision").isin(*d))
        new = told.groupBy(*SURFACE).agg(is_("accept").alias("recalled"), is_("continue").alias("continued"), is_(*REJECTIONS).alias("rejected"))
        parts = [stats, pages.groupBy(*SURFACE).agg(F.count(F.lit(1)).alias("seen")), new]
        whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        stats = written(whole.groupBy(*SURFACE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS)), "grounding-stats")
        again = recalls.unionByName(taken.groupBy(*SURFACE, "qid").agg(F.count(F.lit(1)).alias("n")))
        recalls = written(again.groupBy(*SURFACE, "qid").agg(F.sum("n").alias("n")), "grounding-recalls")
        left = written(left.join(chosen.select("candidate_id", "qid"), ["candidate_id", "qid"], "left_anti"), "grounding-options")
        going = told.groupBy("candidate_id").agg(F.bool_or(F.col("decision") == "continue").alias("goes"), F.bool_or(F.col("decision") != "continue").alias("ends"), F.first("has_more").alias("more"), F.first("page").alias("page"))
        going = going.filter("goes AND NOT ends AND more").select("candidate_id", (F.col("page") + 1).alias("page"))
        open_ = written(own.join(going, "candidate_id"), "grounding-open")
    kind = "candidate_id string, chapter_id long, surface string, qid string, round int"
    found = spark.createDataFrame([], kind)
    for a in accepted:
        found = found.unionByName(a)
    return found, figures
