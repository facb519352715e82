"""Shortest directed paths for many pairs of nodes at once, of any length.

Distances spread block by block: the edges of a path's graph are dealt out by blocks of ``SPAN`` node ids, and a block with
many edges by their ends into parts of about ``EDGES``, so that a hub's edges lie in many tasks; a group of parts is a task's. In a
round, each group that has nodes with a new distance searches as far as its own edges lead; what it reaches is reduced to the least distance of each
node, and only nodes that got nearer go on. Rounds are as many as a path has steps from block to block, not as many as it has
edges, and a block's search ends at the least distance of the path's end found so far.

Of several shortest paths the one whose ids come first in order is taken, as a breadth-first search in the order of ids finds it.
From the end, the edges of shortest paths (distance one less) are followed back in the same way; each node then points to its
smallest successor, and the pointers are doubled until they reach along the whole path, in as many joins as its length has bits.
No row holds a path. Tables between rounds are written, so that plans stay short and lost executors cost one round.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

SPAN, EDGES = 4_096, 100_000
FAR = "path long, node long, distance long"


def _search(edges: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    """The least distances that a task's edges lead to from its fresh nodes; of the nodes inside the bound of their path."""
    names = ["path", "node", "distance"]
    if edges.empty or fresh.empty:
        return pd.DataFrame(columns=names)
    after: dict[tuple[int, int], list[int]] = {}
    for p, a, b in zip(edges["path"].tolist(), edges["from_id"].tolist(), edges["to_id"].tolist(), strict=True):
        after.setdefault((p, a), []).append(b)
    bounds = dict(zip(fresh["path"].tolist(), fresh["bound"].tolist(), strict=True))
    given = dict(zip(zip(fresh["path"].tolist(), fresh["node"].tolist(), strict=True), fresh["distance"].tolist(), strict=True))
    best, queue = dict(given), [(d, p, x) for (p, x), d in given.items()]
    heapq.heapify(queue)
    while queue:
        d, p, x = heapq.heappop(queue)
        if d > best[p, x] or d >= bounds[p]:
            continue
        for y in after.get((p, x), ()):
            if d + 1 < best.get((p, y), bounds[p] + 1):
                best[p, y] = d + 1
                heapq.heappush(queue, (d + 1, p, y))
    return pd.DataFrame([(p, x, d) for (p, x), d in best.items() if d < given.get((p, x), bounds[p] + 1)], columns=names)


def distances(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None, span: int = SPAN, most: int = EDGES) -> DataFrame:
    """``path, node, distance`` of what is reached. ``edges``: path, from_id, to_id; ``starts`` and ``ends``: path, node.

    With ``ends`` nodes that are farther than their path's end need not be there.
    """
    block = lambda c: F.floor(F.col(c) / span).alias("block")
    blocked = edges.select("path", block("from_id"), "from_id", "to_id")
    sizes = blocked.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    sizes = written(sizes, "path-blocks")
    # parts are dealt out to groups, so that small graphs share one
    groups = max(1, -(-8 * (sizes.agg(F.sum("n")).first()[0] or 0) // most))
    group = F.pmod(F.xxhash64("path", "block", "part"), F.lit(groups)).cast("int").alias("group")
    parted = blocked.join(sizes, ["path", "block"]).withColumn("part", F.pmod(F.xxhash64("to_id"), F.col("parts")).cast("int"))
    dealt = written(parted.select(group, "path", "from_id", "to_id"), "path-edges")
    known = fresh = written(starts.select("path", "node", F.lit(0).cast("long").alias("distance")).distinct(), "path-far")
    endless = F.lit(1 << 62).cast("long")
    while True:
        if ends is None:
            bound = fresh.select("path").distinct().withColumn("bound", endless)
        else:
            bound = known.join(ends.select("path", "node"), ["path", "node"], "left_semi").groupBy("path").agg(F.min("distance").alias("bound"))
        going = fresh.join(bound, "path", "left").withColumn("bound", F.coalesce("bound", endless)).filter("distance < bound")
        asked = going.withColumn("block", F.floor(F.col("node") / span)).join(sizes, ["path", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        reached = dealt.groupBy("group").cogroup(asked.select(group, "path", "node", "distance", "bound").groupBy("group")).applyInPandas(_search, FAR)
        nearest = reached.groupBy("path", "node").agg(F.min("distance").alias("distance"))
        old = known.select("path", "node", F.col("distance").alias("old"))
        fresh = written(nearest.join(old, ["path", "node"], "left").filter("old IS NULL OR distance < old").select("path", "node", "distance"), "path-fresh")
        if fresh.isEmpty():
            return known
        known = written(known.unionByName(fresh).groupBy("path", "node").agg(F.min("distance").alias("distance")), "path-far")


def shortest_paths(edges: DataFrame, pairs: DataFrame, span: int = SPAN, most: int = EDGES) -> DataFrame:
    """``path, position, node`` of a shortest path for each pair that has one; positions begin at 0.

    ``edges``: group, from_id, to_id (a null or repeated edge adds nothing); ``pairs``: path (unique), group, start, end. A path
    stays inside its group. A node's path to itself is the node.
    """
    pairs = written(pairs.select(F.col("path").cast("long"), "group", F.col("start").cast("long"), F.col("end").cast("long")), "path-pairs")
    own = edges.select("group", F.col("from_id").cast("long"), F.col("to_id").cast("long")).dropna().distinct()
    own = written(own.join(pairs.filter("start <> end").select("path", "group"), "group").select("path", "from_id", "to_id"), "path-graph")
    starts, ends = pairs.select("path", F.col("start").alias("node")), pairs.select("path", F.col("end").alias("node"))
    far = distances(own, starts, ends, span, most)
    at = lambda c, d: far.select("path", F.col("node").alias(c), F.col("distance").alias(d))
    steps = own.join(at("from_id", "a"), ["path", "from_id"]).join(at("to_id", "b"), ["path", "to_id"]).filter("b = a + 1").select("path", "from_id", "to_id")
    steps = written(steps, "path-steps")
    found = ends.join(far.select("path", "node"), ["path", "node"], "left_semi")
    back = distances(steps.select("path", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), found, None, span, most)
    leads = steps.join(back.select("path", F.col("node").alias("to_id")), ["path", "to_id"], "left_semi")
    jump = written(leads.groupBy("path", F.col("from_id").alias("node")).agg(F.min("to_id").alias("next")), "path-jump")
    walked = starts.join(found.select("path"), "path", "left_semi").select("path", F.lit(0).cast("long").alias("position"), "node")
    length, reach = back.agg(F.coalesce(F.max("distance"), F.lit(0))).first()[0], 1
    while reach <= length:
        ahead = walked.join(jump, ["path", "node"]).select("path", (F.col("position") + reach).alias("position"), F.col("next").alias("node"))
        walked = written(walked.unionByName(ahead), "path-walked")
        reach *= 2
        if reach <= length:
            second = jump.select("path", F.col("node").alias("next"), F.col("next").alias("then"))
            jump = written(jump.join(second, ["path", "next"]).select("path", "node", F.col("then").alias("next")), "path-jump")
    return walked


def shortest_path(edges: DataFrame, start: int, end: int) -> list[int]:
    """The nodes of a shortest path from ``start`` to ``end``, the first in the order of ids; [] if there is none. ``edges``: from_id, to_id."""
    spark = edges.sparkSession
    pair = spark.createDataFrame([(0, 0, start, end)], "path long, group long, start long, end long")
    found = shortest_paths(edges.select(F.lit(0).cast("long").alias("group"), "from_id", "to_id"), pair)
    return [r["node"] for r in found.orderBy("position").collect()]
