"""Reading graph: weights, boundaries between segments, groups, clusters ("snakes"), paths, attention.

Whole-graph steps are joins and aggregates. Steps that are sequential by nature (splits, greedy merges, breadth-first
spreading) run per chapter or per component through ``applyInPandas``; such a group is bounded by one document.

Relations: ``chunks`` (chapter_id, chunk_id, sentence_index, label, words_count, retention, importance, weight, generation),
``edges`` (chapter_id, from_id, to_id, strength, weight). Each function names the columns that it reads.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of retention, importance and link strength, and the constants of clustering.
RETENTION = {"verbatim": 27, "detailed": 9, "focused": 3, "relevant": 1}
IMPORTANCE = {"critical": 9, "important": 3, "helpful": 1}
STRENGTH = {"critical": 9, "important": 3, "helpful": 1}
LEAST_EDGE, DEFAULT_STRENGTH, ATTRIBUTE_BONUS, DECAY, SNAKE_WORDS, GROUP_WORDS = 0.1, 1, 3, 0.75, 280, 3840
OUTLIERS, LEVELS = 0.98, 10


def _looked_up(values: dict[str, int], column: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v))))
    return F.coalesce(F.when(column.isNotNull(), F.element_at(table, column)), F.lit(float(default)))


def chunk_weights(chunks: DataFrame) -> DataFrame:
    """Every chunk with ``weight``: what its retention and its importance count; a missing one counts 0."""
    return chunks.withColumn("weight", _looked_up(RETENTION, F.col("retention"), 0) + _looked_up(IMPORTANCE, F.col("importance"), 0))


def strength_weight(strength: Column) -> Column:
    return _looked_up(STRENGTH, strength, DEFAULT_STRENGTH)


def edge_weights(edges: DataFrame, weighted: DataFrame) -> DataFrame:
    """``from_id, to_id, weight``: each end's weight is shared out over its edges by strength; an edge gets both shares, 0.1 at least."""
    e = edges.select("from_id", "to_id", strength_weight(F.col("strength")).alias("s"))
    totals = e.select(F.explode(F.array("from_id", "to_id")).alias("chunk_id"), "s").groupBy("chunk_id").agg(F.sum("s").alias("total"))
    nodes = weighted.select("chunk_id", "weight").join(totals, "chunk_id")
    side = lambda c, n: nodes.select(F.col("chunk_id").alias(c), F.col("weight").alias(f"w{n}"), F.col("total").alias(f"t{n}"))
    both = e.join(side("from_id", "a"), "from_id", "left").join(side("to_id", "b"), "to_id", "left")
    part = lambda n: F.coalesce(F.col(f"w{n}") * (F.col("s") / F.col(f"t{n}")), F.lit(0.0))
    share = part("a") + part("b")
    return both.select("from_id", "to_id", F.greatest(F.lit(LEAST_EDGE), share).alias("weight"))


def segment_of(sentences: DataFrame, segments: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``keys, segment``: as of each sentence the last segment start of its chapter; null before the first one. One union and one window."""
    keys = list(keys)
    marks = segments.select("chapter_id", F.col("start_sentence_index").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<" + ",".join(f"{k}:{sentences.schema[k].dataType.simpleString()}" for k in keys) + ">").alias("own"))
    asked = sentences.select("chapter_id", F.col("sentence_index").alias("at"), F.lit(1).alias("kind"), F.struct(*keys).alias("own"))
    order = Window.partitionBy("chapter_id").orderBy("at", "kind")
    tagged = marks.unionByName(asked).withColumn("segment", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order))
    return tagged.filter("kind = 1").select("own.*", "segment")


def incisions(segments: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chapter_id, start_sentence_index, words_count, start_incision, end_incision`` of the segments that hold a chunk.

    A chunk's weight is shared out over its edges that leave the segment, by edge weight: to the start if the other end's
    segment comes before, else to the end. ``segments``: chapter_id, start_sentence_index, words_count.
    """
    placed = segment_of(chunks, segments, ["chapter_id", "chunk_id", "weight"]).filter("segment IS NOT NULL")
    here = placed.select("chapter_id", F.col("chunk_id").alias("a"), F.col("weight").alias("w"), F.col("segment").alias("sa"))
    there = placed.select(F.col("chapter_id").alias("c"), F.col("chunk_id").alias("b"), F.col("segment").alias("sb"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).alias("x"), "weight").select("x.*", "weight")
    left = ends.join(here, "a").join(there, "b").filter((F.col("chapter_id") == F.col("c")) & (F.col("sa") != F.col("sb")))
    total = F.sum("weight").over(Window.partitionBy("a"))
    shared = left.withColumn("part", F.when(total != 0, F.col("w") / total * F.col("weight")).otherwise(0.0))
    side = lambda cond: F.sum(F.when(cond, F.col("part")).otherwise(0.0))
    sums = shared.groupBy("chapter_id", F.col("sa").alias("start_sentence_index")).agg(side(F.col("sb") < F.col("sa")).alias("start_incision"), side(F.col("sb") > F.col("sa")).alias("end_incision"))
    used = placed.select("chapter_id", F.col("segment").alias("start_sentence_index")).distinct()
    known = segments.select("chapter_id", "start_sentence_index", "words_count").join(used, ["chapter_id", "start_sentence_index"], "left_semi")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return known.join(sums, ["chapter_id", "start_sentence_index"], "left").select("chapter_id", "start_sentence_index", "words_count", zero("start_incision"), zero("end_incision"))


def normalize_incisions(found: DataFrame) -> DataFrame:
    """Incisions as whole numbers: 0 for none, 10 from the 98 % point of a chapter's positive ones on, else 1 to 10 by logarithm."""
    values = found.select("chapter_id", F.explode(F.array("start_incision", "end_incision")).alias("v")).filter("v > 0")
    by_value = Window.partitionBy("chapter_id").orderBy("v")
    whole = Window.partitionBy("chapter_id")
    placed = values.withColumn("i", F.row_number().over(by_value) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    at = F.least(F.floor(F.col("n") * OUTLIERS), F.col("n") - 1)
    limits = placed.groupBy("chapter_id").agg(F.max(F.when(F.col("i") == at, F.col("v"))).alias("edge"))
    normal = values.join(limits, "chapter_id").groupBy("chapter_id", "edge").agg(F.min(F.when(F.col("v") < F.col("edge"), F.ln("v"))).alias("low"), F.max(F.when(F.col("v") < F.col("edge"), F.ln("v"))).alias("high"))

    def level(name: str) -> Column:
        v = F.col(name)
        scale = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
        step = F.floor(1 + (F.ln(v) - F.col("low")) / scale * (LEVELS - 1) + 0.5)
        return F.when(v <= 0, 0).when((v >= F.col("edge")) | F.col("low").isNull(), LEVELS).otherwise(F.greatest(F.lit(1), F.least(F.lit(LEVELS), step))).cast("long").alias(name)

    joined = found.join(normal, "chapter_id", "left")
    return joined.select("chapter_id", "start_sentence_index", "words_count", level("start_incision"), level("end_incision"))


# --- sequential steps of one chapter


def split_points(words: list[float], starts: list[float], ends: list[float], budget: float) -> list[tuple[int, int]]:
    """Ranges (first, last) of segments that fit the budget: too large a range is cut at the boundary that leaves the fewest
    sides too large, of these the strongest, of these the one with the least words over; without any boundary, from the left."""
    if budget <= 0:
        return [(i, i) for i in range(len(words))]
    sums = [0.0]
    for w in words:
        sums.append(sums[-1] + w)
    done, todo = [], [(0, len(words) - 1)] if words else []
    while todo:
        a, b = todo.pop()
        if a == b or sums[b + 1] - sums[a] <= budget:
            done.append((a, b))
            continue
        options = []
        for i in range(a, b):
            strength, left, right = ends[i] + starts[i + 1], sums[i + 1] - sums[a], sums[b + 1] - sums[i + 1]
            if strength > 0:
                options.append(((left > budget) + (right > budget), -strength, max(0, left - budget) + max(0, right - budget), i))
        if options:
            i = min(options)[3]
            todo += [(i + 1, b), (a, i)]
            continue
        first = a
        for i in range(a, b + 1):
            if first < i and sums[i + 1] - sums[first] > budget:
                done.append((first, i - 1))
                first = i
            if sums[i + 1] - sums[first] >= budget:
                done.append((first, i))
                first = i + 1
        if first <= b:
            done.append((first, b))
    return done


def segment_groups(infos: DataFrame, budget: int = GROUP_WORDS) -> DataFrame:
    """``chapter_id, group_id, start_sentence_index, end_sentence_index``; the end is the start of the group's last segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_sentence_index")
        at = pdf["start_sentence_index"].tolist()
        cuts = split_points(pdf["words_count"].tolist(), pdf["start_incision"].tolist(), pdf["end_incision"].tolist(), budget)
        return pd.DataFrame([(pdf["chapter_id"].iloc[0], g, at[a], at[b]) for g, (a, b) in enumerate(cuts)], columns=["chapter_id", "group_id", "start_sentence_index", "end_sentence_index"])

    return infos.groupBy("chapter_id").applyInPandas(run, "chapter_id long, group_id long, start_sentence_index long, end_sentence_index long")


def group_of_chunks(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks with the first group whose range holds their sentence; chunks behind the last segment's start drop out."""
    met = chunks.join(groups, "chapter_id").filter(F.col("sentence_index").between(F.col("start_sentence_index"), F.col("end_sentence_index")))
    return met.groupBy("chapter_id", "chunk_id").agg(F.min("group_id").alias("group_id")).select(F.col("chapter_id").alias("chapter_id"), F.col("chunk_id").alias("chunk_id"), "group_id")


class Component:
    """One weakly connected component of the graph, for fingerprints and merges."""

    def __init__(self, chunks: list[dict], edges: list[dict]):
        self.chunks = {c["chunk_id"]: c for c in chunks}
        self.edges = [e for e in edges if e["from_id"] in self.chunks and e["to_id"] in self.chunks]
        self.strength: dict[frozenset, float] = {}
        self.pairs: dict[tuple[int, int], float] = {}
        self.near: dict[int, list[int]] = {i: [] for i in sorted(self.chunks)}
        totals = dict.fromkeys(self.chunks, 0.0)
        for e in sorted(self.edges, key=lambda e: (e["from_id"], e["to_id"])):
            a, b, s = e["from_id"], e["to_id"], float(STRENGTH.get(e["strength"], DEFAULT_STRENGTH))
            if a != b:
                self.strength.setdefault(frozenset((a, b)), s)
                for x, y in ((a, b), (b, a)):
                    totals[x] += s
                    if y not in self.near[x]:
                        self.near[x].append(y)
        share = lambda x, s: self.chunks[x].get("weight", 0.0) * s / totals[x]
        self.link = {p: max(LEAST_EDGE, sum(share(x, s) for x in p)) for p, s in self.strength.items()}
        self.linked = {x: [(y, self.link[frozenset((x, y))]) for y in ys] for x, ys in self.near.items()}

    def parts(self) -> list[list[int]]:
        """Connected components, each ascending, by their smallest id."""
        seen, out = set(), []
        for start in self.near:
            if start not in seen:
                seen.add(start)
                part = [start]
                for x in part:
                    fresh = [y for y in self.near[x] if y not in seen]
                    seen.update(fresh)
                    part += fresh
                out.append(sorted(part))
        return out

    def fingerprint(self, start: int) -> dict[int, float]:
        """How much of one unit that spreads from ``start``, layer by layer, by edge weight and with decay, each chunk gets; sums to 1."""
        got, layer = {start: 1.0}, [start]
        while layer:
            gained: dict[int, float] = {}
            for x in layer:
                fresh = [p for p in self.linked[x] if p[0] not in got]
                total = sum([w for _, w in fresh])
                for y, w in fresh:
                    gained[y] = gained.get(y, 0.0) + got[x] * w / total * DECAY
            layer = sorted(gained)
            got.update(gained)
        total = sum(got.values())
        return {x: v / total for x, v in got.items()}

    def snakes(self, budget: float = SNAKE_WORDS) -> list[list[int]]:
        """Clusters of at most ``budget`` words by greedy merging: first without joining two clusters of two or more, then with."""
        order = lambda ids: sorted(ids, key=lambda i: (self.chunks[i]["sentence_index"], i))
        if sum(c["words_count"] for c in self.chunks.values()) <= budget:
            return [order(self.chunks)]
        prints = {i: self.fingerprint(i) for i in self.chunks}
        members = {i: [i] for i in self.near}
        for keep_apart in (True, False):
            members = self._merged(members, prints, budget, keep_apart)
        return [order(ids) for ids in members.values()]

    def _value(self, left: list[int], right: list[int], prints: dict) -> float:
        inside = set(right)
        return min((self._pair(a, b, prints) for a in left for b in inside.intersection(self.near[a])), default=float("-inf"))

    def _pair(self, a: int, b: int, prints: dict) -> float:
        """The value of one edge, seen from ``a``; it stays the same whatever clusters its ends are in."""
        if (a, b) not in self.pairs:
            there = prints[b]
            distance = sum([(v - there.get(x, 0.0)) ** 2 for x, v in prints[a].items()]) ** 0.5
            both = sum(ATTRIBUTE_BONUS for f in ("retention", "importance") if pd.notna(self.chunks[a].get(f)) and pd.notna(self.chunks[b].get(f)))
            self.pairs[a, b] = (1 - distance / 2) * (self.strength[frozenset((a, b))] + both)
        return self.pairs[a, b]

    def _merged(self, members: dict[int, list[int]], prints: dict, budget: float, keep_apart: bool) -> dict[int, list[int]]:
        owner = {x: c for c, ids in members.items() for x in ids}
        words = {c: sum(self.chunks[x]["words_count"] for x in ids) for c, ids in members.items()}
        queue, queued = [], set()

        def offer(a: int, b: int, left: list[int], right: list[int]) -> None:
            if frozenset((a, b)) not in queued:
                queued.add(frozenset((a, b)))
                heapq.heappush(queue, (-self._value(left, right, prints), min(a, b), max(a, b)))

        touching = lambda ids: {owner[y] for x in ids for y in self.near[x]}
        for c, ids in members.items():
            for d in sorted(touching(ids) - {c}):
                if c < d:
                    offer(c, d, ids, members[d])
        while queue:  # values stay as they were when a pair was first offered
            _, a, b = heapq.heappop(queue)
            a, b = owner[a], owner[b]
            if a == b or b not in touching(members[a]) or words[a] + words[b] > budget or keep_apart and len(members[a]) > 1 and len(members[b]) > 1:
                continue
            members[a] += members[b]
            words[a] += words.pop(b)
            for x in members.pop(b):
                owner[x] = a
            for d in touching(members[a]) - {a}:
                offer(a, d, members[a], members[d])
        return members


def components(chunks: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("chapter_id", "group_id")) -> DataFrame:
    """``keys, chunk_id, component``: the smallest chunk id that a chunk reaches inside its group, whatever the edges' direction."""
    return _per_group(chunks, edges, keys, "component long", lambda g: [(i, part[0]) for part in g.parts() for i in part], ["chunk_id", "component"])


def snakes(chunks: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("chapter_id", "group_id"), budget: int = SNAKE_WORDS) -> DataFrame:
    """``keys, chunk_id, local_id, position``: the clusters of each group, component by component."""

    def run(g: Component) -> list[tuple]:
        out, local = [], 0
        for part in g.parts():
            for ids in Component([g.chunks[i] for i in part], g.edges).snakes(budget):
                out += [(i, local, at) for at, i in enumerate(ids)]
                local += 1
        return out

    return _per_group(chunks, edges, keys, "local_id long, position long", run, ["chunk_id", "local_id", "position"])


def _per_group(chunks: DataFrame, edges: DataFrame, keys: tuple[str, ...], added: str, work, names: list[str]) -> DataFrame:
    """Cogroup chunks and the edges inside a group, and work on each group as a ``Component``."""
    tags = chunks.select(*keys, "chunk_id")
    end = lambda c, n: tags.select(F.col("chunk_id").alias(c), F.struct(*keys).alias(n))
    near = edges.select("from_id", "to_id", "strength").join(end("from_id", "_own"), "from_id").join(end("to_id", "_other"), "to_id").filter("_own = _other")
    near = near.select("from_id", "to_id", "strength", *(F.col("_own")[k].alias(k) for k in keys))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[*keys, *names])
        made = pd.DataFrame(work(Component(left.to_dict("records"), right.to_dict("records"))), columns=names)
        for k in reversed(keys):
            made.insert(0, k, left[k].iloc[0])
        return made

    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    need = [*keys, "chunk_id", "sentence_index", "words_count", "retention", "importance", "weight"]
    return chunks.select(*need).groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(run, f"{kinds}, chunk_id long, {added}")


def snake_records(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chapter_id, group_id, local_id, size, words_count, weight, first_label, last_label`` of each cluster."""
    rows = members.join(chunks.select("chunk_id", "label", "words_count", "weight"), "chunk_id")
    return rows.groupBy("chapter_id", "group_id", "local_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum("words_count").alias("words_count"), F.sum("weight").alias("weight"), F.min_by("label", "position").alias("first_label"), F.max_by("label", "position").alias("last_label")
    )


def snake_edges(members: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chapter_id, group_id, from_local, to_local, weight``: summed edge weights between clusters, from the one that begins first."""
    first = members.filter("position = 0").join(chunks.select("chunk_id", "sentence_index"), "chunk_id")
    begin = first.select("chapter_id", "group_id", "local_id", F.struct("sentence_index", "chunk_id").alias("begin"))
    tagged = members.join(begin, ["chapter_id", "group_id", "local_id"]).select("chapter_id", "group_id", "chunk_id", F.struct("begin", "local_id").alias("snake"))
    side = lambda c, n: tagged.select(F.col("chapter_id").alias(f"c{n}"), F.col("group_id").alias(f"g{n}"), F.col("chunk_id").alias(c), F.col("snake").alias(n))
    met = edges.select("from_id", "to_id", "weight").join(side("from_id", "x"), "from_id").join(side("to_id", "y"), "to_id").filter("cx = cy AND gx = gy AND x <> y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return met.groupBy(F.col("cx").alias("chapter_id"), F.col("gx").alias("group_id"), low["local_id"].alias("from_local"), high["local_id"].alias("to_local")).agg(F.sum("weight").alias("weight"))


def topology(chunks: DataFrame, edges: DataFrame, segments: DataFrame, group_words: int = GROUP_WORDS, snake_words: int = SNAKE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, cluster records, cluster edges): weights, boundaries, groups, clusters and the graph between them, in a row."""
    weighted = chunk_weights(chunks)
    weights = edge_weights(edges, weighted)
    groups = segment_groups(normalize_incisions(incisions(segments, weighted, weights)), group_words)
    grouped = weighted.join(group_of_chunks(weighted, groups), ["chapter_id", "chunk_id"])
    members = snakes(grouped, edges, budget=snake_words)
    return groups, snake_records(members, grouped), snake_edges(members, grouped, weights)


# --- neighbours


def neighbours(edges: DataFrame, direction: str = "any") -> DataFrame:
    """``node, other, direction``: every edge seen from its ends, ``in`` and ``out``, or one of them."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit("out").alias("direction"))
    into = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit("in").alias("direction"))
    return {"out": out, "in": into}.get(direction, into.unionByName(out))


def node_order(nodes: DataFrame) -> DataFrame:
    """Neighbours as they are listed: incoming first, then by falling weight, then by id."""
    return nodes.orderBy(F.col("direction") != "in", F.desc("weight"), "other")


def oriented_edges(edges: DataFrame) -> DataFrame:
    """Each pair of chunks once, from the larger id to the smaller; an edge to itself goes."""
    return edges.filter("from_id <> to_id").select(F.greatest("from_id", "to_id").alias("from_id"), F.least("from_id", "to_id").alias("to_id")).distinct()


# --- attention


def spread(starts: list[int], near: dict[int, list[int]], scores: dict[int, float]) -> dict[int, float]:
    """Breadth-first: a node hands its score, as it is when visited, to its successors in equal parts."""
    scores, queue, seen = dict(scores), list(starts), set(starts)
    for x in queue:
        after = sorted(near.get(x, ()))
        for y in after:
            scores[y] = scores.get(y, 0.0) + scores[x] / len(after)
            if y not in seen:
                seen.add(y)
                queue.append(y)
    return scores


def attended(chunks: list[tuple[int, int]], latest: list[int], near: dict[int, list[int]], capacity: int, decay: float) -> list[int]:
    """The chunks to keep in mind: ``chunks`` are (id, generation); scores spread from the latest ones, and back again."""
    if not latest:
        return [i for i, _ in chunks[:capacity]]
    old = [(i, g) for i, g in chunks if i not in set(latest)]
    forward = spread(latest, near, {i: 1 / len(latest) for i in latest})
    back: dict[int, list[int]] = {}
    for i, _ in chunks:
        for y in near.get(i, ()):
            back.setdefault(y, []).append(i)
    scores = spread(sorted(forward), back, forward)  # ids as keys come in their numeric order
    return [i for i, _ in sorted(old, key=lambda c: (-scores.get(c[0], 0.0) * decay ** c[1], c[0]))[:capacity]]


def working_memory(chunks: DataFrame, edges: DataFrame, capacity: int = 7, decay: float = 0.5) -> DataFrame:
    """``chapter_id, generation, chunk_id, kind``: what is in mind when a fragment has been read.

    ``kind`` is ``previous`` for the chunks of the fragment just read and ``extra`` for those that attention brings back.
    """
    tags = chunks.select("chapter_id", F.col("chunk_id").alias("from_id"))
    near = edges.select("from_id", "to_id").join(tags, "from_id").select("from_id", "to_id", F.col("chapter_id").alias("chapter_id"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["chapter_id", "generation", "chunk_id", "kind"]
        if left.empty:
            return pd.DataFrame(columns=names)
        after: dict[int, list[int]] = {}
        for a, b in zip(right["from_id"], right["to_id"]):
            after.setdefault(a, []).append(b)
        known, rows, chapter = [], [], left["chapter_id"].iloc[0]
        for g, part in left.sort_values(["generation", "chunk_id"]).groupby("generation"):
            latest = part["chunk_id"].tolist()
            known += [(i, g) for i in latest]
            ids = {i for i, _ in known}
            links = {i: [y for y in after.get(i, []) if y in ids] for i in ids}
            rows += [(chapter, g, i, "previous") for i in latest]
            rows += [(chapter, g, i, "extra") for i in attended(known, latest, links, capacity, decay)]
        return pd.DataFrame(rows, columns=names)

    schema = "chapter_id long, generation long, chunk_id long, kind string"
    return chunks.select("chapter_id", "chunk_id", "generation").groupBy("chapter_id").cogroup(near.groupBy("chapter_id")).applyInPandas(run, schema)


# --- clues


def merged_clues(clues: list[dict], most: int = 10) -> list[dict]:
    """At most ``most`` clues: while there are more, of the weaker ones (from three quarters of ``most`` on) the two that share
    most sentences become one. ``clues``: id, weight, sentences, sources. Weights become shares, falling."""
    clues, fresh = [dict(c) for c in clues], -1
    while len(clues) > most:
        clues.sort(key=lambda c: -c["weight"])
        weak = clues[int(most * 0.75) :]
        if len(weak) < 2:
            break
        _, i, j = min((-len(set(weak[i]["sentences"]) & set(weak[j]["sentences"])), i, j) for i in range(len(weak)) for j in range(i + 1, len(weak)))
        a, b = weak[i], weak[j]
        clues = [c for c in clues if c is not a and c is not b]
        clues.append({"id": fresh, "weight": a["weight"] + b["weight"], "sentences": sorted({*a["sentences"], *b["sentences"]}), "sources": sorted([*a["sources"], *b["sources"]])})
        fresh -= 1
    total = sum(c["weight"] for c in clues)
    return sorted(({**c, "weight": c["weight"] / total if total else 0.0} for c in clues), key=lambda c: -c["weight"])


def clues(members: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """``chapter_id, group_id, clue_id, weight, sentences, sources``: a group's clusters as clues, merged to at most ``most``."""
    rows = members.join(chunks.select("chunk_id", "sentence_index", "weight"), "chunk_id")
    made = rows.groupBy("chapter_id", "group_id", "local_id").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("sentence_index")).alias("sentences"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("local_id")
        given = [{"id": int(r.local_id), "weight": float(r.weight), "sentences": [int(x) for x in r.sentences], "sources": [int(r.local_id)]} for r in own.itertuples()]
        rows = [(own["chapter_id"].iloc[0], own["group_id"].iloc[0], c["id"], c["weight"], c["sentences"], c["sources"]) for c in merged_clues(given, most)]
        return pd.DataFrame(rows, columns=["chapter_id", "group_id", "clue_id", "weight", "sentences", "sources"])

    return made.groupBy("chapter_id", "group_id").applyInPandas(run, "chapter_id long, group_id long, clue_id long, weight double, sentences array<long>, sources array<long>")
