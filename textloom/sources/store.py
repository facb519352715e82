"""Tables with keys: replace, delete with what depends on it, dangling references; chapter trees; key-value maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

from .model import Archive


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; of rows with one key the fresh one stays, of several fresh ones the last by ``order``."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order) if order else F.lit(1))
    last = fresh.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")
    return table.join(last.select(*keys), keys, "left_anti").select(*table.columns).unionByName(last.select(*table.columns))


def without_chapters(a: Archive, chapters: DataFrame) -> Archive:
    """The archive without some chapters (rows ``chapter_id``): their sentences, mentions and chunks go, then the links and
    edges that lose an end, and those links' evidence."""
    gone = chapters.select("chapter_id").distinct()
    keep = lambda df: df.join(gone, "chapter_id", "left_anti").select(*df.columns)
    mentions, chunks = keep(a.mentions), keep(a.chunks)

    def both(df: DataFrame, ids: DataFrame, one: str, other: str, key: str) -> DataFrame:
        for c in (one, other):
            df = df.join(ids.select(F.col(key).alias(c)), c, "left_semi")
        return df

    links = both(a.links, mentions, "source_id", "target_id", "mention_id").select(*a.links.columns)
    return Archive(
        keep(a.chapters), keep(a.sentences), mentions, links, a.link_evidence.join(links.select("link_id"), "link_id", "left_semi").select(*a.link_evidence.columns),
        chunks, keep(a.chunk_sentences), both(a.edges, chunks, "from_id", "to_id", "chunk_id").select(*a.edges.columns),
    )


def dangling_metadata(metadata: DataFrame, a: Archive) -> DataFrame:
    """Metadata of chunks, entities and triples that are no longer there. ``metadata``: kind, owner_id, key, value."""
    from ..operators.search import triple_id, triples_of

    known = [("chunk", a.chunks.select(F.col("chunk_id").cast("string").alias("owner_id"))), ("entity", a.mentions.select(F.col("qid").alias("owner_id"))), ("triple", triples_of(a).select(triple_id().alias("owner_id")))]
    parts = [metadata.filter(F.col("kind") == kind).join(ids.distinct(), "owner_id", "left_anti").select(*metadata.columns) for kind, ids in known]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unreferenced(parameters: DataFrame, chapters: DataFrame, key: str, uses: list[str]) -> DataFrame:
    """Parameters that no chapter names in any of its columns ``uses``."""
    used = chapters.select(F.explode(F.array(*uses)).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return parameters.join(used, key, "left_anti").select(*parameters.columns)


def valid_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations (source_id, target_id, predicate, evidence) with two different known ends and a usable predicate, each once."""
    from ..functions.text import normalize_predicate

    named = relations.withColumn("predicate", normalize_predicate(F.col("predicate"))).filter("predicate IS NOT NULL AND source_id <> target_id")
    for c in ("source_id", "target_id"):
        named = named.join(mentions.select(F.col("mention_id").alias(c)).distinct(), c, "left_semi")
    return named.select(*relations.columns).dropDuplicates(["source_id", "target_id", "predicate", "evidence"])


# --- key-value maps


def put(table: DataFrame, owner: str, key: str, value_json: str) -> DataFrame:
    """A map's table (``owner, key, value_json``) with one value set. The value must be JSON."""
    import json

    json.loads(value_json)
    fresh = table.sparkSession.createDataFrame([(owner, key, value_json)], "owner string, key string, value_json string")
    return upsert(table, fresh, ["owner", "key"])


def replace_map(table: DataFrame, owner: str, values: dict[str, str]) -> DataFrame:
    rows = [(owner, k, v) for k, v in values.items()]
    return table.filter(F.col("owner") != owner).unionByName(table.sparkSession.createDataFrame(rows, "owner string, key string, value_json string"))


def delete(table: DataFrame, owner: str, key: str | None = None) -> DataFrame:
    """The table without one key of an owner, or without all of them."""
    gone = F.col("owner") == owner
    return table.filter(~(gone if key is None else gone & (F.col("key") == key)))


def get(table: DataFrame, owner: str) -> dict[str, object]:
    import json

    return {r["key"]: json.loads(r["value_json"]) for r in table.filter(F.col("owner") == owner).collect()}


def value_of(json_text: Column, path: str) -> Column:
    """A field of a JSON value; null if it isn't there or the text isn't JSON."""
    return F.get_json_object(json_text, path)


# --- chapter trees: rows ``node_id, parent_id`` (null at the top) ``, ord, key, title, chapter_id``


def flattened_tree(tree: DataFrame) -> DataFrame:
    """Nodes with ``depth, path`` (keys joined by a slash) ``, toc_path`` (titles) and ``place``, by which they sort depth first.

    One join a level, as many as the tree has; a level is written, so that plans stay short. A node that no top node leads to
    (its parent is missing, or is under it) makes an error.
    """
    level = written(tree.filter("parent_id IS NULL").select("*", F.lit(0).alias("depth"), F.col("key").alias("path"), F.array("title").alias("toc_path"), F.array("ord").alias("place")), "tree")
    whole, reached = level, level.count()
    while not level.isEmpty():
        up = level.select(F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.col("path").alias("_p"), F.col("toc_path").alias("_t"), F.col("place").alias("_o"))
        below = tree.join(up, "parent_id").select(*tree.columns, "depth", F.concat_ws("/", "_p", "key").alias("path"), F.concat("_t", F.array("title")).alias("toc_path"), F.concat("_o", F.array("ord")).alias("place"))
        level = written(below, "tree")
        reached += level.count()
        whole = whole.unionByName(level)
    if reached < tree.count():
        raise ValueError("the tree has nodes that no top node leads to")
    return whole


def subtree(flat: DataFrame, path: str) -> DataFrame:
    """A node and all under it, by its path."""
    return flat.filter((F.col("path") == path) | F.col("path").startswith(path + "/"))


def insert_node(tree: DataFrame, node: dict, at: int | None = None) -> DataFrame:
    """The tree with a new node among its parent's children, at a place or at the end."""
    near = F.col("parent_id").eqNullSafe(F.lit(node.get("parent_id")))
    last = tree.filter(near).agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    at = last if at is None else min(at, last)
    moved = tree.withColumn("ord", F.when(near & (F.col("ord") >= at), F.col("ord") + 1).otherwise(F.col("ord")))
    return moved.unionByName(tree.sparkSession.createDataFrame([{**node, "ord": at}], tree.schema))


def remove_node(tree: DataFrame, flat: DataFrame, path: str) -> DataFrame:
    """The tree without a node and all under it."""
    return tree.join(subtree(flat, path).select("node_id"), "node_id", "left_anti").select(*tree.columns)


def move_node(tree: DataFrame, flat: DataFrame, path: str, parent_path: str | None, at: int | None = None) -> DataFrame:
    """The tree with a node under another parent; it can't go under itself."""
    if parent_path is not None and (parent_path == path or parent_path.startswith(path + "/")):
        raise ValueError("a chapter can't be moved into its own subtree")
    node = flat.filter(F.col("path") == path).select(*tree.columns).first().asDict()
    parent = None if parent_path is None else flat.filter(F.col("path") == parent_path).first()["node_id"]
    return insert_node(tree.filter(F.col("node_id") != node["node_id"]), {**node, "parent_id": parent}, at)


def rename_node(tree: DataFrame, node_id: int, title: str) -> DataFrame:
    return tree.withColumn("title", F.when(F.col("node_id") == node_id, title).otherwise(F.col("title")))
