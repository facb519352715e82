"""Many archives as one library: search, lists and objects over all of them, and the register of archive files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import object_hits
from ..sources.model import Archive
from ..sources.packages import archive_files
from . import search as S
from . import views as V


def union(archives: list[Archive]) -> Archive:
    """One library of several archives; the ``archive`` column keeps them apart."""
    whole = vars(archives[0])
    for a in archives[1:]:
        whole = {name: df.unionByName(getattr(a, name)) for name, df in whole.items()}
    return Archive(**whole)


def sources(library: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct archives with ``label``; one without its own is called by its id."""
    return library.select("archive").distinct().join(labels, "archive", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("library-archive:"), "archive")))


def find(a: Archive, index: S.Index, query: str, pattern: str | None = None, limit: int = V.PAGE) -> DataFrame:
    """The best objects of a library as ``type, archive, id, score``, then in the order of archives.

    Entities and nodes score by their names and texts only; with a triple pattern the matching triples are listed instead.
    """
    if pattern is not None:
        found = V.triple_collection(a, S.triples_matching(S.triples_of(a), **S.parse_triple_pattern(pattern)))
        best = found.select("type", "archive", "id", "score").orderBy(F.desc("score"), "archive", "id").limit(limit)
    else:
        best = property_scores(index, query).orderBy(F.desc("score"), "archive", "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "archive", "id"))).orderBy("archive", "rank")  # a page's rows


def property_scores(index: S.Index, query: str) -> DataFrame:
    """``type, archive, id, score`` of entities and nodes by the hits on their own names and texts; triples have none."""
    hits = S.search(index, query, records="object").withColumn("score", T.rank_to_score(F.col("rank")))
    kind = F.when(F.col("kind") == "entity-surface", "entity").when(F.col("kind").startswith("chunk"), "node")
    own = hits.select("archive", kind.alias("type"), F.col("owner_id").alias("id"), F.lit("property").alias("kind"), "score").filter("type IS NOT NULL")
    return object_hits(own, ["archive", "type", "id"]).select("type", "archive", "id", "score")


def listed(a: Archive, types: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Objects of all archives; sentences only if texts are asked for; nodes with their label only."""
    whole = V.collection(a, types)
    if with_text:
        lines = a.sentences.select(F.col("kind").alias("type"), "archive", F.concat_ws(":", "chapter_id", "sentence_index").alias("id"), "chapter_id", "sentence_index", F.col("chapter_id").alias("document_order"))
        whole = whole.unionByName(lines, allowMissingColumns=True)
    return whole


def archives_with(a: Archive, kind: str, object_id: str) -> DataFrame:
    """``archive`` of those that have an object; for triples all links are looked at."""
    if kind == "triple":
        return S.triples_matching(S.triples_of(a), *object_id.split("/")).select("archive").distinct()
    column, table = {"entity": ("qid", a.mentions), "node": ("chunk_id", a.chunks), "chapter": ("chapter_id", a.chapters)}[kind]
    return table.filter(F.col(column).cast("string") == object_id).select("archive").distinct()


def evidence(a: Archive, kind: str, object_id: str) -> DataFrame:
    """Evidence over all archives, by archive, chapter and place."""
    return V.evidence_of(a, kind, object_id).orderBy("archive", "chapter_id", "start", "end")


def related(a: Archive, qid: str) -> DataFrame:
    """Triples of an entity over all archives, by archive and id."""
    return V.related_to_entity(a, qid).orderBy("archive", "id")


#: The prime that fingerprints are taken modulo, and the two bases of their polynomials.
PRIME, BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def _folded(batches):
    """The value of each run of rows of one archive: its number of rows n, and the rows' hashes as a polynomial, the first one highest."""
    import pyarrow as pa

    block, runs = None, []
    for batch in batches:
        for archive, at, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not runs or runs[-1][0] != archive:
                runs.append([archive, 0, 0, 0])
                block = at if block is None else block
            run = runs[-1]
            run[1:] = run[1] + 1, (run[2] * BASES[0] + one) % PRIME, (run[3] * BASES[1] + two) % PRIME
    if runs:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*runs, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([arrays[0], pa.array([block] * len(runs), pa.int32()), *arrays[1:]], names=["archive", "block", "n", "one", "two"])


def _joined(blocks):
    """Blocks of one archive in order as one: n and values of a run of runs."""
    import pandas as pd

    n = one = two = 0
    for r in blocks.sort_values("block").itertuples():
        n, one, two = n + r.n, (one * pow(BASES[0], int(r.n), PRIME) + r.one) % PRIME, (two * pow(BASES[1], int(r.n), PRIME) + r.two) % PRIME
    return pd.DataFrame({"archive": [blocks["archive"].iloc[0]], "fingerprint": [f"{n}-{int(one):016x}{int(two):016x}"]})


def fingerprints(records: DataFrame) -> DataFrame:
    """``archive, fingerprint``: of each archive's records in their order, by chapter, sentence, kind, owner and record.

    Records are parted by ranges of that order; a part is folded row by row, and what is known of a part (a row for each
    archive in it) is joined with the next ones. The value is a polynomial in the rows' hashes, whose parts can be joined anywhere: it is
    the same whatever the partitioning, another one if two rows change places, and no array of rows is ever held.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in (*S.RECORD, "text"))), 256)
    part = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("long")
    order = ["archive", "chapter_id", "sentence_index", "kind", "owner_id", "record_id", "h"]
    hashed = records.select("archive", "chapter_id", "sentence_index", "kind", "owner_id", "record_id", row.alias("h"))
    placed = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("archive", F.spark_partition_id().alias("block"), part(0).alias("one"), part(1).alias("two"))
    blocks = placed.mapInArrow(_folded, "archive string, block int, n long, one long, two long")
    return blocks.groupBy("archive").applyInPandas(_joined, "archive string, fingerprint string")


def scanned(spark, path: str) -> DataFrame:
    """``relative_path, size, modified, token`` of the archive files under a folder, whatever their depth."""
    return archive_files(spark, path)


def reconciled(files: DataFrame, register: DataFrame, trusted: bool = True) -> DataFrame:
    """``archive_id, relative_path, status`` (present, conflict or missing) after a scan; a new file has no id yet.

    ``files``: relative_path, token; ``register``: archive_id, relative_path, token. A file keeps the id of its path; else
    it takes that of the one unseen archive with its token, if that one's own path is gone. A token that is known, but not so
    clearly, makes a conflict; archives that no file takes are missing.
    """
    known = register.select("archive_id", F.col("relative_path").alias("old_path"), F.col("token").alias("old_token"))
    by_path = files.join(known, files["relative_path"] == known["old_path"], "left").select("relative_path", "token", F.when(F.lit(trusted), F.col("archive_id")).alias("archive_id"))
    seen = by_path.filter("archive_id IS NOT NULL").select("archive_id", "relative_path")
    rest = by_path.filter("archive_id IS NULL").select("relative_path", "token")
    free = known.join(seen.select("archive_id"), "archive_id", "left_anti")
    free = free.join(files.select(F.col("relative_path").alias("old_path"), F.lit(True).alias("still_there")), "old_path", "left")
    met = rest.join(free, rest["token"] == free["old_token"], "left")
    usable = F.col("archive_id").isNotNull() & ((F.col("old_path") == F.col("relative_path")) | F.col("still_there").isNull())
    judged = met.groupBy("relative_path").agg(F.count("archive_id").alias("n"), F.count_if(usable).alias("ok"), F.min(F.when(usable, F.col("archive_id"))).alias("archive_id"))
    # two files with one token: the first by path takes the archive
    first = F.row_number().over(Window.partitionBy("archive_id").orderBy("relative_path")) == 1
    clear = (F.col("n") == 1) & (F.col("ok") == 1)
    taken = judged.withColumn("clear", clear).withColumn("own", F.col("clear") & first)
    moved = taken.select(F.when(F.col("own"), F.col("archive_id")).alias("archive_id"), "relative_path", F.when(F.col("own") | (F.col("n") == 0) | F.col("clear"), "present").otherwise("conflict").alias("status"))
    there = seen.select("archive_id", "relative_path", F.lit("present").alias("status")).unionByName(moved)
    gone = register.select("archive_id", "relative_path").join(there.filter("archive_id IS NOT NULL").select("archive_id"), "archive_id", "left_anti").withColumn("status", F.lit("missing"))
    return there.unionByName(gone.select("archive_id", "relative_path", "status"))
