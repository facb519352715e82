"""Entries of archive files (ZIP), read where Spark reads: one task a file, whatever store it lies in."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ending of archive files, and the entry that must come first: the token of their last change.
FILES, TOKEN = "*.wikg", ".wikg-mutation-token"


def _entries(content: bytes, wanted: Sequence[str] | None, first: str | None) -> list[tuple]:
    """(entry, its bytes, fault) of an archive file; a fault alone if it is none, or if its first entry is another one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n.replace("\\", "/").lstrip("/") for n in z.namelist()]
            if first is not None and (not names or names[0] != first):
                return [(None, None, f"the first entry is not {first}")]
            return [(n, z.read(info), None) for n, info in zip(names, z.infolist(), strict=True) if not n.endswith("/") and (wanted is None or any(fnmatch.fnmatchcase(n, w) for w in wanted))]
    except zipfile.BadZipFile as e:
        return [(None, None, str(e))]


def relative_to(spark: SparkSession, path: str):
    """A function from the column of a file's URI to its path below ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, r"\A([a-z0-9]+):/+", "$1:/")  # noqa: E731  a URI may have one slash or three behind its scheme
    return lambda c: F.substring(plain(c), F.length(plain(F.lit(root))) + 1, F.length(c))


def archive_entries(spark: SparkSession, path: str, entries: Sequence[str] | None = None, files: str = FILES, first: str | None = TOKEN) -> DataFrame:
    """``relative_path, size, modified, entry, content, fault`` of the archive files under a folder.

    Only the entries that match one of ``entries`` (patterns; None: all) are unpacked. A file that can't be read, or whose first entry
    isn't ``first`` (None: any), gives one row with a ``fault`` and no entry. A file of over 2 GB can't be read.
    """
    schema = "path string, size long, modified timestamp, entry string, content binary, fault string"

    def run(batches):
        for b in batches:
            made = [(p, n, m, *e) for p, n, m, c in zip(b["path"], b["length"], b["modificationTime"], b["content"], strict=True) for e in _entries(c, entries, first)]
            yield pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    return found.mapInPandas(run, schema).select(relative_to(spark, path)(F.col("path")).alias("relative_path"), "size", "modified", "entry", "content", "fault")


def archive_files(spark: SparkSession, path: str, files: str = FILES, token: str = TOKEN) -> DataFrame:
    """``relative_path, size, modified, token`` of the archive files under a folder; no token if it isn't a file's first entry."""
    rows = archive_entries(spark, path, [token], files, token)
    text = F.btrim(F.decode("content", "UTF-8"), F.lit(" \t\r\n"))
    return rows.select("relative_path", "size", "modified", F.when(text != "", text).alias("token"))
