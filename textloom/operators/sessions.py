"""Kept results of searches: each a table named by a hash of all that it depends on, with its age, last use and cursors.

A session's rows are a Parquet table; what is known of it is a small file beside it. There are ``most`` sessions at most, so
the driver reads and deletes them by name. A session is written before its file is, so that a lost driver leaves rows that
``collect_garbage`` removes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Folder
from .search import HIT_CAP

#: Version of the ranking, number of sessions, and how long one is kept, in seconds.
VERSION, MOST, SECONDS = 7, 500, 7 * 24 * 3600
SCOPE = ("archive_key", "query", "terms", "match", "lens", "order", "types", "chapters", "revision")


def session_id(**scope) -> str:
    """A hash of a search's scope; the order and repeats of types and chapters don't count."""
    known = {k: scope.get(k) for k in SCOPE if k != "query"}
    for k in ("types", "chapters"):
        known[k] = None if known[k] is None else sorted(set(known[k]))
    return hashlib.sha256(json.dumps({"version": VERSION, **known}, sort_keys=True, default=str).encode()).hexdigest()


def revision_scope(chapters: DataFrame, only: list[int] | None = None) -> str:
    """The revision that a search depends on: of the whole archive, or of each asked chapter (0: not there).

    ``chapters``: chapter_id, revision.
    """
    if not only:
        whole = chapters.agg(F.coalesce(F.sum(F.xxhash64("chapter_id", "revision").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
        return json.dumps({"scope": "all", "revision": whole})
    asked = sorted(set(only))
    found = {r[0]: r[1] for r in chapters.filter(F.col("chapter_id").isin(asked)).groupBy("chapter_id").agg(F.max("revision")).collect()}  # the asked ones
    return json.dumps({"scope": "chapters", "chapters": [[c, found.get(c, 0)] for c in asked]})


def to_cursor(session: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([session, offset]).encode()).decode().rstrip("=")


def from_cursor(text: str) -> tuple[str, int]:
    """(session, offset); an error if the text is no cursor."""
    try:
        session, offset = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if isinstance(session, str) and isinstance(offset, int) and offset >= 0:
            return session, offset
    except ValueError:
        pass
    raise ValueError(f"not a cursor: {text}")


class Sessions:
    """``path`` is a folder that all executors share. ``clock`` gives the time in seconds."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST, seconds: int = SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.most, self.seconds, self.clock = spark, path.rstrip("/"), most, seconds, clock
        self.folder = Folder(spark, self.path)

    def _known(self, session: str) -> dict | None:
        """What is known of a session that has not run out."""
        found = self.folder.read(f"known/{session}")
        return found if found and found["expires"] >= self.clock() else None

    def _tell(self, session: str, known: dict) -> None:
        self.folder.delete(f"known/{session}")
        self.folder.create(f"known/{session}", known)

    def keep(self, hits: DataFrame, order: list[str | Column], limit: int = HIT_CAP, **scope) -> str:
        """Keep the first hits of a search in their order, in place of an older session of this scope; returns the session's id."""
        session = session_id(**scope)
        self.folder.delete(f"known/{session}")
        ranked = hits.orderBy(*order).limit(limit).withColumn("session_rank", F.row_number().over(Window.orderBy(*order)) - 1)  # the first hits only
        ranked.write.mode("overwrite").parquet(f"{self.path}/rows/{session}")
        now = self.clock()
        self._tell(session, {**{k: scope.get(k) for k in SCOPE}, "created": now, "accessed": now, "expires": now + self.seconds})
        self.collect_garbage()
        return session

    def find(self, make: Callable[[], DataFrame], order: list[str | Column], **scope) -> str:
        """The session of this scope; ``make()`` gives its hits if there is none that lives."""
        session = session_id(**scope)
        return session if self._known(session) else self.keep(make(), order, **scope)

    def rows(self, session: str) -> DataFrame | None:
        """All rows of a session in any order, without a use of it; None if it is gone."""
        return self.spark.read.parquet(f"{self.path}/rows/{session}") if self._known(session) else None

    def page(self, session: str, limit: int, offset: int = 0, types: list[str] | None = None) -> tuple[list[Row], str | None] | None:
        """(rows, cursor of the next page) of a session, which counts as used; None if it is gone. An error if ``types``
        aren't those of the search."""
        known = self._known(session)
        if known is None:
            return None
        if types is not None and sorted(types) != sorted(set(known["types"] or [])):
            raise ValueError("the cursor belongs to a search of other types")
        self._tell(session, {**known, "accessed": self.clock()})
        place = F.col("session_rank")
        found = self.spark.read.parquet(f"{self.path}/rows/{session}").filter((place >= offset) & (place <= offset + limit)).orderBy(place).collect()  # a page
        return found[:limit], to_cursor(session, offset + limit) if len(found) > limit else None

    def after(self, cursor: str, limit: int, types: list[str] | None = None) -> tuple[list[Row], str | None] | None:
        session, offset = from_cursor(cursor)
        return self.page(session, limit, offset, types)

    def _forget(self, session: str) -> None:
        self.folder.delete(f"known/{session}")
        self.folder.delete(f"rows/{session}")

    def forget_archive(self, archive_key: str) -> int:
        """Delete an archive's sessions."""
        own = [s for s in self.folder.names("known") if (self.folder.read(f"known/{s}") or {}).get("archive_key") == archive_key]
        for s in own:
            self._forget(s)
        return len(own)

    def collect_garbage(self, force: bool = False, dry_run: bool = False) -> dict[str, int]:
        """Delete sessions that have run out, and all but the ``most`` used last (then made last, then by id); with ``force`` all."""
        known = {s: self.folder.read(f"known/{s}") for s in self.folder.names("known")}
        alive = {s: k for s, k in known.items() if k and k["expires"] >= self.clock() and not force}
        by_use = sorted(alive, key=lambda s: (-alive[s]["accessed"], -alive[s]["created"], s))
        gone = sorted({*(known.keys() - alive.keys()), *by_use[self.most :]})
        if not dry_run:
            for s in gone:
                self._forget(s)
            for s in set(self.folder.names("rows")) - set(self.folder.names("known")):
                self.folder.delete(f"rows/{s}")
        return {"scanned": len(known), "removed": len(gone)}
