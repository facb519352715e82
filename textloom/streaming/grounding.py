"""The running counters of surfaces over a stream of events, with the budgets of ``operators.grounding.surface_statistics``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.grounding import BUDGETS, COUNTERS, PRIOR_BUDGETS, REJECTIONS, has_prior

STATISTIC = "chapter_id long, surface string, seq long, candidate_id string, kind string, seen long, recalled long, continued long, rejected long, page long, budget int"


class Counters(StatefulProcessor):
    """State of one surface of a chapter: its counters, and each candidate's number of pages. An event of kind ``end`` deletes both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", ", ".join(f"{c} long" for c in COUNTERS))
        self.pages = handle.getMapState("pages", "candidate_id string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq")  # one batch's events of one surface
        now = dict(zip(COUNTERS, self.counters.get() if self.counters.exists() else (0, 0, 0, 0), strict=True))
        out, ended = [], False
        for e in events.itertuples():
            row = [key[0], key[1], e.seq, e.candidate_id, e.kind, *(now[c] for c in COUNTERS), None, None]
            if e.kind == "page":
                page = self.pages.getValue((e.candidate_id,))[0] if self.pages.containsKey((e.candidate_id,)) else 0
                budgets = PRIOR_BUDGETS if has_prior(**now) else BUDGETS
                row[-2:] = page, budgets[min(page, len(budgets) - 1)]
                self.pages.updateValue((e.candidate_id,), (page + 1,))
            now["seen"] += e.kind == "page"
            now["recalled"] += e.kind == "accept"
            now["continued"] += e.kind == "continue"
            now["rejected"] += e.kind == "close" and e.decision in REJECTIONS
            ended = ended or e.kind == "end"
            if e.kind != "end":
                out.append(row)
        if ended:
            self.counters.clear()
            self.pages.clear()
        else:
            self.counters.update(tuple(int(now[c]) for c in COUNTERS))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in STATISTIC.split(", ")])
        yield made.astype({"page": "Int64", "budget": "Int32"})

    def close(self) -> None:
        pass


def surface_statistics(events: DataFrame) -> DataFrame:
    """As the table operator's, row by row as events come (output mode ``append``); in a batch by ``seq``, batches as they arrive.

    Needs the state store of ``STATE_STORE`` on the session.
    """
    return events.groupBy("chapter_id", "surface").transformWithStateInPandas(statefulProcessor=Counters(), outputStructType=STATISTIC, outputMode="Append", timeMode="None")


#: The setting and value that states of this kind need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
