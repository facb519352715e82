"""Sentences and fragments of texts that arrive in pieces, with what is left over kept as state for each text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A sentence as ``functions.text.split_sentences`` has it, if what ends it has come: a stop with a blank behind it, or a line end.
_ENDED = re.compile(r"[^.!?。！？\n]*(?:[.!?]+(?!\s|\Z)[^.!?。！？\n]*)*(?:[.!?]+(?=\s)|[。！？]+(?=[^。！？])|\n)")


def cut_ended(text: str) -> tuple[list[str], str]:
    """(the sentences that are complete, the rest). Blank ones are left out."""
    found, at = [], 0
    while (m := _ENDED.match(text, at)) and m.end() > at:
        found.append(m.group())
        at = m.end()
    return [s for s in found if s.strip()], text[at:]


def sentences(pieces: DataFrame) -> DataFrame:
    """``text_id, sentence_index, text`` of a stream ``text_id, seq, piece, last``.

    Pieces of a text are taken in the order of ``seq`` inside a batch and across batches as they come; the remainder of a
    text is kept until a piece ends it or is marked as ``last``.
    """

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, index = state.get if state.exists else ("", 0)
        rows, ended = [], False
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            found, rest = cut_ended(rest + (row.piece or ""))
            ended = bool(row.last)
            if ended and rest.strip():
                found.append(rest)
            rows += [(key[0], index + i, s) for i, s in enumerate(found)]
            index += len(found)
            if ended:
                rest = ""
        if ended:
            state.remove()
        else:
            state.update((rest, index))
        yield pd.DataFrame(rows, columns=["text_id", "sentence_index", "text"])

    return pieces.groupBy("text_id").applyInPandasWithState(run, "text_id long, sentence_index long, text string", "rest string, n long", "append", GroupStateTimeout.NoTimeout)


def fragments(found: DataFrame, budget: int = 320) -> DataFrame:
    """``text_id, sentence_index, fragment_id`` of a stream ``text_id, sentence_index, words_count``: runs of at most ``budget`` words, named by their first sentence."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, total = state.get if state.exists else (-1, 0)
        rows = []
        for row in pd.concat(list(parts)).sort_values("sentence_index").itertuples():
            if first < 0 or total + row.words_count > budget:
                first, total = int(row.sentence_index), 0
            total += int(row.words_count)
            rows.append((key[0], row.sentence_index, first))
        state.update((first, total))
        yield pd.DataFrame(rows, columns=["text_id", "sentence_index", "fragment_id"])

    return found.groupBy("text_id").applyInPandasWithState(run, "text_id long, sentence_index long, fragment_id long", "first long, total long", "append", GroupStateTimeout.NoTimeout)
