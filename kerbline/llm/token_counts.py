"""Token counts by byte-pair merging, without token ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.llm.text import filled, portions, utf8
from kerbline.llm.vocabulary import BLANK, Vocabulary, load, merges, units

#: Counts of so many different stretches are remembered in a Python worker; then it starts afresh.
REMEMBERED = 1_000_000


class _Counts(dict):
    """The token count of a stretch: initial symbols minus merges."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        total = self._count(unit)
        if len(unit) <= 64:
            self[unit] = total
        return total

    def _count(self, unit: str) -> int:
        v, total = self.vocabulary, 0
        symbols = list(map(v.ids.get, unit.replace(" ", BLANK)))
        while None in symbols:  # an unknown character is its bytes and merges with nothing
            k = symbols.index(None)
            total += len(unit[k].encode()) + k - merges(symbols[:k], v.pairs)[0]
            symbols, unit = symbols[k + 1 :], unit[k + 1 :]
        return total + len(symbols) - merges(symbols, v.pairs)[0]


_of_worker: dict[str, _Counts] = {}


def _counts(path: str, vocabulary: Vocabulary) -> _Counts:
    """The counts that this worker remembers from task to task."""
    if path not in _of_worker:
        _of_worker.clear()
        _of_worker[path] = _Counts(vocabulary)
    return _of_worker[path]


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens).

    ``n_tokens`` is the number of ids the sentencepiece library gives for the
    whole text with the BPE model at ``model_path``: the lowest-ranked adjacent
    pair merges first (heap and linked list), and the count is initial symbols
    minus merges. Stretches between blanks can't merge with each other, so each
    different one is merged once and its count remembered.

    Null and empty texts have 0 bytes and 0 tokens. Null ids stay null, repeated
    rows give repeated rows, an empty table gives none; other columns are not
    read, whatever their names. Nothing is shuffled: rows stay in their tasks.
    """
    vocabulary = load(model_path)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(model_path, vocabulary)
        for batch in portions(batches, "text"):
            texts = filled(batch.column("text"))
            n_bytes = np.diff(utf8(texts)[1])
            n_tokens = np.fromiter((sum(map(counts.__getitem__, units(t))) for t in texts.to_pylist()), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
