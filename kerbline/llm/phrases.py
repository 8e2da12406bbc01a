"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.storage import written
from kerbline.llm.text import PORTION, filled, mixed, portions

#: Places in a fingerprint; each holds 16 bits of one phrase name.
BINS = 64
EMPTY = 0xFFFF
#: Phrases count from this level on: some ten bytes. Shorter ones all texts share.
FIRST_LEVEL = 2

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _tossed(size: int) -> np.ndarray:
    """Coin tossing for small labels, by the label before and the own: twice
    the lowest place at which they differ, plus the own bit there."""
    before, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = before ^ own
    place = np.zeros_like(differ)
    for k in range(8, -1, -1):
        place[(differ >> k) & 1 == 1] = k
    return (2 * place + ((own >> place) & 1)).astype(np.uint8)


_LABELS = _tossed(128)
_NAMES = mixed(np.arange(256, dtype=np.uint64) + _STEP)
_POWERS = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, np.uint64))


def _cut(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks start: at local maxima of the labels, and at first symbols.
    The rounds before leave neighbours different and labels below 16."""
    higher = np.zeros(len(labels), bool)
    higher[1:] = labels[1:] > labels[:-1]
    starts = higher.copy()
    starts[:-1] &= ~higher[1:]
    # The text's last symbol starts no block alone, nor does its second.
    starts[np.roll(first, -1)] = False
    starts[np.roll(first, 1)] = False
    return starts | first


def _runs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    change = first.copy()
    change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def parse(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of the phrases of each level, from 1, and the text of each.

    A level takes equal neighbours together, tosses coins until labels are
    small, starts a block at each local maximum and names blocks by what they
    hold. All of it looks at a few neighbours only, so equal stretches get equal
    names inside, wherever they stand. Ends when each text is one phrase.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(data):
        return
    small = True
    x = data
    while True:
        first = np.ones(len(x), bool)
        first[1:] = text[1:] != text[:-1]
        kept = _runs(x, first)
        run = np.diff(np.append(kept, len(x)))
        names = _NAMES[x[kept]] if small else x[kept]
        long = run > 1
        names[long] = mixed(names[long] ^ (run[long].astype(np.uint64) * _STEP))
        first, text = first[kept], text[kept]
        differ = np.ones(len(names), np.uint64)
        differ[1:] = names[1:] ^ names[:-1]
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = (place * np.uint64(2) + ((names >> place) & np.uint64(1))).astype(np.uint8)
        labels[first] = 0
        for _ in range(2):
            labels[1:] = _LABELS[labels[:-1], labels[1:]]
            labels[first] = 0
        starts = np.flatnonzero(_cut(labels, first))
        within = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
        x = mixed(np.add.reduceat(names * _POWERS[np.minimum(within, len(_POWERS) - 1)] + within.astype(np.uint64), starts))
        text, small = text[starts], False
        yield x, text
        if len(x) == len(np.unique(text)):
            return


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of ``BINS`` 16-bit numbers per text: in each bin the least of the
    text's phrase names that fall into it. Empty texts have empty bins."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    least = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    done = np.zeros(len(texts), bool)
    for level, (names, text) in enumerate(parse(np.frombuffer(b"".join(texts), np.uint8), at), 1):
        count = np.bincount(text, minlength=len(texts))
        if level < FIRST_LEVEL and (count > 1).any():
            use = count[text] == 1  # short texts: what they are as a whole
        else:
            use = ~done[text]
        np.minimum.at(least, text[use] * BINS + (names[use] & np.uint64(BINS - 1)).astype(np.int64), mixed(names[use]) >> np.uint64(1))
        done |= count == 1
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, least % np.uint64(EMPTY)).astype(np.uint16).reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of bins, of those that either fills, that hold the same: near
    the share of phrases that two texts have in common. Two empty ones are alike."""
    filled_ = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & filled_).sum(1)
    n = filled_.sum(1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def _hex(prints: np.ndarray) -> list[str]:
    data = prints.astype(">u2").tobytes().hex()
    return [data[i : i + 4 * BINS] for i in range(0, len(data), 4 * BINS)]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(texts: list[str], following: list[str]) -> dict[str, list]:
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    both = fingerprints([*(t.encode() for t in texts), *changed, following[-1].encode()]) if n else np.zeros((1, BINS), np.uint16)
    own, other = both[:n], both[n : 2 * n]
    after = np.concatenate([own[1:], both[2 * n :]])
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": _hex(own),
        "edited_fingerprint": _hex(other),
        "near_edited": likeness(own, other).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and ``fingerprint`` (hex) of each row. Equal texts have equal
    fingerprints; null is an empty text. Nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            prints = fingerprints([t.encode() for t in filled(batch.column("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_hex(prints), pa.string())], ["id", "fingerprint"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_column)


def compared(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text with its edited form and with the next text by ascending id: the
    id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (0 to 1). After the last comes the first;
    a single row is followed by itself.

    Null texts are empty. Null ids come first; rows that share an id follow each
    other by a hash of their text, then by the text. An empty table gives none.

    Rows are dealt by ranges of ids, once. A task walks its range in order; the
    first and the last text of each range are put together afterwards, so the
    order costs no single task.
    """
    narrow = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = narrow.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    id_kind = narrow.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(narrow.select("id").limit(0).schema)
    fields = [out.field("id"), pa.field("part", pa.int32()), pa.field("kind", pa.int32()), pa.field("text", pa.string()), pa.field("n_chars", pa.int64()), *(pa.field(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(pa.field(c, pa.float64()) for c in ("near_edited", "near_next"))]
    schema = pa.schema(fields)

    def made(ids: list, part: int, kind: int, texts: list | None, more: dict | None = None) -> pa.RecordBatch:
        columns = {"id": ids, "part": [part] * len(ids), "kind": [kind] * len(ids), "text": texts or [None] * len(ids), **(more or {})}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name) or [None] * len(ids), f.type) for f in schema], schema=schema)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in portions(batches, "text", PORTION // 2):
            ids, texts = batch.column("id").to_pylist(), filled(batch.column("text")).to_pylist()
            if held is None:
                yield made(ids[:1], part, 1, texts[:1])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(texts) > 1:
                yield made(ids[:-1], part, 0, None, _compared(texts[:-1], texts[1:]))
            held = ids[-1], texts[-1]
        if held is not None:
            yield made([held[0]], part, 2, [held[1]])

    staged = written(ranged.select("id", "text").mapInArrow(walk, f"id {id_kind}, part int, kind int, text string, {_RESULT}"), "fingerprints")
    # One narrow row per range; the texts follow by joins.
    heads = staged.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    order = Window.orderBy("part")
    follows = staged.where("kind = 1").select("part").withColumn("next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    ends = staged.where("kind = 2").select("id", "part", "text").join(follows, "part").join(heads, "next_part")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, f in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True):
                row = made([i], 0, 0, None, _compared([t], [f]))
                yield row.select([c for c in schema.names if c not in ("part", "kind", "text")])

    closed = ends.select("id", "text", "following").mapInArrow(close, f"id {id_kind}, {_RESULT}")
    return staged.where("kind = 0").select(closed.columns).unionByName(closed).withColumnRenamed("id", id_column)
