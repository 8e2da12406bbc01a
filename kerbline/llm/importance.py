"""Importance resampling: documents drawn by how much like a target their n-grams are."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.storage import written
from kerbline.llm.text import portions, utf8

#: Buckets of n-grams: two numbers for each go to the driver, and a gain to all tasks.
BUCKETS = 10_000
#: Words that are looked up together; longer texts go in such stretches.
AT_ONCE = 1 << 17
#: Bytes of text that are worked on together.
PORTION = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [~0 & (1 << 64) - 1], np.uint64)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of texts that lie between the places ``at``: the words
    with one blank behind each, where each begins and ends there, and its text."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _INSIDE[data]
    # One place more in front of each text, so that no word spans two.
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:]
    sizes = np.flatnonzero(closes) + 1 - starts
    text = np.searchsorted(at, starts, "right") - 1
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    blank = np.zeros(len(out), bool)
    blank[ends] = True
    out[~blank] = data[inside[:-1]]
    return out, ends - sizes, ends, text


class Interned:
    """Different byte strings of a batch in an open-addressed table.

    Strings are stretches of ``data``; ``hashes`` are taken from the caller only
    where a test wants them to collide. A slot is found by xxhash64 and taken by
    the string that gets there first; a string ends in a slot only if all its
    bytes are those of the slot's string, else it goes on to the next slot.
    ``slot`` has the slot of every occurrence, ``owner`` an occurrence for every
    slot (-1: free), ``count`` the number of occurrences.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None):
        self.data, self.starts, self.sizes = data.tobytes(), starts, ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place
        n = len(starts)
        size = 1 << max(4, (2 * n).bit_length())
        if hashes is None:
            a = self.data
            hashes = np.fromiter((xxhash.xxh64_intdigest(a[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
        self.key = np.zeros(size, np.uint64)
        self.owner = np.full(size, -1, np.int64)
        self.slot = (hashes & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that come together one stays
            mine = self.owner[at]
            self.key[at[free]] = hashes[mine[free]]
            same = self.key[at] == hashes[left]
            same[same] = self._equal(left[same], mine[same])
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences have the same bytes, eight at a time."""
        fine = self.sizes[a] == self.sizes[b]
        go = np.flatnonzero(fine & (a != b))
        x, y, rest = self.starts[a[go]], self.starts[b[go]], self.sizes[a[go]]
        while len(go):
            same = ((self._at[x] ^ self._at[y]) & _KEEP[np.minimum(rest, 8)]) == 0
            fine[go[~same]] = False
            more = same & (rest > 8)
            go, x, y, rest = go[more], x[more] + 8, y[more] + 8, rest[more] - 8
        return fine

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of every slot in use (0 for a free one): crc32 modulo ``n``."""
        out, used = np.zeros(len(self.owner), np.int64), np.flatnonzero(self.owner >= 0)
        owner = self.owner[used]
        begin = self.starts[owner]
        spans = zip(begin.tolist(), (begin + self.sizes[owner]).tolist(), strict=True)
        out[used] = np.fromiter((zlib.crc32(self.data[s:e]) for s, e in spans), np.int64, len(used)) % n
        return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, Interned, np.ndarray]]:
    """The runs of 1 to ``longest`` consecutive words of some texts, a stretch of
    words at a time: the text of each occurrence, the table, each slot's bucket."""
    for a in range(0, len(starts), AT_ONCE):
        b = min(len(starts), a + AT_ONCE)
        firsts, lasts = [], []
        for n in range(longest):
            whole = np.arange(a, min(b, len(starts) - n))
            whole = whole[text[whole] == text[whole + n]]
            firsts.append(whole)
            lasts.append(whole + n)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        low = int(starts[a])
        table = Interned(data[low : int(ends[last.max()])], starts[first] - low, ends[last] - low)
        yield text[first], table, table.buckets(buckets)


def bucket_counts(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS, longest: int = 2) -> np.ndarray:
    """How many features of all rows fall into each bucket. Tasks add up what
    they read; each sends a row per bucket at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in portions(batches, "text", PORTION):
            for _, table, bucket in features(*words_of(*utf8(batch.column("text"))), buckets, longest):
                np.add.at(total, bucket, table.count)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    rows = docs.select(docs[text_column].alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, thousandths of the logarithm of how much more frequent it
    is in the target; every bucket counts once more than it occurs."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    ratio = ((b + 1) * (s + n) / ((a + 1) * (t + n)) for a, b in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", longest: int = 2) -> DataFrame:
    """The id, ``n_words``, ``n_features`` and ``weight``, the floored mean of the
    gains of a text's features (0 if it has none). Null texts have none."""
    buckets = len(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", PORTION):
            n = batch.num_rows
            count, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            words = words_of(*utf8(batch.column("text")))
            n_words = np.bincount(words[-1], minlength=n)
            for text, table, bucket in features(*words, buckets, longest):
                count += np.bincount(text, minlength=n)
                np.add.at(total, text, gain[bucket][table.slot])
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (n_words, count, weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_column)


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise in thousandths that depends on the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
    buckets: int = BUCKETS, longest: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_features``, ``weight``, ``score``
    and ``rank``.

    Features are runs of 1 to ``longest`` words, hashed into buckets. A bucket's
    gain says how much more frequent it is in ``target``; a document's weight is
    the floored mean of its features' gains, its score that plus noise of its id.
    Of the documents with ``least_words`` words or more, ``percent`` of a hundred
    (rounded down) are drawn: those with the highest scores, of equals the
    smaller ids. ``rank`` numbers them from 1 in that order, others have none.

    In each task the features of a stretch of words are interned in an
    open-addressed table, which gives each occurrence its slot, and with it its
    bucket and gain. Nothing but counts by bucket leaves the tasks of the first
    reading, nothing but numbers by document those of the second. The order comes
    from a histogram of scores, which are whole thousandths of logarithms (some
    ten thousand different ones, however many rows), and from ids within a score.

    Null and empty texts have no features, weight 0, and are not drawn while
    ``least_words`` is 1 or more. A null id counts as an empty one and comes
    first. Repeated rows are rows of their own. An empty table gives none, an
    empty ``target`` is one without features. Texts of any length are read whole,
    a stretch of words at a time. Other columns are not read, whatever their names.
    """
    gain = gains(bucket_counts(docs, text_column, buckets, longest), bucket_counts(target, text_column, buckets, longest))
    rows = weighed(docs, gain, id_column, text_column, longest).withColumnRenamed(id_column, "id")
    scored = written(rows.select("*", (F.col("weight") + noise("id", seed)).alias("score")), "scored")
    fit = F.col("n_words") >= least_words
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    places = F.floor(F.lit(percent) * F.sum("n").over(Window.partitionBy()) / 100)
    ladder = by_score.select("score", above.alias("above"), places.alias("places")).where("above < places")
    reached = scored.where(fit).join(ladder, "score")
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    shown = ["id", "n_features", "weight", "score"]
    drawn = reached.select(*shown, F.when(rank <= F.col("places"), rank).alias("rank"))
    rest = scored.join(ladder.select(F.col("score").alias("_score")), fit & (F.col("score") == F.col("_score")), "left_anti")
    return drawn.unionByName(rest.select(*shown, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("id", id_column)
