"""Near-duplicate documents: MinHash candidates, Bayesian pruning, exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.bitmap import hits, marked
from kerbline.llm.graph import components
from kerbline.llm.groups import blocked, joined, whole_groups
from kerbline.llm.storage import written
from kerbline.llm.text import _table, filled, mixed, portions, running, span_hash, utf8, words

N, THRESHOLD = 5, 0.8
#: MinHash values of a document, values in a band, and values compared at a time.
VALUES, BAND, CHUNK = 96, 4, 16
#: Pruning drops a pair right at the threshold with at most this probability, all steps together.
TOLERANCE = 6.5e-6
#: Members of a group that meet in a task.
BLOCK = 1_024

_FLIP = (_table("flip", VALUES) >> np.uint64(32)).astype(np.uint32)
_FACTOR = (_table("factor", VALUES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the text of each. A text of fewer
    words is one run; one without words has none."""
    first, last, text = words(data, at)
    h = span_hash(running(data), first, last)
    count = np.bincount(text, minlength=len(at) - 1)
    ends = np.cumsum(count)
    left = ends[text] - np.arange(len(h))  # words from here to the end of the text
    size = np.minimum(count[text], n)
    begins = left >= size
    out = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        more = begins & (k < size)
        out[more] = mixed(out[more] + padded[np.flatnonzero(more) + k] + np.uint64(k + 1))
    return out[begins], text[begins]


def signatures(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of n texts, whose hashes come in order; without any, the largest."""
    out = np.full((n, VALUES), 0xFFFFFFFF, np.uint32)
    if len(hashes):
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            out[text[starts], k] = np.minimum.reduceat((short ^ _FLIP[k]) * _FACTOR[k], starts)
    return out


def _binomials(share: float) -> list[float]:
    return [math.comb(CHUNK, m) * share**m * (1 - share) ** (CHUNK - m) for m in range(CHUNK + 1)]


def lost(least: list[int], similarity: float = THRESHOLD) -> float:
    """The probability that the limits ``least`` drop a pair of this similarity."""
    more, alive, gone = _binomials(similarity), np.ones(1), 0.0
    for m in least:
        alive = np.convolve(alive, more)
        gone += alive[:m].sum()
        alive[:m] = 0
    return float(gone)


def _limits(threshold: float, posterior: float) -> list[int]:
    """For 16, 32, ... compared values, the fewest matches at which the posterior
    probability of a similarity of ``threshold`` or more reaches ``posterior``
    (uniform prior: the tail of a beta, here as a sum of binomials)."""
    least = []
    for n in range(CHUNK, VALUES + 1, CHUNK):
        below, m = 0.0, -1
        while below < posterior:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Limits by the posterior probability, whose bound is lowered until pairs of
    similarity ``threshold`` are lost with at most ``tolerance``."""
    posterior = tolerance
    while lost(least := _limits(threshold, posterior), threshold) > tolerance:
        posterior /= 1.25
    return least


def likely(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of signatures a and b stay candidates, some values at a time."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * CHUNK, (k + 1) * CHUNK)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        stay = matches >= m
        alive, matches = alive[stay], matches[stay]
    return alive


def _pairs(starts: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members of the same group, a distance at a time: members of
    one block with each other, those of side 1 with those of side 2."""
    group = np.zeros(len(side), np.int64)
    group[starts] = 1
    group = np.cumsum(group)
    i, distance = np.arange(len(side)), 1
    while len(i):
        i = i[i + distance < len(side)]
        i = i[group[i] == group[i + distance]]
        meet = (side[i] == 0) | (side[i] != side[i + distance])
        yield i[meet], i[meet] + distance
        distance += 1


def _signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` (the smallest id of its
    class) and ``n_links`` (other documents whose five-word shingles have a Jaccard
    similarity of ``threshold`` or more with its own, copies included). Classes
    are what links connect.

    Copies are told by a 64-bit hash of the text and compared once. Texts that
    agree in one of 24 bands of four MinHash values are candidates; a pair of
    similarity 0.8 is missed with a probability of 3.2e-6. In a bucket MinHash
    values are compared 16 at a time, and a pair is dropped when the posterior
    probability of reaching the threshold falls below a bound so low that of pairs
    of similarity 0.8 a share of 4.6e-6 is lost in all. What remains connects
    groups of likely copies; in each of them all pairs are verified on the whole
    shingle sets. Pairs never leave a
    task: it gives sums and the links that connect. Groups of more than 1,024
    texts are cut into blocks that meet two by two.

    Words are runs without ASCII white space. A text of fewer than five words has
    one shingle, all of it. Texts without words (null, empty) have no links and
    classes of their own. Null ids link and count, and are never a class_id: a
    class of null ids only has a null one. Rows that share an id are told apart
    by their texts; repeated rows are copies. Empty tables give none.
    """
    least = needed(threshold)
    id_kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 20):
            texts = filled(batch.column("text"))
            data, at = utf8(texts)
            hashes, text = shingles(data, at)
            sig = signatures(hashes, text, len(texts))
            flat = data.tobytes()
            node = [xxhash.xxh3_64_intdigest(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            bands = np.zeros((len(texts), VALUES // BAND), np.uint64)
            for k in range(VALUES):
                bands[:, k // BAND] = mixed(bands[:, k // BAND] + sig[:, k].astype(np.uint64) + np.uint64(k))
            worded = np.bincount(text, minlength=len(texts)) > 0
            offsets = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(worded),
                    pa.array([r.tobytes() for r in sig], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64))),
                ],
                ["id", "node", "worded", "signature", "bands"],
            )

    sketches = written(narrow.mapInArrow(sketch, f"id {id_kind}, node long, worded boolean, signature binary, bands array<long>"), "sketches")
    copies = sketches.groupBy("node", "worded").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    different = sketches.where("worded").groupBy("node").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    different = written(different, "different")
    keys = different.select("node", F.explode("bands").alias("band"))
    meeting = written(blocked(keys, "band", "node", BLOCK), "buckets")

    def connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["band", "block_a", "block_b"]):
            node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
            sig = _signature_rows(table.column("signature"))
            label = np.arange(len(node))
            for i, j in _pairs(starts, side):
                apart = label[i] != label[j]  # the others are connected as it is
                i, j = i[apart], j[apart]
                stay = likely(sig[i], sig[j], least)
                if len(stay):
                    i, j = np.concatenate([np.arange(len(label)), i[stay]]), np.concatenate([label, j[stay]])
                    label = joined(len(label), i, j)
            own = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["a", "b"])

    # The signatures of texts that share no bucket stay where they are.
    some = meeting.join(different.select("node", "signature"), "node").repartition("band", "block_a", "block_b").sortWithinPartitions("band", "block_a", "block_b")
    group = components(some.select("node", "band", "block_a", "block_b", "side", "signature").mapInArrow(connect, "a long, b long"))
    group = written(group.withColumnRenamed("component", "group"), "likely")

    # Texts outside of these groups stay where they are.
    bitmap = marked(group.select("node"))

    def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in portions(batches, "text"):
            node = [xxhash.xxh3_64_intdigest(t) for t in filled(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            signed = np.array(node, np.uint64).view(np.int64)
            keep = [k for k in np.flatnonzero(hits(bitmap, signed)).tolist() if not (node[k] in seen or seen.add(node[k]))]
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(signed[keep]), batch.column("text").take(pa.array(keep, pa.int64()))], ["node", "text"])

    chosen = narrow.select("text").mapInArrow(texts_of, "node long, text string").join(group, "node").dropDuplicates(["node"])
    counted = chosen.join(copies.where("worded").select("node", "copies"), "node")
    gathered = blocked(written(counted.select("group", "node", "copies", "text"), "texts"), "group", "node", BLOCK)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["group", "block_a", "block_b"]):
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                node, side, number = (part.column(c).to_numpy() for c in ("node", "side", "copies"))
                hashes, text = shingles(*utf8(part.column("text").combine_chunks()))
                _, dense = np.unique(hashes, return_inverse=True)
                own = np.unique(text.astype(np.int64) << 32 | dense)  # sets
                text, dense = own >> 32, own & 0xFFFFFFFF
                at = np.searchsorted(text, np.arange(len(node) + 1))
                size = np.diff(at)
                mark = np.zeros(int(dense.max()) + 1 if len(dense) else 1, bool)
                links, left, right = np.zeros(len(node), np.int64), [], []
                for u in range(len(node) - 1):
                    v = np.arange(u + 1, len(node))
                    v = v[(side[u] == 0) | (side[v] != side[u])]
                    v = v[np.minimum(size[v], size[u]) >= threshold * np.maximum(size[v], size[u]) - 1e-9]
                    if not len(v):
                        continue
                    mark[dense[at[u] : at[u + 1]]] = True
                    hits = np.add.reduceat(mark[dense[at[v[0]] : at[v[-1] + 1]]].astype(np.int64), at[v[0] : v[-1] + 1] - at[v[0]])[v - v[0]]
                    mark[dense[at[u] : at[u + 1]]] = False
                    v = v[hits >= threshold * (size[v] + size[u] - hits) - 1e-9]
                    links[u] += number[v].sum()
                    links[v] += number[u]
                    left.append(np.full(len(v), u))
                    right.append(v)
                label = joined(len(node), np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[label])], ["node", "links", "root"])

    ready = gathered.repartition("group", "block_a", "block_b").sortWithinPartitions("group", "block_a", "block_b")
    verified = written(ready.mapInArrow(verify, "node long, links long, root long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = copies.join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.where("worded").groupBy("component").agg(F.min("first_id").alias("class_id"))
    per_text = known.join(smallest, "component", "left").select(F.col("node").alias("n"), F.col("worded").alias("w"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = sketches.select("id", "node", "worded").join(per_text, (F.col("node") == F.col("n")) & (F.col("worded") == F.col("w")))
    return rows.select(
        F.col("id").alias(id_column),
        F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("worded"), F.col("n_links")).otherwise(0).alias("n_links"),
    )


def kept(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each class, same columns: the row
    with the smallest id stays, and of repeated rows one. Texts without words and
    classes without an id stay whole."""
    classes = near_duplicates(docs, id_column=id_column, text_column=text_column, **how).where(F.col(id_column).isNotNull() & (F.col("n_links") > 0))
    marks = classes.groupBy(F.col(id_column).alias("i")).agg(F.min(F.col(id_column) != F.col("class_id")).alias("gone"), (F.count("*") > 1).alias("again")).where("gone or again")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = whole.join(marks, F.col(f"row.{id_column}") == F.col("i"), "left").where(~F.coalesce("gone", F.lit(False)))
    again = F.coalesce("again", F.lit(False))
    one = left.where(again).withColumn("text", F.col(f"row.{text_column}")).dropDuplicates(["i", "text"])
    return left.where(~again).select("row.*").unionByName(one.select("row.*"))
