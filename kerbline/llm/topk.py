"""Exact top-k search by inner product, with score histograms instead of sorting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.llm.storage import written

#: Vectors in a block, queries in a group, groups that meet a block together, and scores worked on at once.
ROWS, QUERIES, TOGETHER, TILE = 16_384, 4_096, 4, 1 << 20
#: So many rows of a block have one peak; the kth peak is no higher than the kth score.
PEAK = 64
#: A round cuts the range in which a query's kth score lies into so many bins.
BINS = 4_096
_BLOCK = "block long, ids binary, dims int, vectors binary"


def _narrowest(largest: int) -> str:
    """The smallest type of whole numbers that holds all components."""
    return next(t for t in ("int8", "int16", "int32", "int64") if largest <= np.iinfo(t).max or t == "int64")


def _packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks of up to ``size`` vectors, each of one task and one dimension, components of type ``kind``."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            held = waiting[dims]
            while held and sum(len(i) for i, _ in held) >= least:
                ids, vectors = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                held[:] = [(ids[size:], vectors[size:])] if len(ids) > size else []
                yield pa.RecordBatch.from_pydict(
                    {"block": [number], "ids": [ids[:size].tobytes()], "dims": [dims], "vectors": [vectors[:size].tobytes()]},
                    pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary())]),
                )
                number += 1

        for batch in batches:
            ids, column = np.asarray(batch.column("id"), np.int64), batch.column("vector")
            lengths = np.diff(np.asarray(column.offsets))
            flat = np.asarray(column.flatten(), np.int64)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                waiting.setdefault(dims, []).append((ids[own], flat[starts[own][:, None] + np.arange(dims)].astype(kind)))
                yield from blocks(dims, size)
        for dims in waiting:
            yield from blocks(dims, 1)

    return rows.select(F.col("id").cast("long"), F.col("vector").cast("array<bigint>")).mapInArrow(pack, _BLOCK)


def _block(ids: bytes, dims: int, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, kind).astype(np.int64).reshape(len(ids), dims)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; vectors of other lengths end in zeros."""
    dims = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :dims], rows[:, :dims]
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims
    if reach < 2**53:
        kind = np.float32 if reach < 2**24 else np.float64
        return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    return queries @ rows.T


def _tiles(q_ids: np.ndarray, queries: np.ndarray, r_ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A few queries at a time: the first one's number, scores, and which don't count."""
    order = np.argsort(r_ids, kind="stable")
    low, high = np.searchsorted(r_ids[order], q_ids, "left"), np.searchsorted(r_ids[order], q_ids, "right")
    step = max(1, TILE // max(1, len(r_ids)))
    for a in range(0, len(q_ids), step):
        scores = _scores(queries[a : a + step], rows)
        own = np.zeros(scores.shape, bool)
        for q in np.flatnonzero(high[a : a + step] > low[a : a + step]):
            own[q, order[low[a + q] : high[a + q]]] = True
        yield a, scores, own


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For each row of ``vectors`` (id, vector: array of whole numbers) for which
    ``is_query`` holds: the ``k`` rows with the highest inner product (all, if
    fewer), as ``query_id``, ``rank`` (int, from 1), ``id``, ``score`` (long).

    Ties go to the smaller id. Rows with the query's own id are not candidates.
    Rows with a null id or vector, or a null component, take no part; vectors of
    other lengths count as ending in zeros. Repeated candidates are candidates
    each; a repeated query is answered once per row. Scores must fit a long.

    Queries meet all rows block by block. Each round scores everything and adds
    up, over all tasks, a histogram per query of the range in which its kth
    score lies; the bin that holds it is the next round's range, until it is one
    number. A task counts only bins at or above its own kth score. The last
    round keeps what reaches the kth score: k rows a query and its ties, of
    which a block gives its k smallest ids.
    """
    usable = vectors.select("id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False))
    )
    ends = usable.agg(F.max(F.array_max("vector")).cast("long"), F.min(F.array_min("vector")).cast("long")).first()
    largest = max(0, ends[0] or 0, -(ends[1] or 0))
    kind = _narrowest(largest)
    blocks = written(_packed(usable, ROWS, kind), "rows")
    asked = written(_packed(usable.where("asks"), QUERIES, kind).withColumn("group", F.col("block")), "queries")
    # One number per 4,096 queries, and one per 16,384 rows.
    group_ids = sorted(r[0] for r in asked.select("group").distinct().collect())
    block_ids = sorted(r[0] for r in blocks.select("block").collect())
    if not group_ids:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")

    def ranges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where a query's scores can lie at all, with ends of equal bins."""
        for frame in batches:
            made = []
            for r in frame.itertuples():
                _, q = _block(r.ids, r.dims, r.vectors, kind)
                reach = np.abs(q).sum(1) * largest + 1
                made.append((r.group, (-reach).tobytes(), reach.tobytes(), np.full(len(q), k, np.int64).tobytes(), np.ones(len(q), bool).tobytes()))
            yield pd.DataFrame(made, columns=["group", "low", "high", "wanted", "open"])

    state_type = "group long, low binary, high binary, wanted binary, open binary"
    state = written(asked.mapInPandas(ranges, state_type), "range")

    def met(state: DataFrame, use, result: str) -> DataFrame:
        """Every block of rows with every group of queries. A task holds one block and
        a few groups at a time; a row moves once for all groups that meet it together."""
        q = asked.select("group", F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("vectors").alias("q_vectors")).join(state, "group")
        place = F.array_position(F.lit(group_ids), F.col("group")) - 1
        q = q.withColumns({"meeting": F.floor(place / TOGETHER).cast("int"), "block": F.explode(F.lit(block_ids))})
        keyed = blocks.withColumn("meeting", F.explode(F.lit([*range(-(-len(group_ids) // TOGETHER))]).cast("array<int>")))

        def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            made = [made for b in left.itertuples() for r in right.itertuples() for made in use(b, r)]
            return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=[c.split()[0] for c in result.split(", ")])

        return keyed.groupBy("block", "meeting").cogroup(q.groupBy("block", "meeting")).applyInPandas(pairs, result)

    lowest = np.iinfo(np.int64).min

    def histogram(b, r) -> Iterator[pd.DataFrame]:
        r_ids, rows = _block(b.ids, b.dims, b.vectors, kind)
        q_ids, queries = _block(r.q_ids, r.q_dims, r.q_vectors, kind)
        low, high, open_ = np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64), np.frombuffer(r.open, bool)
        for a, scores, own in _tiles(q_ids, queries, r_ids, rows):
            n = len(scores)
            lo, hi = low[a : a + n, None], high[a : a + n, None]
            scores[own] = lowest
            peaks = np.maximum.reduceat(scores, np.arange(0, scores.shape[1], PEAK), axis=1)
            least = lo
            if peaks.shape[1] >= k:  # below this block's kth score nothing counts, unless scores lie above the range
                kth = np.partition(peaks, -k, axis=1)[:, [-k]]
                least = np.where(peaks.max(1, keepdims=True) < hi, np.maximum(lo, kth), lo)
            q, at = np.nonzero((scores >= least) & open_[a : a + n, None])
            inside = scores[q, at] < hi[q, 0]
            q, at = q[inside], at[inside]
            width = -((lo - hi) // BINS)
            bins = (scores[q, at] - lo[q, 0]) // width[q, 0]
            keys, count = np.unique(q * BINS + bins, return_counts=True)
            q, bins = keys // BINS, keys % BINS
            ends = np.searchsorted(q, np.arange(n), "right")
            total = np.concatenate([[0], np.cumsum(count)])
            above = total[ends[q]] - total[np.arange(len(q)) + 1]  # in higher bins here
            keep = above < k
            yield pd.DataFrame({"group": r.group, "query": a + q[keep], "bin": bins[keep], "n": count[keep]})

    def narrowed(key: tuple, counts: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(before):
            return pd.DataFrame(columns=["group", "low", "high", "wanted", "open"])
        r = before.iloc[0]
        low, high, wanted, open_ = (np.frombuffer(r[c], t).copy() for c, t in (("low", np.int64), ("high", np.int64), ("wanted", np.int64), ("open", bool)))
        counts = counts.sort_values(["query", "bin"], ascending=[True, False])
        so_far = counts.groupby("query")["n"].cumsum()
        reached = counts[so_far.to_numpy() >= wanted[counts["query"].to_numpy(np.int64)]].assign(so_far=so_far).groupby("query").first()
        q = reached.index.to_numpy(np.int64)
        width = -((low[q] - high[q]) // BINS)
        wanted[q] -= (reached["so_far"] - reached["n"]).to_numpy(np.int64)
        low[q] += reached["bin"].to_numpy(np.int64) * width
        high[q] = low[q] + width
        found = np.zeros(len(low), bool)
        found[q] = True
        open_ &= found & (high - low > 1)  # who has fewer candidates than k takes all
        return pd.DataFrame([(r["group"], low.tobytes(), high.tobytes(), wanted.tobytes(), open_.tobytes())], columns=["group", "low", "high", "wanted", "open"])

    while state.where(F.instr(F.hex("open"), "01") > 0).limit(1).count():
        counts = met(state, histogram, "group long, query long, bin long, n long").groupBy("group", "query", "bin").agg(F.sum("n").alias("n"))
        state = written(counts.groupBy("group").cogroup(state.groupBy("group")).applyInPandas(narrowed, state_type), "range")

    def kept(b, r) -> Iterator[pd.DataFrame]:
        r_ids, rows = _block(b.ids, b.dims, b.vectors, kind)
        q_ids, queries = _block(r.q_ids, r.q_dims, r.q_vectors, kind)
        low = np.frombuffer(r.low, np.int64)
        for a, scores, own in _tiles(q_ids, queries, r_ids, rows):
            q, at = np.nonzero((scores >= low[a : a + len(scores), None]) & ~own)
            score, ids = scores[q, at], r_ids[at]
            order = np.lexsort([ids, -score, q])
            q, score, ids = q[order], score[order], ids[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, "left")
            best = place < k
            yield pd.DataFrame({"group": r.group, "query": a + q[best], "query_id": q_ids[a + q[best]], "id": ids[best], "score": score[best]})

    found = met(state, kept, "group long, query long, query_id long, id long, score long")
    order = Window.partitionBy("group", "query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
