import random
import time

import pyarrow as pa
import pytest

from kerbline.llm.groups import whole_groups


def _batches(rows, sizes):
    at = 0
    for n in sizes:
        yield pa.RecordBatch.from_pydict({"a": [r[0] for r in rows[at : at + n]], "b": [r[1] for r in rows[at : at + n]]}, pa.schema([("a", pa.int64()), ("b", pa.int32())]))
        at += n


@pytest.mark.parametrize("seed", range(20))
def test_groups_come_whole_however_batches_are_cut(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(60)))
    sizes = []
    while sum(sizes) < len(rows):
        sizes.append(min(rng.randrange(8), len(rows) - sum(sizes)))
    got, seen = [], []
    for table, starts in whole_groups(_batches(rows, sizes), ["a", "b"]):
        for x, y in zip(starts, [*starts[1:], table.num_rows], strict=True):
            part = list(zip(*table.slice(x, y - x).to_pydict().values(), strict=True))
            assert len(set(part)) == 1
            seen.append(part[0])
            got += part
    assert got == rows
    assert seen == sorted(set(rows))


def test_one_group_over_many_batches_is_put_together_once():
    batch = pa.RecordBatch.from_pydict({"a": [1] * 2000})
    start = time.perf_counter()
    ((table, starts),) = whole_groups([batch] * 2000, ["a"])
    assert table.num_rows == 4_000_000 and starts.tolist() == [0]
    assert time.perf_counter() - start < 10
