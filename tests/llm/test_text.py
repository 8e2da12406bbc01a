import re

import numpy as np
import pyarrow as pa

from kerbline.llm.text import portions, running, span_hash, utf8, words

TEXTS = ["", None, " a  b\tc\n", "één\x0bzwei\x1fdrei", "x", "\n\n", "日本 語"]


def test_words_are_runs_without_ascii_white_space():
    data, at = utf8(pa.array(TEXTS))
    first, last, text = words(data, at)
    got = [[] for _ in TEXTS]
    for a, b, t in zip(first, last, text, strict=True):
        got[t].append(bytes(data[a:b]).decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def test_hashes_depend_on_bytes_and_not_on_places():
    data = np.frombuffer(b"abcabc" + b"z" * 70_000 + b"abcabd", np.uint8)
    sums = running(data)
    h = span_hash(sums, np.array([0, 3, 70_006, 70_009, 0]), np.array([3, 6, 70_009, 70_012, 2]))
    assert h[0] == h[1] == h[2]
    assert len(set(h.tolist())) == 3


def test_portions_keep_rows_and_long_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    cut = list(portions([batch, batch.slice(0, 0)], "text", 20))
    assert [t for b in cut for t in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert [b.num_rows for b in cut] == [2, 1, 2]
