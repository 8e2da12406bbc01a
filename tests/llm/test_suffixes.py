import hashlib

import numpy as np
import pytest

from kerbline.llm import suffixes


def brute(rows, length):
    """Every string of the input against all earlier places."""
    first = {}
    last = 1 << 62
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - length + 1):
            w, place = data[s : s + length], (last if i is None else i, s)
            first[w] = min(first.get(w, place), place)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (last if i is None else i, s):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out




def got(frame, rows, length):
    done = suffixes.digests(frame(rows), length=length)
    return sorted((tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def passages(seed=4, n=60):
    """Texts of few letters, with shared and shifted passages and runs."""
    rng = np.random.default_rng(seed)
    some = ["".join(rng.choice([*"abé "], 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = ["".join(rng.choice([*"abcdé \n"], rng.integers(0, 50)))]
        for _ in range(rng.integers(0, 4)):
            p = some[rng.integers(0, 6)]
            a = rng.integers(0, 30)
            parts += [p[a:], "".join(rng.choice([*"xyz"], rng.integers(0, 30)))]
        rows.append((int((k * 37) % 101), "".join(parts)))
    return rows + [(200, "a" * 300), (201, "a" * 90), (202, rows[0][1]), (203, rows[0][1]), (204, "ab" * 100)]


@pytest.mark.parametrize("length", [20, 37])
def test_removal(frame, length):
    rows = passages()
    assert got(frame, rows, length) == sorted(brute(rows, length), key=str)


def test_removal_over_many_buckets(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "DOCS", 7)
    monkeypatch.setattr(suffixes, "INDEXED", 400)
    monkeypatch.setattr(suffixes, "SCANNED", 300)
    rows = passages(seed=8)
    assert got(frame, rows, 24) == sorted(brute(rows, 24), key=str)


def test_nulls_repeats_and_empty_tables(frame):
    long = "the passage that comes again and again, "
    rows = [(None, long), (1, None), (2, ""), (3, long), (3, long), (4, "x" + long)]
    done = got(frame, rows, 20)
    assert [(r[0], r[2]) for r in done] == [(1, 0), (2, 0), (3, 0), (3, 0), (4, 40), (None, 40)]
    assert got(frame, [], 20) == []


@pytest.mark.parametrize("letters", [2, 4, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        parts = [rng.integers(1, letters + 1, rng.integers(1, 60)) for _ in range(rng.integers(1, 8))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)
        order = suffixes.suffix_array(text)
        data = text.tobytes()
        keys = [data[i : data.index(0, i)] for i in order]
        assert sorted(order.tolist()) == list(range(len(text)))
        assert keys == sorted(keys)
        shared = suffixes.common(text, order, 9)
        for k in range(1, len(order)):
            if len(keys[k]) >= 9 and len(keys[k - 1]) >= 9:
                assert shared[k] == (keys[k][:9] == keys[k - 1][:9])


def test_every_string_has_one_anchor():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5_000).astype(np.uint8)
    at = np.array([0, 0, 99, 200, 1_500, 5_000])
    h, first, last, text = suffixes.anchors(data, at, 100)
    starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
    assert starts == [s for a, b in zip(at[:-1], at[1:], strict=True) for s in range(a, b - 99)]
    assert (at[text] <= first).all() and (last + 100 <= at[text + 1]).all()
