import random
import re
from itertools import combinations

import numpy as np
import pytest

from kerbline.llm import ngram_join
from kerbline.llm.graph import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """Class and links of each row, all pairs compared."""
    own = [sets(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if own[i] and own[j] and len(own[i] & own[j]) >= threshold * len(own[i] | own[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(j)] = find(i)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return sorted(((i, ids.get(find(k)) if own[k] else i, links[k]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(prose, copies=40):
    rng = random.Random(1)
    base = prose(60, low=3, high=150)
    texts = base + base[:10] + ["", None, "one two", "one two", "one  two"]
    for t in [base[5]] * copies + base[10:30]:
        w = t.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [(100 - k if k % 2 else k, t) for k, t in enumerate(texts)]


def got(frame, rows):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(frame(rows)).collect()), key=str)


def test_all_links_and_classes(frame, prose):
    rows = corpus(prose)
    assert got(frame, rows) == brute(rows)


def test_large_groups_are_cut_into_blocks(frame, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = corpus(prose, 60)
    assert got(frame, rows) == brute(rows)


def test_nulls_repeats_and_empty_tables(frame, prose):
    a, b = prose(2, low=30, high=40)
    rows = [(None, a), (4, a), (3, a), (3, a), (7, b), (7, a), (None, None), (9, " \n"), (None, "lone one")]
    assert got(frame, rows) == brute(rows)
    assert got(frame, []) == []


def test_one_of_each_class_is_kept(frame, prose):
    a, b = prose(2, low=30, high=40)
    rows = [(2, a), (1, a), (1, a), (3, a + " more"), (5, b), (6, ""), (8, None), (None, a)]
    docs = frame(rows)
    kept = ngram_join.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (6, ""), (8, None), (None, a)], key=str)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    least = ngram_join.needed()
    assert all(0 < m <= n for m, n in zip(least, range(16, 97, 16), strict=True))
    a = rng.integers(0, 1 << 30, (20_000, ngram_join.VALUES)).astype(np.uint32)
    for similarity, share in ((0.8, (0.999, 1)), (0.3, (0, 0.01))):
        b = np.where(rng.random(a.shape) < similarity, a, a + np.uint32(1))
        assert share[0] <= len(ngram_join.likely(a, b, least)) / len(a) <= share[1]


def test_pruning_loses_no_more_than_stated():
    """Match counts of a pair at the threshold, followed value by value."""
    least, alive, gone = ngram_join.needed(), {0: 1.0}, 0.0
    for n in range(1, ngram_join.VALUES + 1):
        after = {}
        for m, p in alive.items():
            after[m] = after.get(m, 0) + p * 0.2
            after[m + 1] = after.get(m + 1, 0) + p * 0.8
        if n % ngram_join.CHUNK == 0:
            limit = least[n // ngram_join.CHUNK - 1]
            gone += sum(p for m, p in after.items() if m < limit)
            after = {m: p for m, p in after.items() if m >= limit}
        alive = after
    missed = (1 - 0.8**ngram_join.BAND) ** (ngram_join.VALUES // ngram_join.BAND)
    assert gone <= 6.5e-6 and gone + missed < 1e-5
    assert ngram_join.lost(least) == pytest.approx(gone)


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(5, 4), (4, 3), (9, 8), (3, 2), (8, 7)], {5: 2, 4: 2, 3: 2, 2: 2, 9: 7, 8: 7, 7: 7})])
def test_components(spark, edges, want):
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
