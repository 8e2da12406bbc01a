import numpy as np
import pytest

from kerbline.llm import mixing


def wanted(sizes):
    """Targets by the rule as it is worded: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over, share = 0.0, left
        for s in sorted(open_, key=order.index):
            target[s] += share * weight[s] / total
            if target[s] >= 3.0 * sizes[s]:
                over += target[s] - 3.0 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = over
    return target


def rows(seed=2):
    rng = np.random.default_rng(seed)
    counts = {"a": 400, "b": 30, None: 60, "é": 200, "Z": 5, "\U0001f600": 50, "￮": 20}
    out = []
    for source, n in counts.items():
        out += [(len(out) + k, " ".join(["w"] * int(rng.integers(0, 120))), None, source) for k in range(n)]
    return out


def test_targets_and_taken_words(frame):
    data = rows()
    got = mixing.mix(frame(data)).collect()
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = wanted(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, len(t.split())) for i, t, _, _ in data]
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["copies"] - r["target"] / r["source_size"]) < 1
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60, s


def test_reruns_and_other_partitions_agree(frame, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    first = sorted(tuple(r) for r in mixing.mix(frame(rows())).select("doc_id", "taken").collect())
    again = sorted(tuple(r) for r in mixing.mix(frame(rows()[::-1]).repartition(7)).select("doc_id", "taken").collect())
    assert first == again
    other = sorted(tuple(r) for r in mixing.mix(frame(rows()), seed=2).select("doc_id", "taken").collect())
    assert first != other


@pytest.mark.parametrize("how", [mixing.pivotal, mixing.pivotal_alike])
def test_rounding_keeps_words_and_chances(how):
    rng = np.random.default_rng(1)
    size, total = np.array([5, 100, 3, 40, 40, 7]), np.zeros(6)
    for _ in range(6_000):
        part = how(size, np.full(6, 0.3) if how is mixing.pivotal else 0.3, rng.random(6))
        assert (part * size).sum() == pytest.approx((size * 0.3).sum())
        assert ((part > 0) & (part < 1)).sum() <= 1 and part.min() >= 0 and part.max() <= 1
        total += part
    assert np.abs(total / 6_000 - 0.3).max() < 0.03


def test_nulls_repeats_and_empty_tables(frame):
    data = [(1, None, None, "a"), (None, "x y", None, "a"), (2, "x y z", None, None), (2, "x y z", None, None), (3, "", None, "b")]
    got = mixing.mix(frame(data)).collect()
    assert len(got) == 5
    assert sum(r["source_size"] for r in got if r["doc_id"] == 2) == 12
    assert len({r["taken"] for r in got if r["doc_id"] == 2}) == 1
    assert [r["taken"] for r in got if r["doc_id"] in (1, 3)] == [0, 0]
    assert mixing.mix(frame([])).collect() == []
    assert sum(r["taken"] for r in mixing.mix(frame([(1, None, None, "a")])).collect()) == 0


def test_documents_come_as_often_as_they_are_taken(frame):
    data = rows()
    docs = frame(data)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: n for k, n in copies.items() if n}
