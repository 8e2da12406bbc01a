import random
import re
from collections import Counter, defaultdict

import numpy as np

from kerbline.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=10, most=10):
    found = [(r[2] or "", r[3] or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER)))) for r in rows]
    out = []
    for lang in {f[0] for f in found}:
        here = [f for f in found if f[0] == lang]
        docs = Counter(t for f in here for t in f[2])
        kept = [t for t, n in docs.items() if n >= least_docs]
        count = defaultdict(Counter)
        for _, source, terms in here:
            for t in kept:
                count[source][t] += terms[t]
        total = sum(count.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        shares, all_ = {s: share(c) for s, c in count.items()}, share(total)
        far = lambda p, q: (p - q) ** 2 // (p + q)
        sources = {f[1] for f in here}
        for s in sources:
            mine = shares.get(s, {})
            pairs = [(-sum(far(mine[t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            told = [(-far(mine[t], all_[t]), t.encode(), t) for t in kept if count[s][t] and mine[t] > all_[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(told)[:most], 1)]
    return sorted(out)


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "éa", "Éa", "ÄB", "x1y", "a", "zebra", "日本", "𐐀x"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    # One source has a third of all rows.
    return [(k, rng.choice([None, "", "12 3!"]) if k % 17 == 0 else text(), rng.choice(["en", "de", None, ""]), "hot" if k % 3 == 0 else rng.choice(["s1", "s2", "é", None, ""])) for k in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_rows_are_those_of_brute_force(frame):
    rows = drawn(300)
    assert got(divergence.audit(frame(rows))) == brute(rows)


def test_small_blocks_and_batches_change_nothing(frame, monkeypatch):
    rows = drawn(200, 4) + [(1000, "long " * 300_000, "en", "s1")]
    monkeypatch.setattr(divergence, "CELLS", 3)
    monkeypatch.setattr(divergence, "HELD", 2)
    assert got(divergence.audit(frame(rows), least_docs=2, terms=3)) == brute(rows, 2, 3)
    monkeypatch.setattr(divergence, "HELD", 1 << 20)
    monkeypatch.setattr(divergence, "_DOCS", 12)
    rows = [(k, "b " * 3 + "a", "en", "s1" if k % 3 else "s2") for k in range(5_000)]
    assert got(divergence.audit(frame(rows), least_docs=2, terms=3)) == brute(rows, 2, 3)


def test_groups_without_terms_repeats_and_empty_tables(frame):
    rows = [(None, None, None, None), (1, "a", None, "x"), (1, "a", None, "x"), (2, "", "en", "y")]
    assert got(divergence.audit(frame(rows))) == brute(rows) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
    assert got(divergence.audit(frame([]))) == []


def test_runs_give_the_sum_over_single_terms():
    rng = np.random.default_rng(1)
    counts, times = rng.integers(0, 3, (40, 3)), rng.integers(1, 5, 40)
    rows, edges = divergence.clustered(counts, times)
    assert edges[-1] == times.sum()
    below = [int((rows[:, k] * np.diff(edges)).sum()) + 2 * int(edges[-1]) for k in range(3)]
    runs = [divergence.Runs(rows[:, k], edges[:-1], b) for k, b in enumerate(below)]
    # The vocabulary is in the order that makes few runs: the main column has one for each count.
    assert min(len(r.starts) for r in runs) == 3
    share = [[1 + 10**9 * (int(c) + 2) // below[k] for c in counts[:, k]] for k in range(3)]
    for i in range(3):
        for j in range(3):
            want = sum(int(t) * ((p - q) ** 2 // (p + q)) for t, p, q in zip(times, share[i], share[j], strict=True))
            assert runs[i].apart(runs[j], int(edges[-1])) == want


def test_counts_beyond_a_long_are_exact(spark):
    n, below = 9 * 10**18, 9 * 10**18 + 7
    row = spark.createDataFrame([(n, below)], "n long, below long").select(divergence.share(*map(divergence.F.col, ("n", "below")))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // below
