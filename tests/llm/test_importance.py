import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from kerbline.llm import importance
from kerbline.llm.text import utf8

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    def counted(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t))

    s, t = counted(r[1] for r in rows), counted(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for k, text in rows:
        own = [gain[zlib.crc32(g.encode()) % buckets] for g in grams(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([k, len(own), weight, score, None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def drawn(n, seed=2):
    rng = random.Random(seed)
    pool = ["The", "the", "été", "Été", "x1", "42", "日本", "-", "'s", "benchmark", "passage", "of", "words"]
    return [(k, None if k % 19 == 0 else " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for k in range(n)]


def test_rows_are_those_of_brute_force(frame, spark):
    rows, target = drawn(150), ["benchmark passage of words", None, "the x1 the x1", ""]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert got(importance.resampled(frame(rows), goal)) == brute(rows, target)
    # Few buckets and short stretches of words, which cut texts anywhere.
    for at_once, buckets in ((7, 13), (1, 1)):
        importance.AT_ONCE, before = at_once, importance.AT_ONCE
        try:
            made = importance.resampled(frame(rows[:40]), goal, percent=60, least_words=3, seed=1, buckets=buckets)
            assert got(made) == brute(rows[:40], target, 60, 3, 1, buckets)
        finally:
            importance.AT_ONCE = before


def test_nulls_ties_repeats_long_texts_and_empty_tables(frame, spark):
    none = spark.createDataFrame([], "text string")
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (2, "x y z"), (2, "x y z"), (3, "word " * 400_000)]
    made = got(importance.resampled(frame(rows), none, least_words=2, percent=100))
    assert made == brute(rows, [], 100, 2)
    assert got(importance.resampled(frame([]), none)) == []


def test_words_lie_end_to_end_with_a_blank_behind_each():
    texts = ["Ab c", "", "d", None, "é-F 1", "--", "ab"]
    data, starts, ends, text = importance.words_of(*utf8(pa.array(texts)))
    assert data.tobytes() == "ab c d é f 1 ab ".encode()
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "d", "é", "f", "1", "ab"]
    assert text.tolist() == [0, 0, 2, 4, 4, 4, 6]


def test_equal_hashes_of_different_strings_keep_them_apart():
    strings = [b"a", b"b", b"a", b"abcdefghi", b"abcdefghj", b"abcdefghi", b"", b"b", b"abcdefgh"] * 3
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    honest = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    for hashes in (None, honest, np.zeros(len(strings), np.uint64), np.full(len(strings), 2**64 - 1, np.uint64)):
        table = importance.Interned(data, starts, ends, hashes)
        seen = {}
        for s, slot in zip(strings, table.slot.tolist(), strict=True):
            assert seen.setdefault(slot, s) == s
        assert len(seen) == len(set(strings))
        assert all(table.count[k] == strings.count(s) for k, s in seen.items())
        assert all(strings[table.owner[k]] == s for k, s in seen.items())
        assert all(table.buckets(10_000)[k] == zlib.crc32(s) % 10_000 for k, s in seen.items())
