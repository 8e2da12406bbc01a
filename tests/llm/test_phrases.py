import hashlib

import numpy as np

from kerbline.llm import phrases


def brute(rows):
    """Rows in order of id: sha and hex of text, edited text, next text."""
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 4
        e = t[: len(t) - n] + f[:n]
        p = phrases.fingerprints([x.encode() for x in (t, e, f)])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *phrases._hex(p[:2]), *(float(phrases.likeness(p[:1], p[k : k + 1])[0]) for k in (1, 2))))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_every_text_meets_its_next_one_over_many_ranges(frame, prose, spark):
    rows = [(3 * k, t) for k, t in enumerate(prose(120) + ["", "é", "aaaa" * 500])]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = phrases.compared(frame(rows)).select(COLUMNS).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [tuple(r) for r in got] == brute(rows)


def test_equal_stretches_have_equal_phrases_wherever_they_stand(prose):
    text = prose(1, low=400, high=500)[0].encode()
    names = lambda t: [set(x.tolist()) for x, _ in phrases.parse(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
    plain, moved = names(text), names(b"another beginning " + text)
    for level in range(3):
        assert len(plain[level] & moved[level]) >= len(plain[level]) - 6


def test_a_text_has_the_same_fingerprint_whatever_it_is_parsed_beside(prose):
    for text in prose(20, low=20, high=60):
        plain = "".join(c for c, before in zip(text, " " + text, strict=False) if c != before).encode()
        assert all(a != b for a, b in zip(plain, plain[1:], strict=False))
        alone = phrases.fingerprints([plain])[0]
        for mates in ([plain, b"aa"], [b"aa", plain], [b"", plain, b"abab", b"x" * 500]):
            assert (phrases.fingerprints(mates)[mates.index(plain)] == alone).all()


def test_likeness_follows_what_texts_share(frame, prose):
    got = phrases.compared(frame(list(enumerate(prose(60, low=100, high=300))))).collect()
    assert np.mean([r["near_edited"] for r in got]) > 0.45
    assert all(r["near_edited"] > r["near_next"] for r in got)


def test_nulls_ties_single_and_empty_tables(frame):
    got = phrases.compared(frame([(None, "b"), (1, None), (1, "same"), (1, "same"), (2, "last one of all")])).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 4}) == 1
    assert {r["n_chars"] for r in got if r["doc_id"] == 1} == {0, 4}
    only = phrases.compared(frame([(5, "alone in here")])).collect()
    assert only[0]["near_next"] == 1.0
    assert phrases.compared(frame([])).collect() == []
    assert [r["fingerprint"] for r in phrases.fingerprint(frame([(1, "x"), (2, "x")])).collect()][0] == phrases._hex(phrases.fingerprints([b"x"]))[0]
