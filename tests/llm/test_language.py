import random
import zlib

import numpy as np

from kerbline.llm import language

SYLLABLES = {
    "en": ["the", "er", "ing", "th", "wh", "ly", "and", "ed"],
    "fr": ["eau", "eux", "é", "è", "ment", "que", "oi", "le"],
    "de": ["sch", "ein", "ung", "ü", "ß", "keit", "auf", "ch"],
}


def corpus(n=240):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        lang = rng.choice([*SYLLABLES])
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80)))
        rows.append((k, text.capitalize() + ".", lang))
    return rows


def test_held_out_documents(frame):
    rows = corpus()
    got = {r["doc_id"]: r for r in language.identify(frame(rows)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_documents_teach_nothing(frame):
    rows = corpus()
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    pick = lambda rows: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(frame(rows)).collect())
    assert pick(rows) == pick(other)


def test_vectors_are_sums_of_bound_letters():
    texts = ["Ab c", "", "é1é", "日本語 x" * 3, "\0"]
    grams = language.Grams(texts)
    got = grams.bundled(np.arange(len(texts)), len(texts))
    for text, vector in zip(texts, got, strict=True):
        words, now = [], ""
        for c in text.lower() + " ":
            now, words = (now + c, words) if c.isalpha() else ("", words + [now] * bool(now))
        codes = [0] + [x for w in words for x in (*map(ord, w), 0)]
        want = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            v = [language._letter_vector(x).astype(int) for x in (a, b, c)]
            want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert (vector == want).all(), text


def test_many_texts_and_grams_at_once(monkeypatch):
    texts = [t for _, t, _ in corpus(50)]
    whole = language.Grams(texts).bundled(np.arange(50), 50)
    monkeypatch.setattr(language, "_TEXTS", 7)
    monkeypatch.setattr(language, "_GRAMS", 40)
    assert (language.Grams(texts).bundled(np.arange(50), 50) == whole).all()


def test_nulls_repeats_and_empty_tables(frame):
    rows = [*corpus(60), (1000, None, "en"), (1001, "123 !?", "en"), (None, "the whing", None), (1002, "", None), (1003, "x", None), (1003, "x", None)]
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language.identify(frame(rows)).collect()]
    assert {r[2:] for r in got if r[0] in (1000, 1001, 1002)} == {("und", 0.0)}
    assert [r[1:3] for r in got if r[0] is None] == [(False, "en")]
    assert len([r for r in got if r[0] == 1003]) == 2
    assert language.identify(frame([])).collect() == []
    assert [r["lang_pred"] for r in language.identify(frame([(1, "no labels here", None)])).collect()] == ["und"]
