import random

import public_tokenizers
import pytest
import sentencepiece

from kerbline.llm import pieces, token_counts
from kerbline.llm.vocabulary import load

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "a", "\n", "<s></s><unk> <0x0A>", " lead and trail  ", "▁mark ▁▁", "\x00\x01", "日本語一" * 50, "a" * 3_000, " " * 300, "😀 é ß", "don't 12345 x=1;\ty"]


def texts():
    rng = random.Random(5)
    letters = [*"abcdethe onr  \n\t▁éß日本 😀0123456789.,“”»", " the", "tion", "<s>"]
    return EDGES + ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_those_of_the_library(frame, library, prose):
    rows = dict(enumerate(texts() + prose(50)))
    got = {r["doc_id"]: r for r in pieces.encode(frame(list(rows.items())), MODEL).collect()}
    assert len(got) == len(rows)
    for k, text in rows.items():
        want = library.encode(text)
        assert got[k]["ids"] == want, text
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["decoded"] == (library.decode(want) if text else "")


def test_ids_give_the_text_back(frame, prose):
    rows = {k: t for k, t in enumerate([t for t in texts() if "▁" not in t] + prose(30))}
    coded = pieces.encode(frame(list(rows.items())), MODEL)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(coded, MODEL).collect()} == rows


def test_decoding_odd_ids(spark):
    coded = spark.createDataFrame([(1, [1, 2]), (2, None), (3, []), (4, [259 - 3])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(coded, MODEL).collect()}
    assert got[1] == "" and got[2] is None and got[3] == "" and got[4] == "\N{REPLACEMENT CHARACTER}"
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>"), MODEL).collect()


def test_counts_are_those_of_the_library(frame, library, prose):
    rows = dict(enumerate(texts() + prose(50)))
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(list(rows.items())), MODEL, limit=20).collect()}
    for k, text in rows.items():
        n = len(library.encode(text))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(text.encode()), n, n > 20), text


def test_nulls_repeats_and_empty_tables(frame):
    rows = [(None, "a b"), (1, None), (1, None), (2, "x"), (2, "x")]
    counts = sorted(tuple(r) for r in token_counts.token_counts(frame(rows), MODEL).fillna(-1).collect())
    assert [(r[0], r[1]) for r in counts] == [(-1, 3), (1, 0), (1, 0), (2, 1), (2, 1)]
    coded = pieces.encode(frame(rows), MODEL).collect()
    assert sorted(len(r["ids"]) for r in coded) == [0, 0, 1, 1, 2]
    assert pieces.encode(frame([]), MODEL).collect() == token_counts.token_counts(frame([]), MODEL).collect() == []


def test_neighbours_agree_with_merging():
    v = load(MODEL)
    lattice = pieces.Lattice(v)
    rng = random.Random(3)
    some = rng.choices([p for p in lattice.usable if len(p) > 1], k=600)
    x, y = some[:300], [p.lstrip("▁") or p for p in some[300:]]
    keep = [k for k in range(300) if y[k] in v.ids and y[k] in lattice.usable]
    import numpy as np

    got = lattice.neighbours(np.array([v.ids[x[k]] for k in keep]), np.array([v.ids[y[k]] for k in keep]))
    from kerbline.llm.vocabulary import merges

    for k, fine in zip(keep, got, strict=True):
        symbols = [v.ids[c] for c in x[k] + y[k]]
        merges(symbols, v.pairs)
        assert fine == ([s for s in symbols if s >= 0] == [v.ids[x[k]], v.ids[y[k]]])
