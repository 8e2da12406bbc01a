import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbline.llm import byte_pairs
from kerbline.llm.vocabulary import merges

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = ["", " ", "  ", "\n", "a", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "a" * 3_000, " " * 300 + "x", "日本語" * 50, "😀 é ß", "don't DON'T 12345 x=1;\ty", "\x00\x01"]
# Letters of late Unicode versions, and blanks of several kinds.
EDGES += ["՘a ᲊb \U00016d40c 1\U00011de0", "\x85 　\n\n x  \t y"]


def texts(n=400):
    rng = random.Random(5)
    letters = [*"abcdethe onr  \n\téß日本 😀0123456789.,“”»'", " the", "tion", "<|endoftext|>", "'ll", "\xa0"]
    return EDGES + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    vocabulary = byte_pairs.load(PATH)
    return byte_pairs.Encoder(vocabulary, byte_pairs.automaton_of(vocabulary))


def test_ids_and_texts_are_those_of_the_library(frame, library, prose):
    rows = dict(enumerate(texts() + prose(50)))
    got = {r["doc_id"]: r for r in byte_pairs.encode(frame(list(rows.items())), PATH).collect()}
    packed = {r["doc_id"]: r for r in byte_pairs.encode(frame(list(rows.items())), PATH, packed=True).collect()}
    assert len(got) == len(packed) == len(rows)
    for k, text in rows.items():
        want = library.encode(text, add_special_tokens=False).ids
        assert got[k]["ids"] == want, text
        assert np.frombuffer(packed[k]["ids"], "<u4").tolist() == want
        assert got[k]["n_tokens"] == packed[k]["n_tokens"] == len(want)
        assert got[k]["decoded"] == packed[k]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_stored_ids_give_texts(spark, library):
    coded = spark.createDataFrame([(1, [50256, 64]), (2, None), (3, []), (4, [162, 245, 64])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in byte_pairs.decode(coded, PATH).collect()}
    assert got == {k: v and library.decode(v, skip_special_tokens=False) if v else v if v is None else "" for k, v in [(1, [50256, 64]), (2, None), (3, []), (4, [162, 245, 64])]}
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_pairs.decode(spark.createDataFrame([(1, [50_257])], "doc_id long, ids array<int>"), PATH).collect()


def test_every_prefix_ends_with_the_token_that_merging_leaves_there(encoder):
    v, rng = encoder.vocabulary, random.Random(2)
    words = ["".join(rng.choices([*"abethionr ", "the", "ing", "é"], k=rng.randint(1, 12))).encode() for _ in range(150)]
    words.sort(key=len, reverse=True)
    together = encoder.last_tokens(words)
    for k, data in enumerate(words):
        alone = encoder.last_tokens_of_one(data)
        assert alone == together[: len(data) + 1, k].tolist()
        for j in range(1, len(data) + 1):
            symbols = [v.by_byte[b] for b in data[:j]]
            merges(symbols, v.pairs)
            assert alone[j] == [s for s in symbols if s >= 0][-1]


def test_the_automaton_ends_where_words_end():
    words = {k: w for k, w in enumerate([b"a", b"b", b"ab", b"bab", b"abba", b"bb", b"aab"])}
    made = byte_pairs.Automaton(words)
    go = dict(zip(made.keys.tolist(), made.targets.tolist(), strict=True))
    text, state, matched = b"abbababbaabab", 0, 0
    for j, c in enumerate(text, 1):
        while (state << 8 | c) not in go:
            state = int(made.link[state])
            matched = int(made.length[state])
        state, matched = go[state << 8 | c], matched + 1
        t, found = int(made.near[state]), []
        while t >= 0:
            if made.length[t] <= matched:
                found.append(words[int(made.word[t])])
            t = int(made.near[made.link[t]]) if made.link[t] >= 0 else -1
        assert found == sorted((w for w in words.values() if text[:j].endswith(w)), key=len, reverse=True)


@pytest.mark.parametrize("remembered, longest, pairs, at_once", [(3, 64, 1 << 20, 7), (400_000, 3, 5, 1), (1, 1, 1, 100)])
def test_memory_of_words_and_long_texts(library, encoder, monkeypatch, remembered, longest, pairs, at_once):
    for name, value in (("REMEMBERED", remembered), ("LONGEST", longest), ("PAIRS", pairs), ("AT_ONCE", at_once)):
        monkeypatch.setattr(byte_pairs, name, value)
    small = byte_pairs.Encoder(encoder.vocabulary, encoder.automaton)
    rows = texts(60)
    made = small.encode(rows)
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert [small.decode(m) for m in made] == rows


def test_a_long_text(library, encoder):
    long = "word and word. " * 100_000 + "z" * 200_000
    assert len(encoder.encode([long])[0]) // 4 == len(library.encode(long, add_special_tokens=False).ids)


def test_nulls_repeats_and_empty_tables(frame):
    rows = [(None, "a b"), (1, None), (1, None), (2, "x"), (2, "x")]
    got = sorted((r["doc_id"] or -1, r["ids"], r["n_tokens"], r["decoded"]) for r in byte_pairs.encode(frame(rows), PATH).collect())
    assert got == [(-1, [64, 275], 2, "a b"), (1, [], 0, ""), (1, [], 0, ""), (2, [87], 1, "x"), (2, [87], 1, "x")]
    assert byte_pairs.encode(frame([]), PATH).collect() == []
