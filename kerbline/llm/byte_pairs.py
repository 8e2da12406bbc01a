"""Byte-level BPE by dynamic programming: the last token of every prefix.

In byte-pair merging the tokens of a prefix end with one certain token, and
what stands before it are the tokens of the shorter prefix. So the last token of
every prefix is enough: of the tokens that end at a place (a suffix automaton of
the vocabulary gives them, longest first) exactly one fits behind the last token
of what it leaves over. Following these last tokens from the end gives the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kerbline.llm.text import filled, portions
from kerbline.llm.vocabulary import merges

#: Bytes of text that are worked on together, and words (or ids) of a text at a time.
PORTION, AT_ONCE = 1 << 20, 1 << 16
#: A task remembers the ids of so many different words of up to so many bytes,
#: then it starts afresh; and so many answers about pairs, of which new ones replace old ones.
REMEMBERED, LONGEST, PAIRS = 400_000, 64, 1 << 20
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{digits}+| ?{others}+|\s+(?!\S)|\s+"


@dataclass
class Bytes:
    """A byte-level BPE vocabulary. Token ids fit 20 bits."""

    tokens: dict[int, bytes]
    #: By the ids of two tokens: the rank of their merge and the token that it makes, 20 bits each.
    pairs: dict[int, int]
    #: By token: the rank of the merge that makes it (-1: a single byte), and its two parts.
    born: list[int]
    left: list[int]
    right: list[int]
    special: dict[str, int]
    #: Characters that the pattern's library calls letters or digits and the tokenizer's does not.
    others: str
    by_byte: list[int] = field(default_factory=list)


def _shown_bytes() -> dict[str, int]:
    """How such files write bytes: printable ones as themselves, the rest from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _unknown_to(tokenizer) -> str:
    """Letters and digits of a Unicode version that the tokenizer does not know yet."""
    found = []
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, sample in (("L", "a"), ("N", "1")):
        ours = regex.findall(rf"\p{{{kind}}}", every)
        cut = tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{sample}{c}\n" for c in ours))
        whole = {span[0] for _, span in cut if span[1] - span[0] == 2}
        found += [c for k, c in enumerate(ours) if 3 * k not in whole]
    return "".join(sorted(found))


def load(path: str) -> Bytes:
    """Read a byte-level BPE file of the tokenizers library that leaves texts as they are."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
    if not (plain and level) or told["normalizer"] or told["decoder"]["type"] != "ByteLevel":
        raise ValueError(f"{path}: only byte-level BPE that changes nothing before or after is read")
    if any(a[k] for a in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens must match as they are written")
    special = {a["content"]: a["id"] for a in told["added_tokens"]}
    shown, ids = _shown_bytes(), model["vocab"]
    tokens = {i: bytes(map(shown.__getitem__, t)) for t, i in ids.items() if t not in special}
    by_bytes = {t: i for i, t in tokens.items()}
    size = max([*tokens, *special.values()]) + 1
    if size > 1 << 20 or any(bytes([b]) not in by_bytes for b in range(256)):
        raise ValueError(f"{path}: every byte must be a token, and ids must fit 20 bits")
    born, left, right, pairs = [-1] * size, [-1] * size, [-1] * size, {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        x, y, made = ids[a], ids[b], ids[a + b]
        if born[made] >= 0 or max(born[x], born[y]) >= rank or x << 20 | y in pairs:
            raise ValueError(f"{path}: a token must come from one merge, behind those of its parts")
        born[made], left[made], right[made] = rank, x, y
        pairs[x << 20 | y] = rank << 20 | made
    return Bytes(tokens, pairs, born, left, right, special, _unknown_to(Tokenizer.from_file(path)), [by_bytes[bytes([b])] for b in range(256)])


class Automaton:
    """The suffix automaton of some words: reading a text, its state stands for
    the longest stretch behind which lies the current place and that is part of a
    word. ``near`` is the closest state, going to shorter ends, that is a word."""

    def __init__(self, words: dict[int, bytes]):
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def split(p: int, c: int, q: int) -> int:
            """The shorter stretches of state q get a state of their own."""
            new = len(go)
            go.append(go[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = new
                p = link[p]
            return new

        word_of = {}
        for i, word in words.items():
            at = 0
            for c in word:
                q = go[at].get(c)
                if q is not None:
                    at = q if length[q] == length[at] + 1 else split(at, c, q)
                    continue
                new = len(go)
                go.append({})
                link.append(0)
                length.append(length[at] + 1)
                p = at
                while p >= 0 and c not in go[p]:
                    go[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = go[p][c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                at = new
            word_of[at] = i
        near = [-1] * len(go)
        for s in sorted(range(len(go)), key=length.__getitem__):
            near[s] = s if s in word_of else near[link[s]] if s else -1
        edges = [(s << 8 | c, t) for s, row in enumerate(go) for c, t in row.items()]
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int32)
        self.link, self.length, self.near = (np.array(x, np.int32) for x in (link, length, near))
        self.word = np.full(len(go), -1, np.int32)
        self.word[list(word_of)] = list(word_of.values())


class Encoder(dict):
    """Texts to ids and back. As a dict: the ids of the words that it remembers,
    as little-endian 32-bit numbers."""

    def __init__(self, vocabulary: Bytes, automaton: Automaton):
        super().__init__()
        v, self.automaton = vocabulary, automaton
        self.vocabulary = v
        self.edges = np.argsort(automaton.keys)
        self.edge_keys = automaton.keys[self.edges]
        #: Answers about pairs, each at a place that its key gives; a newer one takes the place.
        self.asked, self.answers = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.shown = {i: t for i, t in v.tokens.items()} | {i: t.encode() for t, i in v.special.items()}
        self.sizes = np.zeros(len(v.born), np.int64)
        self.sizes[list(self.shown)] = [len(t) for t in self.shown.values()]
        self.find = regex.compile(_WORD.format(letters=r"\p{L}", digits=r"\p{N}", others=r"[^\s\p{L}\p{N}]"))
        # Of ASCII texts the standard library's engine is the faster one.
        self.find_ascii = re.compile(_WORD.format(letters="[A-Za-z]", digits="[0-9]", others=r"[^\sA-Za-z0-9]"), re.ASCII)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.first_odd = v.others[0] if v.others else "\U0010ffff"
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.update({t: np.uint32(i).tobytes() for t, i in self.vocabulary.special.items()})

    @cached_property
    def find_odd(self) -> regex.Pattern:
        """For texts with characters that may be newer than the tokenizer."""
        odd = "".join(f"\\U{ord(c):08x}" for c in self.vocabulary.others) or r"\b"
        kinds = {"letters": rf"[\p{{L}}--[{odd}]]", "digits": rf"[\p{{N}}--[{odd}]]", "others": rf"(?:[^\s\p{{L}}\p{{N}}]|[{odd}])"}
        return regex.compile(_WORD.format(**kinds), regex.V1)

    def fit(self, x: int, y: int) -> bool:
        """Whether merging the bytes of tokens x and y gives just x and y.

        Time runs backwards: the younger of the two symbols at the border is
        taken apart, and the pair at the border must never have been due before
        the merges that built them. Of equal ranks the left one goes first.
        """
        v = self.vocabulary
        pairs, born = v.pairs, v.born
        until_x = until_y = 1 << 40
        while True:
            due = pairs.get(x << 20 | y)
            if due is not None and (due >> 20) < until_x and (due >> 20) <= until_y:
                return False
            if born[x] > born[y]:
                until_x, x = born[x], v.right[x]
            elif born[y] >= 0:
                until_y, y = born[y], v.left[y]
            else:
                return True

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same for many pairs; only those are looked into whose answer is not at its place."""
        key = x << 20 | y
        place = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(PAIRS)).astype(np.int64)
        fine = self.answers[place]
        new = np.flatnonzero(self.asked[place] != key)
        if len(new):
            different, back = np.unique(key[new], return_inverse=True)
            made = np.array([self.fit(k >> 20, k & 0xFFFFF) for k in different.tolist()])
            fine[new] = made[back]
            where, which = np.unique(place[new], return_index=True)
            self.asked[where], self.answers[where] = key[new][which], fine[new][which]
        return fine

    def last_tokens(self, words: list[bytes]) -> np.ndarray:
        """By length of prefix and word (longest words first): the prefix's last
        token. All words side by side, a byte of each at a time."""
        m = self.automaton
        sizes = np.array([len(w) for w in words])
        longest = int(sizes[0])
        data = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest).T.astype(np.int64)
        last = np.full((longest + 1, len(words)), -1, np.int32)
        state, matched = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        going = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
        for j, n in enumerate(going.tolist(), 1):
            state, matched = state[:n], matched[:n]
            key, todo = state << 8 | data[j - 1, :n], np.arange(n)
            place = np.zeros(n, np.int64)
            while len(todo):
                found = np.minimum(np.searchsorted(self.edge_keys, key[todo]), len(self.edge_keys) - 1)
                place[todo] = found
                todo = todo[self.edge_keys[found] != key[todo]]
                state[todo] = m.link[state[todo]]  # the empty stretch goes on with every byte
                matched[todo] = m.length[state[todo]]
                key[todo] = state[todo] << 8 | data[j - 1, todo]
            state, matched = m.targets[self.edges[place]].astype(np.int64), matched + 1
            t = m.near[state].astype(np.int64)
            beyond = m.length[t] > matched  # the state's longest stretch is a token, but more than was read
            t[beyond] = m.near[m.link[t[beyond]]]
            left = np.arange(n)
            while len(left):
                before, y = j - m.length[t], m.word[t]
                fine = before == 0
                inner = np.flatnonzero(~fine)
                fine[inner] = self.fits(last[before[inner], left[inner]].astype(np.int64), y[inner].astype(np.int64))
                last[j, left[fine]] = y[fine]
                left, t = left[~fine], m.near[m.link[t[~fine]]]
        return last

    @cached_property
    def _plain(self) -> tuple:
        m = self.automaton
        return dict(zip(m.keys.tolist(), m.targets.tolist(), strict=True)), *(x.tolist() for x in (m.link, m.length, m.near, m.word))

    def last_tokens_of_one(self, data: bytes) -> list[int]:
        """The same for a single long word, in time proportional to its length."""
        go, link, length, near, word = self._plain
        known: dict[int, bool] = {}
        last = [-1] * (len(data) + 1)
        state = matched = 0
        for j, c in enumerate(data, 1):
            to = go.get(state << 8 | c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = go.get(state << 8 | c)
            state = to
            matched += 1
            t = near[state]
            if length[t] > matched:
                t = near[link[t]]
            while True:
                x, y = last[j - length[t]], word[t]
                if x < 0:
                    break
                key = x << 20 | y
                if key not in known:
                    if len(known) >= PAIRS:
                        known.clear()
                    known[key] = self.fit(x, y)
                if known[key]:
                    break
                t = near[link[t]]
            last[j] = y
        return last

    def _learn(self, new: list[str]) -> None:
        """Put the ids of some words into the memory, following back-pointers from their ends."""
        coded = sorted(((w.encode("utf-8", "replace"), w) for w in new), key=lambda p: -len(p[0]))
        while coded and len(coded[0][0]) > LONGEST:
            data, word = coded.pop(0)
            last, at, ids = self.last_tokens_of_one(data), len(data), []
            while at:
                ids.append(last[at])
                at -= int(self.sizes[last[at]])
            self[word] = np.array(ids[::-1], "<u4").tobytes()
        for a in range(0, len(coded), AT_ONCE):
            some = coded[a : a + AT_ONCE]
            last = self.last_tokens([d for d, _ in some])
            at, who, found = np.array([len(d) for d, _ in some]), np.arange(len(some)), []
            while len(who):
                token = last[at, who]
                found.append((who, token))
                at = at - self.sizes[token]
                who, at = who[at > 0], at[at > 0]
            owner = np.concatenate([f[0] for f in found[::-1]])
            order = np.argsort(owner, kind="stable")
            ids = np.concatenate([f[1] for f in found[::-1]])[order].astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(owner, minlength=len(some)))).tolist()
            self.update(zip((w for _, w in some), map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time; special tokens are words of their own."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield [part]
                continue
            find = self.find_ascii if part.isascii() else self.find if max(part) < self.first_odd else self.find_odd
            if len(part) <= AT_ONCE:
                yield find.findall(part)
                continue
            words = (m.group() for m in find.finditer(part))
            while some := list(islice(words, AT_ONCE)):
                yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, 4 bytes each."""
        out = [bytearray() for _ in texts]
        rows: list[tuple[int, list[str]]] = []

        def flush() -> None:
            different = {w for _, words in rows for w in words}
            new = [w for w in different if w not in self]
            if len(self) + len(new) > REMEMBERED:
                self._forget()
                new = [w for w in different if w not in self]
            self._learn(new)
            for k, words in rows:
                out[k] += b"".join(map(self.__getitem__, words))
            for w in new:
                if len(w.encode()) > LONGEST:
                    del self[w]
            rows.clear()

        size = 0
        for k, text in enumerate(texts):
            for words in self._words(text):
                rows.append((k, words))
                size += len(words)
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        return list(map(bytes, out))

    def decode(self, packed: bytes) -> str:
        """The text of ids, 4 bytes each; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, "<u4")
        parts = (b"".join(map(self.shown.__getitem__, ids[k : k + AT_ONCE].tolist())) for k in range(0, len(ids), AT_ONCE))
        return b"".join(parts).decode("utf-8", "replace")


def automaton_of(v: Bytes) -> Automaton:
    """Of the tokens that merging makes; a token that it never makes ends no prefix."""
    made = {}
    for i, t in v.tokens.items():
        if merges([v.by_byte[b] for b in t], v.pairs)[0] == len(t) - 1 and (len(t) == 1 or v.born[i] >= 0):
            made[i] = t
    return Automaton(made)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", packed: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` (array of int, or with
    ``packed`` a binary of little-endian unsigned 32-bit numbers), ``n_tokens``
    and ``decoded``, the text that the ids give back.

    The ids are those of the tokenizers library for the whole text with the
    byte-level BPE file at ``path``, without added begin or end; strings of
    special tokens inside texts are these tokens, as is its default. The table and
    the automaton go to the tasks, whose size is that of the vocabulary.

    Null and empty texts give no ids and decode to an empty text. Null ids stay
    null, repeated rows give repeated rows, an empty table gives none; other
    columns are not read, whatever their names. A text of any length is read
    from end to end, words of it some ten thousand at a time; a word of any
    length takes time in proportion. Nothing is shuffled, nothing outlives a task.
    """
    vocabulary = load(path)
    automaton = automaton_of(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, automaton)
        for batch in portions(batches, "text", PORTION):
            made = encoder.encode(filled(batch.column("text")).to_pylist())
            n = np.array([len(m) // 4 for m in made], np.int64)
            ids = pa.array(made, pa.binary())
            if not packed:
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32)))
            decoded = pa.array(map(encoder.decode, made), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(n), decoded], ["id", "ids", "n_tokens", "decoded"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {kind}, ids {'binary' if packed else 'array<int>'}, n_tokens long, decoded string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode(coded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The id and ``text`` of rows of token ids, special tokens as their strings.
    Null arrays give null; ids outside the vocabulary, and null ones, raise."""
    vocabulary = load(path)
    shown = vocabulary.tokens | {i: t.encode() for t, i in vocabulary.special.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.column("ids").to_pylist():
                if row is not None and any(i not in shown for i in row):
                    raise ValueError("an id lies outside the vocabulary")
                texts.append(None if row is None else b"".join(map(shown.__getitem__, row)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = coded.select(id_column).schema[0].dataType.simpleString()
    narrow = coded.select(coded[id_column].alias("id"), coded[ids_column].alias("ids"))
    return narrow.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
