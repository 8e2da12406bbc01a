"""A BPE vocabulary file of the sentencepiece library as a plain table.

The driver reads the file at the path it is given and ships the table with the
tasks; its size is that of the vocabulary, whatever the data.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

#: The mark that stands for a blank, and how the library cuts nothing but blanks off.
BLANK = "▁"


def _ranges(codes: list[int]) -> str:
    """A character class of ascending code points."""
    cuts = [i for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    return "".join(f"\\U{codes[i]:08x}-\\U{codes[j - 1]:08x}" for i, j in zip(cuts, [*cuts[1:], len(codes)], strict=True))


_LETTERS = _ranges([c for c in range(0x10000) if chr(c) != BLANK and unicodedata.category(chr(c))[0] in "LM"])
_UNIT = re.compile(rf" *[{_LETTERS}]+| *[^{_LETTERS}0-9 \n]+|\n| *[0-9]+| +")
_LETTER = re.compile(rf"[{_LETTERS}]")


@dataclass
class Vocabulary:
    pieces: list[str]
    rank: dict[str, int]  # of pieces that merges may form or find; the lowest goes first
    ids: dict[str, int]
    byte_ids: list[int]
    #: By the ids of two pieces: the rank of their merge and the piece that it makes, 20 bits each.
    pairs: dict[int, int]
    alphabet: frozenset[str] = field(default_factory=frozenset)


def load(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback that leaves texts as they are but for blanks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" a  b\t Ａ ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}b\t Ａ{BLANK}":
        raise ValueError(f"{path}: only models that change nothing but blanks are read")
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(model.is_unused(i) for i in plain) or any(re.search(f"[^{BLANK}]{BLANK}", pieces[i]) for i in plain):
        raise ValueError(f"{path}: pieces must be in use and hold blanks only in front")
    order = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
    rank = {pieces[i]: order[model.get_score(i)] for i in plain}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    blanks = [p for p in rank if not p.strip(BLANK)]
    if BLANK not in rank or any(rank[p] != len(order) - 1 for p in blanks) or len(rank) - len(blanks) != len(order) - 1:
        raise ValueError(f"{path}: pieces must have distinct scores, but for runs of blanks, which come last")
    if model.unk_id() in byte_ids:
        raise ValueError(f"{path}: there must be a fallback for every byte")
    alphabet = frozenset("".join(rank))
    if any(c not in rank for c in alphabet):
        raise ValueError(f"{path}: every character of a piece must be a piece")
    if any(_kind(a) != _kind(b) for p in rank for a, b in zip(p, p[1:], strict=False) if a != BLANK):
        raise ValueError(f"{path}: a piece may hold letters, digits or other characters, but no two kinds")
    ids = {pieces[i]: i for i in plain}
    made = {ids[p[:k]] << 20 | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
    return Vocabulary(pieces, rank, ids, byte_ids, {k: rank[pieces[i]] << 20 | i for k, i in made.items()}, alphabet)


def _kind(c: str) -> int:
    return 0 if c == "\n" else 1 if c in "0123456789" else 2 if _LETTER.match(c) else 3


def units(text: str) -> list[str]:
    """Stretches between which no merge is possible: letters, digits or
    other characters, with the blanks before them. One blank is put in front of the text, as the library does, to which
    the mark itself is a blank as well."""
    return _UNIT.findall(" " + text.replace(BLANK, " ")) if text else []


def merges(symbols: list[int], pairs: dict[int, int]) -> tuple[int, int]:
    """Byte-pair merging with a heap and a linked list, in place: the adjacent
    pair with the lowest rank merges first, the leftmost of equals. A symbol that has merged into the
    one before it becomes -1. Gives the number of merges, and the right one of
    the last two symbols that merged."""
    n, count, last = len(symbols), 0, -1
    get = pairs.get
    due = [get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # by left symbol
    heap = [d << 32 | i for i, d in enumerate(due) if d >= 0]
    if not heap:
        return 0, last
    heapify(heap)
    after, before = [*range(1, n + 1)], [*range(-1, n)]
    while heap:
        key = heappop(heap)
        i = key & 0xFFFFFFFF
        if due[i] != key >> 32:
            continue  # one of the two has merged meanwhile
        j = after[i]
        last = symbols[j]
        new = symbols[i] = key >> 32 & 0xFFFFF
        symbols[j] = -1
        count += 1
        after[i] = k = after[j]
        before[k] = i
        if k < n:
            due[j] = -1
            due[i] = d = get(new << 20 | symbols[k], -1)
            if d >= 0:
                heappush(heap, d << 32 | i)
        else:
            due[i] = -1
            if j < n - 1:
                due[j] = -1
        h = before[i]
        if h >= 0:
            due[h] = d = get(symbols[h] << 20 | new, -1)
            if d >= 0:
                heappush(heap, d << 32 | h)
    return count, last
