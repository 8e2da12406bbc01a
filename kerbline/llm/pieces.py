"""Encoding and decoding with a sentencepiece BPE model by suffix-array matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.llm.text import filled, portions
from kerbline.llm.vocabulary import BLANK, Vocabulary, load, merges, units

#: Bytes of text that are worked on together.
PORTION = 1 << 20
#: Encodings of so many different stretches are remembered in a task; then it starts afresh.
REMEMBERED = 400_000


class Lattice:
    """The vocabulary as arrays: how pieces are made, and which may be neighbours."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        size = len(v.pieces)
        rank, ids = v.rank, v.ids
        #: When a piece comes into being; single characters are there from the start.
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.usable = []
        for piece, number in rank.items():
            i = ids[piece]
            if len(piece) == 1:
                self.usable.append(piece)
                continue
            if not piece.strip(BLANK):
                continue  # runs of blanks merge when all else has: see Encoder
            count, last = merges([ids[c] for c in piece], v.pairs)
            if count != len(piece) - 1:
                continue  # merging never forms it
            b = v.pieces[last]
            a = piece[: -len(b)]
            if max(len(a) > 1 and rank[a], len(b) > 1 and rank[b]) > number:
                raise ValueError(f"{piece!r} has a part that is ranked behind it")
            self.born[i], self.left[i], self.right[i] = number, ids[a], ids[b]
            self.usable.append(piece)
        self.usable.sort()
        self.usable_ids = np.array([ids[p] for p in self.usable])
        self.lengths = np.array([len(p) for p in self.usable])
        self.pairs = np.array(sorted(v.pairs), np.int64)
        self.pair_rank = np.array([v.pairs[k] >> 20 for k in self.pairs.tolist()], np.int64)
        self.size = size

    def neighbours(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces x and y gives just x and y.

        Time runs backwards: the younger of the two symbols at the border is
        taken apart, and the pair at the border must never have been due before
        the merges that built x and y. Of equal ranks the left one goes first.
        """
        fine = np.ones(len(x), bool)
        at = np.arange(len(x))
        end = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(x), end), np.full(len(x), end)
        while len(at):
            key = x << 20 | y
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            due = np.where(self.pairs[found] == key, self.pair_rank[found], end)
            wrong = (due < until_x) & (due <= until_y) & (due < end)
            fine[at[wrong]] = False
            bx, by = self.born[x], self.born[y]
            go = ~wrong & ((bx >= 0) | (by >= 0))
            at, x, y, until_x, until_y, bx, by = (z[go] for z in (at, x, y, until_x, until_y, bx, by))
            undo_x = bx > by
            x, until_x = np.where(undo_x, self.right[x], x), np.where(undo_x, bx, until_x)
            y, until_y = np.where(undo_x, y, self.left[y]), np.where(undo_x, until_y, by)
        return fine

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of stretches of known characters, end to end, and how many each has."""
        lens = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lens + 1)])  # a separator after each
        joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
        unit = np.repeat(np.arange(len(texts)), lens + 1)
        position, piece, length = self._edges(joined)
        offset = position - starts[unit[position]] + length  # where an edge ends in its stretch
        order = np.argsort(offset.astype(np.uint16) if lens.max() < 65536 else offset, kind="stable")
        position, piece, length, offset = position[order], piece[order], length[order], offset[order]
        last = np.full(len(joined) + 1, -1, np.int64)  # by the place behind a piece: the piece
        width = np.zeros(len(joined) + 1, np.int64)
        cuts = np.searchsorted(offset, np.arange(1, lens.max(initial=0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, t, n = position[a:b], piece[a:b], length[a:b]
            first = offset[a:b] == n
            ok = first.copy()
            inner = np.flatnonzero(~first & (last[p] >= 0))
            ok[inner] = self.neighbours(last[p[inner]], t[inner])
            last[p[ok] + n[ok]], width[p[ok] + n[ok]] = t[ok], n[ok]
        # Walk back from the ends, all stretches side by side.
        found, place, who = [], starts[:-1] + lens, np.arange(len(texts))
        while len(who):
            go = place > starts[who]
            place, who = place[go], who[go]
            if not width[place].all():
                raise AssertionError("no path reaches the end of a stretch")
            found.append((who, last[place]))
            place = place - width[place]
        who = np.concatenate([f[0] for f in found[::-1]])
        ids = np.concatenate([f[1] for f in found[::-1]])
        order = np.argsort(who, kind="stable")
        return ids[order], np.bincount(who, minlength=len(texts))

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece: a suffix array of the text, as deep
        as the longest piece, in which each piece's range is found by bisection."""
        letters = np.unique(text)
        letters = letters[letters != 0]
        code = np.zeros(int(letters[-1]) + 1, np.uint64)  # 0 is the separator
        code[letters] = np.arange(1, len(letters) + 1)
        bits = int(len(letters) + 1).bit_length()
        per_key = 64 // bits
        depth = -(-int(self.lengths.max()) // per_key) * per_key
        kind = f"S{depth // per_key * 8}"

        def keyed(rows: list[np.ndarray]) -> list[np.ndarray]:
            """Columns of letters, packed into 64-bit numbers in order."""
            keys = []
            for k in range(0, depth, per_key):
                key = rows[k].copy()
                for row in rows[k + 1 : k + per_key]:
                    key = (key << np.uint64(bits)) | row
                keys.append(key)
            return keys

        def bytewise(keys: list[np.ndarray]) -> np.ndarray:
            return np.stack(keys, 1).astype(">u8").view(kind).ravel()

        n = len(text)
        padded = np.concatenate([code[text], np.zeros(depth, np.uint64)])
        keys = keyed([padded[j : n + j] for j in range(depth)])
        suffixes = np.lexsort(keys[::-1])
        suffixes = suffixes[text[suffixes] != 0]
        table = bytewise([k[suffixes] for k in keys])
        alphabet = set(map(chr, letters.tolist()))
        present = np.array([k for k, p in enumerate(self.usable) if alphabet.issuperset(p)], np.int64)
        wanted = self.lengths[present]
        spelled = np.zeros((len(present), depth), np.uint64)
        flat = np.frombuffer("".join([self.usable[k] for k in present]).encode("utf-32-le"), "<u4")
        inside = np.arange(depth)[None, :] < wanted[:, None]
        spelled[inside] = code[flat]
        low = np.searchsorted(table, bytewise(keyed(list(spelled.T))), "left")
        spelled[~inside] = (1 << bits) - 1
        high = np.searchsorted(table, bytewise(keyed(list(spelled.T))), "right")
        counts = high - low
        which = np.repeat(np.arange(len(present)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return suffixes[low[which] + within], self.usable_ids[present][which], wanted[which]


class Encoder:
    """Texts to ids and back, remembering the stretches that it has met."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.vocabulary = lattice, lattice.vocabulary
        v = self.vocabulary
        shown = [p.replace(BLANK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            shown[i] = bytes([b])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(s) for s in shown])
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        known = self.vocabulary.alphabet
        simple, runs, odd, parts = [], [], [], []
        for u in new:
            run = BLANK + u[1:] if u[0] == " " else u
            if " " not in run and known.issuperset(run):
                simple.append(u)
                runs.append(run)
            else:
                odd.append(u)
        for u in odd:
            parts.append(self._parts(u, runs))
        ids, counts = self.lattice.encode(runs) if runs else (self.ids[:0], self.counts[:0])
        at = np.concatenate([[0], np.cumsum(counts)]).tolist()
        plain = at[len(simple)]
        rest = [self._joined(row, blanks, ids, at) for row, blanks in parts]
        base = len(self.index)
        self.index.update(zip([*simple, *odd], range(base, base + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids[:plain], np.array([i for row in rest for i in row], np.int64)]).astype(np.int32)
        self.counts = np.concatenate([self.counts, counts[: len(simple)], [len(row) for row in rest]]).astype(np.int64)

    def _parts(self, unit: str, runs: list[str]) -> tuple[list, int]:
        """A stretch with unknown characters or several blanks in front, as
        numbers of runs of known ones, which this adds, and bytes of others;
        and the number of blanks before the last."""
        body = unit.lstrip(" ")
        blanks = len(unit) - len(body)
        row: list = []
        run = BLANK if body and blanks else ""
        for c in body:
            if c in self.vocabulary.alphabet:
                run += c
                continue
            if run:
                row.append(len(runs))
                runs.append(run)
            row.append(c.encode())
            run = ""
        if run:
            row.append(len(runs))
            runs.append(run)
        return row, blanks - (bool(body) and blanks > 0)

    def _joined(self, row: list, blanks: int, coded: np.ndarray, at: list[int]) -> list[int]:
        v = self.vocabulary
        ids = [i for x in row for i in (coded[at[x] : at[x + 1]].tolist() if isinstance(x, int) else [v.byte_ids[b] for b in x])]
        if blanks:  # they merge among themselves, behind all other pieces in rank
            alone = bool(ids) and ids[0] == v.ids[BLANK]
            symbols = [v.ids[BLANK]] * (blanks + alone)
            merges(symbols, v.pairs)
            ids[:alone] = [i for i in symbols if i >= 0]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and how many belong to each text."""
        cut = [units(t) for t in texts]
        different = {u for row in cut for u in row}
        if len(self.index) + len(different) > REMEMBERED:
            self._clear()
        new = [u for u in different if u not in self.index]
        if new:
            self._learn(new)
        per_text = np.array([len(row) for row in cut])
        index = self.index
        which = np.fromiter((index[u] for row in cut for u in row), np.int64, per_text.sum())
        n = self.counts[which]
        ids = self.ids[_spread((np.cumsum(self.counts) - self.counts)[which], n)] if len(which) else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces end to end, less the blank put in front."""
        size = self.shown_len[ids]
        data = self.shown[_spread(self.shown_at[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        return [_plain(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _plain(data: bytes) -> bytes:
    data = data[1:] if data[:1] == b" " else data
    try:
        data.decode()
    except UnicodeDecodeError:  # ids that were not made from a text
        return data.decode(errors="replace").encode()
    return data


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, end to end."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` (array of int), ``n_tokens``
    and ``decoded``, the text that the ids give back.

    The ids are those of the sentencepiece library for the whole text with the
    BPE model at ``model_path``, without begin or end. In each task the
    different stretches of a portion are laid end to end and indexed by a suffix
    array; every piece finds its occurrences there by bisection; these edges
    are sorted by position and relaxed from left to right. An edge holds if
    merging the last piece before it and its own piece gives just these two: by
    this rule exactly one path reaches each position, the one of BPE merging.

    Null and empty texts give no ids and decode to an empty text. Null ids stay
    null, repeated rows give repeated rows, an empty table gives none; other
    columns are not read. Nothing is shuffled, and nothing outlives a task.
    """
    lattice = Lattice(load(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lattice)
        for batch in portions(batches, "text", PORTION):
            ids, n = encoder.encode(filled(batch.column("text")).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(n.astype(np.int32)), pa.array(encoder.decode(ids, n), pa.binary()).cast(pa.string())],
                ["id", "ids", "n_tokens", "decoded"],
            )

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    narrow = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens int, decoded string").withColumnRenamed("id", id_column)


def decode(coded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The id and ``text`` of rows of piece ids. Control pieces show nothing,
    null arrays give null; ids outside the vocabulary raise."""
    lattice = Lattice(load(model_path))
    silent = [i for i, p in enumerate(lattice.vocabulary.pieces) if p not in lattice.vocabulary.rank and i not in lattice.vocabulary.byte_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lattice)
        encoder.shown_len[silent] = 0
        for batch in batches:
            rows = [None if r is None else np.asarray(r, np.int64) for r in batch.column("ids").to_pylist()]
            if any(len(r) and (r.min() < 0 or r.max() >= lattice.size) for r in rows if r is not None):
                raise ValueError("an id lies outside the vocabulary")
            full = [np.zeros(0, np.int64) if r is None else r for r in rows]
            shown = encoder.decode(np.concatenate([*full, np.zeros(0, np.int64)]), np.array([len(r) for r in full]))
            texts = pa.array([None if r is None else s for r, s in zip(rows, shown, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], ["id", "text"])

    kind = coded.select(id_column).schema[0].dataType.simpleString()
    narrow = coded.select(coded[id_column].alias("id"), coded[ids_column].alias("ids"))
    return narrow.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
