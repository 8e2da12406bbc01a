"""Language identification with high-dimensional random letter vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.text import filled, portions

#: Dimensions of a vector, letters in an n-gram.
DIMENSIONS, LETTERS = 512, 3
#: Prototypes go to the driver and to all tasks; more languages than this raise.
MOST_LANGUAGES = 1_000
#: Bytes of text that are worked on together: it takes some hundred times that in memory.
PORTION = 1 << 20
#: Texts and n-grams that are multiplied at once.
_TEXTS, _GRAMS = 256, 16_384
UNKNOWN = "und"
#: Texts of fewer n-grams can't be told from noise by their score. The others
#: need this share of the median score of the labelled texts.
JUDGED, SHARE = 32, 0.2
#: Steps of a score that are counted to find the median.
_STEPS = 1_000

_alphabetic: np.ndarray | None = None
_letter_vectors: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    global _alphabetic
    if _alphabetic is None:
        _alphabetic = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _alphabetic


def _letter_vector(code: int) -> np.ndarray:
    """Random signs that every task computes alike; 0 is the border of a word."""
    if code not in _letter_vectors:
        bits = hashlib.shake_256(f"letter {code}".encode()).digest(DIMENSIONS // 8)
        _letter_vectors[code] = (np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int8) * 2 - 1)
    return _letter_vectors[code]


class Grams:
    """The n-grams of some texts: which there are, and how often in each text."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        joined = "\0".join(["", *(t.replace("\0", " ") for t in texts), ""]).lower()
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        text = np.cumsum(codes == 0) - 1
        solid = _letters()[codes]
        keep = solid.copy()
        keep[1:] |= solid[:-1]  # one border behind each word
        keep[0] = True
        codes, text = np.where(solid, codes, 0)[keep], text[keep]
        letters = np.flatnonzero(np.bincount(codes[codes > 0], minlength=1)) if len(codes) else codes
        number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        self.alphabet = np.concatenate([[0], letters]).astype(np.int64)
        base, size = number[codes], len(self.alphabet)
        a, b, c = base[:-2], base[1:-1], base[2:]
        # Borders belong to the letters around them; no n-gram spans two texts.
        left, right = np.where(a > 0, text[:-2], text[1:-1]), np.where(c > 0, text[2:], text[1:-1])
        fine = (left == right) & ((b > 0) | ((a > 0) & (c > 0)))
        gram = ((a * size + b) * size + c)[fine]
        self.text = np.where(b > 0, text[1:-1], text[:-2])[fine]
        if size**3 <= 1 << 22:
            there = np.bincount(gram, minlength=1) > 0
            self.grams = np.flatnonzero(there)
            place = np.cumsum(there) - 1
            self.gram = place[gram]
        else:
            self.grams, self.gram = np.unique(gram, return_inverse=True)

    def vectors(self, first: int, last: int) -> np.ndarray:
        """n-gram vectors: letters turned by their place and bound by products."""
        size = len(self.alphabet)
        g = self.grams[first:last]
        table = np.stack([_letter_vector(int(c)) for c in self.alphabet])
        turned = [np.roll(table, LETTERS - 1 - k, axis=1) for k in range(LETTERS)]
        return (turned[0][g // size**2] * turned[1][g // size % size] * turned[2][g % size]).astype(np.float32)

    def bundled(self, group: np.ndarray, n: int) -> np.ndarray:
        """Sums of the n-gram vectors of each group of texts (-1: of none)."""
        out = np.zeros((n, DIMENSIONS), np.float64)
        order = np.argsort(self.text, kind="stable")
        text, gram = self.text[order], self.gram[order]
        owner = group[text] if len(text) else text
        for a in range(0, len(self.grams), _GRAMS):
            b = min(len(self.grams), a + _GRAMS)
            made = self.vectors(a, b)
            inside = (gram >= a) & (gram < b) & (owner >= 0)
            own, which = owner[inside], gram[inside] - a
            for first in range(0, n, _TEXTS):
                last = min(n, first + _TEXTS)
                if n > _TEXTS:  # then groups are texts, in order
                    lo, hi = np.searchsorted(own, [first, last])
                else:
                    lo, hi = 0, len(own)
                counts = np.bincount((own[lo:hi] - first) * (b - a) + which[lo:hi], minlength=(last - first) * (b - a))
                out[first:last] += counts.reshape(last - first, b - a).astype(np.float32) @ made
        return out


def learn(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """A prototype per language: the sum of all its n-gram vectors over all rows.

    Tasks bundle what they read, two rounds of sums follow; the driver gets one
    vector per language. Rows with a null language teach nothing.
    """

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in portions(batches, "text", PORTION):
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            group = np.asarray(langs.indices.fill_null(-1), np.int64)
            made = Grams(filled(batch.column("text")).to_pylist()).bundled(group, len(names))
            for name, v in zip(names, made, strict=True):
                sums[name] = sums.get(name, 0) + v
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in frame["vector"])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "vector": [total.tobytes()]})

    rows = labelled.select(labelled[text_column].alias("text"), labelled[lang_column].alias("lang")).where(F.col("lang").isNotNull())
    parts = rows.mapInArrow(bundle, "lang string, vector binary").withColumn("part", F.spark_partition_id() % 64)
    some = parts.groupBy("lang", "part").applyInPandas(added, "lang string, vector binary")
    found = some.groupBy("lang").applyInPandas(added, "lang string, vector binary").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.frombuffer(bytes(r["vector"])) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text_column: str = "text", counted: bool = False) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (``counted``: and the text's
    number of n-grams, ``n_grams``): the language whose prototype
    has the largest cosine with the sum of the text's n-gram vectors, and that
    cosine (0 if it is negative). ``und`` with score 0 for texts that are null or
    have no letter, or if nothing was learned. Of equals the first by name wins.
    Whole texts count; nothing is shuffled.
    """
    names = list(prototypes)
    table = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1.0) for n in names]).reshape(len(names), DIMENSIONS)

    inside = keep.index(text_column) if text_column in keep else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if inside is not None:  # a text that is kept comes once
            batches = (b.append_column("text", b.column("row").flatten()[inside]) for b in batches)
        for batch in portions(batches, "text", PORTION):
            n = batch.num_rows
            grams = Grams(filled(batch.column("text")).to_pylist())
            made = grams.bundled(np.arange(n), n)
            norm = np.linalg.norm(made, axis=1)
            known = (norm > 0) & bool(names)
            cosine = made @ table.T / np.where(norm > 0, norm, 1.0)[:, None] if names else np.zeros((n, 1))
            best = cosine.argmax(1)
            lang = np.where(known, np.array([*names, UNKNOWN], object)[best], UNKNOWN)
            score = np.where(known, np.clip(cosine[np.arange(n), best], 0.0, 1.0), 0.0)
            count = pa.array(np.bincount(grams.text, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score), count], ["row", "lang_pred", "score", "n_grams"])

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), *([F.col(text_column).alias("text")] if inside is None else []))
    kind = whole.schema["row"].dataType.simpleString()
    return whole.mapInArrow(run, f"row {kind}, lang_pred string, score double, n_grams long").select("row.*", "lang_pred", "score", *(["n_grams"] if counted else []))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; null ids are neither held out nor learned from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents that are not held out and have a language, then
    predict all: ``keep`` (default doc_id), ``held_out``, ``lang_pred``, ``score``.

    Null ids are not held out and teach nothing. Repeated rows count as often as
    they come. An empty table gives none."""
    prototypes = learn(docs.where(~held_out()))
    kept = list(dict.fromkeys(keep or ["doc_id"]))
    done = predict(docs, prototypes, [*kept, *(["doc_id"] if "doc_id" not in kept else [])])
    return done.select(*kept, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def told(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the documents in which a learned language is told.

    What has no letter goes. Texts of ``JUDGED`` n-grams or more go if their
    score is below ``SHARE`` times the median score of such texts among those that
    teach, so that junk with a label does not set the bound for all junk; shorter
    ones stay. All stay if no language was learned.
    """
    taught = docs.where(~held_out() & F.col("lang").isNotNull())
    prototypes = learn(taught)
    if not prototypes:
        return docs.select(keep)
    judged = F.col("n_grams") >= JUDGED
    step = F.floor(F.col("score") * _STEPS)
    steps = predict(taught, prototypes, ["lang"], counted=True).where(judged).groupBy(step.alias("step")).count().collect()
    found = predict(docs, prototypes, keep, counted=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (~judged | (F.col("score") >= SHARE * _median(steps)))).select(keep)


def _median(steps: list) -> float:
    """The score at which half of the texts are counted, 0 without any."""
    half, seen = sum(r["count"] for r in steps) / 2, 0
    for r in sorted(steps, key=lambda r: r["step"]):
        seen += r["count"]
        if seen >= half:
            return r["step"] / _STEPS
    return 0.0
