"""Removal of byte strings that stand earlier in the corpus, by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.bitmap import is_marked, marked
from kerbline.llm.groups import whole_groups
from kerbline.llm.packed import ROWS, column, packed, split
from kerbline.llm.storage import written
from kerbline.llm.text import _power_tables, filled, mixed, portions, running, span_hash, utf8

LENGTH = 100
#: Documents of a bucket, and bytes of stretches that are indexed at once.
DOCS, INDEXED = 2_048, 1 << 19
#: Bytes of text in which stretches are looked for at once: what the caches hold.
SCANNED = 1 << 18
_LAST = np.iinfo(np.int64).max


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes of a text in order, by two-stage sorting. 0 separates
    stretches; nothing behind a separator is compared, equal ones keep their order.

    Only suffixes smaller than their successors are sorted as strings. A scan
    over the first-letter buckets in ascending order then induces the rest: a
    suffix that is larger than its successor follows it, among those of its
    letter, in the order of the successors.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than the successor: by the next different letter.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1 if text[-1] == 0 else -1
    given = np.where(step != 0, np.arange(n), n)
    given = np.minimum.accumulate(given[::-1])[::-1]
    smaller = (step[np.minimum(given, n - 1)] > 0) | (text == 0)
    direct = np.flatnonzero(smaller)
    keys = eight(text)
    direct = direct[np.argsort(keys[direct], kind="stable")]
    # Where the first eight bytes are equal and hold no separator, compare on.
    k = keys[direct]
    same = np.zeros(len(direct) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & ~_has_zero(k[1:])
    begins, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
    if len(begins):
        whole = text.tobytes().decode("latin-1")
        zeros = np.append(np.flatnonzero(text == 0), n)
        inside = np.flatnonzero(same[:-1] | same[1:])
        end = np.zeros(len(direct), np.int64)
        end[inside] = zeros[np.searchsorted(zeros, direct[inside])]
        order, until = direct.tolist(), end.tolist()
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            rows = sorted([(whole[i + 8 : e], i) for i, e in zip(order[a:b], until[a:b], strict=True)])
            order[a:b] = [i for _, i in rows]
        direct = np.array(order, np.int64)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    led: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        larger = led[c]
        now = np.concatenate(larger) if larger else direct[:0]
        if c and len(now):
            while True:  # a run of one letter, a letter longer each time
                now = now[now > 0] - 1
                now = now[text[now] == c]
                if not len(now):
                    break
                larger.append(now)
        bucket = np.concatenate([*larger, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        letter = text[before]
        up = letter > c
        before, letter = before[up], letter[up]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        cuts = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else []:
            led[text[part[0]]].append(part)
    return np.concatenate(out)


def eight(text: np.ndarray) -> np.ndarray:
    """The next eight bytes of each place as a number; zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _has_zero(x: np.ndarray) -> np.ndarray:
    low, high = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    return ((x - low) & ~x & high) != 0


def common(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with the one before it in order."""
    keys = np.concatenate([eight(text), np.zeros(length, np.uint64)])
    alive = np.arange(1, len(order))
    for at in [*range(0, length - 7, 8), length - 8]:
        alive = alive[keys[order[alive] + at] == keys[order[alive - 1] + at]]
    out = np.zeros(len(order), bool)
    out[alive] = True
    return out


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every place where ``length`` bytes of one text start, by the half as long
    stretch with the least hash among those inside: its hash, first and last
    such place, and text. Equal strings have equal stretches in equal places."""
    n, gram = len(data), length // 2
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    sums = running(data)
    h = mixed((sums[gram:] - sums[:-gram]) * _power_tables(n + 1)[1][: n - gram + 1])
    bits = np.uint64(max(23, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    window, width = length - gram + 1, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        rest = window - width
        least = np.minimum(least[:-rest], least[rest:])
    fine = np.ones(n - length + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        fine[max(a, b - length + 1) : b] = False
    where = (least & low).astype(np.int64)
    begin = fine.copy()
    begin[1:] &= ~fine[:-1] | (where[1:] != where[:-1])
    end = fine.copy()
    end[:-1] &= ~fine[1:] | (where[1:] != where[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    return h[where[first]], first, last, np.searchsorted(at, first, "right") - 1


def repeated(data: np.ndarray, at: np.ndarray, of: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuttings stand at places: cutting ``of`` at byte ``start`` of document
    ``doc``. Which place, and from and to which byte of its cutting, is covered by
    strings of ``length`` bytes that stand at an earlier place (doc, then start)."""
    # Equal cuttings are indexed once, at their earliest place; later ones are covered.
    mark = span_hash(running(data), at[:-1], at[1:])[of]
    sizes, begins = np.diff(at)[of], at[of]
    order = np.lexsort([start, doc, sizes, mark])
    new = np.ones(len(order), bool)
    o = order
    new[1:] = (mark[o][1:] != mark[o][:-1]) | (sizes[o][1:] != sizes[o][:-1])
    head = o[new][np.cumsum(new) - 1]
    later = (doc[o] != doc[head]) | (start[o] != start[head])
    copies, heads = o[~new & later], np.sort(o[new])
    part = np.repeat(np.arange(len(heads)), sizes[heads] + 1)
    place = np.arange(len(part)) - np.repeat(np.cumsum(sizes[heads] + 1) - sizes[heads] - 1, sizes[heads] + 1)
    inner = place < sizes[heads][part]
    text = np.zeros(len(part), np.uint8)
    text[inner] = data[begins[heads][part[inner]] + place[inner]]
    suffixes = suffix_array(text)
    suffixes = suffixes[place[suffixes] + length <= sizes[heads][part[suffixes]]]
    shared = common(text, suffixes, length)
    group = np.cumsum(~shared) - 1
    size = np.bincount(group) if len(group) else group
    some = size[group] > 1 if len(group) else shared
    suffixes, group = suffixes[some], group[some]
    of, within = heads[part[suffixes]], place[suffixes]
    d, s = doc[of], start[of] + within
    order = np.lexsort([s, d, group])
    group, of, within, d, s = group[order], of[order], within[order], d[order], s[order]
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(lead) else lead
    covered = (d != d[head]) | (s != s[head]) if len(lead) else lead
    of, within = of[covered], within[covered]
    order = np.lexsort([within, of])
    of, within = of[order], within[order]
    begin = np.ones(len(of), bool)
    begin[1:] = (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1)
    end = np.append(begin[1:], True) if len(of) else begin
    return (
        np.concatenate([copies, of[begin]]),
        np.concatenate([np.zeros(len(copies), np.int64), within[begin]]),
        np.concatenate([sizes[copies], within[end] + length]),
    )


#: Where a cutting stands.
_PLACE = np.dtype([("cutting", "<u4"), ("doc", "<i8"), ("byte", "<u4")])


def _numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (cutting, document, byte) of all messages, cuttings numbered through."""
    base = np.cumsum([0, *(len(x or b"") // 4 for x in table.column("b").to_pylist())])
    rows = [np.frombuffer(x or b"", _PLACE) for x in table.column("c").to_pylist()]
    cutting = np.concatenate([np.zeros(0, np.int64), *(r["cutting"] + b for r, b in zip(rows, base, strict=False))])
    all_ = np.concatenate([np.zeros(0, _PLACE), *rows])
    return cutting.astype(np.int64), all_["doc"].astype(np.int64), all_["byte"].astype(np.int64)


def _slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)]


def without_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans``
    and ``kept`` (binary): the text's UTF-8 without each byte that lies in a string
    of ``length`` bytes that also starts earlier, in a document with a smaller id
    or in the same one. Strings overlap, never cross documents, and are judged on
    the texts as they come. A removed byte may split a character, so ``kept`` is
    bytes. Null is an empty text. Null ids come last, in no order: such documents
    lose what others or earlier places in all of them have. Rows that share an id
    are the same document at the same places: repeated rows don't remove each
    other. An empty table gives none.

    Equal strings contain the same stretch of least hash, so a string can only
    be repeated if its stretch is. (1) Tasks send the hashes of their stretches
    to buckets, each once per document bucket. (2) Buckets return those that
    come more than once. (3) Documents cut out what surrounds these stretches,
    equal cuttings of a task only once, and send them to buckets by hash.
    (4) There a suffix array over the cuttings puts equal strings next to each
    other; adjacent common prefixes of ``length`` bytes make groups, in which the
    earliest place stays. (5) Byte ranges go back to the documents.
    """
    id_kind = docs.select(id_column).schema[0].dataType.simpleString()
    buckets = max(1, -(-docs.count() // DOCS))
    bucket = F.pmod(F.xxhash64(id_column, F.xxhash64(text_column)), F.lit(buckets))
    narrow = docs.select(bucket.alias("bucket"), docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))

    # Of a hash, one half names the bucket and the other half goes there: chance
    # hits between some 300,000 of a bucket only bring a few more cuttings.
    small = np.uint8 if buckets <= 1 << 8 else np.uint16 if buckets <= 1 << 16 else np.uint32

    def number(h: np.ndarray) -> np.ndarray:
        return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)

    def key(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)).astype(np.uint32)

    def announce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", SCANNED):
            h, _, _, text = anchors(*utf8(batch.column("text")), length)
            own = np.asarray(batch.column("bucket"), np.int64)[text]
            order = np.lexsort([own, h])
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
            yield packed((n, [k, o, np.packbits(m)]) for n, (k, o, m) in split(number(h[new]), [key(h[new]), own[new].astype(small), many]))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket"]):
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(a, b - a)
                h, own = column(part, "a", np.uint32), column(part, "b", small).astype(np.int64)
                counts = [len(x) // 4 for x in part.column("a").to_pylist()]
                many = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=n).astype(bool) for c, n in zip(part.column("c").to_pylist(), counts, strict=True)])
                order = np.lexsort([own, h])
                h, own, many = h[order], own[order], many[order]
                group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1 if len(h) else own
                times = np.bincount(group, weights=1 + many) if len(h) else own
                some = times[group] > 1 if len(h) else many
                h, own = h[some], own[some]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                here = np.array([part.column("bucket")[0].as_py()])
                yield packed((n, [k, here]) for n, (k,) in split(own[new], [h[new]]))

    def by_bucket(rows: DataFrame, *then: str) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", *then)

    met = by_bucket(narrow.select("bucket", "text").mapInArrow(announce, ROWS)).mapInArrow(meet, ROWS)

    def beside(messages: DataFrame) -> DataFrame:
        """Documents of a bucket behind the messages to it."""
        mail = messages.select("bucket", F.lit(None).cast(id_kind).alias("id"), F.lit(None).cast("string").alias("text"), "a", "b", "c")
        empty = F.lit(None).cast("binary")
        return by_bucket(mail.unionByName(narrow.select("bucket", "id", "text", empty.alias("a"), empty.alias("b"), empty.alias("c"))), "a", "id")

    def places(ids: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(ids.cast(pa.int64()).fill_null(_LAST).combine_chunks(), np.int64)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket"]):
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(a, b - a)
                mail = part.filter(part.column("a").is_valid())
                known = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(k, np.uint32).astype(np.int64) | np.frombuffer(n, np.int64) << 32 for k, n in zip(mail.column("a").to_pylist(), mail.column("b").to_pylist(), strict=True))]))
                rows = part.filter(part.column("text").is_valid())
                if not len(known):
                    continue
                for batch in portions(rows.combine_chunks().to_batches(), "text", SCANNED):
                    data, at = utf8(batch.column("text"))
                    h, first, last, text = anchors(data, at, length)
                    wanted = key(h).astype(np.int64) | number(h) << 32
                    found = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
                    h, first, last, text = h[found], first[found], last[found], text[found]
                    size = last - first + length
                    mark = span_hash(running(data), first, last + length)
                    _, lead, of = np.unique(np.stack([mark, h], 1), axis=0, return_index=True, return_inverse=True)
                    doc = places(pa.chunked_array([batch.column("id")]))[text]
                    at_doc = first - at[text]
                    own = {n: c for n, c in split(number(h[lead]), [lead])}
                    message = []
                    for n, (o, d, p) in split(number(h), [of, doc, at_doc]):
                        rows_of = own[n][0]
                        cutting = np.unique(o, return_inverse=True)[1]
                        rows_of = rows_of[np.argsort(of[rows_of], kind="stable")]
                        stand = np.empty(len(d), _PLACE)
                        stand["cutting"], stand["doc"], stand["byte"] = cutting, d, p
                        message.append((n, [_slices(data, first[rows_of], size[rows_of]), size[rows_of].astype(np.uint32), stand, key(h[rows_of])]))
                    yield packed(message)

    cuttings = by_bucket(beside(met).mapInArrow(cut, ROWS))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket"]):
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                part = table.slice(a, b - a)
                data, size, h = column(part, "a", np.uint8), column(part, "b", np.uint32).astype(np.int64), column(part, "d", np.uint32)
                of, doc, start = _numbered(part)
                order = np.argsort(h, kind="stable")
                turned = np.empty(len(order), np.int64)
                turned[order] = np.arange(len(order))
                begin, h, size = (np.cumsum(size) - size)[order], h[order], size[order]
                by_cutting = np.argsort(turned[of], kind="stable")
                of, doc, start = turned[of][by_cutting], doc[by_cutting], start[by_cutting]
                total = np.cumsum(size)
                # Cuttings of one hash stay together; others are indexed in several arrays.
                edges = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)) if len(h) else np.zeros(1, np.int64)
                lo = 0
                while lo < len(edges) - 1:
                    base = total[edges[lo]] - size[edges[lo]]
                    hi = max(lo + 1, int(np.searchsorted(total[edges[1:] - 1], base + INDEXED, "right")))
                    x, y = edges[lo], edges[hi]
                    at = np.concatenate([[0], np.cumsum(size[x:y])])
                    here = slice(*np.searchsorted(of, [x, y]))
                    d, s = doc[here], start[here]
                    which, left, right = repeated(_slices(data, begin[x:y], size[x:y]), at, of[here] - x, d, s, length)
                    yield pa.RecordBatch.from_arrays([pa.array(d[which]), pa.array(s[which] + left), pa.array(s[which] + right)], ["doc", "left", "right"])
                    lo = hi

    ranges = written(cuttings.mapInArrow(search, "doc long, left long, right long"), "ranges")
    return _finished(narrow, ranges, id_column, id_kind)


def _finished(narrow: DataFrame, ranges: DataFrame, id_column: str, id_kind: str) -> DataFrame:
    by_doc = written(ranges.groupBy("doc").agg(F.collect_list(F.struct("left", "right")).alias("ranges")), "by-document")
    # Documents that lose nothing stay in their tasks.
    keyed = narrow.select("id", "text", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)).alias("key"))
    touched = keyed.withColumn("touched", is_marked(marked(by_doc.select("doc")), F.col("key")))
    whole = touched.where("not touched").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    both = touched.where("touched").join(by_doc, F.col("key") == F.col("doc"), "left")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            texts = filled(batch.column("text")).cast(pa.large_binary()).to_pylist()
            rows = []
            for text, spans in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                if not spans:
                    rows.append((len(text), 0, 0, text))
                    continue
                edge = np.zeros(max(len(text), max(s["right"] for s in spans)) + 1, np.int64)
                np.add.at(edge, [s["left"] for s in spans], 1)
                np.add.at(edge, [s["right"] for s in spans], -1)
                gone = np.cumsum(edge)[: len(text)] > 0
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), n_spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = both.select("id", "text", "ranges").mapInArrow(remove, f"id {id_kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.unionByName(whole).withColumnRenamed("id", id_column)


def digests(docs: DataFrame, **how) -> DataFrame:
    """``without_repeats`` with the SHA-256 of what is kept instead of the bytes."""
    done = without_repeats(docs, **how)
    return done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
