"""How the vocabularies of the sources of a language differ."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.storage import written
from kerbline.llm.text import portions

#: A term is a run of these in the UTF-8 of a text; only A-Z are lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Probabilities are whole numbers of so many parts; a count weighs so much more than it is, in all twice that.
PARTS, EXTRA = 1_000_000_000, 2
#: Different (lang, source, term) that a task adds up before it sends them on.
HELD = 500_000
#: A task holds occurrences and rows of a term in one number, rows in so many bits,
#: and sends them on after half as many rows as these can count.
_DOCS = 24
#: Counts (different rows of the vocabulary times sources) that one task compares, about.
CELLS = 1 << 21


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (rows that
    have it), added up within tasks only; and a row with a null term for each
    lang and source that a task has met."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = rows = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n, many = np.fromiter(terms.values(), np.int64, len(terms)), len(terms) + 1
                columns = [pa.array([lang] * many), pa.array([source] * many), pa.array([*terms, None], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.append(n >> _DOCS, 0)), pa.array(np.append(n & (1 << _DOCS) - 1, 0))], ["lang", "source", "term", "n", "docs"])

        for batch in portions(batches, "text", 1 << 20):
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                terms = held.setdefault((lang or "", source or ""), {})
                size -= len(terms)
                for term, n in Counter(_found(batch.column("text")[k].as_py() or "")).items():
                    terms[term] = terms.get(term, 0) + (n << _DOCS | 1)
                size, rows = size + len(terms), rows + 1
                if size >= HELD or rows >= 1 << _DOCS - 1:
                    yield from sent()
                    held.clear()
                    size = rows = 0
        yield from sent()

    narrow = docs.select(docs[text_column].alias("text"), docs[lang_column].alias("lang"), docs[source_column].alias("source"))
    return narrow.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _found(text: str) -> Iterable[bytes]:
    data = text.encode().lower()
    return _TERM.findall(data) if len(data) < 1 << 20 else (m.group() for m in _TERM.finditer(data))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, below: Column) -> Column:
    """1 + floor(PARTS * (count + EXTRA) / below), exact for counts of any length."""
    top = (count + EXTRA).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return _div(top, below.cast("decimal(28,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most PARTS + 1, so the square is a long."""
    return _div((p - q) * (p - q), p + q)


class Runs:
    """One source's shares along the vocabulary, as runs of equal ones."""

    def __init__(self, counts: np.ndarray, edges: np.ndarray, below: int):
        first = np.concatenate([[0], np.flatnonzero(counts[1:] != counts[:-1]) + 1])
        #: Where in the vocabulary each run starts, and its share.
        self.starts = edges[first]
        different, which = np.unique(counts[first], return_inverse=True)
        self.shares = np.array([1 + PARTS * (c + EXTRA) // below for c in different.tolist()], np.int64)[which]

    def apart(self, other: Runs, end: int) -> int:
        """The distances of all terms: run boundaries of both are put together,
        between two of which every term has the same distance."""
        starts = np.union1d(self.starts, other.starts)
        p = self.shares[np.searchsorted(self.starts, starts, "right") - 1]
        q = other.shares[np.searchsorted(other.starts, starts, "right") - 1]
        return int(((p - q) ** 2 // (p + q) * np.diff(starts, append=end)).sum())


def clustered(counts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vocabulary (terms times sources), each there so many ``times``,
    in an order in which equal counts stand together: sorted by the source with
    most terms, then by the next. And where each row starts, and the end."""
    by_use = np.argsort((counts > 0).sum(0), kind="stable")
    order = np.lexsort(counts[:, by_use].T)
    return counts[order], np.concatenate([[0], np.cumsum(times[order])])


def _block_pairs(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of distances over a block of the vocabulary, for every two sources."""
    names, below = sources.column("source").to_pylist(), sources.column("below").to_pylist()
    place = {s: k for k, s in enumerate(names)}
    out: list[tuple[str, str, int]] = []
    if rows.num_rows and len(names) > 1:
        cells = rows.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()))
        flat = cells.flatten()
        which = np.array([place[s] for s in flat.field("source").to_pylist()])
        counts = np.zeros((len(cells), len(names)), np.int64)
        counts[owner, which] = flat.field("n").to_numpy()
        counts, edges = clustered(counts, rows.column("times").to_numpy())
        runs = [Runs(counts[:, k], edges[:-1], b) for k, b in enumerate(below)]
        end = int(edges[-1])
        out = [(names[i], names[j], runs[i].apart(runs[j], end)) for i in range(len(names)) for j in range(i)]
    lang = sources.column("lang")[0].as_py() if sources.num_rows else None
    a, b, v = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})


def audit(
    docs: DataFrame, least_docs: int = 10, terms: int = 10,
    text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    A language keeps the terms that ``least_docs`` of its rows have. Every source
    of a language, and the language itself, gives each kept term a share; two
    shares p, q are floor((p - q)^2 / (p + q)) apart. Part ``pair``: a row for
    every other source of the language, with the sum over all kept terms. Part
    ``term``: the ``terms`` terms that tell most about the source, which it has
    and uses more than its language does, with the distance to the language.

    Counts are added up within tasks before they move. Terms with the same count
    in every source become one row with a number of times; blocks of these rows
    go to tasks of their own, whatever the language, and are sorted there so that
    equal counts stand together; each source's counts are run-length encoded, and
    two sources are compared run by run. The sums of the blocks are added.

    Null texts, languages and sources count as ''. A group without terms has its
    rows in part ``pair``; where a language keeps no term, all values are 0. Texts
    are read whole, whatever their length; repeated rows count as often as they
    come; an empty table gives none; other columns are not read. Rows come out for
    every ordered pair of sources of a language, so their number is the square of
    that of its sources.
    """
    some = term_counts(docs, text_column, lang_column, source_column)
    counts = written(some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = written(
        counts.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
        .where(F.col("docs") >= least_docs)
        .drop("docs"),
        "kept",
    )
    cells = kept.select("lang", "term", F.col("n").alias("all"), F.explode("cells").alias("cell")).select("lang", "term", "all", "cell.*")
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("all"))
    zero = F.lit(0).cast("long")
    met = counts.select("lang", "source").distinct()
    groups = met.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(
        groups.select(
            "lang", "source", F.coalesce("size", zero).alias("size"),
            (F.coalesce("n", zero) + EXTRA * F.coalesce("size", zero)).alias("below"),
            (F.coalesce("all", zero) + EXTRA * F.coalesce("size", zero)).alias("below_all"),
        ),
        "groups",
    )

    p, q = share(F.col("n"), F.col("below")), share(F.col("all"), F.col("below_all"))
    told = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    own = told.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    along = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = own.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= terms)

    sizes = groups.groupBy("lang").agg(F.ceil(F.max("size") * F.count("*") / CELLS).cast("int").alias("blocks")).where("blocks > 0")
    alike = kept.groupBy("lang", "cells").agg(F.count("*").alias("times"))
    dealt = alike.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("cells"), "blocks"))
    asked = groups.join(sizes, "lang").withColumn("block", F.explode(F.sequence(zero, F.col("blocks").cast("long") - 1)))
    parts = (
        dealt.select("lang", "block", "cells", "times").groupBy("lang", "block")
        .cogroup(asked.select("lang", "block", "source", "below").groupBy("lang", "block"))
        .applyInArrow(_block_pairs, "lang string, source string, item string, value long")
    )
    both = parts.unionByName(parts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    sums = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    full = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", zero))
    ranked = full.withColumn("rank", F.row_number().over(along))

    shown = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(shown).unionByName(best.withColumn("part", F.lit("term")).select(shown))
