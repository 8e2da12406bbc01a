"""Named queries over whole tables, and independent SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import archive, byte_pairs, divergence, importance, language, lines, mixing, ngram_join, phrases, pieces, suffixes, token_counts, topk
from kerbline.llm.storage import shared_folder, shipped

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they give its text back."""
    docs = _table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, public_tokenizers.path(MODEL))
    return coded.select("doc_id", "ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return phrases.compared(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document: five-word shingles, similarity 0.8 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per page, read the archive back, and weigh what came back."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    archive.write_archive(_table(spark, sf_dir, "pages"), path)
    return archive.weighed(archive.read_archive(spark, path))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every 50th, on whole-numbered components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    vectors = _table(spark, sf_dir, "embeddings").where(finite).select(F.col("vec_id").alias("id"), whole.alias("vector"))
    found = topk.exact_top_k(vectors, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that stand earlier."""
    return suffixes.digests(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four folds of five."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier one resembles."""
    done = lines.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the sources of each language are, and the terms that tell them."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by likeness to the benchmark."""
    drawn = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they give back, as digests."""
    coded = byte_pairs.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), packed=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_fingerprints,
        op3_token_counts,
        op4_ngram_jaccard,
        op5_mixing,
        op6_warc,
        op7_exact_top_k,
        op8_suffix_dedup,
        op9_language_id,
        op10_line_dedup,
        op11_source_divergence,
        op12_importance,
        op13_byte_bpe,
    )
}

ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
        v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
        l AS (SELECT lang, count(*) AS size, sum(n) AS n FROM v GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        x AS (
            SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.size) AS p,
                   1 + (1000000000::HUGEINT * (v.n + 2)) // (l.n + 2 * l.size) AS q
            FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
        s AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM x AS a JOIN x AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        f AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
            FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM x WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "BINARY") AS rank FROM f)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
    "op12_importance": r"""
        WITH RECURSIVE crc(b, k, c) AS (
            SELECT range, 0, range FROM range(256)
            UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
        tab AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
        a AS (
            SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents
            UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
        w AS (
            SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
        f AS (
            SELECT side, k, unnest(list_concat(ws, CASE WHEN len(ws) < 2 THEN [] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g
            FROM w),
        n AS (SELECT side, k, g, count(*) AS n FROM f GROUP BY ALL),
        u AS (SELECT DISTINCT g FROM n),
        by_bytes AS (SELECT g, hex(encode(g)) AS h FROM u),
        c AS (
            SELECT g, xor(4294967295, list_reduce(
                list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
                lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8), 4294967295::BIGINT)) % 10000 AS bucket
            FROM by_bytes, tab),
        e AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN c USING (g) GROUP BY bucket),
        z AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM e),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM e, z),
        m AS (SELECT k, sum(n) AS n_features, sum(n * gain) AS won FROM n JOIN c USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY k),
        o AS (
            SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
                   coalesce((won - ((won % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                   ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
            FROM w LEFT JOIN m USING (k) WHERE side = 'd'),
        p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
        r AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
                   25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS places FROM p)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= places THEN place END::BIGINT AS rank FROM r""",
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        c AS (
            SELECT doc_id, base, substr(h, 2 * base + 1, 2198) AS piece, least(1000, n - 99 - base) AS starts
            FROM (SELECT *, unnest(range(0, n - 99, 1000)) AS base FROM d)),
        s AS (SELECT doc_id, base + i AS i, md5_number(substr(piece, 2 * i - 1, 200)) AS w FROM (SELECT *, unnest(range(1, starts + 1)) AS i FROM c)),
        f AS (SELECT w, min(doc_id::HUGEINT * 4294967296 + i) AS place FROM s GROUP BY w HAVING count(*) > 1),
        g AS (
            SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
            FROM s JOIN f USING (w) WHERE doc_id::HUGEINT * 4294967296 + i > place),
        r AS (SELECT *, sum(CASE WHEN before >= i - 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        p AS (SELECT doc_id, run, min(i) AS a, max(i) + 99 AS b FROM r GROUP BY doc_id, run),
        q AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS done FROM p),
        k AS (
            SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last,
                   string_agg(substr(h, 2 * done + 1, 2 * (a - 1 - done)), '' ORDER BY a) AS kept
            FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN k.last IS NULL THEN d.h ELSE k.kept || substr(d.h, 2 * k.last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT text, min(doc_id) AS first_id, count(*) AS copies, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents GROUP BY text),
        t AS (SELECT first_id AS k, text, first_id, copies, ws FROM w WHERE len(ws) > 0),
        s AS (
            SELECT k, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh
            FROM t),
        n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
        i AS (SELECT a.k AS a, b.k AS b, count(*) AS inter FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.k <> b.k GROUP BY ALL),
        l AS (
            SELECT i.a, i.b FROM i JOIN n AS x ON x.k = i.a JOIN n AS y ON y.k = i.b
            WHERE inter >= 0.8 * (x.n + y.n - inter) - 1e-9),
        reach(a, b) AS (SELECT k, k FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
        m AS (SELECT l.a, sum(t.copies) AS linked FROM l JOIN t ON t.k = l.b GROUP BY l.a)
        SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id,
               (CASE WHEN t.k IS NULL THEN 0 ELSE coalesce(m.linked, 0) + t.copies - 1 END)::BIGINT AS n_links
        FROM documents AS d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.a = t.k LEFT JOIN m ON m.a = t.k""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d),
        r AS (SELECT *, n >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM m)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to
        FROM r""",
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
