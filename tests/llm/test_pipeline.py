import random
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from kerbline.llm.queries import MODEL, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    named = entry.queries()
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(named)


def test_stages(frame, prose, tmp_path, spark):
    base = prose(30, low=20, high=60)
    rows = [(k, t + "\nthe line that all documents share", "en", f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0"), (101, base[1] + " with a few more words", "en", "s1"), (102, "12 34 !!", None, "s1"), (103, None, None, None)]
    docs = frame([(*r[:2], *r[2:]) for r in rows]).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "id extra")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: [r["doc_id"] for r in rows] for name, rows in kept.items()}
    assert sorted(ids["language_id"]) == [*range(30), 100, 101]
    assert sum("all documents share" in r["text"] for r in kept["line_dedup"]) == 1
    assert sorted(ids["line_dedup"]) == [*range(30)]  # nothing was left of the copies
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    assert sorted(ids["ngram_jaccard"]) == [*range(30)]
    assert set(ids["mixing"]) <= set(range(30)) and max(map(ids["mixing"].count, range(30))) <= 3
    assert sorted(ids["sentencepiece"]) == sorted(ids["mixing"])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]] for r in kept["sentencepiece"])


def _documents(frame, rows):
    return frame(rows).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars")


def test_the_language_stage_rejects_by_score(frame, prose, spark):
    rng = random.Random(3)
    noise = ["".join(rng.choices("bcdfgjklmpqvxyz  ", k=800)) for _ in range(6)] + ["".join(rng.choices("абвгдежзиклмнопрст  ", k=800)) for _ in range(6)]
    rows = [(k, t, "en" if k % 3 else None, "s") for k, t in enumerate(prose(60))]
    rows += [(100, "Short.", None, "s"), (101, "12 34 !!", None, "s")] + [(200 + k, t, None, "s") for k, t in enumerate(noise)]
    left = {r["doc_id"] for r in corpus_pipeline.identified(spark, _documents(frame, rows), SF).collect()}
    assert left == {*range(60), 100}


def test_labelled_noise_does_not_set_the_bound(frame, prose, spark):
    rng = random.Random(5)
    noise = ["".join(rng.choices("bcdfgjklmpqvxyz  ", k=600)) for _ in range(8)]
    rows = [(k, t, "en", "s") for k, t in enumerate(prose(80))] + [(200 + k, t, "en" if k % 2 else None, "s") for k, t in enumerate(noise)]
    left = {r["doc_id"] for r in corpus_pipeline.identified(spark, _documents(frame, rows), SF).collect()}
    assert left == {*range(80)}


def test_the_language_stage_keeps_all_if_nothing_was_learned(frame, prose, spark):
    clean = prose(5)
    rows = [(k, t, None, "s") for k, t in enumerate(clean)] + [(9, None, None, None)]
    assert corpus_pipeline.identified(spark, _documents(frame, rows), SF).count() == len(rows)
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    held = [(out, clean[0], "en", "s"), (out, clean[1], "en", "s")]
    assert corpus_pipeline.identified(spark, _documents(frame, held), SF).count() == 2


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 50


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, db, name):
    from check import _rows

    done = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(done.columns)
    assert _rows(done.columns, done.collect()) == _rows(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in entry.oracle_sql()])
def test_queries_without_sql_return_every_document(spark, name):
    done = QUERIES[name](spark, SF)
    assert done.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
