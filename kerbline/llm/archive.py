"""A content-addressed web archive: payload bytes once by digest, record headers
apart, records put together again by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.bitmap import is_marked, marked
from kerbline.llm.storage import written

END = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("\n", page.cast("string"), digest))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Line breaks in a value can't start a new line."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), text, F.lit(END)), F.lit(""))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to ``path``.

    ``path/payloads`` holds each different payload once under its SHA-256,
    ``path/headers`` the exact header bytes of every record. Of the records with
    equal payloads of ``least`` bytes or more, that with the smallest page_id is
    a response and the others revisit it; smaller ones are all responses.

    A null html is an empty payload, a null url leaves its line out. Rows with a
    null page_id revisit like others, but are never revisited: where all ids of
    a payload are null, all are responses. Rows that repeat the smallest page_id
    are all responses. An empty table makes an empty archive.
    """
    base = pages.select(
        pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = written(base.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")), "digests")
    # Payloads without copies are stored where they are. Copies meet in their
    # tasks first, so any number of them is moved once per task at most.
    several = is_marked(marked(first.where("rows > 1").select(F.xxhash64("digest"))), F.xxhash64("digest"))
    tagged = base.select("digest", "payload", several.alias("several"))
    stored = tagged.where("several").groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.unionByName(tagged.where("not several").select("digest", "payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = first.select("digest", "first_id")
    narrow = base.select("page_id", "url", "digest", F.octet_length("payload").alias("n"))
    again = (F.col("n") >= least) & (~F.col("page_id").eqNullSafe(F.col("first_id"))) & F.col("first_id").isNotNull()
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _urn(F.col("first_id"), F.col("digest"))), _line("Refers-To-Page", F.col("first_id")))).otherwise(""),
        _line("Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, 0).otherwise(F.col("n"))),
        F.lit(END),
    )
    narrow.join(first, "digest").select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    value = F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id``, ``url``, ``record_type``, ``refers_to``
    (the response's page_id), ``payload_digest``, ``payload`` (binary, in full for
    revisits too) and ``record``, the bytes of the record as a WARC file has
    them (a revisit without payload).

    Every payload is checked against its digest; a payload that differs, or a
    header whose payload is missing, raises. Fields that a header lacks are null.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = stored.select(
        F.col("digest").alias("stored"),
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("payload"),
    )
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    digest = F.substring(_field("WARC-Payload-Digest"), 8, 64)
    fields = headers.select(
        digest.alias("payload_digest"), _field("Page-ID").cast("long").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), _field("Refers-To-Page").cast("long").alias("refers_to"), "header",
    )
    whole = fields.join(checked, F.col("payload_digest") == F.col("stored"), "left").withColumn(
        "payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), "payload_digest")).cast("binary"))
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), body, F.lit((END * 2).encode()))
    return whole.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload", record.alias("record"))


def weighed(records: DataFrame) -> DataFrame:
    """What the bytes of each ``record`` say: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``.

    A record is split at its blank line. Its block must be as long as
    Content-Length says and end as records do, else this raises. A revisit takes
    length and digest from the record of the response it refers to, which must
    be there. Only these narrow rows move.
    """
    text = F.col("record").cast("string")
    head = F.substring(text, F.lit(1), F.instr(text, END * 2) + 3)
    n = F.octet_length("head")
    split = records.select("page_id", "record_type", "refers_to", F.col("payload_digest").alias("stated"), "record", head.alias("head"))
    block = F.substring("record", n + 1, F.octet_length("record") - n - 4)
    length = F.regexp_extract("head", "\r\nContent-Length: ([0-9]+)\r\n", 1)
    ended = F.substring("record", F.octet_length("record") - 3, F.lit(4)) == F.lit((END * 2).encode())
    cut = split.select("page_id", "record_type", "refers_to", "stated", block.alias("block"), length.alias("length"), ended.alias("ended"))
    right = (F.octet_length("block").cast("string") == F.col("length")) & F.col("ended")
    whole = F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("Content-Length differs in a record of payload "), F.coalesce("stated", F.lit("?")))).cast("binary"))
    own = cut.select("page_id", "record_type", "refers_to", "stated", whole.alias("block"))
    narrow = written(own.select("page_id", "record_type", "refers_to", "stated", F.octet_length("block").cast("long").alias("n"), F.sha2("block", 256).alias("own")), "records")
    response = F.col("record_type") == "response"
    first = narrow.where(response).groupBy(F.col("page_id").alias("i"), F.col("stated").alias("d")).agg(F.first("n").alias("first_n"), F.first("own").alias("first_own"))
    again = narrow.where(~response).join(written(first, "responses"), (F.col("refers_to") == F.col("i")) & (F.col("stated") == F.col("d")), "left")
    missing = F.raise_error(F.concat(F.lit("no response for "), "stated"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = again.withColumn("payload_bytes", F.coalesce("first_n", missing.cast("long"))).withColumn("payload_digest", F.col("first_own"))
    return narrow.where(response).withColumnsRenamed({"n": "payload_bytes", "own": "payload_digest"}).select(*columns).unionByName(revisits.select(*columns))


def export_warc(records: DataFrame, path: str) -> None:
    """Records as plain WARC files, one per partition."""
    text = F.col("record").cast("string")
    records.select(F.substring(text, F.lit(1), F.length(text) - 4).alias("value")).write.option("lineSep", END * 2).text(path)
