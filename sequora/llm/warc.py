"""WARC archives with revisits resolved by payload digest.

Headers alone (digest, id, size) are shuffled to find, for each payload, the
record that keeps it.  Payloads are joined to that decision by row, so copies of
one payload are never gathered, and only responses need them: revisit records
are written from headers.  Rows that are equal in all are one header with a
number of copies.  Records are written by Spark's text writer (a record's last
byte is the newline that it adds), in files of about `file_bytes`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm.runtime import Tables, attach, lean, picked, repeated, shared_folder, ship

#: The WARC 1.1 profile for revisits by identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """Base-32 SHA-1 of a string's UTF-8 bytes: 10 hex digits at a time are 8 digits in base 32."""
    h = F.sha1(F.encode(text, "utf-8"))
    parts = [F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolved(base: DataFrame, spark: SparkSession, at_least: int = 0) -> DataFrame:
    """Per distinct row of base (key, page_id, url, html): key, page_id, url, bytes, digest, copies, responses (how many of its copies
    hold the payload) and r (page_id, key and url of the record that the others refer to)."""
    tables = Tables(spark)
    headers = base.select("key", "page_id", "url", F.octet_length("html").cast("long").alias("bytes"), base32_sha1(F.col("html")).alias("digest"))
    headers = tables.write(headers.groupBy("key", "page_id", "url", "bytes", "digest").agg(F.count("*").alias("copies")))
    enough = headers.where(F.col("bytes") >= at_least)
    best = enough.groupBy("digest").agg(F.max(F.struct("page_id", "key", "url")).alias("r"), F.count("*").alias("n"))
    best = tables.write(best.withColumnRenamed("digest", "digest_"))
    facts = best.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    met = attach(enough, "digest", best, "digest_", "n", facts.most, facts.total).drop("digest_")
    met = met.withColumn("responses", F.when(F.col("r.key") == F.col("key"), 1).otherwise(0).cast("long"))
    less = headers.where(F.col("bytes") < at_least).withColumn("r", F.lit(None).cast(best.schema["r"].dataType)).withColumn("responses", F.col("copies"))
    return tables.write(met.unionByName(less))


def write_archives(pages: DataFrame, path: str, spark: SparkSession, date: str = "2024-01-01T00:00:00Z", at_least: int = 0, file_bytes: int = 1 << 27) -> None:
    """Write one record for each row of pages (page_id, url, html, any others) under `path`, as gzip files of about `file_bytes` before compression.

    Null html is an empty payload, a null url an empty target, a null page_id an absent id; of repeated rows one is the
    response, the others revisit it.  Of equal payloads of at least `at_least` bytes the largest page_id is the response.
    """
    crlf = "\r\n"
    base = picked(pages, page_id="long", url="string", html="string").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")
    roles = resolved(base, spark, at_least)
    facts = roles.agg(F.coalesce(F.sum(F.col("bytes") * F.col("responses")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    holders = roles.where("responses > 0").withColumnRenamed("key", "key_")
    payload = base.select("key", "html")
    same = F.col("key") == F.col("key_")
    # one row for each key: rows that are equal in all are reduced to one before they meet their header
    once = payload.join(holders.where("copies > 1").select("key_"), same, "left_semi").dropDuplicates(["key"])
    rows = payload.join(holders.where("copies = 1"), same).unionByName(once.join(holders.where("copies > 1"), same)).drop("key_")
    responses = repeated(rows, "responses", "number").withColumn("type", F.lit("response"))
    again = repeated(roles.withColumn("rest", F.col("copies") - F.col("responses")), "rest", "number").drop("rest")
    revisits = again.withColumn("number", F.col("number") + F.col("responses")).withColumn("type", F.lit("revisit")).withColumn("html", F.lit(""))
    record_id = lambda key, n: F.concat(F.lit("<urn:x-page-record:"), F.hex(key), F.lit("-"), n.cast("string"), F.lit(">"))
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    block = F.concat(http, "html")
    target = lambda url: F.regexp_replace(url, r"[\x00-\x20]", "%20")
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf)), F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        field("WARC-Type", F.col("type")),
        field("WARC-Record-ID", record_id(F.col("key"), F.col("number"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", target(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("r.key"), F.lit(0)))),
        field("WARC-Refers-To-Target-URI", F.when(revisit, target(F.col("r.url")))),
        field("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("X-Page-Id", F.col("page_id")),
        field("X-Refers-To-Page-Id", F.when(revisit, F.col("r.page_id"))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block)),
    )
    value = F.concat(header, F.lit(crlf), block, F.lit("\r\n\r")).alias("value")
    per_file = max(1, int(file_bytes // (facts.bytes / max(1, facts.rows) + 700)))
    responses.select(value).unionByName(revisits.select(value)).write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record in a stream of WARC bytes."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            lines = bytes(held[:end]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            stop = end + 4 + int(fields["content-length"])
            if len(held) < stop + 4:
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield fields, bytes(held[end + 4 : stop])
            del held[: stop + 4]
    if held:
        raise ValueError("the archive ends within a record")


def _inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    while len(data):  # one gzip member after the other
        z = zlib.decompressobj(31)
        at = 0
        while not z.eof and at < len(data):
            yield z.decompress(data[at : at + step])
            at += step
        if not z.eof:
            raise ValueError("the archive is cut short")
        at = min(at, len(data)) - len(z.unused_data)
        data = data[at:]


@lean
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "refers_to_record"]
    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple] = []
            for fields, block in records(_inflated(memoryview(content.as_buffer()))):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(head.rsplit(b": ", 1)[1])
                if fields["warc-type"] == "response":
                    n = len(payload)
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError("a payload does not have its digest")
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                out.append((number("x-page-id"), n, digest, fields["warc-type"], number("x-refers-to-page-id"), fields.get("warc-target-uri"), fields["warc-record-id"], fields.get("warc-refers-to")))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record under `path`; each response's payload is held against its digest."""
    ship(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_record string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_parse, schema)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write pages to archives in the shared folder and read them back; columns as read_archives."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, spark)
    return read_archives(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, list_reduce(list_transform([1, 11, 21, 31], lambda i: list_reduce(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i, 10))::BIGINT >> s) & 31) + 1)::INTEGER, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN top END AS refers_to FROM b
"""
