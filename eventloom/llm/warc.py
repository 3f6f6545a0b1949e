"""Web archives (WARC 1.1): write, read, and keep each payload once.

A record is headers, an empty line, a body, and two line ends. Spark's text
writer produces exactly that when the line separator is the two line ends, so
archives go to any store Spark can write to; files are compressed whole.

Duplicates are found on headers alone: digests and lengths are shuffled, bodies
are not. A revisit record has no payload and names the record it repeats; on
reading, revisits are joined to the responses they name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import scratch_path, ship_package

END = "\r\n"
LEAST_BYTES = 1000
#: Records per archive file at most.
FILE_RECORDS = 50_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"

RECORD = (
    "record_id string, record_type string, page_id {kind}, url string, "
    "refers_to_record string, payload_bytes bigint, payload_digest string, payload binary"
)


def as_records(pages: DataFrame) -> DataFrame:
    """A response record for each row of `page_id, url, html`; missing html is empty."""
    payload = F.coalesce("html", F.lit(""))
    digest = F.sha1(payload)
    # The id of a record follows from its content, so a rerun writes the same one.
    name = F.md5(
        F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), digest)
    )
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(name, start, n) for start, n in parts])
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        "page_id",
        F.regexp_replace("url", r"[\r\n]", "").alias("url"),
        F.lit(None).cast("string").alias("refers_to_record"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        payload.alias("payload"),
    )


def mark_revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Records whose payload another one has become revisits of it, without payload.

    Of equal payloads of at least `least_bytes` the record with the largest
    page_id stays; rows with that page_id all stay, as does a group without any.
    """
    headers = records.where(F.col("payload_bytes") >= least_bytes).select(
        "payload_digest", "payload_bytes", "page_id", "record_id"
    )
    originals = (
        headers.groupBy(
            F.col("payload_digest").alias("same_digest"), F.col("payload_bytes").alias("same_bytes")
        )
        .agg(
            F.max(F.struct("page_id", "record_id")).alias("original"),
            F.count(F.lit(1)).alias("copies"),
        )
        .where((F.col("copies") > 1) & F.col("original.page_id").isNotNull())
    )
    repeats = F.coalesce(~F.col("original.page_id").eqNullSafe(F.col("page_id")), F.lit(False)) & (
        F.col("original").isNotNull()
    )
    return records.join(
        originals,
        (records["payload_digest"] == originals["same_digest"])
        & (records["payload_bytes"] == originals["same_bytes"]),
        "left",
    ).select(
        "record_id",
        F.when(repeats, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "url",
        F.when(repeats, F.col("original.record_id")).alias("refers_to_record"),
        "payload_bytes",
        "payload_digest",
        F.when(~repeats, F.col("payload")).alias("payload"),
    )


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_archives(records: DataFrame, path: str) -> None:
    """One archive record per row, with fresh headers, in files below `path`."""
    revisit = F.col("record_type") == "revisit"
    body = F.concat(F.lit(_HTTP), F.coalesce(F.col("payload"), F.lit("")))
    text = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.col("refers_to_record")),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END),
        body,
    )
    (
        records.select(text.alias("value"))
        .write.option("lineSep", END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and body of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_archives(
    spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = True
) -> DataFrame:
    """The records of all archives below `path`.

    Length and digest are those of the payload that is there; for a revisit
    the length is missing and the digest the one its headers state.
    """
    ship_package(spark)
    schema = RECORD.format(kind=id_type)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                with gzip.open(io.BytesIO(content.as_py())) as stream:
                    for headers, body in _records(stream):
                        payload = body.partition((END * 2).encode())[2]
                        kind = headers["warc-type"]
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        revisit = kind == "revisit"
                        rows.append(
                            (
                                headers["warc-record-id"],
                                kind,
                                headers.get("page-id"),
                                headers.get("warc-target-uri"),
                                headers.get("warc-refers-to"),
                                None if revisit else len(payload),
                                digest if revisit else hashlib.sha1(payload).hexdigest(),
                                payload if payloads and not revisit else None,
                            )
                        )
                        size += len(body)
                        if len(rows) >= 1000 or size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    text_ids = RECORD.format(kind="string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select("content").mapInArrow(parsed, text_ids)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).select(
        *[c.split()[0] for c in schema.split(", ")]
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with `refers_to`, the page a revisit repeats; its length and digest are
    those of the response it names. Other records have no `refers_to`."""
    originals = (
        records.where("record_type <> 'revisit'")
        .groupBy(F.col("record_id").alias("original_id"))
        .agg(
            F.max("page_id").alias("refers_to"),
            F.max("payload_bytes").alias("original_bytes"),
            F.max("payload_digest").alias("original_digest"),
        )
    )
    return records.join(
        originals, records["refers_to_record"] == originals["original_id"], "left"
    ).select(
        "page_id",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("original_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` per row of `pages`,
    as read from the archives that are written.

    Missing html is an empty payload; short payloads are responses always.
    Repeated rows with the largest page_id of their payload are responses, all
    of them. Other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark)
    write_archives(mark_revisits(as_records(pages), least_bytes), path)
    kind = pages.schema["page_id"].dataType.simpleString()
    return resolve_revisits(read_archives(spark, path, kind, payloads=False))
