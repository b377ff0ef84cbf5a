"""WARC archives: writing captures, reading records, assembling transactions.

``write_archive`` turns pages into WARC 1.1 records with string functions and
writes them with Spark's text writer: a record ends with two CRLF, which is the
writer's line separator, so the files are plain (gzipped) WARC files that any
file system of the cluster can hold.  A capture has a request, a response (or a
revisit without the payload, where another capture has the same one) and a
metadata record; request and metadata name the response in WARC-Concurrent-To.

``read_records`` takes whole files, one after another and record by record, and
``assemble`` joins the records through these identifiers to one nested row a
capture.

Defined results: a null html is an empty payload; a null id or address is
kept as null; every row is a capture with records of its own, also where rows
repeat; of captures with equal payloads the first of those with the largest id,
then address, is the response (nulls come last); a very long page is one record,
held whole by the task that writes or reads it; line ends in an address are percent-encoded; an empty table gives an
empty archive and no rows; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads up to which they are broadcast rather than shuffled.
MAX_BROADCAST_GROUPS = 100_000
RECORDS_OUT = 128
SALTS = 8

RECORD_FIELDS = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "digest string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of ``data`` in upper-case base 32 (15 hex digits are 12 of base 32)."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, a, n), 16, 32), n * 4 // 5, "0") for a, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, *of: Column) -> Column:
    known = (F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in of)  # null is not the empty text
    h = F.md5(F.concat_ws("/", F.lit(kind), *known))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without its closing CRLFs; headers whose value is null are left out."""
    head = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    return F.concat(
        F.concat_ws(
            CRLF,
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), record_id),
            F.lit(f"WARC-Date: {date}"),
            *head,
            F.concat(F.lit("Content-Length: "), F.octet_length(block)),
        ),
        F.lit(CRLF + CRLF),
        block,
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    captures_per_file: int = 4000,
) -> None:
    own = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")
    ).withColumn("digest", base32_sha1("html"))
    last = F.max(F.struct("id", "url"))
    groups = own.groupBy("digest").agg(last.alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = materialise(groups.select("digest", F.struct("first.id", "first.url").alias("first")), "repeats")
    if repeats.count() <= MAX_BROADCAST_GROUPS:
        repeats = F.broadcast(repeats)
    joined = own.join(repeats, "digest", "left")
    leads = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    # rows with one id, address and payload are counted and written as often
    same = joined.filter("first IS NOT NULL").withColumn("html", F.when(leads, F.col("html")))
    same = same.groupBy("id", "url", "digest", "first").agg(F.max("html").alias("html"), F.count("*").alias("n"))
    same = same.select("id", "url", "digest", "first", "html", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    alone = joined.filter("first IS NULL").withColumn("k", F.lit(0).cast("bigint"))
    rows = alone.unionByName(same)
    revisit = F.col("first").isNotNull() & ~(leads & (F.col("k") == 0))
    rid = lambda kind: _record_id(kind, F.col("id"), F.col("url"), F.col("digest"), F.col("k"))
    refers_to = _record_id("response", F.col("first.id"), F.col("first.url"), F.col("digest"), F.lit(0))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    address = ("WARC-Target-URI", url)
    partner = ("WARC-Concurrent-To", F.col("rid"))
    rows = rows.withColumns({"rid": rid("response"), "revisit": revisit})
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    known = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("fetch: complete\r\n"))
    records = (
        _record(F.lit("request"), rid("request"), date, [address, partner, ("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"),
            F.col("rid"),
            date,
            [
                address,
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Refers-To", F.when(F.col("revisit"), refers_to)),
                ("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.concat(F.lit(HTTP_HEAD), F.when(F.col("revisit"), "").otherwise(F.col("html"))),
        ),
        _record(F.lit("metadata"), rid("metadata"), date, [address, partner, ("Content-Type", F.lit("application/warc-fields"))], known),
    )
    text = F.concat_ws(CRLF + CRLF, *records)
    writer = rows.select(text.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    writer.option("maxRecordsPerFile", captures_per_file).text(path)


def _unzipped(data: bytes) -> io.BufferedIOBase:
    if data[:2] != b"\x1f\x8b":
        return io.BytesIO(data)
    import gzip

    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 16)


def records_of(data: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one file in the order of RECORD_FIELDS."""
    stream = _unzipped(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        kind, fields, payload = head["warc-type"], {}, None
        if kind == "metadata":
            for row in block.decode("utf-8").split(CRLF):
                name, colon, value = row.partition(":")
                if colon:
                    fields[name] = value.strip()
        elif kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield (
            head["warc-record-id"],
            kind,
            head.get("warc-target-uri"),
            head["warc-date"],
            head.get("warc-concurrent-to"),
            head.get("warc-refers-to"),
            head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            None if payload is None else len(payload),
            digest,
            list(fields.items()),
            payload if payloads else None,
        )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files below ``path``; without ``payloads`` these stay null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    types = [
        *[(n, pa.string()) for n in ("record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "digest")],
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])

        held: list[tuple] = []
        for b in batches:
            for content in b.column(0):
                for r in records_of(content.as_py(), payloads):
                    held.append(r)
                    if len(held) == RECORDS_OUT:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    return files.mapInArrow(run, RECORD_FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, record_type, digest, payload_bytes,
    refers_to, request, response, metadata).

    ``digest`` and ``payload_bytes`` are those of the full payload: a revisit
    takes them from the response that it refers to.  A response whose bytes do
    not give the digest in its header raises an error.
    """
    main = records.filter("type IN ('response', 'revisit')").dropDuplicates(["record_id"])
    sound = F.col("digest").isNull() | F.col("payload_digest").isNull() | (F.col("digest") == F.col("payload_digest"))
    checked = F.when(sound, F.coalesce("payload_digest", "digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest of "), "record_id")))
    main = main.select(
        F.col("record_id").alias("capture_id"),
        F.col("type").alias("record_type"),
        checked.alias("digest"),
        "payload_bytes",
        "refers_to",
        F.struct("target_uri", "date", "payload").alias("response"),
    )

    def partner(kind: str, body: Column) -> DataFrame:
        own = records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), body.alias(kind))
        return own.dropDuplicates(["capture_id"])

    out = main.join(partner("request", F.struct("record_id", "target_uri", "date")), "capture_id", "left")
    out = out.join(partner("metadata", F.struct("record_id", "fields")), "capture_id", "left")
    return out


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` with the payload size of revisits and the fields of what they
    refer to (``original``); the originals are one row a payload."""
    originals = captures.filter("record_type = 'response'").select(
        F.col("capture_id").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("metadata.fields").alias("original")
    )
    revisits = captures.filter("refers_to IS NOT NULL")
    asked = originals.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi")
    # a page that a third of all captures repeat is as many keys as there are salts
    dealt = revisits.withColumn("_s", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    copies = asked.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.join(copies, ["refers_to", "_s"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_n"))
    rest = captures.filter("refers_to IS NULL").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    return rest.unionByName(met.select(*rest.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as an archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path)
    records = materialise(read_records(spark, path, payloads=False), "records")
    return resolve_revisits(materialise(assemble(records), "captures"))
