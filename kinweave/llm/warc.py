"""WARC: writing captures as archives, reading records back, and assembling transactions.

An archive is gzip of WARC/1.1 records. Spark's text writer makes it: a row is one record and the separator of
rows is the blank line that ends a record, so any file system that Spark reaches will do.

A null url or html counts as empty. Of captures with equal payloads of at least `least` bytes, the one with the
smallest page_id is a response and the others revisit it; rows that repeat that page_id are all responses,
under one record id.
Empty tables give an archive without records and an empty result.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

END = "\r\n\r\n"
RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "content_type string, payload_digest string, fields map<string,string>, payload binary"
)


def _uuid(*cols) -> F.Column:
    h = F.md5(F.concat_ws("|", *cols))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(*lines, block) -> F.Column:
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(head, F.lit(END), block)


def write(pages: DataFrame, path: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000, file_bytes: int = 256 << 20) -> None:
    """Archives of request, response (or revisit) and metadata records for each row of page_id, url, html.

    Payloads are shuffled once, by their digest; a digest that many rows share is split by the join. A file ends after
    `records_per_file` records, fewer where the longest payload would bring it over `file_bytes` before packing (three
    records at least). A reader's task holds one packed file, so no payload may come near 2 GB."""
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("f"))
    first = first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    rows = rows.join(first, "digest", "left")
    again = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    turn = F.xxhash64(F.monotonically_increasing_id(), "url")  # tells repeated rows apart
    rows = rows.withColumn("again", again).withColumn("own", F.concat_ws("/", name, F.when(again | (F.col("bytes") < least), F.concat_ws("/", "digest", turn)).otherwise(F.col("digest"))))
    shared = F.concat_ws("/", F.coalesce(F.col("first_id").cast("string"), F.lit("null")), "digest")
    rows = rows.withColumn("cap", _uuid(F.lit("response"), "own")).withColumn("mark", _uuid(F.lit("mark"), "own", turn))
    when, uri = F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), "url")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit(END))
    rid = lambda c: F.concat(F.lit("WARC-Record-ID: "), c)
    line = lambda k, c: F.concat(F.lit(f"{k}: "), c)
    request = _record(
        F.lit("WARC-Type: request"), rid(_uuid(F.lit("request"), "mark")), line("WARC-Concurrent-To", F.col("cap")), when, uri, F.lit("Content-Type: application/http; msgtype=request"),
        block=F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1"), F.lit(END)),
    )
    response = _record(
        F.lit("WARC-Type: response"), rid(F.col("cap")), when, uri, digest, F.lit("Content-Type: application/http; msgtype=response"),
        block=F.concat(http, F.col("html")),
    )
    revisit = _record(
        F.lit("WARC-Type: revisit"), rid(F.col("cap")), when, uri, digest, line("WARC-Refers-To", _uuid(F.lit("response"), shared)), line("WARC-Refers-To-Target-URI", F.col("first_url")),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit("Content-Type: application/http; msgtype=response"), block=http,
    )
    metadata = _record(
        F.lit("WARC-Type: metadata"), rid(_uuid(F.lit("metadata"), "mark")), line("WARC-Concurrent-To", F.col("cap")), when, uri, F.lit("Content-Type: application/warc-fields"),
        block=F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    out = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    most = max(3, min(records_per_file, 3 * (file_bytes // (longest + 4096))))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of an archive's bytes, by their Content-Length; what RECORD lists."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        linked = []
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode("utf-8", "replace").partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "warc-concurrent-to":
                linked.append(value)
            fields[key] = value
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        kind = fields.get("content-type", "")
        payload = block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block
        digest = fields.get("warc-payload-digest")
        yield (
            fields.get("warc-record-id"), fields.get("warc-type"), linked, fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
            kind, digest and digest.rpartition(":")[2], list(fields.items()), payload,
        )


class _Gunzip(io.RawIOBase):
    """Reads gzip of any number of members piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.engine = memoryview(data), 0, b"", zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, b):
        while not self.left:
            if self.engine.eof:
                rest = self.engine.unused_data
                self.at -= len(rest)
                self.engine = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return 0
            piece = self.data[self.at : self.at + 65536]
            self.at += len(piece)
            self.left = self.engine.decompress(piece)
        n = min(len(b), len(self.left))
        b[:n], self.left = self.left[:n], self.left[n:]
        return n


def read(spark: SparkSession, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records under `path`, files ending in .gz unpacked; a task holds one packed file and one batch."""
    schema = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()),
        ("date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def records(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                stream = io.BufferedReader(_Gunzip(data) if name.endswith(".gz") else io.BytesIO(data), 1 << 16)
                rows, size = [], 0
                for row in parse(stream):
                    rows.append(row)
                    size += len(row[-1])
                    if size > batch_bytes or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(records, RECORD)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), requests, metadata.

    Members are joined by WARC-Concurrent-To: to the capture itself, from the capture, or through one
    record that is linked with it. A member without a capture is left out; a capture needs no members."""
    captures = records.filter(F.col("type").isin("response", "revisit", "resource", "conversion"))
    inner = F.struct(*[c for c in records.columns if payload or c != "payload"])
    captures = captures.select(F.col("record_id").alias("capture_id"), inner.alias("response"))
    others = records.filter(F.col("type").isin("request", "metadata"))
    names = F.transform("concurrent_to", lambda x: F.struct(F.col("record_id").alias("a"), x.alias("b")))
    ways = records.select(F.explode(names).alias("e")).select("e.a", "e.b", F.lit(True).alias("out"))
    ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("out")))
    ids = captures.select("capture_id")
    near = ways.join(ids, F.col("b") == F.col("capture_id")).select(F.col("a").alias("member"), "capture_id")
    far = ways.join(near, F.col("b") == F.col("member")).select(F.col("a").alias("member"), "capture_id")
    far = far.join(ids.withColumnRenamed("capture_id", "_c"), F.col("member") == F.col("_c"), "left_anti")
    member = near.withColumn("hop", F.lit(1)).unionByName(far.withColumn("hop", F.lit(2))).groupBy("member").agg(F.min(F.struct("hop", "capture_id")).alias("m"))
    joined = others.select("record_id", "type", inner.alias("r")).join(member, F.col("record_id") == F.col("member")).select(F.col("m.capture_id").alias("capture_id"), "type", "record_id", "r")
    # a capture has a few members of its own, never those of others
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "r")))), lambda x: x.r)
    grouped = joined.withColumn("r", F.col("r").dropFields("fields")).groupBy("capture_id").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    return captures.join(grouped, "capture_id", "left")


def captures(pages: DataFrame, least: int = 100, **how) -> DataFrame:
    """Writes `pages`, reads the archives back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it refers to. Page ids keep their type, strings and decimals too; an empty
    string as id is read back as null. Extra columns are not read."""
    spark = pages.sparkSession
    hold = Scratch(spark)
    write(pages, f"{hold.path}/warc", least, **how)
    whole = read(spark, f"{hold.path}/warc")
    whole = whole.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("found_digest", F.sha2("payload", 256))
    page = F.when(F.col("type") == "metadata", F.regexp_extract(F.decode("payload", "utf-8"), r"page-id: *([^\r\n]*)", 1))
    small = hold.save(whole.withColumn("page", page).drop("payload"), "records")
    rows = assemble(small, payload=False)
    rows = rows.select("capture_id", F.expr("nullif(metadata[0].page, '')").cast(pages.schema["page_id"].dataType).alias("page_id"), "response.*")
    rows = rows.select("capture_id", "page_id", "type", "refers_to", "payload_bytes", "found_digest", "payload_digest")
    first = rows.filter("type = 'response'").groupBy(F.col("capture_id").alias("_id")).agg(F.min(F.struct("page_id", "payload_bytes", "found_digest")).alias("_f"))
    first = first.select("_id", F.col("_f.page_id").alias("_page"), F.col("_f.payload_bytes").alias("_bytes"), F.col("_f.found_digest").alias("_digest"))
    # a response meets itself, so that no single key gathers all of them
    both = rows.join(first, F.coalesce("refers_to", "capture_id") == F.col("_id"), "left")
    again = F.col("type") == "revisit"
    return both.select(
        "page_id", F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("_digest")).otherwise(F.col("found_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(again, F.col("_page")).alias("refers_to"),
    )
