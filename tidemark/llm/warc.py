"""WARC archives: writing captures, reading records back, assembling transactions.

A capture is three records: the response (or a revisit of an equal payload), its request and its metadata,
tied by WARC-Concurrent-To.  ``write_archive`` renders them as text columns and writes gzipped
``.txt.gz`` part files whose line end is the blank line that closes a WARC record, so the files are plain
WARC.  ``read_archive`` reads the files whole (their size is bounded when they are written) and walks the
records by Content-Length.  ``assemble`` joins request and metadata to their response through the
concurrent-to identifiers, in either direction and over one intermediate record, and gives one nested row
per capture.

Edge cases: null html is an empty payload; a null page id or url is left out of the records and comes back
null; line ends in a url are removed; equal rows are written and come back as often as they occur; records without a
response are kept apart (``orphans``); an empty table gives an empty archive; other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

from .common import small_batches, written

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Uncompressed bytes of one archive file, about.
FILE_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _record(kind, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing blank line; fields that are null are left out."""
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write every row of ``pages`` as a capture below ``path``.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes that of the smallest id is the response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(url_col, r"[\r\n]+", "").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size")
    )
    firsts = rows.filter((F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "url")).alias("first"))
    firsts = firsts.filter("n > 1").select("digest", "first")
    stat = rows.agg(F.avg(F.col("size")).alias("size")).first()
    per_file = max(1, int(FILE_BYTES / ((stat["size"] or 0) + 1500)))

    def name(i: Column, url: Column) -> Column:
        return F.concat(F.lit("urn:capture:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex(F.xxhash64(url, F.col("digest")))))

    rows = rows.join(firsts, "digest", "left")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    response = name(F.col("id"), F.col("url"))
    target = ("WARC-Target-URI", F.col("url"))
    tie = ("WARC-Concurrent-To", F.concat(F.lit("<"), response, F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z+]+://([^/?#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit(""))
    parts = [
        _record("request", F.concat(response, F.lit(":request")), [target, tie, ("Content-Type", F.lit("application/http; msgtype=request"))], ask),
        _record(
            F.when(later, "revisit").otherwise("response"),
            response,
            [
                target,
                ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                ("WARC-Profile", F.when(later, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                ("WARC-Refers-To", F.when(later, F.concat(F.lit("<"), name(F.col("first.id"), F.col("first.url")), F.lit(">")))),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.when(later, http).otherwise(F.concat(http, F.col("html"))),
        ),
        _record("metadata", F.concat(response, F.lit(":metadata")), [target, tie, ("Content-Type", F.lit("application/warc-fields"))], about),
    ]
    lines = rows.select(F.concat_ws(END, *parts).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields with lower-case names, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields[b"content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def inflate(content: bytes) -> bytes:
    """A file's bytes; gzip files may hold a member for each record or one for all."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_length long, content binary"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record.  ``content`` is the payload of a response, without its HTTP head, and the whole
    block of any other record; ``http_length`` is the length that the HTTP head states."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def text(b):
            return b.decode("utf-8", "replace").strip("<>") if b is not None else None

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_records(inflate(content.as_buffer().to_pybytes())):
                    kind, length = text(f.get(b"warc-type")), None
                    if b"msgtype=response" in f.get(b"content-type", b""):
                        head, _, body = block.partition(b"\r\n\r\n")
                        for line in head.split(b"\r\n"):
                            if line.lower().startswith(b"content-length:"):
                                length = int(line[15:])
                        block = body
                    rows.append((text(f.get(b"warc-record-id")), kind, text(f.get(b"warc-concurrent-to")), text(f.get(b"warc-refers-to")), text(f.get(b"warc-target-uri")), text(f.get(b"warc-payload-digest")), length, block))
                    size += len(block) + 500
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = small_batches(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return files.select("content").mapInArrow(walk, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """``records`` with ``capture``: the id of the response that each belongs to; null for orphans."""
    whole = F.struct(*[F.col(c) for c in records.columns]).alias("r")
    is_response = F.col("type").isin("response", "revisit")
    own = records.filter(is_response).select(F.col("record_id").alias("capture"), whole)
    other = records.filter(~is_response).select(whole)
    heads = own.select(F.explode(F.array("capture", "r.concurrent_to")).alias("k"), "capture").filter("k is not null").distinct()
    # a record names its response, is named by it, or names a record that does
    direct = other.select("r", F.explode(F.array_distinct(F.array("r.concurrent_to", "r.record_id"))).alias("k")).join(heads, "k", "left")
    first = direct.groupBy(F.col("r.record_id").alias("id"), F.col("r.concurrent_to").alias("to")).agg(F.max("capture").alias("capture"))
    hop = first.filter("capture is not null").select(F.col("id").alias("k2"), F.col("capture").alias("via"))
    tied = first.join(hop, first["to"] == hop["k2"], "left").select("id", "to", F.coalesce("capture", "via").alias("capture"))
    back = other.join(tied, F.col("r.record_id").eqNullSafe(F.col("id")) & F.col("r.concurrent_to").eqNullSafe(F.col("to")), "left")
    return own.unionByName(back.select("capture", "r"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, response, request, metadata, each a struct of ``records``' columns.

    Columns with large contents are best reduced before: what ``records`` carries is shuffled."""
    rows = captures(records)
    kind = F.col("r.type")
    pick = lambda *t: F.max_by(F.col("r"), F.when(kind.isin(*t), F.lit(1)))
    rows = rows.filter("capture is not null").groupBy("capture").agg(
        pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata"), F.count(F.when(kind.isin("response", "revisit"), 1)).alias("n")
    )
    # captures that were written several times under one id are told apart by their number only
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "copy")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archive."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path)
    records = read_archive(spark, path)
    stored = F.col("type") == "response"
    thin = records.select(
        "record_id",
        "type",
        "concurrent_to",
        "refers_to",
        F.when(stored, F.octet_length("content").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("content", 256)).otherwise(F.regexp_extract("payload_digest", "sha256:(.*)", 1)).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.regexp_extract(F.col("content").cast("string"), r"page-id: (-?\d+)", 1)).alias("page"),
    )
    done = written(assemble(written(thin, "records")), "captures")
    rows = done.select(
        F.expr("try_cast(metadata.page as bigint)").alias("page_id"), "response.record_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to")
    )
    named = rows.filter(F.col("record_type") == "response").groupBy(F.col("record_id").alias("to")).agg(F.min("page_id").alias("refers_to"))
    return rows.join(named, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
