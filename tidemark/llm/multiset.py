"""Document fingerprints by a homomorphic hash of a multiset of paragraphs.

A paragraph (a line) is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two: the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector.  A vector has two parts.  ``EXACT`` lanes of 64 bits are
a uniform hash of the whole paragraph: sums that agree in all of them are equal multisets but for chance.
``WIDE`` lanes of 32 bits are a signed sketch of the paragraph's word shingles: each shingle adds +1 or -1
to one lane, so the inner product of two fingerprints estimates that of the shingle multisets, and
likeness is the estimated weighted overlap.  A lane wraps only beyond 2^31 shingles of one document.

Edge cases: null text is empty; an empty text has the fingerprint of zeros; empty lines are paragraphs of
no shingles, they count in the exact lanes only; repeated ids are ordered by the hash of their text and null
ids come first; one document is its own next one; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, small_batches

EXACT, WIDE, SHINGLE = 4, 256, 3
BYTES = EXACT * 8 + WIDE * 4
_BLANK = np.zeros(WIDE, np.int64)


def paragraph_sums(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of paragraphs: exact lanes and wide lanes."""
    exact = np.zeros(EXACT, np.uint64)
    marks: list[int] = []
    digest = xxhash.xxh3_64_intdigest
    raw = b"".join(hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in paragraphs)
    if raw:
        exact = np.frombuffer(raw, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    for p in paragraphs:
        words = p.split()
        n = len(words)
        if n > SHINGLE:
            line = b" ".join(words)
            at, starts, ends = 0, [], []
            for w in words:
                starts.append(at)
                at += len(w)
                ends.append(at)
                at += 1
            marks += [digest(line[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :])]
        elif n:
            marks.append(digest(b" ".join(words)))
    if not marks:
        return exact, _BLANK
    h = np.array(marks, np.uint64)
    sign = (h >> np.uint64(63)).astype(np.int64) * 2 - 1
    return exact, np.bincount((h & np.uint64(WIDE - 1)).astype(np.int64), sign, WIDE).astype(np.int64)


def pack(exact: np.ndarray, wide: np.ndarray) -> bytes:
    return exact.astype("<u8").tobytes() + (wide & 0xFFFFFFFF).astype("<u4").tobytes()


def unpack(fp: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fp[: EXACT * 8], "<u8"), np.frombuffer(fp[EXACT * 8 :], "<i4").astype(np.int64)


def fingerprint(text: bytes) -> bytes:
    return pack(*paragraph_sums(text.split(b"\n"))) if text else bytes(BYTES)


def update(fp: bytes, inserted: list[bytes] = (), deleted: list[bytes] = ()) -> bytes:
    """The fingerprint after paragraphs came and went; the rest of the document is not needed."""
    exact, wide = unpack(fp)
    more, less = paragraph_sums(list(inserted)), paragraph_sums(list(deleted))
    return pack(exact + more[0] - less[0], wide + more[1] - less[1])


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: 1 for equal fingerprints, else the overlap of the shingle multisets, (|A| + |B| - |A - B|) /
    (|A| + |B| + |A - B|) in estimated squared lengths."""
    if a == b:
        return 1.0
    x, y = unpack(a)[1], unpack(b)[1]
    both, apart = float(x @ x + y @ y), float((x - y) @ (x - y))
    return max(0.0, min(1.0, (both - apart) / (both + apart))) if both + apart else 0.0


def edited_fingerprint(fp: bytes, text: bytes, keep: int, tail: bytes) -> bytes:
    """Fingerprint of text[:keep] + tail from that of the text: only the lines that change are hashed."""
    if not keep and not tail:
        return bytes(BYTES)
    cut = text.rfind(b"\n", 0, keep) + 1  # the line in which the edit begins
    deleted = text[cut:].split(b"\n") if text else []
    return update(fp, (text[cut:keep] + tail).split(b"\n"), deleted)


def next_rows(rows: DataFrame, order: list[str], carry: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``carry`` of the row that follows in ``order`` (first a long), the first after the last.

    The order is cut at quantiles of its first column.  The first row of every range also visits the range
    before it as a guest, so each range finds its followers by itself and no task holds the whole order."""
    key = order[0]
    parts = shuffle_width(rows.sparkSession)
    cuts = sorted({int(c) for c in rows.approxQuantile(key, [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    bucket = F.when(F.col(key).isNull(), F.lit(0)).otherwise(bucket)
    placed = rows.withColumn("__range", bucket)
    # The first row of each range, by its place in the order; there are at most `parts` of them.
    firsts = placed.groupBy("__range").agg(F.min(F.struct(F.col(key).isNotNull().alias("z"), *order)).alias("f")).orderBy("__range").collect()
    if not firsts:
        return rows.withColumn(name, carry)
    guests = [(r["f"][key], r["f"][order[1]], firsts[k - 1]["__range"]) for k, r in enumerate(firsts)]
    kinds = T.StructType([T.StructField("__k", T.LongType()), T.StructField("__h", rows.schema[order[1]].dataType), T.StructField("__to", T.IntegerType())])
    guests = F.broadcast(rows.sparkSession.createDataFrame(guests, kinds))
    visit = rows.join(guests, rows[key].eqNullSafe(guests["__k"]) & rows[order[1]].eqNullSafe(guests["__h"]))
    last = len(firsts) - 1
    visit = visit.withColumn("__turn", (F.col("__to") == firsts[last]["__range"]).cast("int") + 1)
    every = placed.withColumn("__turn", F.lit(0)).unionByName(visit.withColumnRenamed("__to", "__range").drop("__k", "__h"))
    w = Window.partitionBy("__range").orderBy("__turn", F.col(key).asc_nulls_first(), *order[1:])
    # A guest that stands for several equal rows is met once: lead takes the first of them.
    out = every.withColumn(name, F.lead(carry).over(w))
    return out.filter("__turn = 0").drop("__range", "__turn")


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = next_rows(base, ["doc_id", "h"], F.col("text"), "next")
    size = F.char_length("text")
    swap = F.floor(size / 4).cast("int")
    following = F.substring(F.col("next"), F.lit(1), swap)
    rows = rows.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.col("text").cast("binary").alias("text"),
        # the last floor(n / 4) code points go, whatever the next document has to give
        F.octet_length(F.substring(F.col("text"), F.lit(1), size - swap)).alias("keep"),
        following.cast("binary").alias("tail"),
        F.col("next").cast("binary").alias("next"),
    )
    schema = T.StructType(
        [rows.schema["doc_id"], rows.schema["n_chars"]]
        + T._parse_datatype_string("edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double").fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in document order, so the next document's fingerprint is most often that of the next row.
        for batch in batches:
            sha, own, new, near, beyond = [], [], [], [], []
            texts, keeps, tails, nexts = (batch.column(k) for k in (2, 3, 4, 5))
            known: dict[bytes, bytes] = {}
            for t, keep, tail, following in zip(texts.to_pylist(), keeps.to_pylist(), tails.to_pylist(), nexts.to_pylist()):
                fp = known.get(t) or fingerprint(t)
                after = fp if following == t else fingerprint(following)
                known = {following: after}
                changed = edited_fingerprint(fp, t, keep, tail)
                sha.append(hashlib.sha256(t[:keep] + tail).hexdigest())
                own.append(fp)
                new.append(changed)
                near.append(likeness(fp, changed))
                beyond.append(likeness(fp, after))
            cols = [pa.array(sha), pa.array(own, pa.binary()), pa.array(new, pa.binary()), pa.array(near), pa.array(beyond)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], schema.names)

    return rows.mapInArrow(run, schema)
