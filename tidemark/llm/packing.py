"""Best-fit packing planned on the histogram of lengths.

The plan never sees a document: best-fit decreasing runs over (length, count) and keeps groups of equally
filled sequences as intervals, so its work and size depend on the number of distinct lengths (at most the
capacity), not on the corpus.  Every piece then takes the slot that the plan has for its rank within its
length: an equi-join on (length, rank).

Edge cases: null text is empty; every document has at least its end token, so it yields at least one piece;
only documents longer than the capacity are cut; ids may be null or repeated, each row is packed for itself;
an empty table gives an empty result; other columns of the pieces pass through.
"""

from __future__ import annotations

import bisect
import os
import re
from array import array
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

CAPACITY = 2048
#: Cached parts of texts of one Python worker; a full cache starts anew.
CACHE_PARTS, CACHE_BYTES = 400_000, 8_000_000
#: The tokenizer's own runs, as they are within plain lower-case text.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\x09-\x0d\x20{_LETTERS}0-9]+").findall
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
CHUNK = 1 << 17


class Segment(NamedTuple):
    """``count`` pieces of one length, from rank ``rank`` on: piece t goes to sequence first + t // per,
    at offset + (t % per) * length."""

    length: int
    rank: int
    count: int
    first: int
    per: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Best-fit decreasing over counts: longest lengths first, each into the fullest sequences that hold it."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> intervals (first sequence, how many)
    keys: list[int] = []
    out: list[Segment] = []
    sequences = 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(keys, free)
                room[free] = []
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(keys, length)
            if k == len(keys):
                n = -(-left // (capacity // length))
                put(capacity, sequences, n)
                sequences += n
                continue
            free = keys[k]
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
                keys.pop(k)
            per = free // length
            full = min(n, left // per)
            if full:
                out.append(Segment(length, rank, full * per, first, per, capacity - free))
                put(free - per * length, first, full)
                rank += full * per
                left -= full * per
            if full < n and left:
                out.append(Segment(length, rank, left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                full, left = full + 1, 0
            put(free, first + full, n - full)
    return out


def best_fit_pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  Lengths lie between 1 and ``capacity``.

    The rows are written once with the task and place that made them; a rank within a length is the rank
    within (length, task) plus the count of earlier tasks, so no task ever holds a whole length."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")  # columns of these names give way to the result
    rows = written(pieces.withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id()), "pieces")
    per_task = rows.groupBy(length, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(length).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(length, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}  # at most `capacity` rows
    # A long segment is planned in chunks so that no task expands it alone.
    plan = []
    for s in best_fit(counts, capacity):
        step = max(1, CHUNK // s.per) * s.per
        for t in range(0, s.count, step):
            plan.append((s.length, s.rank + t, min(step, s.count - t), s.first + t // s.per, s.per, s.offset))
    plan = spark.createDataFrame(plan, "len int, rank long, n long, first long, per long, at long")
    slots = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t")).select(
        F.col("len").alias(length),
        (F.col("rank") + F.col("t")).alias("__rank"),
        (F.col("first") + F.floor(F.col("t") / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.col("t") % F.col("per") * F.col("len")).alias("offset"),
    )
    local = F.row_number().over(Window.partitionBy(length, "__part").orderBy("__pos")) - 1
    ranked = rows.withColumn("__local", local).join(base, [length, "__part"]).withColumn("__rank", F.col("__local") + F.col("__base"))
    return ranked.join(slots, [length, "__rank"]).drop("__rank", "__local", "__base", "__part", "__pos")


class WordEncoder:
    """Token ids of whole texts through a cache.

    The tokenizer drops white space and lets no token span it, so the ids of a text are those of its parts in
    a row.  A plain text (printable ASCII, Latin-1 letters and the six white-space characters, no special token) is cut
    into the pre-tokenizer's own runs, and the tokenizer's model merges each new run once; another text is cut
    into words, and the whole tokenizer encodes each new word once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # How the tokenizer spells the bytes of each plain letter beyond ASCII.
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelt = {ord(c): "".join(part for part, _ in spell(c)) for c in letters}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | bytes, int] = {}  # runs are str, words bytes
        self.bytes = 0
        self.flat, self.start = array("I"), array("q", [0])

    def _learn(self, parts) -> None:
        words, index, flat, start, merge, spelt = [], self.index, self.flat, self.start, self.tokenizer.model.tokenize, self.spelt
        for p in parts:
            if isinstance(p, str):
                flat.extend([t.id for t in merge(p if p.isascii() else p.translate(spelt))])
                start.append(len(flat))
                index[p] = len(index)
            else:
                words.append(p)
            self.bytes += len(p)
        for k in range(0, len(words), 2048):
            some = words[k : k + 2048]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                flat.extend(e.ids)
                start.append(len(flat))
                index[w] = len(index)

    def encode(self, text: bytes) -> np.ndarray:
        if len(self.index) > CACHE_PARTS or self.bytes > CACHE_BYTES:
            self.clear()
        line = text.decode("utf-8", "replace")
        parts = _RUNS(line.lower()) if _PLAIN(line) and "<|" not in line else text.split()
        found = list(map(self.index.get, parts))
        if None in found:
            new = [i for i, k in enumerate(found) if k is None]
            self._learn(dict.fromkeys([parts[i] for i in new]))
            for i in new:
                found[i] = self.index[parts[i]]
        which = np.array(found, np.int64)
        start = np.frombuffer(self.start, np.int64)
        first = start[which]
        size = start[which + 1] - first
        ends = np.cumsum(size)
        place = np.repeat(first - ends + size, size)
        place += np.arange(len(place))
        return np.frombuffer(self.flat, np.uint32)[place] if len(place) else np.empty(0, np.uint32)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which Spark reuses for many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, as binary).

    ``tokenizer`` is the path of a tokenizer file that every executor can read; the tokenizer must drop
    white space and give a special meaning to no text that holds any."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            took, piece, start, length, ids = [], [], [], [], []

            def flush():
                cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), *cols], ["doc_id", "piece", "start", "length", "ids"])
                for x in (took, piece, start, length, ids):
                    x.clear()
                return out

            size = 0
            texts = batch.column(1)
            for row in range(batch.num_rows):
                t = texts[row].as_buffer()
                tokens = np.append(enc.encode(t.to_pybytes() if t is not None else b""), np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[a : a + capacity]
                    took.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    ids.append(part.tobytes())
                size += 4 * len(tokens)
                if size > 1 << 23:
                    yield flush()
                    size = 0
            if took:
                yield flush()

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``; the ids are carried as their checksum only."""
    import public_tokenizers

    pieces = token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity=capacity)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = best_fit_pack(slim, "length", capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
