"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of order 0 to ``order``.  A context with n following bytes of
u kinds codes a seen byte with its count over n + u and an escape with u over n + u; after an escape the
shorter context codes the byte with the bytes already ruled out removed, down to a uniform code below
order 0.  Statistics are frozen after training, so the cost of a byte is a function of the byte and the
``order`` bytes before it, and a tree compiles to one table of exact code lengths.  A text is scored by the
sum of its code lengths; the language with the shortest code wins and its score is the posterior under
equal priors.

Training is bounded: at most about ``sample`` documents of a language, taken whole by a hash of their
id, whatever the size of the corpus.  The alphabet has ``symbols`` byte classes: the most frequent bytes
(ASCII letters folded to lower case) have one each, all others share the last, which then costs a uniform
choice among them.

Edge cases: null text and text without a letter is ``und`` with score 0; with no labelled row everything
is ``und``; languages tie to the first by code point; repeated rows are scored each for itself; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

ORDER = 3
SYMBOLS = 40
SAMPLE = 1500
#: Bytes scored at once.
BLOCK = 1 << 19

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def trained_on(id_col: str, folds: int = 5) -> Column:
    """Rows to learn from: all folds but fold 0 of the CRC-32 of the id as text."""
    return F.coalesce(held_out(id_col, folds) == F.lit(False), F.lit(False))


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def sample_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): about ``sample`` labelled documents of each language, by a hash of the id."""
    rows = docs.filter(trained_on(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(0)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(sample / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    return rows.filter(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def _classes(text: bytes, classes: np.ndarray) -> np.ndarray:
    return classes[np.frombuffer(text.translate(_FOLD), np.uint8)]


def grams(data: np.ndarray, order: int, symbols: int) -> np.ndarray:
    """For each byte the index of (the ``order`` bytes before it, itself).  ``data`` has ``order`` leading symbols."""
    n = len(data) - order
    out = np.zeros(n, np.int32)
    for k in range(order + 1):
        out *= symbols
        out += data[k : k + n]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, symbols: int = SYMBOLS, sample: int = SAMPLE) -> dict:
    """Frozen statistics: languages, byte classes and the counts of (context, byte) of the longest order.

    The counts come to the driver once each: at most symbols ** (order + 1) for a language, of a bounded sample."""
    rows = written(sample_rows(docs, id_col, text_col, lang_col, sample), "language-sample")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen += np.bincount(np.frombuffer(t.translate(_FOLD), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(seen)], ["byte", "n"])

    totals = rows.select(F.col("text").cast("binary")).mapInArrow(bytes_of, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    ranked = sorted((-r.n, r.byte) for r in totals if r.n)
    classes = np.full(256, symbols - 1, np.uint8)
    for k, (_, b) in enumerate(ranked[: symbols - 1]):
        classes[b] = k
    classes[65:91] = classes[97:123]  # folded before they are looked up

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in waiting.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])
            waiting.clear()

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(_classes(b" " * order + t, classes), order, symbols)
                waiting.setdefault(lang, []).append(found)
                size += len(found)
                if size > 1 << 21:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = rows.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, gram int, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    which = np.array([langs.index(x) for x in table.column("lang").to_pylist()], np.int16)
    return {
        "langs": langs,
        "classes": classes,
        "order": order,
        "symbols": symbols,
        "lang": which,
        "gram": table.column("gram").to_numpy().astype(np.int32),
        "n": table.column("n").to_numpy(),
    }


def code_lengths(counts: np.ndarray, order: int, symbols: int, shared: int) -> np.ndarray:
    """Bits of every (context, byte) of one language, flat.  ``shared``: bytes in the last class."""
    below = np.full((1, symbols), 1.0 / symbols, np.float32)
    for k in range(order + 1):
        n = counts.reshape(-1, symbols**k, symbols).sum(axis=0)  # a context is its last k bytes
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        lower = np.tile(below, (symbols, 1)) if k else below
        seen = n > 0
        rest = 1.0 - np.where(seen, lower, 0.0).sum(axis=1, keepdims=True)
        escape = np.where(kinds == symbols, 0.0, kinds / np.maximum(total + kinds, 1.0))
        escape = np.where(total == 0, 1.0, escape)
        kept = np.where(kinds == symbols, total, total + kinds)
        below = np.where(seen, n / np.maximum(kept, 1.0), escape * lower / np.maximum(rest, 1e-6)).astype(np.float32)
    bits = -np.log2(np.maximum(below, 1e-30))
    bits[:, symbols - 1] += np.log2(max(shared, 1))
    return bits.astype(np.float32).ravel()


def compiled(model: dict) -> np.ndarray:
    """Code lengths as a table (context and byte, language)."""
    size = model["symbols"] ** (model["order"] + 1)
    shared = int((model["classes"] == model["symbols"] - 1).sum())
    out = np.empty((size, len(model["langs"])), np.float32)
    for k in range(len(model["langs"])):
        mine = model["lang"] == k
        counts = np.zeros(size, np.float32)
        counts[model["gram"][mine]] = model["n"][mine]
        out[:, k] = code_lengths(counts, model["order"], model["symbols"], shared)
    return out


_TABLES: dict[int, np.ndarray] = {}


def score(text: bytes, table: np.ndarray, model: dict) -> np.ndarray:
    """Bits of the whole text under each language."""
    order = model["order"]
    total = np.zeros(table.shape[1])
    for k in range(0, len(text), BLOCK):
        piece = text[max(0, k - order) : k + BLOCK]
        data = _classes(b" " * max(0, order - k) + piece, model["classes"])
        total += table[grams(data, order, model["symbols"])].sum(axis=0, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id and ``carry`` columns with lang_pred, score and bits_per_byte of the whole text."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), hash((model["gram"].tobytes(), model["n"].tobytes(), model["lang"].tobytes()))
    kept = [id_col, *carry]
    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string("lang_pred string, score double, bits_per_byte double").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m["langs"] and key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = compiled(m)
        table = _TABLES.get(key)
        for batch in batches:
            lang, sure, rate = [], [], []
            texts, letters = batch.column(len(kept)), batch.column(len(kept) + 1)
            for t, letter in zip(texts, letters.to_pylist()):
                if not letter or not m["langs"]:
                    lang.append("und")
                    sure.append(0.0)
                    rate.append(None)
                    continue
                b = t.as_buffer().to_pybytes()
                bits = score(b, table, m)
                best = int(np.argmin(bits))
                lang.append(m["langs"][best])
                sure.append(float(1.0 / np.exp2(np.minimum(bits[best] - bits, 0.0)).sum()))
                rate.append(float(bits[best] / len(b)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(rate, pa.float64())], schema.names)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return small_batches(docs).select(*kept, F.col(text_col).cast("binary").alias("__text"), letter.alias("__letter")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the model learns from the other folds."""
    rows = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
