"""BPE by a lexicon of frequent words: a minimal acyclic transducer that gives a word's token ids.

Words are runs without a space, with the space before them; a tokenizer that never joins a space to what is before it
encodes them one by one.  All words of the corpus are counted; the most frequent ones are compiled on the driver into an
automaton that is built from sorted words, so that equal suffixes are one state, and whose outputs (id sequences) stand as
near to the start as all words that share an arc allow.  The automaton is one file of arrays.  Spark hands it to each executor
once and all its Python workers map it into memory, so they share its pages.  A batch's new words go through it
together, a byte at a time: one binary search of (state, byte) for all of them.

What the lexicon does not hold is cut by the tokenizer's own rules and merged exactly: always the pair of
least rank, of equals the leftmost, from a heap over linked symbols, in n log n steps for a word of n bytes.

Edge cases: null text is empty and has no ids; special tokens in a text are tokens, as in the tokenizers library; a text is
read whole, however long, and may be one word; rows may repeat ids or have none, each is encoded for itself; an empty
table gives an empty lexicon and result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from itertools import chain
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path

from .common import small_batches, written

#: Words of the lexicon, and bytes of its longest word: the file and the driver's work are bounded by these.
LEXICON, LONGEST = 1 << 17, 64
#: Cached words of one Python worker and their bytes; a full cache starts anew.
CACHE_WORDS, CACHE_BYTES = 300_000, 8_000_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 19
#: Distinct words that a counting task holds, and characters that it reads in between.
COUNTED, COUNTED_CHARS = 200_000, 32 << 20
#: A space beside other white space, where a word's cut must be looked for.
_UNEVEN = re.compile(r" \s|\s ").search
_CUTS = re.compile(r"(?<=\S)(?= \S)").split
#: The rule of the tokenizer for text of ASCII and Latin-1 letters; other text is cut by the tokenizer itself.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\x09-\x0d\x20-\x7e{_LATIN}]*").fullmatch
_SIMPLE = re.compile(f" ?[\x21-\x7e{_LATIN}]+").fullmatch
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\x09-\x0d\x20{_LATIN}0-9]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+").findall


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(0x100 + hidden.index(b)) for b in range(256)}


def packed_ids(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers: small objects that need no garbage collection and join fast."""
    return np.asarray(ids, "<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Merger:
    """Exact byte-pair merging under the ranks of a tokenizer file.

    Words are merged together, a round at a time: in each word every leftmost occurrence of its pair of least rank.
    That equals one merge after another, because merging makes pairs of higher rank only.  A long word is merged alone,
    from a heap over linked symbols."""

    BITS, SLOTS, LONG, FEW = 20, 18, 64, 64
    NONE = np.iinfo(np.int64).max

    def __init__(self, spec: dict):
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.single = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rules = {vocab[a] << self.BITS | vocab[b]: rank << self.BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.tables = list(self._tables())

    def _tables(self) -> Iterator[tuple[np.uint64, np.ndarray, np.ndarray]]:
        """Hash tables of the rules, without probing: what finds its slot taken goes to the next table."""
        keys = np.fromiter(self.rules, np.int64, len(self.rules))
        values = np.fromiter(self.rules.values(), np.int64, len(self.rules))
        for k in range(64):
            if len(keys):
                odd = np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
                slot = self._slots(keys, odd)
                _, first = np.unique(slot, return_index=True)
                key, value = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, np.int64)
                key[slot[first]], value[slot[first]] = keys[first], values[first]
                yield odd, key, value
                keys, values = np.delete(keys, first), np.delete(values, first)

    def _slots(self, keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * odd) >> np.uint64(64 - self.SLOTS)).view(np.int64)

    def rules_of(self, ids: np.ndarray) -> np.ndarray:
        """The rule of each id with the next one; NONE where there is none."""
        pair = ids[:-1] << self.BITS | ids[1:]
        out = np.full(len(ids), self.NONE)
        for odd, key, value in self.tables:
            slot = self._slots(pair, odd)
            hit = np.flatnonzero(key[slot] == pair)
            out[hit] = value[slot[hit]]
        return out

    def merge(self, word: bytes) -> bytes:
        return packed_ids(self._merge_one(self.single[list(word)].tolist()))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed."""
        out: list = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > self.LONG or not w:
                out[k] = self.merge(w)
            else:
                short.append(k)
        ids = self.single[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(words[k]) for k in short])
        mask, done = (1 << self.BITS) - 1, []
        while len(ids) > self.FEW:
            rule = self.rules_of(ids)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rule[first[1:] - 1] = self.NONE  # no pair across two words
            size = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rule, first), size)
            open_ = least != self.NONE
            if not open_.all():
                done.append((word[~open_], ids[~open_]))
                ids, word, rule, least = ids[open_], word[open_], rule[open_], least[open_]
                if not len(ids):
                    break
            merged = rule == least
            # of a run of one pair, as in a run of one letter, every second one
            places = np.arange(len(ids))
            starts = merged & ~np.append(False, merged[:-1])
            merged &= (places - np.maximum.accumulate(np.where(starts, places, 0))) % 2 == 0
            ids = np.where(merged, rule & mask, ids)
            stay = ~np.append(False, merged[:-1])
            ids, word = ids[stay], word[stay]
        if len(ids):
            cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                out[int(word[lo])] = packed_ids(self._merge_one(ids[lo:hi].tolist()))
        for word, ids in done:
            cut = np.flatnonzero(np.append(True, word[1:] != word[:-1])).tolist()
            flat = packed_ids(ids)
            for w, lo, hi in zip(word[cut].tolist(), cut, [*cut[1:], len(ids)]):
                out[w] = flat[4 * lo : 4 * hi]
        return out

    def _merge_one(self, ids: list[int]) -> list[int]:
        if len(ids) > self.LONG:
            return self._merge_long(ids)
        bits, rule, none = self.BITS, self.rules.get, self.NONE
        ranks = [rule(a << bits | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            k = ranks.index(low)
            new = ids[k] = low & (1 << bits) - 1
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rule(new << bits | ids[k + 1], none)
            if k:
                ranks[k - 1] = rule(ids[k - 1] << bits | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        bits, rule, mask = self.BITS, self.rules.get, (1 << self.BITS) - 1
        right, left = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r >> bits, k, ids[k], ids[k + 1], r & mask) for k in range(len(ids) - 1) if (r := rule(ids[k] << bits | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j], right[k] = new, -1, right[j]
            if right[k] < len(ids):
                left[right[k]] = k
            for i in (left[k], k):
                if i >= 0 and right[i] < len(ids) and (r := rule(ids[i] << bits | ids[right[i]])) is not None:
                    heapq.heappush(heap, (r >> bits, i, ids[i], ids[right[i]], r & mask))
        return [i for i in ids if i >= 0]


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte -> [state, output]; the last one added may still change
        self.final: tuple | None = None

    def key(self):
        return self.final, tuple((b, id(t), o) for b, (t, o) in self.arcs.items())


def compile_words(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> _State:
    """The minimal transducer of sorted, distinct ``(word, ids)``.

    Only the states of the last word can change; a state that the next word leaves is replaced by its equal if there
    is one.  Outputs move towards the start while words share an arc: what they do not share is pushed on."""
    register: dict = {}

    def settle(state: _State) -> _State:
        return register.setdefault(state.key(), state)

    path, last = [_State()], b""
    for word, ids in entries:
        keep = _shared(last, word)
        for k in range(len(last), keep, -1):
            path[k - 1].arcs[last[k - 1]][0] = settle(path[k])
        del path[keep + 1 :]
        rest = tuple(ids)
        for k in range(keep):
            arc = path[k].arcs[word[k]]
            n = _shared(arc[1], rest)
            if tail := arc[1][n:]:
                below = path[k + 1]
                for onward in below.arcs.values():
                    onward[1] = tail + onward[1]
                if below.final is not None:
                    below.final = tail + below.final
                arc[1] = arc[1][:n]
            rest = rest[n:]
        for k in range(keep, len(word)):
            path.append(_State())
            path[k].arcs[word[k]] = [path[k + 1], rest]
            rest = ()
        path[-1].final = rest  # what is left: all of it where the word is the beginning of an earlier arc's
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[last[k - 1]][0] = settle(path[k])
    return path[0]


_PARTS = ("keys", "target", "at", "size", "final_at", "final_size", "pool")
_TYPES = ("<i8", "<u4", "<u4", "<u2", "<u4", "<i4", "<u4")


def pack(root: _State) -> bytes:
    """The transducer as one file: a line of JSON with the arrays' lengths, then the arrays.

    ``keys`` holds state * 256 + byte of all arcs in order; a state that is not final has size -1."""
    number, todo = {id(root): 0}, [root]
    for state in todo:
        for t, _ in state.arcs.values():
            if id(t) not in number:
                number[id(t)] = len(todo)
                todo.append(t)
    where: dict[tuple, int] = {(): 0}
    pool: list[int] = []

    def place(ids: tuple) -> int:
        if ids not in where:
            where[ids] = len(pool)
            pool.extend(ids)
        return where[ids]

    columns: list[list[int]] = [[] for _ in range(6)]
    for n, state in enumerate(todo):
        for b, (t, out) in sorted(state.arcs.items()):
            for column, v in zip(columns, (n << 8 | b, number[id(t)], place(out), len(out))):
                column.append(v)
        columns[4].append(place(state.final or ()))
        columns[5].append(-1 if state.final is None else len(state.final))
    arrays = [np.array(c, t) for c, t in zip([*columns, pool], _TYPES)]
    head = (json.dumps([len(a) for a in arrays]) + "\n").encode()
    return head + b"\0" * (-len(head) % 8) + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Transducer:
    """A packed transducer over any buffer, for instance a mapped file."""

    def __init__(self, buffer):
        end = buffer[:400].index(b"\n") + 1
        at = end + -end % 8
        for name, kind, n in zip(_PARTS, _TYPES, json.loads(buffer[: end - 1])):
            a = np.frombuffer(buffer, kind, n, at)
            at += a.nbytes + -a.nbytes % 8
            setattr(self, name, a)

    @classmethod
    def mapped(cls, path: str) -> "Transducer":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word; None for those that are not in the lexicon."""
        out: list = [None] * len(words)
        short = np.array([k for k, w in enumerate(words) if 0 < len(w) <= LONGEST], np.int64)
        if not len(short) or not len(self.keys):
            return out
        size = np.array([len(words[k]) for k in short.tolist()], np.int64)
        flat = np.frombuffer(b"".join(words[k] for k in short.tolist()), np.uint8)
        start = np.cumsum(size) - size
        alive, state, ends, paths = np.arange(len(short)), np.zeros(len(short), np.int64), [], []
        for step in range(int(size.max())):
            key = state << 8 | flat[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            state = self.target[arc].astype(np.int64)
            paths.append((alive, arc))
            ended = (size[alive] == step + 1) & (self.final_size[state] >= 0)
            ends.append((alive[ended], state[ended]))
            going = size[alive] > step + 1
            alive, state = alive[going], state[going]
        found, last = (np.concatenate(x) for x in zip(*ends))
        if not len(found):
            return out
        # outputs of the arcs that found words went over, then those of their last states, in order
        took = np.zeros(len(short), bool)
        took[found] = True
        who, at, n = [], [], []
        for words_at, arcs in paths:
            told = took[words_at] & (self.size[arcs] > 0)
            who.append(words_at[told])
            at.append(self.at[arcs[told]])
            n.append(self.size[arcs[told]])
        who, at, n = (np.concatenate([*x, y]).astype(np.int64) for x, y in ((who, found), (at, self.final_at[last]), (n, self.final_size[last])))
        order = np.argsort(who, kind="stable")
        who, at, n = who[order], at[order], n[order]
        stop = np.cumsum(n)
        ids = packed_ids(self.pool[np.arange(stop[-1]) + np.repeat(at - stop + n, n)])
        cut = np.flatnonzero(np.append(who[1:] != who[:-1], True))
        lo = 0
        for k, hi in zip(short[who[cut]].tolist(), stop[cut].tolist()):
            out[k] = ids[4 * lo : 4 * hi]
            lo = hi
        return out

    @property
    def n_states(self) -> int:
        return len(self.final_size)


class Encoder:
    """Token ids of whole texts, as the tokenizers library has them for byte-level BPE without special tokens added."""

    def __init__(self, tokenizer: str, transducer: Transducer | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger, self.transducer = Merger(spec), transducer
        self.cut = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        letters = {c: b for b, c in byte_letters().items()}
        # a token that is not spelt in byte letters stands for itself
        spelt = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        names = {i: t for t, i in {**spec["model"]["vocab"], **added}.items()}
        self.bytes_of = [spelt(names.get(i, "")) for i in range(max(names) + 1)]
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {t: packed_ids([i]) for t, i in self.special.items()}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def cuts(self, words: list[str]) -> list[list[str]]:
        """The tokenizer's own pieces of each word.  Words without other white space than a first space are cut together: a line end
        before each is a piece of its own."""
        out: list = [None] * len(words)
        simple = [k for k, w in enumerate(words) if _SIMPLE(w)]
        pieces = _RUNS("\n".join([words[k] for k in simple]))
        ends = [k for k, p in enumerate(pieces) if p == "\n"]
        for k, lo, hi in zip(simple, [-1, *ends], [*ends, len(pieces)]):
            out[k] = pieces[lo + 1 : hi]
        for k, w in enumerate(words):
            if out[k] is None:
                out[k] = _RUNS(w) if _PLAIN(w) else [w[a:b] for _, (a, b) in self.cut(w)]
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word by the tokenizer's cuts and exact merging."""
        cut = self.cuts(words)
        known = self.pieces
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, self.merger.merge_all([p.encode("utf-8", "replace") for p in new])))
        out = [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in cut]
        for p in new:
            self.held += len(p)
            if len(p) > LONGEST:
                del known[p]
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of new words: those of the lexicon from the transducer, others merged."""
        known = self.transducer.look_up([w.encode("utf-8", "replace") for w in words]) if self.transducer else [None] * len(words)
        rest = [w for w, ids in zip(words, known) if ids is None]
        self.words.update(zip(words, known))
        self.words.update(zip(rest, self.merged(rest)))
        self.held += sum(map(len, words)) + 8 * len(words)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.encode_all([text])[0])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the new words of all of them go through the transducer together."""
        if len(self.words) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        cut = [self.parts(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.words)
        if new:
            self.learn(list(new))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in cut]

    def parts(self, text: str) -> list[str]:
        """Words of a text; special tokens are words that are never cut."""
        if not text:
            return []
        if "<" in text and any(s in text for s in self.special):
            return list(chain.from_iterable([p] if p in self.special else cut_words(p) for p in self.split_special(text) if p))
        return cut_words(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def cut_words(text: str) -> list[str]:
    """A text cut before each space that stands between two characters that are no white space."""
    if text[0].isspace() or text[-1].isspace() or _UNEVEN(text):
        return _CUTS(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; a task adds up before it shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        read = 0

        def flush():
            short = [(w, n) for w, n in seen.items() if len(w) < LONGEST]  # a longer one is never in the lexicon
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                seen.update(text.split())
                read += len(text)
                if len(seen) > COUNTED or read > COUNTED_CHARS:
                    yield flush()
                    read = 0
        if seen:
            yield flush()

    found = small_batches(docs).filter(F.col(text_col).isNotNull()).select(F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """At most ``size`` words of the most frequent: all that occur more often than the least count for which that holds.

    The driver sees the number of words for each count up to 4096, and for each 64th of a power of two beyond."""
    level = F.when(F.col("n") <= 4096, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 64) * 100.0)
    counts = counts.withColumn("level", level)
    kept, floor = 0, float("inf")
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        kept += r["words"]
        if kept > size:
            break
        floor = r["level"]
    return sorted(r["word"] for r in counts.filter(F.col("level") >= floor).select("word").collect())


def build(docs: DataFrame, tokenizer: str, size: int = LEXICON, text_col: str = "text") -> bytes:
    """The packed transducer of the most frequent words of ``docs``, at most ``size``, each with the space before it.

    The driver gets at most ``size`` words of at most ``LONGEST`` bytes."""
    encoder = Encoder(tokenizer)
    words = frequent_words(written(word_counts(docs, text_col), "word-counts"), size)
    spaced = [" " + w for w in words]
    entries = sorted((w.encode(), tuple(unpacked(ids))) for w, ids in zip(spaced, encoder.merged(spaced)))
    return pack(compile_words([e for e in entries if len(e[0]) <= LONGEST]))


def share(spark: SparkSession, packed: bytes) -> str:
    """Writes the file to the shared folder, from which each executor fetches it once, and gives its name there."""
    path = scratch_path(spark, "llm-lexicon") + ".bin"
    name = path.rsplit("/", 1)[1]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(packed))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, name: str) -> Encoder:
    """One encoder for each Python worker, over the mapped file of its executor."""
    if (tokenizer, name) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, name] = Encoder(tokenizer, Transducer.mapped(SparkFiles.get(name)))
    return _ENCODERS[tokenizer, name]


def encode(docs: DataFrame, tokenizer: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every text, little-endian unsigned 32-bit, as binary."""
    return _mapped(docs, tokenizer, name, id_col, text_col, "ids binary", lambda enc, ids: (ids,))


def decode(rows: DataFrame, tokenizer: str, name: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): what binary ids, as ``encode`` gives them, stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, name)
        for batch in batches:
            texts = [enc.decode(unpacked(b.as_py() or b"")) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return small_batches(rows).select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text that they decode to."""

    def digests(enc: Encoder, packed: bytes) -> tuple:
        ids = unpacked(packed)
        decimal = ",".join(map(enc.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(enc.decode(ids).encode("utf-8", "replace")).hexdigest()

    return _mapped(docs, tokenizer, name, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, tokenizer: str, name: str, id_col: str, text_col: str, fields: str, of) -> DataFrame:
    added = T.StructType.fromDDL(fields)
    types = [{"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, name)
        for batch in batches:
            rows, some, size = [], [], 0
            for k, t in enumerate(batch.column(1)):
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size > TOGETHER or k == batch.num_rows - 1:
                    rows += [of(enc, ids) for ids in enc.encode_all(some)]
                    some, size = [], 0
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *added.names])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *added])
    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document encoded and decoded with a lexicon of the most frequent words of all of them."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(docs, tokenizer, share(docs.sparkSession, build(docs, tokenizer)))
