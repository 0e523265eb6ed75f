import hashlib
import json
import random
import string

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "it's we'll I'M don't'", "x\n\n y\t z  ", "é à ü ß ÿ × ÷ ª º µ ² ½", "日本語 テスト", "a b  c", "x\x1c y \x1f", "﻿BOM",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "< |endoftext|>", "<|endoftext|", "emoji 😀😀 👩‍👩‍👧", "é ́x", "١٢٣ 123abc", "\x00\x01\x02", "a" * 5000, "ab" * 3000 + " end",
    " " * 3000, "\n \n \n", "x" + " " * 7 + "y", "1,000.5% (ok) [no] {x} #$%", "՘֋ ꟎", "tab\tsep \t x", "᠎ ​ z", "\x85 next line",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text, add_special_tokens=False).ids


def nerode_states(entries):
    """States of the minimal transducer with outputs as early as possible: distinct residual functions."""

    def common(outs):
        n = 0
        while all(len(o) > n for o in outs) and len({o[n] for o in outs}) == 1:
            n += 1
        return n

    found = set()
    for word, _ in entries:
        for k in range(len(word) + 1):
            rest = [(w[k:], o) for w, o in entries if w[:k] == word[:k]]
            cut = common([o for _, o in rest]) if k else 0
            found.add(tuple((w, o[cut:]) for w, o in rest))
    return len(found)


def count_states(root):
    seen, todo = {id(root)}, [root]
    for s in todo:
        for t, _ in s.arcs.values():
            if id(t) not in seen:
                seen.add(id(t))
                todo.append(t)
    return len(todo)


def test_transducer_gives_outputs_and_is_minimal():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 30, 200):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 6))).encode() for _ in range(n)}
        entries = sorted((w, tuple(rng.choices(range(3), k=rng.randint(0, 4)))) for w in words)
        root = lexicon.compile_words(entries)
        t = lexicon.Transducer(lexicon.pack(root))
        asked = [w for w, _ in entries] + [b"", b"zz", b"a" * 100] + ["".join(rng.choices("abc", k=rng.randint(1, 7))).encode() for _ in range(100)]
        table = {w: lexicon.packed_ids(o) for w, o in entries}
        assert t.look_up(asked) == [table.get(w) for w in asked]
        if n:
            assert count_states(root) == nerode_states(entries)


def test_suffixes_are_shared():
    words = [(a + b"ing", (k,)) for k, a in enumerate(sorted({bytes([x, y]) for x in b"abcdef" for y in b"abcdef"}))]
    assert count_states(lexicon.compile_words(words)) == 1 + 6 + 4


def test_merger_equals_the_library(library):
    rng = random.Random(4)
    merger = lexicon.Merger(json.load(open(PATH)))
    letters, words, wanted = lexicon.byte_letters(), [], []
    alphabets = [string.ascii_lowercase, "aab", " the", "=-", "éàü日", string.printable]
    for n in (1, 2, 3, 8, 39, 63, 64, 65, 200, 4000):
        for a in alphabets:
            word = "".join(rng.choices(a, k=n)).encode()
            want = [t.id for t in library.model.tokenize("".join(letters[b] for b in word))]
            assert lexicon.unpacked(merger.merge(word)) == want
            words.append(word)
            wanted.append(want)
    for _ in range(3):
        assert list(map(lexicon.unpacked, merger.merge_all(words))) == wanted
        words, wanted = words + words[::-1], wanted + wanted[::-1]
    assert merger.merge_all([]) == []


def test_encoder_without_lexicon_on_odd_texts(library):
    enc = lexicon.Encoder(PATH)
    rng = random.Random(8)
    pool = [*" \n\t'", " ", " ", "s", "ab", "É", "9", "!", " ", "字", "<|endoftext|>", "'ll", "\x1c"]
    for text in ODD + ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(1500)]:
        ids = enc.encode(text)
        assert ids == expected(library, text), repr(text)
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()


def want(library, text):
    ids = expected(library, text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in lexicon.encode_documents(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and got == {r[0]: want(library, r[1]) for r in rows}


def test_edge_rows_and_small_lexicon(spark, library):
    texts = ODD + [None, None, "word " * 30_000, "same words here", "same words here"]
    rows = [(k if k % 5 else None, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int")
    name = lexicon.share(spark, lexicon.build(docs, PATH, size=7))
    got = sorted(map(repr, map(tuple, lexicon.round_trip(docs, PATH, name).collect())))
    assert got == sorted(repr((r[0], *want(library, r[1]))) for r in rows)
    back = lexicon.decode(lexicon.encode(docs, PATH, name), PATH, name).collect()
    assert sorted((repr(r[0]), r[1]) for r in back) == sorted((repr(r[0]), r[1] or "") for r in rows)
    empty = docs.limit(0)
    assert lexicon.encode_documents(empty).collect() == []


def test_lexicon_holds_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(1, "b b b a a c"), (2, "a b\nd"), (3, None)], "doc_id long, text string")
    t = lexicon.Transducer(lexicon.build(docs, PATH, size=2))
    assert [x is not None for x in t.look_up([b" a", b" b", b" c", b" d"])] == [True, True, False, False]
    assert {r["word"]: r["n"] for r in lexicon.word_counts(docs).collect()} == {"a": 3, "b": 4, "c": 1, "d": 1}
