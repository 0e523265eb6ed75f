"""Stages of the pipeline against brute force on a small corpus, and the whole run."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemark.llm import mixing, simhash

LANGS = {"en": "the of and to in is that for with are".split(), "fr": "le la les des que dans est pour une avec".split(), "de": "der die und das ist nicht ein mit auf für".split()}


def text(r, lang, n):
    base = LANGS[lang]
    return " ".join(r.choice(base) if r.random() < 0.4 else "".join(r.choice(base) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for i in range(90):
        lang = r.choice(sorted(LANGS))
        out.append([i, text(r, lang, r.randrange(60, 200)), lang, r.choice(["a", "a", "b", None])])
    out[40][1] = out[3][1]  # an exact copy
    words = out[5][1].split()
    words[10] = "changed"
    out[41][1] = " ".join(words)  # a near copy
    passage = out[7][1].split()[:60]
    out[50][1] = out[50][1] + "\n" + " ".join(passage)
    out += [[200, None, "en", "a"], [201, "", None, "b"], [202, "12345 !!", "en", "a"], [203, "the end", "en", "b"]]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    return df.repartition(3).cache()


def test_language_keeps_clean_documents(spark, docs, rows):
    got = {x.doc_id: x for x in C.language(spark, docs, "").collect()}
    assert set(got) == {i for i, *_ in rows} - {200, 201, 202}
    assert sum(got[i].lang == lang for i, _, lang, *_ in rows if i in got) >= 0.97 * len(got)


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    fp = {i: simhash.fingerprint((t or "").encode(), 5) for i, t, *_ in rows}
    first = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= C.NEAR_BITS and first[b] < first[a]:
                    first[a], changed = first[b], True
    want = {i for i in fp if first[i] == i}
    got = [x.doc_id for x in C.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    assert 40 not in got and 41 not in got


def test_near_duplicates_keep_null_ids(spark, docs, rows):
    t, u = rows[0][1], text(random.Random(12), "en", 90)
    more = [(None, t), (None, u), (None, u), (None, u.replace(u.split()[0], "other", 1)), (300, u[::-1]), (None, u[::-1] + " ")]
    df = docs.unionByName(spark.createDataFrame([(i, x, "en", "a", len(x), "y") for i, x in more], docs.schema))
    before = Counter(x.doc_id for x in C.near_duplicates(spark, docs, "").collect())
    got = C.near_duplicates(spark, df, "").collect()
    assert Counter(x.doc_id for x in got) == before + Counter({None: 1, 300: 1})
    kept = [x.text for x in got if x.doc_id is None]
    assert kept[0] in (more[1][1], more[3][1])


def test_passages_go_from_the_later_document(spark, docs, rows):
    by = {i: t for i, t, *_ in rows}
    got = {x.doc_id: x for x in C.passages(spark, docs.filter("doc_id not in (40, 41)"), "").collect()}
    assert set(got) == set(by) - {40, 41}
    assert got[50].text.split() == by[50].split()[:-60] and got[50].n_chars == len(got[50].text)
    assert all(got[i].text == by[i] for i in got if i != 50)


def test_mix_repeats_documents(spark, docs):
    plan = {x.doc_id: x.copies for x in mixing.mix_documents(docs).collect()}
    got = Counter(x.doc_id for x in C.mix(spark, docs, "").collect())
    assert got == Counter({i: n for i, n in plan.items() if n})


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == C.COLUMNS, name
    want = now.groupBy("doc_id").count().collect()
    got = C.run(spark, f"file://{tmp_path}")
    assert Counter({x.doc_id: x["count"] for x in want}) == Counter(x.doc_id for x in got.filter("piece = 0").collect())
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert full.filter("n <> e or n > 2048").count() == 0


def test_empty(spark, docs):
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
