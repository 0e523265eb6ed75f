"""Homomorphic fingerprints: order, insertion, deletion, likeness, and the edited documents row by row."""

import hashlib
import random

from tidemark.llm import multiset as M


def test_order_insertion_and_deletion():
    r = random.Random(1)
    lines = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randrange(12))).encode() for _ in range(30)]
    fp = M.fingerprint(b"\n".join(lines))
    mixed = lines[:]
    r.shuffle(mixed)
    assert M.fingerprint(b"\n".join(mixed)) == fp
    assert M.update(fp, [b"new line here now"], [lines[3]]) == M.fingerprint(b"\n".join(lines[:3] + lines[4:] + [b"new line here now"]))
    assert M.fingerprint(b"\n".join(lines + [lines[0]])) != fp


def test_likeness_follows_the_share_of_common_shingles():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    a, other = " ".join(words).encode(), " ".join(f"v{r.randrange(10**6)}" for _ in range(2000)).encode()
    b = " ".join(words[:1500] + [f"u{k}" for k in range(500)]).encode()
    assert M.likeness(M.fingerprint(a), M.fingerprint(a)) == 1
    assert abs(M.likeness(M.fingerprint(a), M.fingerprint(b)) - 0.6) < 0.15
    assert M.likeness(M.fingerprint(a), M.fingerprint(other)) < 0.2


def test_long_texts_of_one_shingle_do_not_wrap():
    for n in (600, 60_000, 600_000):
        a, b = M.fingerprint(b"x " * n), M.fingerprint(b"x " * (3 * n // 4))
        assert abs(M.likeness(a, b) - 12 / 13) < 0.01  # (n n + m m - (n - m)(n - m)) / (n n + m m + (n - m)(n - m)) at m = 3 n / 4
        assert not any(M.update(a, deleted=[b"x " * n]))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b = M.fingerprint(t.encode()), M.fingerprint(e.encode())
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, M.likeness(a, b), M.likeness(a, M.fingerprint(nxt.encode())))
    return out


def test_edited_documents_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(k * 7 % 101, "\n".join(" ".join(r.choice(["é", "word", "and", "ßx"]) for _ in range(r.randrange(9))) for _ in range(r.randrange(6)))) for k in range(100)]
    rows += [(500, None), (501, ""), (502, "abc"), (503, "\n\n\n\n\n\n\n\n"), (None, "no id at all"), (504, "long " * 40000), (505, "long " * 40000)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, h string").repartition(5)
    got = {x.doc_id: (x.n_chars, x.edited_sha256, bytes(x.fingerprint), bytes(x.edited_fingerprint), x.near_edited, x.near_next) for x in M.edited_documents(df).collect()}
    assert got == expected(rows)
    one = M.edited_documents(df.filter("doc_id = 502")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert M.edited_documents(df.limit(0)).count() == 0
    assert M.edited_documents(df.union(df)).count() == 2 * len(rows)


def test_query_returns_hexadecimal_strings(spark, tmp_path):
    from tidemark.llm.queries import op10_multiset_fingerprints

    docs = spark.createDataFrame([(1, "some words here"), (2, None), (3, "")], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op10_multiset_fingerprints(spark, f"file://{tmp_path}").collect()}
    raw = {x.doc_id: x for x in M.edited_documents(docs).collect()}
    for i, x in raw.items():
        assert got[i].fingerprint == x.fingerprint.hex() and got[i].edited_fingerprint == x.edited_fingerprint.hex()
