from collections import Counter
from itertools import permutations

import re

from tidemark.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails(doc_id, text, smallest):
    w = WORDS.findall(text)
    out = ""
    out += "A" if len(w) < 100 else ""
    out += "B" if 100 * len(set(w)) < 80 * len(w) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    out += "D" if any(c in "#$%&*|" for c in text) else ""
    out += "E" if doc_id is not None and smallest[text] < doc_id else ""
    return out


def brute(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = [(part or "", fails(i, text or "", smallest), i is not None and i in good, i is not None and i in toxic) for i, text, part in docs]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                out[part, order, step] = [len(alive), len(gone), failing - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, docs, labels, extra=False):
    kind = "doc_id long, text string, lang string"
    d = spark.createDataFrame([(i, t, p, 1, 2) for i, t, p in docs] if extra else docs, kind + (", part int, key int" if extra else ""))
    rows = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    keys = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert not rows or rows[0].__fields__ == keys
    return [tuple(r) for r in rows]


def test_lehmer_rank_counts_orders_before():
    names = audit.orders("ABCD")
    for k in range(1, 5):
        for r, o in enumerate(names):
            if r == 0 or names[r - 1][:k] != o[:k]:
                assert audit.lehmer_rank(o[:k], "ABCD") == r


def test_intervals_cover_the_removing_orders_once():
    for n in (1, 2, 4):
        filters = "ABCDE"[:n]
        spans = audit.removal_intervals(filters)
        for mask in range(1, 1 << n):
            want = Counter()
            for r, o in enumerate(audit.orders(filters)):
                step = next(k for k, f in enumerate(o) if mask >> filters.index(f) & 1)
                want[r, step + 1, o[step]] += 1
            have = Counter((r, s, f) for m, f, s, a, b in spans if m == mask for r in range(a, b))
            assert have == want


def test_audit_equals_removal_order_by_order(spark):
    long_text = " ".join(f"w{k}" for k in range(120))
    kinds = [long_text, long_text + " $", "A B C", "", None, "x " * 130, "x " * 130, long_text.upper(), "\x0b\t ", "é ü 10%"]
    docs = [(i, kinds[i * 7 % 10], ["en", "de", None, ""][i % 4]) for i in range(80)]
    docs += [(3, kinds[1], "en"), (3, kinds[1], "en"), (None, kinds[1], "en"), (None, kinds[1], None), (None, None, "fr")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999, 1, 1), (6, None, None)]
    rows = got(spark, docs, labels, extra=True)
    want = brute(docs, labels)
    assert len(rows) == len(want) and set(rows) == want


def test_hot_group_of_copies_and_empty_tables(spark):
    docs = [(i, "same " * 200, "en") for i in range(900)] + [(-1, "same " * 200, "de"), (5000, "other", "de")]
    rows = got(spark, docs, [])
    assert set(rows) == brute(docs, []) and len(rows) == 2 * 600
    assert got(spark, [], [(1, 1, 1)]) == []
