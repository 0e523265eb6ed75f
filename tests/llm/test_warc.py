"""Archives: exact round trip, revisits, and transactions tied in other ways."""

import hashlib

from tidemark.llm import warc


def expected(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        again = h in first and sum((x[2] or "").encode() == h for x in rows) > 1 and i != first[h]
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/x", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 5),
    (3, "http://a.example/y", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 5),
    (9, None, "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 5),
    (1, "http://b.example/\r\nX: y", "short"),
    (2, "http://b.example/", "short"),
    (4, "http://c.example/", None),
    (6, "", ""),
    (None, "http://d.example/", "no id"),
    (7, "http://e.example/", "long " * 300_000),
    (8, "http://e.example/", "line\n" * 40),
    (8, "http://e.example/", "line\n" * 40),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, type string").repartition(3)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    assert got == expected(ROWS)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_read_back_payloads(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    recs = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    stored = sorted(bytes(r.content) for r in recs if r.type == "response")
    revisits = [r for r in recs if r.type == "revisit"]
    assert len(recs) == 3 * len(ROWS) and len(revisits) == 2
    want = [(r[2] or "").encode() for r in ROWS]
    want.remove(ROWS[0][2].encode())
    want.remove(ROWS[0][2].encode())
    assert stored == sorted(want)


def test_transactions_tied_in_other_ways(spark):
    rows = [
        ("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "q1"),
        ("r2", "response", "q2"), ("q2", "request", None), ("m2", "metadata", "r2"),
        ("q3", "request", "nowhere"),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string")
    got = {(x.capture, x.request.record_id, x.metadata.record_id) for x in warc.assemble(df).collect()}
    assert got == {("r1", "q1", "m1"), ("r2", "q2", "m2")}
    assert [x.r.record_id for x in warc.captures(df).filter("capture is null").collect()] == ["q3"]


def test_gzip_members_of_single_records():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(warc.inflate(gzip.compress(one) + gzip.compress(one)))] == [b"abc", b"abc"]
