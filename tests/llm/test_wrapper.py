"""Tree matching against brute force, and pages of invented templates whose article is known."""

import html as entities
import itertools
import random

from tidemark.llm import wrapper as W


def brute(a, b):
    if a.key != b.key:
        return 0
    best = 0
    for n in range(min(len(a.children), len(b.children)) + 1):
        for i in itertools.combinations(range(len(a.children)), n):
            for j in itertools.combinations(range(len(b.children)), n):
                w = [brute(a.children[x], b.children[y]) for x, y in zip(i, j)]
                if all(w):
                    best = max(best, sum(w))
    return 1 + best


def random_tree(r, depth):
    return W.Tree(r.choice("ab") if depth < 3 else "a", children=[random_tree(r, depth - 1) for _ in range(r.randrange(4) if depth else 0)])


def test_simple_tree_matching_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        a, b = random_tree(r, 3), random_tree(r, 3)
        a.key = b.key = "a"
        assert W.match(a, b, {}) == brute(a, b)


def test_merging_adds_up():
    r = random.Random(2)
    ts = [W.skeleton(W.parse(f"<body><div><p>{r.random()}</p>{'<ul><li>x</ul>' if k % 2 else ''}<p class=z>same</p></div></body>")) for k in range(10)]
    t = W.merge_all(ts)
    assert t.n == 10 and W.Tree.load(t.dump()).dump() == t.dump()
    div = t.children[0].children[0]
    assert [(c.key, c.n) for c in div.children] == [("p", 10), ("ul", 5), ("p.z", 10)] or {(c.key, c.n) for c in div.children} == {("p", 10), ("ul", 5), ("p.z", 10)}


def page(r, k, host):
    line = lambda n: " ".join(r.choice(["alpha", "bêta", "a & b", "<c>", "delta"]) + str(r.randrange(999)) for _ in range(n))
    paras = [line(r.randrange(3, 40)) for _ in range(r.randrange(1, 6))]
    title = line(5)
    e = entities.escape
    body = "".join(f"<p>{e(p)[:10]}{e(p)[10:]}" for p in paras)
    links = "".join(f"<li><a href='/{j}'>{line(2)}</a>" for j in range(5)).replace("<c>", "c")
    wrap = {
        0: f"<article><h1>{e(title)}</h1>{body}<p>Read us every day</p></article>",
        1: f"<div id=content><div class=post><h1>{e(title)}</h1>{body}</div><div class='list'><ul>{links}</ul></div></div>",
    }[host]
    return (
        f"<!DOCTYPE html><html><head><title>{e(title)}</title><style>p>a{{}}</style><script>if (a<b) document.write('</p>')</script></head><body>"
        f"<header><p>Site {r.random()}</header><nav>{links}</nav><div class='cookie-notice'>We use &cookies {r.random()}</div>{wrap}"
        f"<aside><p>{e(line(9))}</aside><div class=ad>{r.random()}</div><section id='comments'><p>{e(line(8))}</section><form><p>x<input></form>"
        f"<footer>&copy; {r.random()}</footer></body>"
    ), "\n\n".join(" ".join(x.split()) for x in [title, *paras])


def test_articles_of_two_templates(spark):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        h, t = page(r, k, k % 2)
        rows.append((k, f"http://{'one' if k % 2 else 'two'}.example/{k}", h, "x"))
        want[k] = t
    rows += [(100, None, None, "x"), (101, "", "", "x"), (102, "http://z.example", "no markup &amp; a  break", "x"), (103, "http://z.example/q", "<p>cut <b", "x"), (104, "http://z.example/r", "<div>" * 5000 + "deep", "x")]
    rows += [(105, "http://y.example", "<p>" + "word " * 200_000, "x"), (1, rows[1][1], rows[1][2], "x"), (None, "http://y.example/1", "<p>n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = W.extract(df).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    by = {x.page_id: x.text for x in got}
    for k in range(40):
        assert by[k] == want[k], k
    assert by[100] == by[101] == "" and by[102] == "no markup & a break" and by[104] == "deep" and by[None] == "n" and len(by[105]) == 999_999
    assert W.extract(df.limit(0)).count() == 0


def test_constant_text_among_many_and_long_paragraphs(spark):
    r = random.Random(4)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    short, long, most = line(5), line(90), line(6)
    rows, want = [], {}
    for k in range(60):
        paras = [line(r.randrange(4, 12)) for _ in range(30)]
        fixed = [short, long] + [most] * (k % 5 > 0)
        rows.append((k, f"http://h.example/{k}", "<article>" + "".join(f"<p>{p}</p>" for p in paras[:15] + fixed + paras[15:]) + "</article>"))
        want[k] = "\n\n".join(paras)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(200)]  # copies of a page do not make its text constant
    got = {x.page_id: x.text for x in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[k] == want[k] for k in want)
    assert all(got[1000 + k] == want[0] for k in range(200))
