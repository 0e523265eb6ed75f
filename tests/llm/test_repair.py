import hashlib
import random
import re
import zlib
from itertools import product

from pyspark.sql import functions as F

from tidemark.llm import repair

GOOD = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")
LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        f = None
        if not BLANK.search(text):
            f = "blank"
        elif (role, text) in seen:
            f = "duplicate"
        elif not LAST.search(text):
            f = "truncated"
        seen.add((role, text))
        out.append(f)
    return out


def cheapest(rows, most=2):
    """Every edit of every turn with up to ``most`` inserts in all, tried one by one."""
    flags = faults(rows)
    options = []
    for (role, text), f in zip(rows, flags):
        stay = 5 if f == "truncated" else 0
        o = [(2, "D", [])]
        if f not in ("blank", "duplicate"):
            o += [(stay, "K", [(role, text)])] + [(stay + 1, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(o)
    gaps = [[(0, "", [])] + [(5, "I", [(r, "")]) for r in ("user", "assistant")] + [(10, "II", [("user", ""), ("assistant", "")])]] * (len(rows) + 1)
    best = None
    for inserts in product(*gaps):
        if sum(i[0] for i in inserts) > 5 * most:
            continue
        for edits in product(*options):
            steps = [inserts[0]]
            for e, i in zip(edits, inserts[1:]):
                steps += [e, i]
            turns = [t for s in steps for t in s[2]]
            if all(r for r, _ in turns) and GOOD.fullmatch("".join(r[0] for r, _ in turns)):
                new = (sum(s[0] for s in steps), "".join(s[1] for s in steps), turns)
                if best is None or new[:2] < best[:2]:
                    best = new
    return best


def parsed(rows, sink=repair.Turns):
    p = repair.Parser(repair.Table(), sink=sink)
    for (role, text), f in zip(rows, faults(rows)):
        p.turn(role, text, f)
    return p.finish()


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", " ", "", "User"]
    return [(rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(["a.", "b!", "c?", "cut", "", " \n", f"t{rng.random()}."])) for _ in range(n)]


def test_parser_equals_trying_all_edits():
    rng = random.Random(3)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        for _ in range(5 if n > 2 else 12):
            rows = random_rows(rng, n)
            cost, audit, turns = parsed(rows)
            assert (cost, audit, [(t["role"], t["text"]) for t in turns]) == cheapest(rows), rows


def dynamic(rows):
    """The same minimum over positions of the grammar's automaton, comparing whole audits."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    give = {"u": "user", "a": "assistant"}
    live = {0: (0, "", [])}

    def put(to, state, new):
        if state not in to or new[:2] < to[state][:2]:
            to[state] = new

    def widened(live):
        out = dict(live)
        for _ in range(4):
            for q, (c, a, t) in list(out.items()):
                for s, r in give.items():
                    if s in moves[q]:
                        put(out, moves[q][s], (c + 5, a + "I", t + [(r, "")]))
        return out

    for (role, text), f in zip(rows, faults(rows)):
        nxt = {}
        for q, (c, a, t) in [*live.items(), *widened(live).items()]:
            stay = 5 if f == "truncated" else 0
            put(nxt, q, (c + 2, a + "D", t))
            if f in ("blank", "duplicate"):
                continue
            if role[:1] in moves[q]:
                put(nxt, moves[q][role[:1]], (c + stay, a + "K", t + [(role, text)]))
            for s, r in give.items():
                if s in moves[q]:
                    put(nxt, moves[q][s], (c + stay + 1, a + "R", t + [(r, text)]))
        live = nxt
    return min((v for q, v in widened(live).items() if q in (0, 3)), key=lambda v: v[:2])


def test_long_conversations_equal_a_dynamic_program():
    rng = random.Random(5)
    for n in (4, 6, 8, 12, 20, 40, 120):
        for _ in range(25):
            rows = random_rows(rng, n)
            cost, audit, turns = parsed(rows)
            assert (cost, audit, [(t["role"], t["text"]) for t in turns]) == dynamic(rows)


def test_live_stacks_stay_few():
    rng = random.Random(1)
    p = repair.Parser(repair.Table(), sink=repair.Digest)
    for role, text in random_rows(rng, 3000):
        p.turn(role, text, None)
        assert len(p.live) <= 12


def damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if what == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def brute(rows):
    out = {}
    for conv, mine in damage(rows).items():
        pairs = [(r, t) for _, r, t in mine]
        f = faults(pairs)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, fixed = dynamic(pairs)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha)
    return out


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def run(spark, rows, kind="conv_id long, turn long, role string, text string"):
    df = repair.repaired_damage(spark.createDataFrame(rows, kind))
    assert df.columns == COLUMNS
    got = df.collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rng = random.Random(9)
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate(random_rows(rng, c % 9))]
    rows += [(None, 1, "user", "a."), (None, 2, None, None), (70, None, "user", "hi."), (70, None, "user", "hi."), (70, 5, "assistant", "yes."), (71, 3, "user", "b."), (71, 3, "assistant", "a."), (71, 3, "user", "b.")]
    rows += [(72, None, None, None), (73, -5, "user", "é" * 50_000 + "."), (73, 900, "assistant", "ok")] + [(74, 10**12, "system", "Be brief.")]
    assert run(spark, rows) == brute(rows)
    wide = [(*r, 1, 2) for r in rows]
    assert run(spark, wide, "conv_id long, turn long, role string, text string, fault int, id int") == brute(rows)
    assert run(spark, []) == {}


def test_a_conversation_with_a_third_of_all_rows(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)] + [(100 + k, t, "user", "x.") for k in range(3000) for t in range(2)]
    got = run(spark, rows)
    assert got == brute(rows)


def test_repaired_turns_match_the_digest(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c."), (3, 0, "tool", "")], "c long, n int, who string, says string")
    named = dict(id_col="c", turn_col="n", role_col="who", text_col="says")
    texts = {r["c"]: r for r in repair.repair(rows, **named).collect()}
    digests = {r["c"]: r["repaired"] for r in repair.repair(rows, digest=True, **named).collect()}
    for c, r in texts.items():
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"]).encode()).hexdigest() == digests[c]
    assert [(t["role"], t["text"]) for t in texts[1]["repaired"]] == [("user", "a."), ("assistant", "b.")]
    assert texts[1]["audit"] == "KR" and texts[2]["audit"] == "D" and texts[3]["repaired"] == []
