"""Preference pairs against a plain rendering of each conversation."""

from tidemark.llm import chat

S, E = chat.START, chat.END


def show(turns):
    return "".join(f"{S}{r}\n{t}{E}" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        lead, said = len(f"{S}{r}\n"), len(t + E)
        if r == "assistant":
            out.append((at + lead, said))
        at += lead + said
    return out


def test_pairs(spark):
    rows = [
        (0, 0, "system", "be ü"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "bye"),
        (1, 1, "assistant", "no"), (1, 0, "user", "hi"),
        (4, 0, "user", "alone"), (4, 1, "assistant", "x" * 100_000),
        (6, 0, "user", "mute"), (7, 0, "user", "q"), (7, 1, "assistant", ""),
        (8, 0, None, None), (8, 1, "assistant", "same"), (9, 0, "user", ""), (9, 1, "assistant", "same"),
        (None, 0, "user", "lost"), (-1, 0, "user", "n"), (-1, 1, "assistant", "a"), (-2, 0, "user", "m"), (-2, 1, "assistant", "b"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, prompt string").repartition(3)
    convs = {}
    for i, n, r, t in rows:
        if i is not None:
            convs.setdefault(i, []).append((n, r or "user", t or ""))
    convs = {i: [(r, t) for _, r, t in sorted(c)] for i, c in convs.items()}
    got = {x.conv_id: x for x in chat.preferences(df).collect()}
    assert set(got) == set(convs)
    for i, c in convs.items():
        p = i + 1 if i % 2 == 0 else i - 1
        at = [k for k, (r, _) in enumerate(c) if r == "assistant"]
        other = [t for t in convs.get(p, []) if t[0] == "assistant"]
        rejected = c[: at[-1]] + [other[-1]] if at and other else None
        n = 0
        while rejected and n < min(len(c), len(rejected)) and c[n] == rejected[n]:
            n += 1
        g = got[i]
        assert (g.shared_turns, g.prompt, g.chosen_text) == (n, show(c[:n]), show(c[n:]))
        assert g.rejected_text == (show(rejected[n:]) if rejected else None)
        assert g.chosen_loss_chars == sum(b for _, b in spans(c[n:]))
        assert g.partner == (p if rejected else None)
    assert chat.preferences(df.limit(0)).count() == 0


def test_loss_spans_cover_what_the_assistant_says(spark):
    c = [("user", "a"), ("assistant", "éé"), ("user", "b"), ("assistant", "")]
    df = spark.createDataFrame([(c, c[:2])], f"chosen {chat.TURN}, rejected {chat.TURN}")
    r = chat.format_pairs(df).collect()[0]
    assert r.shared_turns == 2 and r.prompt == show(c[:2]) and r.rejected_text == ""
    assert [(s.start, s.length) for s in r.chosen_loss] == spans(c[2:]) and r.rejected_loss == []
