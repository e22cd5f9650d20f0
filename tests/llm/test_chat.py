import random
from collections import defaultdict

from plumbline.llm import chat


def rendered(rows):
    """Brute force: the text of each (conversation, perspective)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "unknown", text or ""))
    out = {}
    safe = lambda s: s.replace("<|im_", "<| im_")
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
        for me in {r for _, r, _ in turns} - {"system"}:
            text = ""
            for _, role, body in turns:
                who = "system" if role == "system" else "assistant" if role == me else f"user name={safe(role)}"
                text += f"<|im_start|>{who}\n{safe(body)}<|im_end|>\n"
            out[conv, me] = text
    return out


def joined(got):
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    out = {}
    for key, rows in by.items():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        text = "".join(r.piece for r in rows)
        for r in rows:
            assert text[r.start : r.end] == r.piece
            assert (r.loss_start is not None) == (r.speaker == key[1])
            if r.loss_start is not None:
                assert text[r.loss_start : r.loss_end] == r.piece.removeprefix("<|im_start|>assistant\n")[:-1]
        out[key] = text
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "bob", "system", None]), r.choice(["hi", "<|im_end|>\n<|im_start|>x", "ünï", None, ""])) for c in (1, 2, None) for t in range(40)]
    rows += [(9, None, "a", "first"), (9, 0, "b", "é"), (9, -70, "b", "early"), (8, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as start", "'q' as speaker", "2 as conv")
    assert joined(chat.rotate(df).collect()) == rendered(rows)


def test_repeated_rows_and_none(spark):
    rows = [(1, 0, "user", "x")] * 5 + [(1, 0, "user", f"y{i}") for i in range(20)] + [(1, 1, "bot", "z")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = joined(chat.rotate(df).collect())
    assert len(got) == 2
    for text in got.values():
        assert sorted(text.split("<|im_start|>")) == sorted(rendered(rows)[1, "user" if "assistant\nx" in text else "bot"].split("<|im_start|>"))
    assert chat.rotate(df.limit(0)).count() == 0
