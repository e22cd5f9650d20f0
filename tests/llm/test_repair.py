import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from plumbline.llm import repair as R

ALLOWED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, copies int"
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Cheapest edits of one conversation as the least pair of cost and letters, by suffixes."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if i < len(rows):
            _, _, role, text = rows[i]
            tail = faults[i] == "truncated"
            found.append((3, "D", None, i + 1, state, 3))
            if faults[i] not in ("blank", "duplicate"):
                for name in ("user", "assistant"):
                    if name[0] in STEP[state]:
                        found.append((2 + tail, "R", (name, text), i + 1, STEP[state][name[0]], 3))
                if role[:1] in STEP[state]:
                    found.append((tail, "K", (role, text), i + 1, STEP[state][role[:1]], 3))
        for name in ("user", "assistant"):
            if inserts and name[0] in STEP[state]:
                found.append((2, "I", (name, ""), i, STEP[state][name[0]], inserts - 1))
        done = []
        for cost, letter, *rest in found:
            if not letter:
                done.append((cost, letter, ()))
                continue
            turn, *to = rest
            after = best(*to)
            if after:
                done.append((cost + after[0], letter + after[1], ((turn,) if turn else ()) + after[2]))
        return min(done, key=lambda x: x[:2]) if done else None

    cost, audit, turns = best(0, 0, 3)
    assert ALLOWED.fullmatch("".join(r[:1] for r, _ in turns))
    there = [r[1] for r in rows if r[1] is not None]
    gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def brute(rows, damaged):
    convs = {r[0]: [] for r in rows}
    for r in damaged:
        convs[r[0]].append(r)
    return sorted([(c, *plain_repair(x)) for c, x in convs.items()], key=str)


def made(seed, convs=60, longest=14):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user" if turn % 2 == 0 else "assistant")
            role = r.choice(["system", "tool", None, "User", ""]) if r.random() < 0.15 else role
            text = r.choice(["Yes.", "No", "Why? ", "Stop!\n", "", " \t\x0b", None, f"Text {turn}.", f"x{r.randrange(30)}", "é. ", "…"])
            at = None if r.random() < 0.1 else r.choice([turn, turn, turn, turn * 3, -turn])
            rows.append((None if c == 0 else c, at, role, text, 1))
    r.shuffle(rows)
    return rows


def result(spark, rows, damaged=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, R.repair(R.damage(df) if damaged else df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_damaged_equals_plain_version(spark, seed):
    rows = made(seed)
    assert result(spark, rows) == brute(rows, plain_damage(rows))


@pytest.mark.parametrize("size", [1, 3])
def test_segments_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SEGMENT", size)
    monkeypatch.setattr(R, "LANES", 5)
    monkeypatch.setattr(R, "BROADCAST_REPEATS", 0)
    rows = made(10 + size, 30, 25)
    assert result(spark, rows) == brute(rows, plain_damage(rows))


def test_one_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 16)
    rows = [(7, i, "user" if i % 3 else "assistant", f"Text {i % 211}." if i % 5 else "cut", 1) for i in range(400)]
    rows = [(1, 0, "user", "Hello.", 1), (1, 1, "assistant", "Hi.", 1), *rows]
    assert result(spark, rows) == brute(rows, plain_damage(rows))


def test_copies_and_none(spark):
    rows = [(1, 0, "user", "Same.", 4), (1, 1, "assistant", "Yes.", 1), (2, 0, "user", "x.", 0), (3, 5, "user", "", 3)]
    found = result(spark, rows, damaged=False)
    assert found == brute(rows, [r[:4] for r in rows for _ in range(r[4])])
    assert found[1] == (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[0][7] == "KDDDK"


def test_nothing_and_other_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "a.", 9, 9)], "conv_id long, turn int, role string, text string, digest int, seen int")
    assert R.repair(R.damage(df)).count() == 1


def test_matrices():
    kinds = [[1, 2, 3], [], [0], [5, 4]]
    found = R.matrices(kinds)
    for ks, m in zip(kinds, found, strict=True):
        plain = R.product(R.INSERTS[None], R.INSERTS[None])[0] * 0 + R.FAR
        plain[range(4), range(4)] = 0
        for k in ks:
            plain = R.product(plain, R.product(R.INSERTS, R.ROWS[k]))
        assert (plain == m).all()
