"""Conversation repair against a plain search over edits, and on odd rows."""

import hashlib
import random
import zlib
from itertools import pairwise

import pytest

from panelcast.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"": "user", "s": "user", "a": "user", "u": "assistant"}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def by_hand(rows):
    kinds, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
        seen.add((role, text))
    best = {"": (0, "", [])}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for s, (c, a, r) in list(out.items()):
                to, new = ROLE[s][0], (c + 5, a + "I", [*r, ROLE[s] + ":"])
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        now = {}
        for s, (c, a, r) in inserted(best).items():
            moves = [(s, c + 2, a + "D", r)]
            if kind not in ("b", "d"):
                late = 5 if kind == "t" else 0
                if role[:1] in NEXT[s]:
                    moves.append((NEXT[s][role[0]], c + late, a + "K", [*r, f"{role}:{text}"]))
                moves.append((ROLE[s][0], c + late + 1, a + "R", [*r, f"{ROLE[s]}:{text}"]))
            for to, *new in moves:
                if to not in now or tuple(new[:2]) < now[to][:2]:
                    now[to] = tuple(new)
        best = now
    cost, audit, kept = min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda x: x[:2])
    turns = [t for t, *_ in rows if t is not None]
    legal = {"su", "ua", "au"}
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        kinds.count("b"),
        kinds.count("d"),
        kinds.count("t"),
        sum(x[1][:1] + y[1][:1] not in legal for x, y in pairwise(rows)),
        cost,
        audit,
        hashlib.sha256("\n".join(kept).encode()).hexdigest(),
    )


def results(spark, rows, parts=5):
    d = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = conversations.report(conversations.repair(conversations.damage(d))).collect()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}, len(got)


def some_rows(seed):
    r = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "Go on!", "", " \t\n", "hm. ", "é.", ".", "...", "a b", "Well. \x0b"] + [f"word {i}." for i in range(40)] + [f"word {i}" for i in range(20)]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", "User", "usher", " "]
    rows = []
    for conv in range(60):
        for turn in range(r.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), r.choice(roles) if r.random() < 0.4 else ["user", "assistant"][turn % 2], r.choice(texts)))
    return rows + [(None, 1, "user", "Null key."), (None, None, None, None), (100, None, "user", "One."), (100, None, "assistant", "Two.")]


@pytest.mark.parametrize("piece_rows", [256, 3])
def test_equal_to_search_by_hand(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    rows = some_rows(piece_rows)
    got, n = results(spark, rows)
    expected = {k: by_hand(v) for k, v in damaged(rows).items()}
    assert n == len(expected) and got == expected


@pytest.mark.parametrize("fix_ups", [0, 2])
def test_one_long_conversation_over_many_tasks(spark, monkeypatch, fix_ups):
    """A third of all rows in one conversation; long runs that pass every cost on, so pieces do not converge by themselves."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", 4)
    monkeypatch.setattr(conversations, "FIX_UPS", fix_ups)
    r = random.Random(5)
    rows = [(7, i, r.choice(["user", "assistant"]), f"cut off {i}" if 40 < i < 360 else f"Whole {i}.") for i in range(400)]
    rows += [(i, t, ["user", "assistant"][t % 2], f"Said {i} {t}.") for i in range(100, 300) for t in range(4)]
    got, n = results(spark, rows)
    expected = {k: by_hand(v) for k, v in damaged(rows).items()}
    assert n == len(expected) and got == expected


def test_odd_inputs(spark):
    assert results(spark, [])[0] == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert results(spark, [(gone, 0, "user", "Hi.")])[0] == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    long = "x" * 3_000_000 + "."
    rows = [(1, 2, "user", long), (1, 3, "assistant", "Yes.")] * 6
    got, _ = results(spark, rows)
    assert got == {k: by_hand(v) for k, v in damaged(rows).items()}
    sound = next(i for i in range(1000) if min(zlib.crc32(f"{i}:{t}".encode()) % 20 for t in (0, 1)) > 4)
    d = spark.createDataFrame([(sound, t, ["user", "assistant"][t], "Hi.", 1, 2, 3) for t in (0, 1)], SCHEMA + ", conv long, copies long, part int")
    pieces = conversations.repair(conversations.damage(d))
    assert [(x.role, x.text) for x in conversations.repaired_rows(pieces).orderBy("part", "piece", "place").collect()] == [("user", "Hi."), ("assistant", "Hi.")]
