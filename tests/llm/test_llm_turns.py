"""Conversation repair against a search over all edit scripts."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_data import SF001
from shiftscope.llm import turns
from shiftscope.session import read_table

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"


def damaged(rows):
    """Contract's damage -> conv -> rows (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ENDS)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute(rows):
    """Expected answer of one conversation's rows, by searching all scripts."""
    seen, kinds = set(), []
    for _, role, text in rows:
        t = text.rstrip(SPACE)
        kinds.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ENDS else "")
        seen.add((role, text))
    n = len(rows)

    # states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == n:
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            must = kinds[i] in ("blank", "duplicate")
            c, a, o = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, o))
            if not must:
                late = 5 if kinds[i] == "truncated" else 0
                if (state, role[:1]) in step:
                    c, a, o = best(i + 1, step[(state, role[:1])], 0)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *o)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        c, a, o = best(i + 1, step[(state, new[0])], 0)
                        found.append((c + late + 1, "R" + a, (f"{new}:{text}", *o)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in step:
                    c, a, o = best(i, step[(state, new[0])], inserted + 1)
                    found.append((c + 5, "I" + a, (f"{new}:", *o)))
        return min(found) if found else (10 ** 9, "", ())

    import sys
    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, 0, 0)
    at = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def invented(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randint(1, longest)):
            rows.append((conv, rnd.choice([None, turn, turn, turn * 2, 1]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]),
                         rnd.choice([None, "", " \n", "Yes.", "Yes.", "cut off", "Fine!\x0b", f"Text {turn}?", "é 漢字。", "Well. \t"])))
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x"))
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair(turns.damage(df), **how).collect()}
    want = {conv: brute(tuple(here)) for conv, here in damaged(rows).items()}
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


@pytest.mark.parametrize("how", [{}, {"block": 2, "partitions": 7}, {"block": 1, "partitions": 2}, {"block": 5, "partitions": 1}])
def test_odd_rows(spark, how):
    check(spark, invented(1, 40, 9), **how)


def test_one_conversation_over_many_tasks(spark):
    rnd = random.Random(4)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"T{t}.", f"cut {t}", "Same.", ""])) for t in range(150)]
    rows += [(8, 0, "user", "Hi."), (9, 5, "assistant", "Hello."), (6, 1, "system", "Be brief.")]
    check(spark, rows, block=8, partitions=9)
    check(spark, rows)


def test_copies_of_one_row(spark):
    rows = [(1, 1, "user", "Again.")] * 300 + [(1, 2, "assistant", "Once.")] * 2 + [(2, None, "user", "A.")] * 3
    check(spark, rows)
    check(spark, rows, block=1, partitions=4)


def test_texts_without_damage(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1).cast("long"))
    r = turns.repair(df).first()
    assert (r["audit"], r["cost"], r["gaps"], r["illegal"]) == ("KKK", 0, 0, 0)
    assert r["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Why?\nassistant:So.").hexdigest()


def test_table(spark):
    df = read_table(spark, SF001, "conversations")
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.op13_turns(df).collect()}
    want = {conv: brute(tuple(here)) for conv, here in damaged([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.op13_turns(df).count() == 0


def test_long_text_and_extreme_turns(spark):
    rows = [(1, -2 ** 63, "user", "x" * 500_000 + "."), (1, 2 ** 63 - 1, "assistant", " " * 100_000 + "ok"), (2, 3, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in turns.op13_turns(df).collect()}
    assert set(got) == {1, 2} and got[1]["gaps"] in (0, turns.LONG_MAX)
