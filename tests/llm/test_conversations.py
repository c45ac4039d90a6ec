"""Conversation repair against shortest paths over whole conversations."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest

from glyphstat.llm import conversation_repair as repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for r in rows:
        conv, turn, role, text = (" " if x is None else x for x in r)
        hit = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(r[0], r[1], "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows):
    """Shortest path over (row, state), by cost and then by the edits' initials."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not text.strip(SPACE) else "dup" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    n = len(rows)
    best = {(0, ""): (0, "", ())}
    todo = {(0, "")}
    while todo:
        at = min(todo, key=lambda x: best[x])
        todo.remove(at)
        (i, state), (cost, audit, kept) = at, best[at]
        want = "assistant" if state == "u" else "user"
        steps = [("I", 5, i, after[state, want[0]], ((want, ""),))]
        if i < n:
            role, text = rows[i][2:]
            steps.append(("D", 2, i + 1, state, ()))
            if faults[i] not in ("blank", "dup"):
                more = 5 * (faults[i] == "cut")
                if (state, role[:1]) in after:
                    steps.append(("K", more, i + 1, after[state, role[:1]], ((role, text),)))
                steps.append(("R", 1 + more, i + 1, after[state, want[0]], ((want, text),)))
        for letter, add, j, then, new in steps:
            found = (cost + add, audit + letter, kept + new)
            if cost + add <= 2 * n and ((j, then) not in best or found[:2] < best[j, then][:2]):
                best[j, then] = found
                todo.add((j, then))
    cost, audit, kept = min(best[n, q] for q in ("", "a") if (n, q) in best)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("dup"), faults.count("cut"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def check(spark, rows, key="long"):
    df = spark.createDataFrame(rows, f"conv_id {key}, turn long, role string, text string, choice int, run string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[:4])
    assert got == {c: expected(damaged(rs)) for c, rs in by_conv.items()}
    return got


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["yes.", "no", "why?", "", None, " \t", "a long answer that goes on.", "ok!"] + [f"text {i}." for i in range(40)]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None]
    return [
        (c, rng.choice([t, t, t, None]), rng.choice(roles), rng.choice(texts), None, None)
        for c in range(conversations) for t in range(rng.randint(0, most))
    ]


@pytest.mark.parametrize("segment", [1, 3, 32])
def test_random_conversations_whatever_the_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    check(spark, random_rows(segment, 40, 9))


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 4)
    rows = [(7, t, "user" if t % 3 else "assistant", f"text {t}." if t % 5 else "same.", None, None) for t in range(400)]
    got = check(spark, rows + random_rows(5, 3, 5))
    assert got[7][1] > 0


def test_edges(spark):
    assert check(spark, []) == {}
    rows = [
        (None, 1, "user", "a question?", 1, "x"), (None, None, None, None, 1, "x"), (2, 0, "user", "unfinished", 1, "x"),
        (3, 5, "user", "same.", 1, "x"), (3, 5, "user", "same.", 1, "x"), (3, 6, "assistant", "word " * 200_000 + ".", 1, "x"),
    ]
    got = check(spark, rows)
    assert len(got) == 3
    dropped = [(c, 0, "user", "x.", None, None) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = check(spark, dropped)
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_given_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair(rows).collect()}
    want = sorted(map(tuple, rows.select("conv_id", "turn", "role", "text").collect()), key=lambda r: r[0])
    assert found == {c: expected(damaged(list(g))) for c, g in groupby(want, key=lambda r: r[0])}


def test_repaired_rows_are_well_formed(spark):
    made = repair.Repair(repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))).rows()
    by_conv = {}
    for r in sorted(made.collect(), key=lambda r: (r.conv_id, r.place)):
        by_conv.setdefault(r.conv_id, []).append(r.role[:1])
    assert by_conv and all("".join(x).removeprefix("s") == "ua" * (len("".join(x).removeprefix("s")) // 2) for x in by_conv.values())
