"""Repair of the turn structure of conversations by the cheapest edits, found with iterative-deepening A*.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its rows, ordered by
turn, are edited one after another: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (of
a user or assistant row without text) 5. Blank rows and repeated ones must be deleted; a truncated row
that is not deleted costs 5 more. Among the cheapest edits those whose initials are least in ASCII win.

The search is depth-first in ASCII order of the edits, under a cost bound that is raised by one until
a path accepts; a lower bound on what the remaining rows cost cuts branches, and a table keeps, per
place and state of the grammar, the largest budget that failed, across all bounds. The first accepting
path is the answer.

One conversation may be any part of the data, so it's never searched as a whole. Rows are range
partitioned by conversation and turn, and each partition cuts its stretch of a conversation (a run)
into segments of ``SEGMENT`` rows. Each segment is searched from every state of the grammar it may begin in
to every state it may end in. An edit string of a segment ends with the row it takes last, so none is a
prefix of another and strings of concatenated segments compare as the first differing segment does:
costs and ranks of segments combine exactly, first within runs, then within conversations.

Defined cases: a null role or text is one space; null turns come first and count for no gap; rows of
equal turn are ordered by role, by the first ``TIE_CHARS`` characters of their text, by its hash and by input order; a null ``conv_id`` is a
conversation; an empty role has an empty initial; an empty table has no conversations. Other columns
are never read.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphstat.llm.storage import store

SEGMENT = 32
TIE_CHARS = 32

# States of the grammar, named by the initial that was read last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that end a conversation

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
NO_PATH = -1
_WORD = r"[^\x20\x09-\x0D]"
_BATCH_ROWS = 256


def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults: one row in twenty each is dropped, emptied, stripped of ``.!?``, repeated or made a user's."""

    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("hit"),
    )
    return rows.filter("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with a row number ``uid`` and the first ``fault`` of each row.

    The first row of every (conversation, role, text) is found by an aggregation; it comes back by
    row number, so no key is hot on the way.
    """
    rows = store(
        rows.select(
            "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "turns",
    )
    worded = F.col("text").rlike(_WORD)
    keyed = rows.filter(worded).groupBy("conv_id", "role", F.sha2("text", 256).alias("digest"))
    first = keyed.agg(F.min(F.struct("turn", "uid")).alias("at")).select(F.col("at.uid").alias("uid"), F.lit(True).alias("first"))
    fault = (
        F.when(~worded, BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    )
    return rows.join(first, "uid", "left").select(*rows.columns, fault.alias("fault"))


def cheapest(initials: list[str], fault: list[int], start: int, goal: int) -> tuple[int, str] | None:
    """Cost and initials of the least cheapest edits that take all rows and lead from one state to another."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in reversed(range(n)):
        ahead[i] = ahead[i + 1] + (DELETE if fault[i] else int(initials[i] not in ("s", "u", "a")))
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def walk(i: int, state: int, left: int) -> bool:
        if i == n:
            return state == goal
        if ahead[i] > left or failed.get((i, state), -1) >= left:
            return False
        must_go, extra = fault[i] in (BLANK, DUPLICATE), UNFINISHED * (fault[i] == TRUNCATED)
        wanted = _WANTED[state][0]
        steps = [("D", DELETE, i + 1, state), ("I", INSERT, i, _AFTER[state, wanted])]
        if not must_go and (state, initials[i]) in _AFTER:
            steps.append(("K", extra, i + 1, _AFTER[state, initials[i]]))
        if not must_go and initials[i] != wanted:
            steps.append(("R", REROLE + extra, i + 1, _AFTER[state, wanted]))
        for letter, cost, j, then in steps:
            path.append(letter)
            if cost <= left and walk(j, then, left - cost):
                return True
            path.pop()
        failed[i, state] = left
        return False

    systems = any(x == "s" and k in (FINE, TRUNCATED) for x, k in zip(initials, fault))
    if goal == START and start != START or goal == SYSTEM and start != SYSTEM and not (start == START and systems):
        return None
    for bound in range(ahead[0], DELETE * n + INSERT * len(STATES)):
        if walk(0, start, bound):
            return bound, "".join(path)
    return None


def transfer(initials: list[str], fault: list[int], starts) -> tuple[list[int], list[int], list[str]]:
    """For each pair of states: cost, rank of the edits among those with the same start, and the edits."""
    costs, ranks, audits = [NO_PATH] * 16, [0] * 16, [""] * 16
    for start in starts:
        found = {goal: cheapest(initials, fault, start, goal) for goal in STATES}
        for rank, goal in enumerate(sorted((g for g in STATES if found[g]), key=lambda g: found[g][1])):
            at = 4 * start + goal
            costs[at], audits[at], ranks[at] = *found[goal], rank
    return costs, ranks, audits


def chain(parts: list[tuple[list[int], list[int]]], start: int) -> list[tuple[int, int, list[int]] | None]:
    """Parts in a row: for each last state the cost, the rank of the edits and the states between the parts."""
    at = {start: (0, 0)}
    back = []
    for costs, ranks in parts:
        options: dict[int, list] = {}
        for state, (cost, rank) in at.items():
            for goal in STATES:
                step = costs[4 * state + goal]
                if step != NO_PATH:
                    options.setdefault(goal, []).append((cost + step, rank, ranks[4 * state + goal], state))
        best = {goal: min(choices) for goal, choices in options.items()}
        order = sorted(best, key=lambda g: best[g][1:3])
        at = {goal: (best[goal][0], order.index(goal)) for goal in best}
        back.append({goal: best[goal][3] for goal in best})
    out: list = [None] * 4
    for goal, (cost, rank) in at.items():
        states = [goal]
        for step in reversed(back):
            states.append(step[states[-1]])
        out[goal] = (cost, rank, states[::-1])
    return out


_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_NUMBERS = ["gaps", *_COUNTS[1:5], "cost"]
_STATS = pa.schema([
    *((name, pa.int64()) for name in _COUNTS), ("low", pa.int64()), ("high", pa.int64()),
    ("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
])
_STATS_SQL = ", ".join(
    [*(f"{name} long" for name in [*_COUNTS, "low", "high"]), "head string, tail string, costs array<long>, ranks array<int>"]
)


def _illegal(pair: str) -> int:
    return int(pair not in ("su", "ua", "au"))


def _stats(rows: list[dict]) -> dict:
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    kinds = [r["fault"] for r in rows]
    return {
        "n": len(rows), "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED),
        "illegal": sum(_illegal(a + b) for a, b in zip(initials, initials[1:])),
        "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "head": initials[0], "tail": initials[-1],
    }


def _joined(a: dict, b: dict) -> dict:
    """The statistics of two stretches of a conversation that follow one another."""
    out = {name: a[name] + b[name] for name in _COUNTS}
    out["illegal"] += _illegal(a["tail"] + b["head"])
    out["turns"] -= int(a["high"] is not None and a["high"] == b["low"])
    low = [x["low"] for x in (a, b) if x["low"] is not None]
    high = [x["high"] for x in (a, b) if x["high"] is not None]
    return out | {"low": low[0] if low else None, "high": high[-1] if high else None, "head": a["head"], "tail": b["tail"]}


def _all_joined(parts: list[dict]) -> dict:
    total = parts[0]
    for part in parts[1:]:
        total = _joined(total, part)
    return total


def segments(rows: DataFrame) -> DataFrame:
    """Cut conversations into segments, each with its edits between all pairs of states, its statistics and its rows."""
    key = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "_start", "_hash", "uid"]
    placed = rows.select("*", F.substring("text", 1, TIE_CHARS).alias("_start"), F.xxhash64("text").alias("_hash"))
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_start", "_hash", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        schema = None
        held: list[dict] = []
        made: list[dict] = []
        run_no, seq = 0, 0

        def close() -> None:
            nonlocal seq
            starts = [START] if run_no and not seq else STATES
            costs, ranks, audits = transfer([r["role"][:1] for r in held], [r["fault"] for r in held], starts)
            made.append(
                {"conv_id": held[0]["conv_id"], "run": (partition << 32) + run_no, "seq": seq, "roles": [r["role"] for r in held],
                 "texts": [r["text"] for r in held], "audits": audits, "costs": costs, "ranks": ranks} | _stats(held)
            )
            seq += 1
            held.clear()

        for batch in batches:
            schema = schema or pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("run", pa.int64()), ("seq", pa.int64()), ("roles", pa.list_(pa.string())),
                ("texts", pa.list_(pa.string())), ("audits", pa.list_(pa.string())), *_STATS,
            ])
            for row in batch.to_pylist():
                if held and (held[-1]["conv_id"] != row["conv_id"] or len(held) == SEGMENT):
                    last = held[-1]["conv_id"]
                    close()
                    if last != row["conv_id"]:
                        run_no, seq = run_no + 1, 0
                held.append(row)
                if len(made) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made.clear()
        if held:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    fields = f"conv_id {key}, run long, seq long, roles array<string>, texts array<string>, audits array<string>, {_STATS_SQL}"
    return dealt.mapInArrow(run, fields)


def _consecutive(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of sorted batches, those with an equal key together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _streamed(rows: DataFrame, key: str, order: list[str], step, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """``step`` over the rows of every key in order, which returns rows of ``fields``; a key's rows come one after another in a task."""
    schema = pa.schema([(name, to_arrow_type(kind)) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for group in _consecutive(batches, key):
            made += step(group)
            if len(made) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(made, schema=schema)
                made.clear()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, T.StructType([T.StructField(name, kind) for name, kind in fields]))


_LONG, _TEXT = T.LongType(), T.StringType()
_SUMMARY = [
    *((name, _LONG) for name in [*_COUNTS, "low", "high"]), ("head", _TEXT), ("tail", _TEXT),
    ("costs", T.ArrayType(_LONG)), ("ranks", T.ArrayType(T.IntegerType())),
]


def _runs(pieces: DataFrame) -> DataFrame:
    """Combine the segments of each run."""

    def combine(rows: list[dict]) -> list[dict]:
        costs, ranks = [NO_PATH] * 16, [0] * 16
        for start in STATES:
            for goal, end in enumerate(chain([(r["costs"], r["ranks"]) for r in rows], start)):
                if end:
                    costs[4 * start + goal], ranks[4 * start + goal] = end[0], end[1]
        return [_all_joined(rows) | {"conv_id": rows[0]["conv_id"], "run": rows[0]["run"], "costs": costs, "ranks": ranks}]

    fields = [("conv_id", pieces.schema["conv_id"].dataType), ("run", _LONG), *_SUMMARY]
    return _streamed(pieces.drop("roles", "texts", "audits"), "run", ["seq"], combine, fields)


_STEP = [("run", _LONG), ("start", T.IntegerType()), ("goal", T.IntegerType()), ("last", T.BooleanType())]
_CHOICE = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _STEP]))


def _plans(runs: DataFrame) -> DataFrame:
    """Combine the runs of each conversation: its statistics, its cost, and the states each run goes between."""

    def combine(rows: list[dict]) -> list[dict]:
        ends = [
            (end[0] + INSERT * len(_TAIL[goal]), end[1], goal, end[2])
            for goal, end in enumerate(chain([(r["costs"], r["ranks"]) for r in rows], START)) if end
        ]
        cost, _, _, states = min(ends)
        total = _all_joined(rows)
        choice = [
            {"run": r["run"], "start": a, "goal": b, "last": i == len(rows) - 1}
            for i, (r, a, b) in enumerate(zip(rows, states, states[1:]))
        ]
        gaps = total["high"] - total["low"] + 1 - total["turns"] if total["high"] is not None else 0
        return [{name: total[name] for name in _COUNTS[1:5]} | {"conv_id": rows[0]["conv_id"], "gaps": gaps, "cost": cost, "choice": choice}]

    fields = [("conv_id", runs.schema["conv_id"].dataType), *((name, _LONG) for name in _NUMBERS), ("choice", _CHOICE)]
    return _streamed(runs, "conv_id", ["run"], combine, fields)


def _chosen(pieces: DataFrame, plans: DataFrame) -> DataFrame:
    """``(run, seq, start, goal, last)``: the states that each segment goes between."""

    def trace(rows: list[dict]) -> list[dict]:
        plan = rows[0]
        states = chain([(r["costs"], r["ranks"]) for r in rows], plan["start"])[plan["goal"]][2]
        return [
            {"run": r["run"], "seq": r["seq"], "start": a, "goal": b, "last": plan["last"] and i == len(rows) - 1}
            for i, (r, a, b) in enumerate(zip(rows, states, states[1:]))
        ]

    wanted = pieces.select("run", "seq", "costs", "ranks").join(plans.select(F.inline("choice")), "run")
    return _streamed(wanted, "run", ["seq"], trace, [("seq", _LONG), *_STEP])


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The rows that edits leave, from a state of the grammar on."""
    out, i = [], 0
    for letter in audit:
        if letter in "IR":
            out.append((_WANTED[state], "" if letter == "I" else texts[i]))
        elif letter == "K":
            out.append((roles[i], texts[i]))
        if letter != "D":
            state = _AFTER[state, out[-1][0][:1]]
        i += letter != "I"
    return out


class Repair:
    """The cheapest repair of ``rows(conv_id, turn, role, text)``: its statistics, its edits and its rows."""

    def __init__(self, rows: DataFrame):
        pieces = store(segments(faults(rows)), "segments")
        self.plans = store(_plans(_runs(pieces)), "plans")
        at = F.col("start") * 4 + F.col("goal") + 1
        tail = F.when(F.col("last"), F.element_at(F.create_map(*(F.lit(x) for s in STATES for x in (s, _TAIL[s]))), F.col("goal")))
        self.pieces = pieces.join(_chosen(pieces, self.plans), ["run", "seq"]).select(
            "conv_id", "run", "seq", "start", "roles", "texts",
            F.concat(F.element_at("audits", at), F.coalesce(tail, F.lit(""))).alias("audit"),
        )

    def _ordered(self, step, fields: str) -> DataFrame:
        ordered = self.pieces.repartition("conv_id").sortWithinPartitions("conv_id", "run", "seq")
        return ordered.mapInArrow(step, fields)

    def rows(self) -> DataFrame:
        """``(conv_id, place, audit, role, text)``: the repaired rows, numbered from 0 in each conversation."""
        key = self.pieces.schema["conv_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, place = object(), 0
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    place = place if r["conv_id"] == now else 0
                    now = r["conv_id"]
                    for role, text in edited(r["audit"], r["start"], r["roles"], r["texts"]):
                        out.append({"conv_id": now, "place": place, "role": role, "text": text})
                        place += 1
                schema = [batch.schema.field("conv_id"), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(schema))

        return self._ordered(run, f"conv_id {key}, place long, role string, text string")

    def digests(self) -> DataFrame:
        """``(conv_id, audit, repaired_sha256)``; texts pass through the digest segment by segment."""
        key = self.pieces.schema["conv_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema, made, held = None, [], None

            def close() -> None:
                if held:
                    made.append({"conv_id": held["conv_id"], "audit": "".join(held["audit"]), "repaired_sha256": held["digest"].hexdigest()})

            for batch in batches:
                schema = schema or pa.schema([batch.schema.field("conv_id"), ("audit", pa.string()), ("repaired_sha256", pa.string())])
                for r in batch.to_pylist():
                    if not held or held["conv_id"] != r["conv_id"]:
                        close()
                        held = {"conv_id": r["conv_id"], "audit": [], "digest": hashlib.sha256(), "n": 0}
                    held["audit"].append(r["audit"])
                    for role, text in edited(r["audit"], r["start"], r["roles"], r["texts"]):
                        held["digest"].update(f"{chr(10) * bool(held['n'])}{role}:{text}".encode())
                        held["n"] += 1
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made.clear()
            close()
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=schema)

        return self._ordered(run, f"conv_id {key}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Damage conversations and repair them: one row per conversation of the input, with the digest of what it becomes."""
    made = Repair(damage(conversations))
    ids = conversations.select("conv_id").distinct()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("conv_id", "_right")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("_right")), "left").drop("_right")

    found = joined(joined(ids, made.plans.drop("choice")), made.digests())
    return found.select(
        "conv_id", *(F.coalesce(name, F.lit(0)).alias(name) for name in _NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
