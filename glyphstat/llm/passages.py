"""What both searches for repeated passages share: blocks of documents, anchors and recurring anchors.

A window of fixed length is represented by its anchor, the short gram in it with the least hash.
Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so
anchors are few and a window can only recur if its anchor does.

Documents are dealt into blocks of bounded size. A block reports every anchor, and every stretch of
text around a recurring anchor, once, however often it holds it; so what meets at one key is bounded by
the number of blocks and not by the number of documents that share a passage.

The edge of a common passage runs into text that differs by document, so an anchor can have any number of
different stretches. Where it has many, its windows are counted by their hashes, and those that stand in more
than one place are compared one by one, each where its hash sends it.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes of text per block, and per shard of the stretches that are compared.
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 2_000_000

# Different stretches beyond one a block up to which an anchor's stretches are compared in one place.
HOT_STRETCHES = 4_000

# What a row says of a hash: a recurring anchor, one with many stretches, a recurring window of such a one.
ANCHOR, HOT, HOT_WINDOW = range(3)

_LAST = (1 << 63) - 1

# Places that are worked on at a time, so that what lies between stays in a processor's cache.
_STEP = 1 << 16


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def dealt(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``(doc_id, at, fp, text, block)``: documents in order of (at, fp), a missing id last."""
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("at"),
        F.xxhash64("text").alias("fp"), "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"),
    )


class Block:
    """The different documents of a block in order; ``row_of`` gives the place of each row."""

    def __init__(self, table: pa.Table):
        at, fp = (table.column(name).to_numpy() for name in ("at", "fp"))
        order = np.lexsort((fp, at))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(at[order]) != 0) | (np.diff(fp[order]) != 0)
        chosen = order[new]
        self.at, self.fp = at[chosen], fp[chosen]
        self.texts = table.column("text").take(pa.array(chosen)).cast(pa.binary()).to_pylist()
        self.row_of = np.empty(len(order), np.int64)
        self.row_of[order] = np.cumsum(new) - 1

    def places(self, marks: pa.Table) -> np.ndarray:
        """Which document each row of ``marks(at, fp)`` belongs to."""
        place = {key: i for i, key in enumerate(zip(self.at.tolist(), self.fp.tolist(), strict=True))}
        keys = zip(marks.column("at").to_pylist(), marks.column("fp").to_pylist(), strict=True)
        return np.fromiter((place[key] for key in keys), np.int64, marks.num_rows)


def window_anchors(values: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows with one anchor, and the anchor's place.

    A window takes its anchor from ``width`` consecutive gram hashes; of equal hashes the first.
    """
    n = len(values) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    anchors = np.empty(n, np.int64)
    for i in range(0, n, _STEP):
        j = min(i + _STEP, n)
        least = (values[i : j + width - 1] >> np.uint64(32) << np.uint64(32)) | np.arange(j - i + width - 1, dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: j - i], least[width - reach : width - reach + j - i])
        anchors[i:j] = i + (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(valid[:n])
    anchor = anchors[start]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return start[first], start[last], anchor[first]


def anchor_table(block: int, hashes: np.ndarray, spans: np.ndarray) -> pa.Table:
    """``(block, h, n, m)``: each anchor once, with 2 for any number of places above one, and its different stretches."""
    found, n = np.unique(hashes, return_counts=True)
    _, m = np.unique(hashes[np.unique(spans, return_index=True)[1]], return_counts=True)
    return pa.table(
        {
            "block": pa.array(np.full(len(found), block, np.int32)), "h": pa.array(found.view(np.int64)),
            "n": pa.array(np.minimum(n, 2).astype(np.int32)), "m": pa.array(m.astype(np.int32)),
        }
    )


ANCHORS = "block int, h long, n int, m int"


def recurring(anchors: DataFrame) -> DataFrame:
    """``(block, h, kind)``: the anchors of each block that stand in more than one place of all texts."""
    per_anchor = Window.partitionBy("h")
    found = anchors.withColumn("total", F.sum("n").over(per_anchor)).withColumn("more", F.sum(F.col("m") - 1).over(per_anchor))
    kind = F.when(F.col("more") > HOT_STRETCHES, HOT).otherwise(ANCHOR)
    return found.filter("total > 1").select("block", "h", kind.alias("kind"))


def is_recurring(hashes: np.ndarray, table: pa.Table, kind: int) -> np.ndarray:
    return np.isin(hashes.view(np.int64), table.filter(pc.equal(table.column("kind"), kind)).column("h").to_numpy())


def expanded(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All window starts of the runs [first, last], one run after the other."""
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def hot_windows(
    first: np.ndarray, last: np.ndarray, hashes: np.ndarray, table: pa.Table, mark_first: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recurring windows in the runs [first, last] of hot anchors; ``hashes`` are those of all their windows.

    Run and start of each different window, to be compared; and the start and length of runs of windows that
    stand twice in the block, which are marked at once, with ``mark_first`` also where they first stand.
    """
    again = is_recurring(hashes, table, HOT_WINDOW)
    _, index, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    once = np.zeros(len(hashes), bool)
    once[index] = True
    bounds = np.concatenate([[0], np.cumsum(last - first + 1)])
    sent = np.flatnonzero(once & again)
    run = np.searchsorted(bounds, sent, "right") - 1
    owner, offset, length = runs(again & (count[inverse] > 1) if mark_first else again & ~once, bounds)
    return run, first[run] + sent - bounds[run], first[owner] + offset, length


STRETCHES = "block int, h long, key long, at long, fp long, start long, n long, stretch binary"
MARKS = "block int, at long, fp long, start long, n long"


def mark_table(block, at, fp, start, n) -> pa.Table:
    """``n`` consecutive window starts of a document to be removed."""
    names = ("block", "at", "fp", "start", "n")
    kinds = (pa.int32(), *[pa.int64()] * 4)
    return pa.table({c: pa.array(x, k) for c, x, k in zip(names, (block, at, fp, start, n), kinds, strict=True)})


def stretch_table(block: int, docs: Block, doc, hashes, keys, start, n, texts: list) -> pa.Table:
    """Stretches around the anchors ``hashes``; those with equal windows have equal ``keys``."""
    marks = mark_table(np.full(len(doc), block, np.int32), docs.at[doc], docs.fp[doc], start, n)
    return pa.table(
        {
            "block": marks["block"], "h": pa.array(hashes, pa.int64()), "key": pa.array(keys, pa.int64()), "at": marks["at"], "fp": marks["fp"],
            "start": marks["start"], "n": marks["n"], "stretch": pa.array(texts, pa.binary()),
        }
    )


def in_shards(stretches: DataFrame, n_shards: int):
    """Stretches with one key (their anchor, or the window itself where that is hot), and so all equal windows, meet in one shard.

    Rows without a stretch are marks already; they are spread evenly and only pass through.
    """
    key = F.when(F.col("stretch").isNotNull(), F.xxhash64("key")).otherwise(F.xxhash64("at", "start"))
    return stretches.withColumn("shard", F.pmod(key, F.lit(n_shards))).groupBy("shard")


def settled(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows of a shard with a stretch, and the others as marks."""
    marked = pc.is_null(table.column("stretch"))
    return table.filter(pc.invert(marked)), table.filter(marked).select(["block", "at", "fp", "start", "n"])


def repeated(docs: DataFrame, steps, block_bytes: int, shard_bytes: int):
    """Documents in blocks next to the marks of what is removed from them.

    ``steps`` are the functions that make a block's anchors, its windows at hot anchors, its stretches and a
    shard's marks. All is one plan, in which the texts are moved once and read four times.
    """
    size = text_bytes(docs)
    blocks = dealt(docs, max(1, -(-size // block_bytes))).groupBy("block")
    anchors = recurring(blocks.applyInArrow(steps[0], ANCHORS))
    windows = blocks.cogroup(anchors.filter(F.col("kind") == HOT).groupBy("block")).applyInArrow(steps[1], ANCHORS)
    known = anchors.union(recurring(windows).withColumn("kind", F.lit(HOT_WINDOW)))
    stretches = blocks.cogroup(known.groupBy("block")).applyInArrow(steps[2], STRETCHES)
    marks = in_shards(stretches, max(1, -(-size // shard_bytes))).applyInArrow(steps[3], MARKS)
    return blocks.cogroup(marks.groupBy("block"))


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, offset and length of each run of set flags; runs end at the bounds of their owner."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(flags)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(owner[place]) != 0)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(place)))
    return owner[place[first]], place[first] - bounds[owner[place[first]]], length
