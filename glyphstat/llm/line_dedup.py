"""Deleting aligned common blocks of lines from the later of two documents.

Documents that overlap are found through the least runs of lines that have enough words: each holder of
a run is paired with the first document that holds it. Every common block is a union of such runs, so
no block is missed, and the number of pairs stays below the number of runs. Each pair is aligned by
patience diff: lines that are unique in both texts are matched along a longest increasing sequence,
matches grow over equal neighbours, and the gaps between them are aligned in the same way. What stays
unmatched of the later text, as its block is repeated or stands in another order, is then searched for in
the whole of the earlier text by least runs. So a line is deleted from the document with the larger id
if and only if a run of lines around it with enough words stands in an earlier one; both texts are taken
as they came.

Defined cases: null texts have no lines and stay null; documents without an id stay as they are;
rows with equal ids are never compared with each other, and each is judged by its own text; other
columns pass through. Lines are compared by a 64-bit hash of their bytes.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.storage import cut
from glyphstat.llm.words import Words, as_bytes, chunks, mix, prefix_hashes, span_hashes

# Words that a deleted block has at least.
MIN_BLOCK_WORDS = 20

# Lines that are held in arrays at a time; one longer text is a batch of its own.
CHUNK_LINES = 500_000


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, increasing in both."""
    matches: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            matches.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            matches.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: k for k, x in enumerate(b[j:j_end], j) if once_b[x] == 1}
        common = [(k, place[x]) for k, x in enumerate(a[i:i_end], i) if once_a[x] == 1 and x in place]
        chain = _longest_increasing(common)
        for (k, m), (k_next, m_next) in zip([(i - 1, j - 1), *chain], [*chain, (i_end, j_end)], strict=True):
            if chain and k + 1 < k_next and m + 1 < m_next:
                stack.append((k + 1, k_next, m + 1, m_next))
        matches += chain
    return sorted(matches)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs whose second parts increase; the first parts do already."""
    ends: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, m) in enumerate(pairs):
        at = bisect_left(ends, m)
        back.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [m], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def blocks(a: list, b: list, words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Line ranges [start, end) of ``a`` that stand in ``b`` as one block of at least ``min_words`` words.

    Together they hold every line of ``a`` that is in such a block, wherever the block stands in ``b``.
    """
    found, run = [], []
    for match in [*patience(a, b), (-1, -1)]:
        if run and match == (run[-1][0] + 1, run[-1][1] + 1):
            run.append(match)
            continue
        if run and sum(words[run[0][0] : run[-1][0] + 1]) >= min_words:
            found.append((run[0][0], run[-1][0] + 1))
        run = [match]
    return joined(found + _left_over(a, b, words, min_words, found))


def _left_over(a: list, b: list, words: list[int], min_words: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The least runs of ``a`` that stand in ``b`` but not wholly in the ``found`` ranges.

    An alignment matches a line once and in one order; repeated and moved blocks are found here.
    """
    start, end = run_bounds(np.array(words, np.int64), np.array([0, len(a)]), min_words)
    gone = np.zeros(len(a) + 1, np.int64)
    for i, j in found:
        gone[i + 1 : j + 1] = 1
    gone = np.cumsum(gone)
    left = gone[end] - gone[start] < end - start
    if not left.any():
        return []
    start, end = start[left], end[left]
    # A line that is not in ``a`` may have any number of words, as no run of ``a`` holds it.
    count = dict(zip(a, words, strict=True))
    other = np.array([count.get(line, min_words) for line in b], np.int64)
    keys = _run_hashes(a, start, end)
    stands = np.isin(keys, _run_hashes(b, *run_bounds(other, np.array([0, len(b)]), min_words)))
    return list(zip(start[stands].tolist(), end[stands].tolist(), strict=True))


def _run_hashes(lines: list | np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(mix(np.asarray(lines, np.int64).view(np.uint64))), start, end)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, lines, words)``: hash and number of words of every line of documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(as_bytes(batch.column("text")))
            start, end = w.lines()
            hashes = w.line_hashes(start, end).view(np.int64)
            words = (np.searchsorted(w.start, end) - np.searchsorted(w.start, start)).astype(np.int32)
            bounds = np.searchsorted(start, w.text_start).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("fp"), pa.ListArray.from_arrays(bounds, pa.array(hashes)),
                    pa.ListArray.from_arrays(bounds, pa.array(words)),
                ],
                names=["doc_id", "fp", "lines", "words"],
            )

    keyed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), fingerprint(), "text")
    return keyed.mapInArrow(run, "doc_id long, fp long, lines array<long>, words array<int>")


def fingerprint() -> Column:
    return F.xxhash64("text").alias("fp")


def run_bounds(words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The least runs of lines [start, end) with ``min_words`` words, from every line on and up to every line.

    ``words`` are those of the lines of some texts, ``bounds`` where the texts begin and end. Every common
    block of two texts is a union of such runs, and each of them stands in both.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    place = np.arange(len(words))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    on, up = end <= bounds[text + 1], start >= bounds[text]
    found = np.unique(
        np.concatenate([np.column_stack([place, end])[on], np.column_stack([start, place + 1])[up]]), axis=0
    )
    return found[:, 0], found[:, 1]


def run_table(lines: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, fp, run)``: hashes of the least runs of every document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in line_chunks(batches):
            hashes, words = batch.column("lines"), batch.column("words").flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())])
            start, end = run_bounds(words, bounds, min_words)
            keys = _run_hashes(hashes.flatten().to_numpy(), start, end)
            doc = np.searchsorted(bounds, start, "right") - 1
            order = np.lexsort((keys, doc))
            doc, keys = doc[order], keys[order]
            new = np.ones(len(doc), bool)
            new[1:] = (np.diff(doc) != 0) | (np.diff(keys.view(np.int64)) != 0)
            owner = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("fp").take(owner), pa.array(keys[new].view(np.int64))],
                names=["doc_id", "fp", "run"],
            )

    return lines.mapInArrow(run, "doc_id long, fp long, run long")


def line_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more than CHUNK_LINES lines."""
    for batch in batches:
        sizes = np.cumsum(batch.column("lines").value_lengths().to_numpy())
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_LINES, "right")))
            yield batch.slice(start, end - start)
            start = end


def overlapping(lines: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """Pairs ``(doc_id, fp, other_id, other_fp)`` of a document and the first one that holds a run of its lines."""
    holders = run_table(lines, min_words)
    # Stored, so that the join below sees exchanges on both sides and can split a frequent run.
    shared = cut(
        holders.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "fp")).alias("first"))
        .filter("n > 1").select("run", F.col("first.doc_id").alias("other_id"), F.col("first.fp").alias("other_fp"))
    )
    return holders.join(shared, "run").filter("other_id < doc_id").drop("run").distinct()


def removed_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``(doc_id, fp, ranges)``: the line ranges to delete from each later document."""
    lines = cut(line_table(docs).dropDuplicates(["doc_id", "fp"]))
    other = lines.select(F.col("doc_id").alias("other_id"), F.col("fp").alias("other_fp"), F.col("lines").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name) for name in ("lines", "other", "words")]
            found = [
                [{"start": s, "end": e} for s, e in blocks(*(x.as_py() for x in row), min_words)]
                for row in zip(*columns, strict=True)
            ]
            ranges = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("fp"), ranges], names=["doc_id", "fp", "ranges"]
            )
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    aligned = (
        overlapping(lines, min_words).join(lines, ["doc_id", "fp"]).join(other, ["other_id", "other_fp"])
        .select("doc_id", "fp", "lines", "other", "words")
        .mapInArrow(run, "doc_id long, fp long, ranges array<struct<start:int,end:int>>")
    )
    return aligned.groupBy("doc_id", "fp").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"))


def without_common_blocks(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``kept_text`` (the lines that stay), ``n_lines`` and ``n_removed``."""
    gone = cut(removed_lines(docs, min_words)).select(
        F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp"), F.col("ranges").alias("gone_ranges")
    )
    split = F.split("text", "\n", -1)
    kept = F.filter(
        split, lambda _, i: ~F.exists("gone_ranges", lambda r: (r["start"] <= i) & (i < r["end"]))
    )
    found = docs.join(
        gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_fp")), "left"
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    n_kept = F.when(F.col("gone_id").isNull(), n_lines).otherwise(F.size(kept)).cast("long")
    return found.select(
        *(docs[c] for c in docs.columns),
        F.when(F.col("gone_id").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"),
    )
