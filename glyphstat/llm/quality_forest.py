"""Quality rules and an isolation forest over their statistics.

Every document gets the statistics that simple quality rules look at. Two rules reject outright; of
the rest an isolation forest tells how easily a document is set apart from the labelled documents
by random splits of those statistics, and a threshold fitted to the labels turns that into a verdict.

Defined cases: a null or empty text has no words and fails the base rules; rows are judged one by
one, so repeated rows and ties get equal verdicts; without labelled rows of both kinds only the base
rules decide; other columns are never read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.words import Words, as_bytes, chunks, covered, mix

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Labelled rows that the forest and its threshold are fitted on, at most.
MAX_LABELLED = 20_000

_SYMBOL, _UPPER, _MARK, _WORD_BYTE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(range(65, 91))] = True
_MARK[list(b"!?")] = True
_WORD_BYTE[:] = True
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_WORD_BYTE[128:192] = False  # continuation bytes: only the first byte of a character counts


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in the same text, and which of those come after the first."""
    joint = mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    again, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, again


def text_stats(texts: list) -> np.ndarray:
    """One row of STATS for each text (UTF-8 bytes or None)."""
    w = Words(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, w.text_start[:-1], dtype=np.int64)

    if not texts:
        return np.zeros((0, len(STATS)), np.int64)
    start, end = w.lines()
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[has_word], end[has_word]
    line_doc = np.searchsorted(w.text_start, start, "right") - 1
    _, again = _repeats(w.line_hashes(start, end), line_doc)

    three, whole = w.windows(w.hashes(), 3)
    at = np.flatnonzero(whole)
    repeated, _ = _repeats(three[at], w.doc[at])
    in_repeat = covered(at[repeated], 3, len(w.start))

    count = np.bincount
    return np.stack(
        [
            np.diff(w.first), per_text(_WORD_BYTE[w.data]), per_text(_SYMBOL[w.data]),
            count(line_doc[again], minlength=w.n), count(w.doc[in_repeat], minlength=w.n),
            count(line_doc, minlength=w.n), per_text(_UPPER[w.data]), per_text(_MARK[w.data]),
        ],
        axis=1,
    ).astype(np.int64)


def stats(docs: DataFrame) -> DataFrame:
    """``(doc_id, <STATS>)``, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            table = text_stats(as_bytes(batch.column("text")))
            columns = [batch.column("doc_id"), *(pa.array(table[:, i]) for i in range(len(STATS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in STATS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def base_failed(table: np.ndarray) -> np.ndarray:
    words, repeats = table[:, 0], table[:, STATS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


# Shares of repeated words and lines that good texts reach too; only what lies above tells texts apart.
COMMON_SHARE = 0.3


def features(table: np.ndarray) -> np.ndarray:
    """What the forest splits on: word length, the shares of symbols, capitals and marks, and the excess of repetition.

    None of them grows with the length of a text. Repetition counts from ``COMMON_SHARE`` on: good texts
    with a few repeated lines would be the first to be isolated otherwise.
    """
    t = {name: table[:, i].astype(np.float64) for i, name in enumerate(STATS)}
    words, chars, lines = (np.maximum(t[name], 1) for name in ("n_words", "word_chars", "n_lines"))
    repeated = [np.maximum(x - COMMON_SHARE, 0) for x in (t["n_repeat_words"] / words, t["n_dup_lines"] / lines)]
    return np.stack(
        [t["word_chars"] / words, t["n_symbols"] / words, t["n_upper"] / chars, t["n_marks"] / words, *repeated], axis=1
    )


class Forest:
    """Random isolation trees in flat arrays, with the score above which a document is an anomaly."""

    def __init__(self, points: np.ndarray, trees: int = 200, sample: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(points))
        depth = int(np.ceil(np.log2(max(self.sample, 2))))
        self.nodes = []  # per tree: column, cut, left child, path length at a leaf
        for _ in range(trees):
            nodes: list[list] = []
            self._grow(points[rng.choice(len(points), self.sample, replace=False)], 0, depth, rng, nodes)
            self.nodes.append([np.array(x) for x in zip(*nodes, strict=True)])
        self.threshold = np.inf

    def _grow(self, points, level, depth, rng, nodes) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, level + _mean_path(len(points))])
        spread = np.flatnonzero(np.ptp(points, axis=0) > 0) if len(points) > 1 else []
        if level < depth and len(spread):
            column = int(rng.choice(spread))
            cut = rng.uniform(points[:, column].min(), points[:, column].max())
            low = points[:, column] <= cut
            left = self._grow(points[low], level + 1, depth, rng, nodes)
            right = self._grow(points[~low], level + 1, depth, rng, nodes)
            nodes[at] = [column, cut, left, right, 0.0]
        return at

    def score(self, points: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is easier to isolate."""
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for column, cut, left, right, length in self.nodes:
            at = np.zeros(len(points), np.int64)
            while (inner := column[at] >= 0).any():
                go = points[rows, np.maximum(column[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.nodes) / _mean_path(self.sample))


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n entries."""
    if n < 2:
        return 0.0 if n < 1 else 1e-9
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit(table: np.ndarray, good: np.ndarray, max_lost: float = 0.005) -> Forest | None:
    """Grow a forest on the labelled rows that pass the base rules and calibrate its threshold.

    The threshold is the one with the best balanced accuracy among those that reject at most
    ``max_lost`` of the good rows, halfway to the next higher score.
    """
    ok = ~base_failed(table)
    points, good = features(table[ok]), good[ok]
    if good.sum() < 2 or good.all():
        return None
    forest = Forest(points)
    scores = forest.score(points)
    floor = np.quantile(scores[good], 1 - max_lost, method="higher")
    cuts = np.unique(scores[scores >= floor])
    caught = (scores[~good][:, None] > cuts).mean(axis=0)
    lost = (scores[good][:, None] > cuts).mean(axis=0)
    best = int(np.argmax(caught - lost))
    forest.threshold = (cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2
    return forest


def fit_labelled(statistics: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Forest | None:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of their id."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = (
        statistics.join(marks.dropna(), "doc_id").select(*STATS, "quality")
        .orderBy(F.xxhash64("doc_id", F.lit(7)), *STATS).limit(max_labelled).collect()
    )
    if not rows:
        return None
    table = np.array([tuple(r) for r in rows], np.int64)
    return fit(table[:, :-1], table[:, -1] == 1)


def verdicts(table: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base rule failed, kept, and the anomaly score (0 without a forest)."""
    failed = base_failed(table)
    scores = forest.score(features(table)) if forest and len(table) else np.zeros(len(table))
    return failed, ~failed & ~(scores > forest.threshold if forest else failed), scores


def judge(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``anomaly`` to a table of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(name).to_numpy(False) for name in STATS], axis=1)
            found = [pa.array(x) for x in verdicts(table, forest)]
            names = [*batch.schema.names, "base_failed", "kept", "anomaly"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=names)

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in STATS)
    return statistics.mapInArrow(run, schema + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, all columns unchanged; only texts go to Python, where they are judged."""

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        parts = chunks([pa.RecordBatch.from_arrays([text], names=["text"])])
        found = [verdicts(text_stats(as_bytes(part.column("text"))), forest)[1] for part in parts]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.filter(good("text"))
