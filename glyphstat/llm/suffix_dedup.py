"""Removing byte strings that stand in more than one place, by a hash-compared suffix sort.

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else is removed. The
stretches of text around recurring anchors (see ``passages``) are dealt into shards, so that equal
strings meet. A shard sorts the suffixes that begin at its anchors: the common extension of two
suffixes is found by binary search over prefix polynomial hashes, so a comparison takes a number of
steps that is the logarithm of the length, and a mergesort puts suffixes with long common
extensions next to each other. What precedes the anchors is sorted in the same way, read backwards; the
bytes of neighbours are compared. The two orders decide which windows are equal.

Defined cases: null texts count as empty; matches never cross documents; rows without an id are
documents as any other; equal rows (same id, same text) count as one document; other columns are
never read.
"""

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphstat.llm import passages
from glyphstat.llm.passages import Block
from glyphstat.llm.words import prefix_hashes, sha256, span_hashes

WINDOW = 200
GRAM = 50


class Texts:
    """Texts in one buffer, a zero byte after each, with prefix hashes."""

    def __init__(self, texts: list):
        self.raw = b"\0".join([t or b"" for t in texts]) + b"\0"
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(size + 1)])
        self.size = size

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_hashes(self.data)

    def spans(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on, as far as the buffer goes."""
        place = np.arange(max(0, len(self.data) - width + 1))
        return span_hashes(self.prefix, place, place + width)

    def windows(self) -> np.ndarray:
        """Places where a window begins that ends in the same text."""
        ends = np.repeat(self.start[:-1] + self.size, self.size + 1)
        return np.arange(len(self.data)) + WINDOW <= ends


def _anchors(texts: Texts):
    grams = texts.spans(GRAM)
    first, last, anchor = passages.window_anchors(grams, texts.windows(), WINDOW - GRAM + 1)
    return first, last, anchor, grams[anchor] if len(anchor) else np.zeros(0, np.uint64)


def block_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    texts = Texts(Block(table).texts)
    first, last, _, grams = _anchors(texts)
    return passages.anchor_table(key[0].as_py(), grams, span_hashes(texts.prefix, first, last + WINDOW))


def block_windows(key: tuple[pa.Scalar, ...], table: pa.Table, anchors: pa.Table) -> pa.Table:
    """The windows around hot anchors."""
    found = np.zeros(0, np.uint64)
    if anchors.num_rows:
        texts = Texts(Block(table).texts)
        first, last, _, grams = _anchors(texts)
        hot = passages.is_recurring(grams, anchors, passages.HOT)
        place = passages.expanded(first[hot], last[hot])
        found = span_hashes(texts.prefix, place, place + WINDOW)
    return passages.anchor_table(key[0].as_py(), found, found)


def block_stretches(key: tuple[pa.Scalar, ...], table: pa.Table, anchors: pa.Table) -> pa.Table:
    """Each different stretch around a recurring anchor, or window of a hot one, once; one that stands twice is marked at once."""
    docs = Block(table)
    texts = Texts(docs.texts)
    first, last, _, grams = _anchors(texts)
    keep = passages.is_recurring(grams, anchors, passages.ANCHOR)
    hot = passages.is_recurring(grams, anchors, passages.HOT)
    hot_first, hot_last, hot_grams = first[hot], last[hot], grams[hot]
    first, last, grams = first[keep], last[keep], grams[keep]
    _, index, inverse, count = np.unique(
        span_hashes(texts.prefix, first, last + WINDOW), return_index=True, return_inverse=True, return_counts=True
    )
    sent = np.sort(index)
    twice = count[inverse] > 1
    place = passages.expanded(hot_first, hot_last)
    run, one, again, length = passages.hot_windows(
        hot_first, hot_last, span_hashes(texts.prefix, place, place + WINDOW), anchors, True
    )
    none = np.zeros(int(twice.sum()) + len(again), np.uint64)
    keys = np.concatenate([grams[sent], span_hashes(texts.prefix, one, one + WINDOW), none]).view(np.int64)
    grams = np.concatenate([grams[sent], hot_grams[run], none]).view(np.int64)
    first, last = (
        np.concatenate([x[sent], one, x[twice], y]) for x, y in ((first, again), (last, again + length - 1))
    )
    n = len(sent) + len(one)
    stretches = [texts.raw[i:j] for i, j in zip(first[:n].tolist(), (last[:n] + WINDOW).tolist(), strict=True)]
    doc = np.searchsorted(texts.start, first, "right") - 1
    return passages.stretch_table(
        key[0].as_py(), docs, doc, grams, keys, first - texts.start[doc], last - first + 1, stretches + [None] * len(none)
    )


def _common(texts: Texts, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
    """Length of the common extension from places ``a`` and ``b``, at most ``most``, to the right or left."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        if left:
            same = span_hashes(texts.prefix, a - middle, a) == span_hashes(texts.prefix, b - middle, b)
        else:
            same = span_hashes(texts.prefix, a, a + middle) == span_hashes(texts.prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _heads(texts: Texts, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first seven bytes of each suffix as one number; what lies behind its end counts as less than any byte."""
    out = np.zeros(len(place), np.int64)
    for i in range(7):
        at = place + i
        out = (out << 9) | np.where(at < end, texts.data[np.minimum(at, len(texts.data) - 1)].astype(np.int64) + 1, 0)
    return out


def sorted_suffixes(texts: Texts, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes [place, end) by mergesort; all runs of one width are merged together.

    Two suffixes are told apart by their first bytes, or else by the byte after their common extension.
    """
    n = len(place)
    order = np.arange(n)
    heads = _heads(texts, place, end)

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b, or is equal to it where that counts."""
        out = heads[a] < heads[b]
        alike = np.flatnonzero(heads[a] == heads[b])
        if len(alike):
            out[alike] = after_heads(a[alike], b[alike], or_equal[alike])
        return out

    def after_heads(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        room = np.minimum(end[a] - place[a], end[b] - place[b])
        same = _common(texts, place[a], place[b], room)
        byte_a = np.where(same < end[a] - place[a], texts.data[np.minimum(place[a] + same, end[a] - 1)].astype(np.int64), -1)
        byte_b = np.where(same < end[b] - place[b], texts.data[np.minimum(place[b] + same, end[b] - 1)].astype(np.int64), -1)
        return (byte_a < byte_b) | (or_equal & (byte_a == byte_b))

    width = 1
    while width < n:
        slot = np.arange(n)
        run = slot // width
        sibling = run ^ 1
        low = np.minimum(sibling * width, n)
        start, high = low.copy(), np.minimum(low + width, n)
        # How many of the sibling run come before each suffix; equal ones of the left run do.
        from_left = run % 2 == 1
        while (open_ := low < high).any():
            middle = (low[open_] + high[open_]) // 2
            first = before(order[middle], order[open_], from_left[open_])
            low[open_] = np.where(first, middle + 1, low[open_])
            high[open_] = np.where(first, high[open_], middle)
        merged = np.empty(n, np.int64)
        merged[slot - run * width + (run // 2) * 2 * width + low - start] = order
        order, width = merged, width * 2
    return order


def _neighbours(texts: Texts, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the length of each one's common extension with the next; bytes are compared."""
    order = sorted_suffixes(texts, place, end)
    a, b = place[order[:-1]], place[order[1:]]
    common = _common(texts, a, b, np.minimum(end[order[:-1]] - a, end[order[1:]] - b))
    raw = texts.raw
    for k, (i, j, n) in enumerate(zip(a.tolist(), b.tolist(), common.tolist(), strict=True)):
        if raw[i : i + n] != raw[j : j + n]:
            common[k] = next(m for m in range(n) if raw[i + m] != raw[j + m])
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """A number for each suffix, the same for those that agree in their first ``length`` bytes."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < length)
    return out


def repeated_windows(texts: Texts, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of all windows of different stretches (the texts) that stand in another one too, and their bounds.

    ``anchors`` are the places of the anchors in their stretches. A window reaches some bytes to the left of its
    anchor and the rest to the right; it stands in another stretch if that one agrees with it on both sides.
    The sorted order of what follows the anchors tells which agree to the right, that of what precedes them,
    read backwards, which agree to the left.
    """
    n = len(texts.size)
    back = Texts([texts.raw[i : i + k][::-1] for i, k in zip(texts.start.tolist(), texts.size.tolist())])
    begin, end = texts.start[:-1], texts.start[:-1] + texts.size
    bounds = np.concatenate([[0], np.cumsum(texts.size - WINDOW + 1)])
    flags = np.zeros(bounds[-1], bool)
    right = _neighbours(texts, begin + anchors, end)
    left = _neighbours(back, end - anchors, end)
    for reach in range(WINDOW - GRAM + 1):
        both = _classes(*right, WINDOW - reach) * n + _classes(*left, reach)
        order = np.argsort(both)
        same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
        found = np.concatenate([order[same], order[same + 1]])
        flags[bounds[found] + anchors[found] - reach] = True
    return flags, bounds


def shard_marks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Marks of the shard's windows that stand in another place too."""
    table, marked = passages.settled(table)
    at, fp, start, n, block, h = (table.column(c).to_numpy() for c in ("at", "fp", "start", "n", "block", "h"))
    texts = table.column("stretch").to_pylist()
    place: dict[bytes, int] = {}
    number = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(texts))
    whole = np.bincount(number)[number] > 1
    different = list(place)
    first = np.unique(number, return_index=True)[1]
    stretches = Texts(different)
    flags, bounds = repeated_windows(stretches, anchor_places(stretches, h[first]))
    owner, offset, length = passages.runs(flags, bounds)
    # Equal stretches are removed whole, so what is left are stretches of one place.
    single = ~whole[first[owner]]
    rows = np.concatenate([np.flatnonzero(whole), first[owner[single]]])
    found = passages.mark_table(
        block[rows], at[rows], fp[rows], np.concatenate([start[whole], start[first[owner[single]]] + offset[single]]),
        np.concatenate([n[whole], length[single]]),
    )
    return pa.concat_tables([marked, found])


def anchor_places(texts: Texts, h: np.ndarray) -> np.ndarray:
    """Where the gram with hash ``h`` first stands in each stretch, which is where all its windows hold it."""
    low, high = texts.start[:-1] + texts.size - WINDOW, texts.start[:-1] + WINDOW - GRAM
    place = passages.expanded(low, high)
    owner = np.repeat(np.arange(len(low)), high - low + 1)
    hits = np.flatnonzero(span_hashes(texts.prefix, place, place + GRAM).view(np.int64) == h[owner])[::-1]
    out = np.zeros(len(low), np.int64)
    out[owner[hits]] = place[hits] - texts.start[owner[hits]]
    return out


def block_result(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row."""
    docs = Block(table)
    texts = Texts(docs.texts)
    doc = docs.places(marks)
    first, n = texts.start[doc] + marks.column("start").to_numpy(), marks.column("n").to_numpy()
    step = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + n + WINDOW - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    begins = gone & ~np.append(False, gone[:-1])
    total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
    removed, n_spans = (x[texts.start[1:]] - x[texts.start[:-1]] for x in (total, spans))
    kept = []
    for d, text in enumerate(docs.texts):
        text = text or b""
        if removed[d]:
            i = texts.start[d]
            text = texts.data[i : i + len(text)][~gone[i : i + len(text)]].tobytes()
        kept.append(text)
    rows = docs.row_of
    return pa.table(
        {
            "doc_id": table.column("doc_id"), "n_bytes": pa.array(texts.size[rows]), "n_removed": pa.array(removed[rows]),
            "n_spans": pa.array(n_spans[rows]), "kept": pa.array([kept[i] for i in rows], pa.binary()),
        }
    )


def _digested(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
    out = block_result(key, table, marks)
    digests = pa.array([sha256(x) for x in out.column("kept").to_pylist()], pa.string())
    return out.drop_columns("kept").append_column("kept_sha256", digests)


def without_repeats(
    docs: DataFrame, digests: bool = False,
    block_bytes: int = passages.BLOCK_BYTES, shard_bytes: int = passages.SHARD_BYTES,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, or ``kept_sha256`` in place of ``kept``."""
    pairs = passages.repeated(docs, (block_anchors, block_windows, block_stretches, shard_marks), block_bytes, shard_bytes)
    kept = "kept_sha256 string" if digests else "kept binary"
    return pairs.applyInArrow(
        _digested if digests else block_result, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}"
    )
