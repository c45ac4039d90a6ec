"""Removing repeated passages with Aho-Corasick automata.

Every window of ``WINDOW`` words whose words also start earlier, in a document with a smaller id or
further left in the same one, is removed. The stretches of text around recurring anchors (see
``passages``) are dealt into shards, so that equal windows meet. A shard confirms which windows
recur, compiles them into automata over its words and streams its stretches through them; that
locates every occurrence, word by word, and all but the first of each window are marked.

Defined cases: null and empty texts have no words; rows without an id come last; rows with equal ids
are ordered by a hash of their texts, and equal rows count as one document; other columns are
never read.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphstat.llm import passages
from glyphstat.llm.passages import Block
from glyphstat.llm.words import Words, covered, prefix_hashes, sha256, span_hashes

WINDOW = 20
GRAM = 6

# Windows that one automaton holds at most; a shard with more of them compiles several.
MAX_PATTERNS = 20_000

# Symbols of an automaton's alphabet leave out the surrogates, which no text can hold.
_SURROGATES = 0xD800


def _anchors(words: Words):
    hashes = words.hashes()
    grams, _ = words.windows(hashes, GRAM)
    _, whole = words.windows(hashes, WINDOW)
    first, last, anchor = passages.window_anchors(grams, whole, WINDOW - GRAM + 1)
    return hashes, first, last, grams[anchor]


def block_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    hashes, first, last, grams = _anchors(Words(Block(table).texts))
    return passages.anchor_table(key[0].as_py(), grams, span_hashes(prefix_hashes(hashes), first, last + WINDOW))


def block_windows(key: tuple[pa.Scalar, ...], table: pa.Table, anchors: pa.Table) -> pa.Table:
    """The windows around hot anchors."""
    found = np.zeros(0, np.uint64)
    if anchors.num_rows:
        words = Words(Block(table).texts)
        hashes, first, last, grams = _anchors(words)
        hot = passages.is_recurring(grams, anchors, passages.HOT)
        found = words.windows(hashes, WINDOW)[0][passages.expanded(first[hot], last[hot])]
    return passages.anchor_table(key[0].as_py(), found, found)


def block_stretches(key: tuple[pa.Scalar, ...], table: pa.Table, anchors: pa.Table) -> pa.Table:
    """Each different stretch around a recurring anchor, or window of a hot one, once; its repeats are marked at once."""
    docs = Block(table)
    words = Words(docs.texts)
    hashes, first, last, grams = _anchors(words)
    keep = passages.is_recurring(grams, anchors, passages.ANCHOR)
    hot = passages.is_recurring(grams, anchors, passages.HOT)
    hot_first, hot_last, hot_grams = first[hot], last[hot], grams[hot]
    first, last, grams = first[keep], last[keep], grams[keep]
    spans = span_hashes(prefix_hashes(hashes), first, last + WINDOW)
    new = np.zeros(len(first), bool)
    new[np.unique(spans, return_index=True)[1]] = True
    windows, _ = words.windows(hashes, WINDOW)
    run, one, again, length = passages.hot_windows(
        hot_first, hot_last, windows[passages.expanded(hot_first, hot_last)], anchors, False
    )
    none = np.zeros(len(again), np.uint64)
    keys = np.concatenate([grams, windows[one], none]).view(np.int64)
    grams = np.concatenate([grams, hot_grams[run], none]).view(np.int64)
    first, last = np.concatenate([first, one, again]), np.concatenate([last, one, again + length - 1])
    new = np.concatenate([new, np.ones(len(one), bool), np.zeros(len(again), bool)])
    raw, begin, end = words.raw, words.start[first], words.end[last + WINDOW - 1]
    texts = [
        b" ".join(raw[i:j].split()) if once else None
        for i, j, once in zip(begin.tolist(), end.tolist(), new.tolist(), strict=True)
    ]
    doc = words.doc[first]
    return passages.stretch_table(
        key[0].as_py(), docs, doc, grams, keys, first - words.first[doc], last - first + 1, texts
    )


def _symbols(words) -> dict[bytes, str]:
    """A character for every word; other words share the character 0."""
    return {w: chr(i if i < _SURROGATES else i + 2048) for i, w in enumerate(sorted(words), 1)}


def repeated_windows(stretches: list[bytes], order: np.ndarray) -> np.ndarray:
    """Flags of all windows of all stretches: whether an equal window stands earlier in ``order``.

    ``order`` numbers all windows by their place in the corpus.
    """
    split = [s.split() for s in stretches]
    w = Words(stretches)
    windows, whole = w.windows(w.hashes(), WINDOW)
    at = np.flatnonzero(whole)
    owner = w.doc[at]
    _, index, count = np.unique(windows[at], return_inverse=True, return_counts=True)
    again = count[index] > 1
    flags = np.zeros(len(at), bool)
    if not again.any():
        return flags
    bounds = np.searchsorted(owner, np.arange(len(stretches) + 1))
    # One window of each recurring hash, in groups of bounded size.
    members = np.flatnonzero(again)
    _, firsts = np.unique(index[members], return_index=True)
    patterns = members[firsts]
    active = np.unique(owner[members])
    for k in range(0, len(patterns), MAX_PATTERNS):
        chosen = patterns[k : k + MAX_PATTERNS]
        phrases = [split[d][i : i + WINDOW] for d, i in zip(owner[chosen].tolist(), (chosen - bounds[owner[chosen]]).tolist(), strict=True)]
        symbols = _symbols({word for phrase in phrases for word in phrase})
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, phrase in enumerate(phrases):
            automaton.add_word("".join(map(symbols.__getitem__, phrase)), number)
        automaton.make_automaton()
        found_window, found_phrase = [], []
        for d in active.tolist():
            text = "".join([symbols.get(word, "\0") for word in split[d]])
            base = int(bounds[d]) - WINDOW + 1
            for end, number in automaton.iter(text):
                found_window.append(base + end)
                found_phrase.append(number)
        window, phrase = np.array(found_window, np.int64), np.array(found_phrase, np.int64)
        earliest = np.full(len(phrases), np.iinfo(np.int64).max)
        np.minimum.at(earliest, phrase, order[window])
        flags[window[order[window] > earliest[phrase]]] = True
    return flags


def shard_marks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Marks of the shard's windows that stand earlier."""
    table, marked = passages.settled(table)
    at, fp, start, n, block = (table.column(c).to_numpy() for c in ("at", "fp", "start", "n", "block"))
    order = np.lexsort((start, fp, at))
    at, fp, start, n, block = at[order], fp[order], start[order], n[order], block[order]
    texts = table.column("stretch").take(pa.array(order)).to_pylist()
    # A stretch that has stood in an earlier place is removed whole; the rest is compared by windows.
    first: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    once = np.array(sorted(first.values()), np.int64)
    copies = np.setdiff1d(np.arange(len(texts)), once)
    bounds = np.concatenate([[0], np.cumsum(n[once])])
    flags = repeated_windows([texts[i] for i in once], np.arange(bounds[-1]))
    owner, offset, length = passages.runs(flags, bounds)
    rows = np.concatenate([copies, once[owner]])
    found = passages.mark_table(
        block[rows], at[rows], fp[rows], np.concatenate([start[copies], start[once[owner]] + offset]),
        np.concatenate([n[copies], length]),
    )
    return pa.concat_tables([marked, found])


def block_result(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
    """``(doc_id, n_words, n_removed, kept)`` of every row; ``kept`` is the words that stay, joined."""
    docs = Block(table)
    words = Words(docs.texts)
    doc = docs.places(marks)
    first, n = words.first[doc] + marks.column("start").to_numpy(), marks.column("n").to_numpy()
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else first, n) + np.arange(n.sum())
    gone = covered(starts, WINDOW, len(words.start))
    removed = np.bincount(words.doc[gone], minlength=words.n)
    kept = []
    for d, text in enumerate(docs.texts):
        parts = (text or b"").split()
        if removed[d]:
            stays = ~gone[words.first[d] : words.first[d + 1]]
            parts = [parts[i] for i in np.flatnonzero(stays).tolist()]
        kept.append(b" ".join(parts))
    rows = docs.row_of
    return pa.table(
        {
            "doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(words.first)[rows]),
            "n_removed": pa.array(removed[rows].astype(np.int64)), "kept": pa.array([kept[i] for i in rows], pa.binary()),
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
    """``(doc_id, n_words, n_removed, kept)``, or ``kept_sha256`` in place of ``kept`` with ``digests``."""
    pairs = passages.repeated(docs, (block_anchors, block_windows, block_stretches, shard_marks), block_bytes, shard_bytes)
    if digests:
        return pairs.applyInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return pairs.applyInArrow(block_result, "doc_id long, n_words long, n_removed long, kept binary")
