"""Words, lines and their hashes for whole batches of texts at once.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. A :class:`Words` holds the
words of many texts in flat numpy arrays: texts are joined by a line break, so no word spans two of
them. Hashes of words, lines and windows of a fixed width are sums of 64-bit values, each times a factor of
its place; hashes of any other spans are polynomials modulo 2 ** 61 - 1. Both are finished with a bit mixer.
Factors and base have no pattern, so no regular text makes spans of different content collide.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are held in arrays at a time; one longer text is a batch of its own.
CHUNK_BYTES = 1_000_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = _SEPARATOR.copy()
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Values of bytes in hashes, and factors of the places in a span: unrelated 64-bit numbers.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_places = {"factors": mix(np.arange(1 << 12, dtype=np.uint64) + np.uint64(1 << 40))}

# Powers of a base that are kept, at most.
_KEPT_POWERS = 6_000_000

# Entries that are worked on at a time, so that what lies between stays in a processor's cache.
_STEP = 1 << 16


def _factors(n: int) -> np.ndarray:
    if n > len(_places["factors"]):
        made = mix(np.arange(max(n, 2 * len(_places["factors"])), dtype=np.uint64) + np.uint64(1 << 40))
        if n > CHUNK_BYTES:
            return made
        _places["factors"] = made
    return _places["factors"]


def piece_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end) that do not overlap: sums of values times a factor of their place in the span."""
    length = end - start
    out = np.zeros(len(start), np.uint64)
    total = np.cumsum(length)
    factors = _factors(int(length.max(initial=0)))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _STEP)))
        filled = i + np.flatnonzero(length[i:j])
        if len(filled):
            n = length[filled]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first, n)
            out[filled] = np.add.reduceat(values[place + np.repeat(start[filled], n)] * factors[place], first)
        i = j
    return mix(out + mix(length.astype(np.uint64)))


# Spans that overlap are hashed by polynomials modulo a prime, in a base without any pattern.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x11D3F5A9C7B2E64D % ((1 << 61) - 1)
_INVERSE = pow(_BASE, -1, (1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_powers: dict[str, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - _PRIME)  # a difference below 0 wraps to a large number


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues, from halves of 31 bits."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a_high * b_low + a_low * b_high
    return _reduced(
        ((a_high * b_high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a_low * b_low
    )


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    """The first n powers; tables up to a size are kept."""
    known = _powers.get(name, np.ones(1, np.uint64))
    if len(known) < n:
        size = max(n, min(2 * len(known), _KEPT_POWERS))
        out = np.ones(size, np.uint64)
        out[: len(known)] = known
        done = len(known)
        while done < size:
            more = min(done, size - done, _STEP)
            factor = np.full(1, pow(base, done, (1 << 61) - 1), np.uint64)
            out[done : done + more] = _times(out[:more], factor)
            done += more
        known = out
        if size <= _KEPT_POWERS:
            _powers[name] = out
    return known[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of values below 2 ** 32 or of any 64-bit values, one longer than the values."""
    up = _power_table("up", _BASE, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    carry = np.uint64(0)
    for i in range(0, len(values), _STEP):
        j = min(i + _STEP, len(values))
        term = _times(up[i:j], _reduced(values[i:j].astype(np.uint64)))
        high, low = np.cumsum(term >> np.uint64(31)), np.cumsum(term & _LOW31)
        high = _reduced(high)
        out[i + 1 : j + 1] = _reduced((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + low + carry)
        carry = out[j]
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal spans wherever they stand."""
    down = _power_table("down", _INVERSE, len(prefix))
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _STEP):
        a, b = start[i : i + _STEP], end[i : i + _STEP]
        sums = _times(_reduced(prefix[b] + _PRIME - prefix[a]), down[a])
        out[i : i + _STEP] = mix(sums + mix((b - a).astype(np.uint64)))
    return out


class Words:
    """The words of some texts (bytes; None is a text without words)."""

    def __init__(self, texts: list, punctuation: bool = False):
        """With ``punctuation`` ASCII punctuation separates words too."""
        self.n = len(texts)
        self.raw = b"\n".join([t or b"" for t in texts]) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, self.n)
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = ~(_PUNCTUATION if punctuation else _SEPARATOR)[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_start)  # of each text, and the end
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        self.data = data

    def hashes(self, lower: bool = False, first_bytes: int | None = None) -> np.ndarray:
        """A hash per word, with A-Z as a-z if ``lower``, of its first bytes only if so many are given."""
        end = self.end if first_bytes is None else np.minimum(self.end, self.start + first_bytes)
        return piece_hashes((_LOWER_BYTE if lower else _BYTE)[self.data], self.start, end)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the lines of all texts begin and end."""
        end = np.flatnonzero(self.data == 10)
        return np.concatenate([[0], end[:-1] + 1]).astype(np.int64), end

    def line_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return piece_hashes(_BYTE[self.data], start, end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and whether they end in the same text."""
        n = len(hashes)
        if n < width:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        whole, factors = out[: n - width + 1], _factors(width)
        for k in range(width):
            whole += hashes[k : n - width + 1 + k] * factors[k]
        out[: n - width + 1] = mix(whole + mix(np.full(1, width, np.uint64)))
        return out, np.arange(n) + width <= self.first[self.doc + 1]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans that begin at ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_bytes(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more than CHUNK_BYTES of one text column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        sizes = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end
