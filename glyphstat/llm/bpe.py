"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text arrives in pieces; token ids leave as soon as no later text can change them. Two things are
held back: the end of the text that could still belong to an unfinished pretoken, and, inside one
pretoken, the bytes within the lookahead of the merge list. Both are bounded, so memory does not
grow with the text or with its longest run of letters.

The lookahead is computed from the merges. A merge (x, y) can be prevented only by an earlier merge
that takes the right end of y, which in turn can be prevented by a still earlier one further right.
The longest such chain, in bytes, is how far a decision can depend on what follows.

Defined cases: null counts as an empty text and gives no ids; repeated rows give equal results;
other columns are never read.
"""

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.words import chunks

# The pretoken pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Classes whose runs may be cut: the rest of a cut run is read with the same class. A run of white
# space leaves its last character to what follows, unless nothing does.
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
_SPACE = regex.compile(r"\s+")

# Characters of text that are looked at together, and pretokens that are remembered.
PIECE_CHARS = 1 << 16
MAX_CACHED = 800_000

_NO_MERGE = 1 << 60
_NO_RANK = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """Vocabulary, merges and lookahead read from a vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.byte_ids = [vocab[c] for c in sorted(alphabet, key=alphabet.get)]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.rank_of = {(vocab[left], vocab[right]): rank for rank, (left, right) in enumerate(pairs)}
        self.made = [vocab[left + right] for left, right in pairs]
        self.byte_table, self.made_table = np.array(self.byte_ids, np.int64), np.array(self.made, np.int64)
        keys = np.array([(left << 32) + right for left, right in self.rank_of], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.max_token = max(map(len, self.bytes_of.values()))
        self.lookahead = self._lookahead()
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.chunk_cache: dict[str, tuple[int, ...]] = {}
        self.numbers = np.array(range(max(self.bytes_of) + 1), object)  # one object for each id, however often it is remembered

    def _lookahead(self) -> int:
        """Bytes right of a token that can take part in deciding it."""
        right_end: dict[int, list[int]] = {i: [i] for i in self.byte_ids}  # a token and its right constituents
        reach: dict[int, int] = {}  # longest chain that starts with a merge whose left part is the token
        longest = 0
        for (left, right), rank in self.rank_of.items():
            chain = len(self.bytes_of[right]) + max(reach.get(x, 0) for x in right_end[right])
            reach[left] = max(reach.get(left, 0), chain)
            right_end.setdefault(self.made[rank], [self.made[rank], *right_end[right]])
            longest = max(longest, chain)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a sequence: always the earliest merge, leftmost first."""
        if len(ids) > 200:
            return self._merge_long(ids)
        get, made = self.rank_of.get, self.made
        ranks = [get(pair, _NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) is not _NO_MERGE:
            at = ranks.index(rank)
            ids[at] = made[rank]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), _NO_MERGE)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of possible merges over a linked list."""
        rank_of, n = self.rank_of, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or rank_of.get((ids[i], ids[j])) != rank:
                continue
            ids[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of.get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, after[j]))
            if before[i] >= 0 and (r := rank_of.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (r, before[i], i))
        return [token for token, there in zip(ids, alive, strict=True) if there]

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short pretokens: one merge in every unfinished word at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_table[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = self._ranks(ids, word, np.arange(len(ids)))
        done_word, done_ids = [], []
        while len(ids):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            # The least rank of each word, and the leftmost place that has it.
            best = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), start)
            found, at = best >> 32, best & 0xFFFFFFFF
            open_ = found < _NO_RANK
            ids[at[open_]] = self.made_table[found[open_]]
            stays = np.repeat(open_, np.diff(np.append(start, len(ids))))
            done_word.append(word[~stays])
            done_ids.append(ids[~stays])
            stays[at[open_] + 1] = False
            place = np.cumsum(stays) - 1
            ids, word, rank, at = ids[stays], word[stays], rank[stays], place[at[open_]]
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._ranks(ids, word, changed)
        done = np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(done, kind="stable")
        flat = self.numbers[np.concatenate([np.zeros(0, np.int64), *done_ids])[order]].tolist()
        ends = np.cumsum(np.bincount(done, minlength=len(words))).tolist()
        return [tuple(flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places."""
        out = np.full(len(at), _NO_RANK, np.int64)
        pairs = np.flatnonzero(at + 1 < len(ids))
        pairs = pairs[word[at[pairs]] == word[at[pairs] + 1]]
        keys = (ids[at[pairs]] << 32) + ids[at[pairs] + 1]
        near = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[near] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        out[pairs[known]] = self.pair_ranks[near[known]]
        return out

    def prime(self, texts: list[str]) -> None:
        """Encode together what the texts hold between spaces and is not remembered yet."""
        seen = self.chunk_cache
        new = [c for c in set().union(*(t.split(" ") for t in texts)) if c not in seen and 0 < len(c) <= 32]
        new = [c for c in new if not (c[0].isspace() or c[-1].isspace())]
        if len(seen) + len(new) > MAX_CACHED:
            seen.clear()
        if len(self.cache) + len(new) > MAX_CACHED:
            self.cache.clear()
        # Letters alone, or before a single mark, need no pattern.
        split = [
            [" " + c] if c.isalpha() else [" " + c[:-1], c[-1]] if c[-1] in ".," and c[:-1].isalpha()
            else self.pattern.findall(" " + c)
            for c in new
        ]
        words = list({w for tokens in split for w in tokens if w not in self.cache})
        self.cache.update(zip(words, self.merge_many([w.encode() for w in words]), strict=True))
        cache = self.cache
        for chunk, tokens in zip(new, split, strict=True):
            seen[chunk] = cache[tokens[0]] if len(tokens) == 1 else tuple(i for w in tokens for i in cache[w])

    def pretoken(self, text: str) -> tuple[int, ...]:
        """Ids of a whole pretoken, remembered if it is short."""
        ids = self.cache.get(text)
        if ids is None:
            run = Run(self)
            ids = (*run.feed(text.encode()), *run.close())
            if len(text) <= 64:
                if len(self.cache) >= MAX_CACHED:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of a text, or of a part of one between two stable cuts."""
        # A space between two other characters always begins a pretoken, so what lies between such
        # spaces has its own ids. Other white space next to a space needs the whole pattern.
        get, out = self.chunk_cache.get, []
        first, *rest = text.split(" ")
        if first:
            if rest and first[-1].isspace():
                return self._by_pattern(text)
            out += self._by_pattern(first)
        for at, chunk in enumerate(rest, 1):
            ids = get(chunk)
            if ids is None:
                if not chunk or chunk[0].isspace() or (chunk[-1].isspace() and at < len(rest)):
                    return self._by_pattern(text)
                ids = tuple(self._by_pattern(" " + chunk))
                if len(chunk) <= 32 and not chunk[-1].isspace():
                    if len(self.chunk_cache) >= MAX_CACHED:
                        self.chunk_cache.clear()
                    self.chunk_cache[chunk] = ids
            out += ids
        return out

    def _by_pattern(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.pattern.findall(text):
            out += self.pretoken(token)
        return out


def stable_cut(text: str) -> int:
    """The last place where a space between two other characters begins a pretoken, or 0."""
    at = text.rfind(" ", 1, len(text) - 1)
    while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
        at = text.rfind(" ", 1, at)
    return max(at, 0)


class Run:
    """The ids of one pretoken whose bytes arrive in pieces."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, b""

    def feed(self, data: bytes) -> Iterator[int]:
        bpe = self.bpe
        margin = bpe.lookahead + bpe.max_token
        for start in range(0, len(data), margin):
            self.held += data[start : start + margin]
            spare = len(self.held) - margin
            if spare < margin:
                continue
            at = 0
            for token in bpe.merge([bpe.byte_ids[b] for b in self.held]):
                if at >= spare:
                    break
                yield token
                at += len(bpe.bytes_of[token])
            self.held = self.held[at:]

    def close(self) -> list[int]:
        ids = self.bpe.merge([self.bpe.byte_ids[b] for b in self.held])
        self.held = b""
        return ids


class Encoder:
    """Feed pieces of one text; ids come out as soon as they are stable."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.tail = bpe, ""
        self.run: Run | None = None  # an unfinished pretoken longer than a piece
        self.run_class = None

    def feed(self, piece: str, last: bool = False) -> list[int]:
        """Ids that this piece settles. Only the final call has ``last``."""
        text, self.tail = self.tail + piece, ""
        at, ids = 0, []
        if self.run:
            more = self.run_class.match(text)
            end = at = more.end() if more else 0
            if self.run_class is _SPACE and at and not (last and end == len(text)):
                at -= 1
            ids += self.run.feed(text[:at].encode())
            if end == len(text) and not last:
                self.tail = text[at:]
                return ids
            ids += self.run.close()
            self.run = None
        text = text[at:]
        cut = len(text) if last else stable_cut(text)
        ids += self.bpe.ids(text[:cut])
        self.tail = text[cut:]
        if len(self.tail) > PIECE_CHARS:
            # No such space for long: settle all but the last two pretokens, which may still change.
            tokens = self.bpe.pattern.findall(self.tail)
            for token in tokens[:-2]:
                ids += self.bpe.pretoken(token)
            self.tail = "".join(tokens[-2:])
        if len(self.tail) > PIECE_CHARS:
            ids += self._open_run()
        return ids

    def _open_run(self) -> list[int]:
        """Move a held pretoken that is longer than a piece into a run of its class."""
        lead = 1 if self.tail[:1] == " " else 0
        for kind, start, spare in (*((k, lead, 0) for k in _RUNS), (_SPACE, 0, 1)):
            found = kind.match(self.tail, start)
            if found and found.end() == len(self.tail):
                cut = len(self.tail) - spare
                self.run, self.run_class = Run(self.bpe), kind
                data, self.tail = self.tail[:cut].encode(), self.tail[cut:]
                return list(self.run.feed(data))
        return []


def encode_pieces(bpe: Bpe, pieces: Iterator[str]) -> Iterator[list[int]]:
    """Ids of a text that arrives in pieces and holds no special tokens, as they become stable."""
    encoder = Encoder(bpe)
    for piece in pieces:
        yield encoder.feed(piece)
    yield encoder.feed("", last=True)


def stream(bpe: Bpe, text: str) -> Iterator[list[int]]:
    """Ids of a whole text, some at a time. Special tokens in it become their ids, whatever stands next to them."""
    start = 0
    for mark in [*bpe.marks.finditer(text), None]:
        end = mark.start() if mark else len(text)
        yield from encode_pieces(bpe, (text[i : min(i + PIECE_CHARS, end)] for i in range(start, end, PIECE_CHARS)))
        if mark:
            yield [bpe.special[mark.group()]]
            start = mark.end()


def encode(bpe: Bpe, text: str) -> list[int]:
    """Ids of a whole text."""
    return [i for ids in stream(bpe, text) for i in ids]


class Decoder:
    """Turns ids into text as they arrive; bytes of an unfinished character wait for the next id."""

    def __init__(self, bpe: Bpe):
        self.bytes_of = bpe.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


def decode(bpe: Bpe, ids: list[int], step: int = 4096) -> str:
    decoder = Decoder(bpe)
    parts = [decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
    return "".join(parts) + decoder.feed([], last=True)


_loaded: dict[str, Bpe] = {}


def loaded(content: str) -> Bpe:
    """The vocabulary, parsed once in each Python worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(content)
    return _loaded[key]


def round_trip(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``ids`` and ``decoded``. ``vocabulary`` is the content of a vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in chunks(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            bpe.prime(texts)
            ids = [encode(bpe, text) for text in texts]
            arrays = [
                *(batch.column(name) for name in keep), pa.array(ids, pa.list_(pa.int32())),
                pa.array([decode(bpe, x) for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "ids", "decoded"])
            del texts, ids, arrays
        # The worker is used again by later stages.
        pa.default_memory_pool().release_unused()

    chosen = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(run, schema + ", ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what :func:`round_trip` returns, as digests."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def digest(bpe: Bpe, text: str) -> tuple[int, str, str]:
        n, decoder, joined, decoded = 0, Decoder(bpe), hashlib.sha256(), hashlib.sha256()
        for ids in stream(bpe, text):
            if ids:
                joined.update(("," * (n > 0) + ",".join(map(bpe.text_of.__getitem__, ids))).encode())
                decoded.update(decoder.feed(ids).encode())
                n += len(ids)
        decoded.update(decoder.feed([], last=True).encode())
        return n, joined.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in chunks(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            bpe.prime(texts)
            n, ids, decoded = zip(*(digest(bpe, text) for text in texts), strict=True)
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
