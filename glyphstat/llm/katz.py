"""Log probabilities of texts under a bigram model with Good-Turing discounts and Katz backoff.

Tokens are words with A-Z lower-cased, and one end per text; a text begins in the context START.
A token that follows its context in the training texts r times of the context's n has the probability
``d(r) r / n``; any other gets ``alpha(context) * p(token)``, where ``p`` is the discounted share of the
token among all training tokens, and a token never seen there shares what those discounts leave with all
others like it. Discounts are Good-Turing's for counts up to ``LOW``; where counts of counts give none
between 0 and 1, it is ``(r - 1/2) / r``. A context (or the whole corpus) without any low count keeps mass for
other tokens by one more event in its total. ``alpha`` makes every context sum to 1 over the training
words and the unknown one: it is the mass that the discounts leave over the unigram mass of the tokens
not seen there.

How it runs. Texts are read in blocks; a block knows its own words and refers to them by small numbers.
1. A block deals its words, packed, into shards by a hash of their spelling. There they meet by spelling, and the block is told the training
   count of each and a number that the word has in all blocks.
2. Each block sends its distinct bigrams with their counts and the documents they stand in to shards. A shard is
   chosen by the context, and by the next token too where the context is frequent, so that no shard holds
   much more than ``SHARD_TOKENS`` tokens.
3. A shard counts its bigrams, evaluates each once, and returns per document the sum of logarithms and how
   many tokens had each low count; per context the integers that ``alpha`` needs; and which
   documents back off from which context. These tables are stored, partitioned by kind.
4. Counts of counts give the discounts, contexts get their ``alpha``, and documents add up their parts.
Counts and mass are integers until the last step, and logarithms are added in a fixed order.

Defined cases: a null or empty text is its end alone; without training texts every token is unknown and has
probability 1; repeated rows are scored one by one and all count in training; a null ``doc_id`` hashes as an
empty string; other columns are never read. Spelling is compared in full, numbers are exact.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.storage import store
from glyphstat.llm.words import mix, piece_hashes

BLOCK_BYTES = 18_000_000
SHARD_TOKENS = 4_000_000
SHARD_WORDS = 1_500_000
LOW = 5
START = -1
_POSITION_BITS, _BLOCK_BITS = 27, 16  # a word's number: partition, block within it, place in the block
_R = np.arange(1, LOW + 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Integers or doubles, compressed byte by byte of their places."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Token numbers of all texts in a row, tokens per text, the words by number, and where texts end.

    Words are numbered by falling frequency; the end of a text is the empty word.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    text = text[real.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(text, minlength=len(lists)) + 1
    ends = np.cumsum(lengths) - 1
    out = np.full(lengths.sum(), len(coded.dictionary), np.int32)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(out, minlength=len(coded.dictionary) + 1), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    spelled = pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)])
    return number[out], lengths, spelled.take(pa.array(order)).to_pylist(), ends


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in as few pieces as hold about ``BLOCK_BYTES`` of text at most, all of about one size."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    if batch.num_rows:
        piece = max(1, -(-int(sizes[-1]) // -(-max(1, int(sizes[-1])) // BLOCK_BYTES)))
        number = np.maximum(sizes - 1, 0) // piece
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield batch.slice(start, end - start)


def _read(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, held, text)`` as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, partition = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in _blocks(batch):
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                number, lengths, words, _ = tokens(part.column("text"))
                train = np.bincount(number[np.repeat(~held, lengths)], minlength=len(words))
                row = {
                    "block": (partition << _BLOCK_BITS) + seq, "n": len(number), "doc_id": part.column("doc_id").to_pylist(),
                    "held": pack(held), "lengths": pack(lengths), "tokens": pack(number), "words": words, "train": train,
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                seq += 1

    schema = pa.schema([
        ("block", pa.int64()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("held", "lengths", "tokens")),
        ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int32())),
    ])
    fields = "block long, n long, doc_id array<long>, held binary, lengths binary, tokens binary, words array<string>, train array<int>"
    return docs.mapInArrow(run, fields)


def _bigrams(block: int, row: dict, number: np.ndarray, count: np.ndarray, shards: int) -> Iterator[tuple[int, list[bytes]]]:
    """The distinct bigrams of a block by shard: context, its count, token, its count, places, those in training, documents."""
    held, lengths = unpack(row["held"], bool), unpack(row["lengths"])
    token = unpack(row["tokens"], np.int32)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    end = token[-1]
    number, count = np.append(number, START), np.append(count, count[end])
    context = np.concatenate([[len(number) - 1], token[:-1]]).astype(np.int32)
    context[np.cumsum(lengths)[:-1]] = len(number) - 1

    by_count = np.lexsort((number, count))
    rank = np.empty(len(number), np.int64)
    rank[by_count] = np.arange(len(number))
    key = context.astype(np.int64) * len(number) + rank[token]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    del key
    v, w = context[order[first]], token[order[first]]
    places = np.diff(first, append=len(order))
    train = np.add.reduceat((~held)[doc[order]].astype(np.int64), first)

    salts = 1 + count[v] // max(1, SHARD_TOKENS // 4)
    salt = mix(number[w].astype(np.uint64)) % salts.astype(np.uint64)
    shard = (mix(number[v].astype(np.uint64) + mix(salt)) % np.uint64(shards)).astype(np.int64)
    by_shard = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[by_shard], np.arange(shards + 1))
    doc = doc[order]
    for k in np.flatnonzero(np.diff(bounds)):
        at = by_shard[bounds[k] : bounds[k + 1]]
        own = np.repeat(first[at] - np.concatenate([[0], np.cumsum(places[at])[:-1]]), places[at]) + np.arange(places[at].sum())
        columns = [number[v[at]], count[v[at]], number[w[at]], count[w[at]], places[at], train[at]]
        yield int(k), [*map(pack, columns), pack(doc[own])]


def _asked(blocks: DataFrame, shards: int) -> DataFrame:
    """The words of each block by shard: steps between their places, lengths, spelling, counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                words = batch.column("words").slice(i, 1).flatten().cast(pa.large_binary())
                train = batch.column("train").slice(i, 1).flatten().to_numpy()
                ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
                data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
                shard = (piece_hashes(_BYTES[data], ends[:-1], ends[1:]) % np.uint64(shards)).astype(np.int64)
                by_shard = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[by_shard], np.arange(shards + 1))
                rows = []
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    at = by_shard[bounds[k] : bounds[k + 1]]
                    steps = np.diff(at, prepend=0).astype(np.int32)
                    lengths = (ends[at + 1] - ends[at]).astype(np.int32)
                    spelled = memoryview(words.take(pa.array(at)).buffers()[2] or b"")[: lengths.sum()]
                    rows.append({"word_shard": k, "block": block, "blobs": [pack(steps), pack(lengths), zstandard.compress(spelled, 3), pack(train[at])]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("word_shard", pa.int64()), ("block", pa.int64()), ("blobs", pa.list_(pa.binary()))])
    return blocks.select("block", "words", "train").mapInArrow(run, "word_shard long, block long, blobs array<binary>")


def _answers(table: pa.Table) -> pa.Table:
    """For the words that each block sent to a shard: steps between their places, numbers, counts in all training texts."""
    sent = sorted(zip(table.column("block").to_pylist(), table.column("blobs").to_pylist(), strict=True))
    steps, lengths = ([unpack(blobs[i], np.int32) for _, blobs in sent] for i in (0, 1))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths).astype(np.int64))])
    spelled = pa.py_buffer(b"".join(zstandard.decompress(blobs[2]) for _, blobs in sent))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), spelled])
    word = words.dictionary_encode().indices.to_numpy()
    count = np.bincount(word, np.concatenate([unpack(blobs[3], np.int32) for _, blobs in sent])).astype(np.int64)
    # Blocks come in order, and so the first place of a word is the least.
    here = np.concatenate([(block << _POSITION_BITS) + np.cumsum(x) for (block, _), x in zip(sent, steps, strict=True)])
    number = here[np.unique(word, return_index=True)[1]]
    bounds = np.cumsum([0, *map(len, steps)])
    rows = []
    for (block, blobs), i, j in zip(sent, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows.append({"block": block, "blobs": [blobs[0], pack(number[word[i:j]]), pack(count[word[i:j]])]})
    return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("blobs", pa.list_(pa.binary()))]))


def _send(blocks: DataFrame, shards: int) -> DataFrame:
    """Give words their counts and numbers, then deal out the bigrams of every block."""
    word_shards = 1 + (blocks.agg(F.sum(F.size("train"))).first()[0] or 0) // SHARD_WORDS
    asked = _asked(blocks, word_shards).groupBy("word_shard").applyInArrow(_answers, "block long, blobs array<binary>")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = row["block"]
            count = np.array(row["train"], np.int64)
            number = (block << _POSITION_BITS) + np.arange(len(count))
            for place, numbers, counts in right.column("blobs").to_pylist():
                at = np.cumsum(unpack(place, np.int32))
                number[at], count[at] = unpack(numbers), unpack(counts)
            held, lengths = unpack(row["held"], bool), unpack(row["lengths"])
            token = unpack(row["tokens"], np.int32)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(doc, np.log10(count + 0.5)[token], len(lengths))
            known = np.bincount(doc, (count > 0)[token], len(lengths)).astype(np.int64)
            fresh = count[number == (block << _POSITION_BITS) + np.arange(len(number))]
            totals = [fresh.sum(), (fresh > 0).sum(), *((fresh == r).sum() for r in range(1, LOW + 2))]
            ids = np.array([x or 0 for x in row["doc_id"]], np.int64)
            null = np.array([x is None for x in row["doc_id"]], bool)
            blobs = [pack(x) for x in (ids, null, held, lengths, known, base)]
            out.append({"shard": block % shards, "block": block, "totals": totals, "blobs": blobs})
            out += ({"shard": k, "block": block, "totals": None, "blobs": x} for k, x in _bigrams(block, row, number, count, shards))
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("totals", pa.list_(pa.int64())), ("blobs", pa.list_(pa.binary()))])
    left = blocks.select("block", "doc_id", "held", "lengths", "tokens", "train").groupBy("block")
    return left.cogroup(asked.groupBy("block")).applyInArrow(run, "shard long, block long, totals array<long>, blobs array<binary>")


_CONTEXT = ["context", "total", *(f"low{r}" for r in _R), "mass", *(f"uni{r}" for r in _R)]
_OPEN = ["context", "block", "doc", "unseen", "bare"]
_CLASSES = 2 * LOW + 2  # bigram counts 1 to LOW, unigram counts 1 to LOW, known tokens backed off to, unknown ones


def _structs(names: list[str], columns: list[np.ndarray]) -> pa.ListArray:
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names)
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _shard(table: pa.Table) -> pa.Table:
    """Count and evaluate the bigrams of one shard."""
    table = table.sort_by("block")
    sent = [(r["block"], r["blobs"]) for r in table.to_pylist() if r["totals"] is None]
    base = table.filter(pc.is_valid(table.column("totals")))
    empty = {n: pa.nulls(base.num_rows, _OUT.field(n).type) for n in ("contexts", "open")}
    kind = pa.array(["base"] * base.num_rows, pa.string())
    through = pa.Table.from_arrays([kind, *(base.column(n).combine_chunks() for n in ("block", "totals", "blobs")), *empty.values()], schema=_OUT)
    if not sent:
        return through
    columns = [np.concatenate([unpack(blobs[i]) for _, blobs in sent]) for i in range(6)]
    v, v_count, w, w_count, places, train = columns
    owner = np.repeat(np.arange(len(sent)), [len(unpack(blobs[4])) for _, blobs in sent])

    order = np.lexsort((w, v))
    new = np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    count = np.bincount(group, train).astype(np.int64)
    one = order[new]  # one row of each bigram
    seen = count > 0
    counts = [int((count == r).sum()) for r in range(1, LOW + 2)]

    # Contexts: how many of their tokens have each low count, and the unigram mass of those tokens.
    context, where = np.unique(v[one], return_inverse=True)
    total = np.zeros(len(context), np.int64)
    total[where] = v_count[one]

    def tally(flags: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(where[flags], None if weight is None else weight[flags], len(context)).astype(np.int64)

    of_w = w_count[one]
    low = [tally(count == r) for r in _R]
    uni = [tally(seen & (of_w == r)) for r in _R]
    high = np.zeros(len(context), np.int64)
    np.add.at(high, where[seen & (of_w > LOW)], of_w[seen & (of_w > LOW)])
    no_low = (np.sum(low, axis=0) == 0) & (total > 0)

    # Every token of every document, through the bigram it is part of.
    backed_off = ~seen & (total[where] > 0)
    known = ~seen & (of_w > 0)
    log = np.where(seen, np.log10(np.maximum(count, 1)) - np.log10(np.maximum(total[where], 1)), np.log10(np.maximum(of_w, 1)))
    label = np.where(seen & (count <= LOW), count - 1, -1)
    label = np.where(known & (of_w <= LOW), LOW + of_w - 1, label)
    label = np.where(~seen & (of_w == 0), _CLASSES - 1, label)
    bare = seen & no_low[where]

    rows, opened = [], []
    for i, (block, blobs) in enumerate(sent):
        mine = owner == i
        g = np.repeat(group[mine], places[mine])
        doc, at = np.unique(unpack(blobs[6], np.int32), return_inverse=True)
        classes = np.zeros((len(doc), _CLASSES), np.int64)
        marked = label[g] >= 0
        np.add.at(classes, (at[marked], label[g][marked]), 1)
        np.add.at(classes[:, _CLASSES - 2], at[known[g]], 1)
        rows.append([pack(doc), pack(np.bincount(at, log[g], len(doc))), pack(classes.reshape(-1).astype(np.int32))])
        pick = backed_off[g] | bare[g]
        if pick.any():
            key, back = np.unique(where[g[pick]] * len(doc) + at[pick], return_inverse=True)
            unseen = np.bincount(back, backed_off[g[pick]], len(key)).astype(np.int64)
            plain = np.bincount(back, bare[g[pick]], len(key)).astype(np.int64)
            c, d = key // len(doc), doc[key % len(doc)]
            opened.append([context[c], np.full(len(key), block), d, unseen, plain])

    needed = total > SHARD_TOKENS // 4  # split contexts: other shards may need what stands here
    needed[where[backed_off | bare]] = True
    kept = [x[needed] for x in (context, total, *low, high, *uni)]
    opened = [np.concatenate(x) for x in zip(*opened)] if opened else [np.zeros(0, np.int64)] * len(_OPEN)
    own = pa.Table.from_arrays(
        [pa.array(["shard"]), pa.nulls(1, pa.int64()), pa.array([counts], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.binary())),
         _structs(_CONTEXT, kept), _structs(_OPEN, opened)], schema=_OUT,
    )
    docs = pa.Table.from_arrays(
        [pa.array(["docs"] * len(sent)), pa.array([b for b, _ in sent], pa.int64()), pa.nulls(len(sent), pa.list_(pa.int64())),
         pa.array(rows, pa.list_(pa.binary())), *(pa.nulls(len(sent), _OUT.field(n).type) for n in ("contexts", "open"))], schema=_OUT,
    )
    return pa.concat_tables([through, own, docs])


_OUT = pa.schema([
    ("kind", pa.string()), ("block", pa.int64()), ("totals", pa.list_(pa.int64())), ("blobs", pa.list_(pa.binary())),
    *((name, pa.list_(pa.struct([(n, pa.int64()) for n in fields]))) for name, fields in (("contexts", _CONTEXT), ("open", _OPEN))),
])
_OUT_SQL = "kind string, block long, totals array<long>, blobs array<binary>, " + ", ".join(
    f"{name} array<struct<{','.join(f'{n}:long' for n in fields)}>>" for name, fields in (("contexts", _CONTEXT), ("open", _OPEN))
)


def discounts(counts: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 1 to LOW from the numbers of events seen 1 to LOW + 1 times."""
    n = np.array(counts, np.float64)
    with np.errstate(all="ignore"):
        a = (LOW + 1) * n[LOW] / n[0]
        d = ((_R + 1) * n[1:] / (_R * n[:-1]) - a) / (1 - a)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (_R - 0.5) / _R)


class Model:
    """Discounts and totals, all that the evaluation needs besides counts."""

    def __init__(self, totals: list[int], bigram_counts: list[int]):
        self.tokens, self.types, unigrams = totals[0], totals[1], totals[2:]
        self.bigram, self.unigram = discounts(bigram_counts), discounts(unigrams)
        left = float(((1 - self.unigram) * _R * np.array(unigrams[:LOW])).sum())
        self.total = self.tokens if left else self.tokens + 1
        self.unknown = (left or 1.0) / self.total

    def class_logs(self) -> np.ndarray:
        return np.concatenate([np.log10(self.bigram), np.log10(self.unigram), [-np.log10(self.total), np.log10(self.unknown)]])


def _alphas(contexts: DataFrame, model: Model) -> DataFrame:
    """``(context, back, bare)``: logarithms of the backoff weight, and of what one more event takes from seen tokens."""
    summed = contexts.groupBy("context").agg(F.max("total").alias("total"), *(F.sum(x).alias(x) for x in _CONTEXT[2:]))
    left = sum((F.col(f"low{r}") * float((1 - d) * r) for r, d in zip(_R, model.bigram)), F.lit(0.0))
    lower = sum((F.col(f"uni{r}") * float(d * r) for r, d in zip(_R, model.unigram)), F.col("mass").cast("double")) / F.lit(float(model.total))
    full = F.col("total") + F.when(left == 0, 1.0).otherwise(0.0)
    alpha = F.when(left == 0, 1.0).otherwise(left) / full / (F.lit(1.0) - lower)
    return summed.select("context", F.log10(alpha).alias("back"), F.log10(F.col("total") / full).alias("bare"))


def score(docs: DataFrame, held) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; learns from rows where ``held`` is false.

    ``base_score`` is that of a unigram model with half a count added to every word.
    """
    blocks = store(_read(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), "text")), "blocks")
    shards = 1 + (blocks.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS
    found = _send(blocks, shards).groupBy("shard").applyInArrow(_shard, _OUT_SQL)
    tables = store(found, "katz", by="kind")

    summed = tables.filter("totals IS NOT NULL").select("kind", F.posexplode("totals").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n").alias("n"))
    totals = {"base": [0] * (LOW + 3), "shard": [0] * (LOW + 1)}
    for r in summed.collect():
        totals[r.kind][r.i] = r.n
    model = Model(totals["base"], totals["shard"])

    contexts = tables.filter("kind = 'shard'").select(F.inline("contexts"))
    opened = tables.filter("kind = 'shard'").select(F.inline("open"))
    opened = opened.withColumnRenamed("bare", "plain").join(_alphas(contexts, model), "context")
    backed = opened.select("block", "doc", (F.col("unseen") * F.col("back") + F.col("plain") * F.col("bare")).alias("log"))
    logs = model.class_logs()

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = left.to_pylist()
        base = [p["blobs"] for p in parts if p["kind"] == "base"]
        if not base:
            return schema.empty_table()
        kinds = (np.int64, bool, bool, np.int64, np.int64, np.float64)
        ids, null, held, lengths, known, unigram = (unpack(x, k) for x, k in zip(base[0], kinds))
        n = len(ids)
        log, classes = np.zeros(n), np.zeros((n, _CLASSES))
        sums = []
        for p in parts:
            if p["kind"] == "docs":
                doc = unpack(p["blobs"][0], np.int32)
                sums.append((doc, unpack(p["blobs"][1], np.float64)))
                classes[doc] += unpack(p["blobs"][2], np.int32).reshape(len(doc), _CLASSES)
        if right.num_rows:
            sums.append((right.column("doc").to_numpy(), right.column("log").to_numpy()))
        if sums:
            doc, value = (np.concatenate(x) for x in zip(*sums))
            order = np.lexsort((value, doc))
            log = np.bincount(doc[order], value[order], n)
        final = log + (classes * logs).sum(axis=1)
        base_score = unigram - lengths * np.log10(model.tokens + 0.5 * (model.types + 1))
        columns = [pa.array(ids, mask=null), held, lengths, known, np.full(n, model.tokens), base_score, final]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ])
    parts = tables.filter("kind <> 'shard'").select("block", "kind", "blobs")
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("block").cogroup(backed.groupBy("block")).applyInArrow(add, fields)
