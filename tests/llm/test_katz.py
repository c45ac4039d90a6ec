"""The backoff model against a plain version with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphstat.llm import katz, queries

SF = "/root/testdata/sf0.001"


def plain_tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


def plain_discounts(counts):
    n = [sum(1 for c in counts if c == r) for r in range(1, 7)]
    out = {}
    for r in range(1, 6):
        d = None
        if n[0] and n[r - 1]:
            a = 6 * n[5] / n[0]
            if a != 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
        out[r] = d if d is not None and 0 < d < 1 else (r - 0.5) / r
    return out


class Plain:
    def __init__(self, texts):
        seqs = [plain_tokens(t) for t in texts]
        self.uni = Counter(w for s in seqs for w in s)
        self.bi = defaultdict(Counter)
        for s in seqs:
            for v, w in zip(["<s>", *s], s):
                self.bi[v][w] += 1
        self.n = sum(self.uni.values())
        self.d1 = plain_discounts(self.uni.values())
        self.d2 = plain_discounts([c for x in self.bi.values() for c in x.values()])
        left = sum((1 - self.d1[c]) * c for c in self.uni.values() if c <= 5)
        self.total = self.n + (left == 0)
        self.unk = (left or 1) / self.total

    def p1(self, w):
        c = self.uni.get(w, 0)
        return self.d1.get(c, 1.0) * c / self.total if c else self.unk

    def p(self, v, w):
        seen = self.bi.get(v)
        if not seen:
            return self.p1(w)
        left = sum((1 - self.d2[c]) * c for c in seen.values() if c <= 5)
        total = sum(seen.values()) + (left == 0)
        if w in seen:
            return self.d2.get(seen[w], 1.0) * seen[w] / total
        return (left or 1) / total / (1 - sum(self.p1(x) for x in seen)) * self.p1(w)

    def score(self, text):
        s = plain_tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip(["<s>", *s], s))


def compare(spark, rows, held=lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1):
    model = Plain([t for i, t in rows if not held(i)])
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, number int, word string")
    expr = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = katz.score(df, expr).collect()
    v = len(model.uni)
    want = []
    for i, t in rows:
        s = plain_tokens(t)
        base = sum(math.log10((model.uni[w] + 0.5) / (model.n + 0.5 * (v + 1))) for w in s)
        want.append((i, held(i), len(s), sum(model.uni[w] > 0 for w in s), model.n, base, model.score(t)))

    def order(r):
        return (r[0] is not None, r[0] or 0, r[2], r[5])

    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def texts(seed, n, words, most):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(words)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("shard,block", [(4_000_000, 16_000_000), (200, 300), (40, 5000)])
def test_against_dictionaries_whatever_the_shards(spark, monkeypatch, shard, block):
    monkeypatch.setattr(katz, "SHARD_TOKENS", shard)
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    compare(spark, texts(shard, 120, 300, 40))


def test_tokens_of_slices():
    texts = pa.array([f"Row {i}  \x0bword é{i} X" if i % 7 else None for i in range(5000)])
    for part in (texts, texts.slice(2401, 1203), texts.slice(4999)):
        number, lengths, words, ends = katz.tokens(part)
        want = [plain_tokens(t) for t in part.to_pylist()]
        assert [words[i] or "</s>" for i in number] == [w for s in want for w in s]
        assert lengths.tolist() == [len(s) for s in want] and not any(words[number[i]] for i in ends)


def test_contexts_sum_to_one(spark):
    model = compare(spark, texts(3, 60, 60, 30))
    for v in [*model.bi, "never"]:
        assert sum(model.p(v, w) for w in model.uni) + model.p(v, "unknown") == pytest.approx(1)


def test_edges(spark):
    compare(spark, [])
    compare(spark, [(1, None), (1, None), (2, ""), (None, "A b\x0bC"), (None, None), (4, "  İx É é"), (5, "a b c"), (7, " ".join(["x y"] * 90_000))])
    held_only = [(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    compare(spark, held_only)
    compare(spark, [(i, "one and the same") for i in range(60)])  # no low counts at all


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, rows)
    assert queries.QUERIES["op11_katz"](spark, SF).count() == len(rows)
