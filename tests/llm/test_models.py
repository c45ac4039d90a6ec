"""Mixing, search, classifiers, tokens and URL rules against brute force and held-out labels."""

import heapq
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphstat.llm import bpe, mixing, quality_forest, toxicity, topk, url_filters
from glyphstat.llm.queries import BPE_FILE, URL_RULES, bpe_vocabulary

SF = "/root/testdata/sf0.001"


# Mixing

def mix_rows():
    rng = random.Random(2)
    rows = []
    for k, source in enumerate(["b", "a", "é", None, "Z", "hot"]):
        for i in range(200 if source == "hot" else 12 * (k + 1)):
            rows.append((1000 * k + i, source, " ".join(["w"] * rng.randint(0, 90)), 5, "x"))
    return [*rows, (91, "a", None, 5, "x"), (None, "a", "one two", 5, "x"), (93, "empty", "", 5, "x"), rows[3]]


def brute_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, [s for s in names if sizes[s]]
    left = 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * share > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else weight[s] * share
        if not over:
            break
        left -= sum(2 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


@pytest.mark.parametrize("shard", [1 << 21, 700])
def test_mix(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD", shard)
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, size string")
    found = mixing.mix_sizes(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[1]] += len((r[2] or "").split())
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len((r[2] or "").split())) for r in rows)
    assert all(r.taken <= 2 * r.size for r in found)
    of = {r[0]: r[1] for r in rows}
    taken, shards = Counter(), max(1, sum(sizes.values()) / shard)
    for r in found:
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 * (1 + shards) for s in sizes)
    assert sorted(map(str, mixing.mix_sizes(docs.repartition(3)).collect())) == sorted(map(str, found))
    copies = mixing.mixed(docs).collect()
    assert sum(len((r.text or "").split()) for r in copies) == sum(taken.values())
    assert copies[0].asDict().keys() == {"doc_id", "source", "text", "n_chars", "size"}


def test_mix_without_words(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_sizes(spark.createDataFrame([], schema)).collect() == []
    found = mixing.mix_sizes(spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in found) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_apportionment(spark):
    rng = random.Random(9)
    rows = [(g, k, float(rng.choice([0, 1, 5, rng.randint(1, 1000)])), s) for g, s in ((1, 37), (2, 1), (3, 0), (4, 400)) for k in range(13)]
    found = mixing.apportion(spark.createDataFrame(rows, "g long, k long, votes double, seats long"), ["g"], ["k"], "votes", "seats", "won")
    expected = {}
    for g in (1, 2, 3, 4):
        votes = {k: v for h, k, v, _ in rows if h == g}
        heap = [(-v, k, 0) for k, v in votes.items()]
        heapq.heapify(heap)
        won = Counter()
        for _ in range(next(s for h, *_, s in rows if h == g)):
            _, k, n = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
        expected |= {(g, k): won[k] for k in votes}
    assert {(r.g, r.k): r.won for r in found.collect()} == expected


# Search

@pytest.mark.parametrize("group", [4096, 16])
def test_top_k(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "VECTOR_GROUP", group)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.3, 6).tolist() for _ in range(300)]
    rows = list(enumerate(vectors)) + [(i, vectors[7]) for i in range(300, 420)]
    rows += [(500, None), (501, [None] * 6), (550, [float("nan")] * 6), (552, [float("inf")] * 6), (None, vectors[0])]
    rows += [(600, [0.1, 0.2]), (601, [0.3, 0.1]), (650, [0.5] * 7), (7, vectors[7])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    whole = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    expected = []
    for q, v in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
            expected += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []


# Quality

def brute_stats(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside),
    )


def test_quality_statistics_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b a b a b"), (10**6 + 3, "é|\x0b日 本\n\n日 本\nx y\n日 本"), (10**6 + 3, "é"), (None, "a # b")]
    more = spark.createDataFrame(extra, "doc_id long, text string").withColumn("kept", F.lit(1))
    rows = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    statistics = quality_forest.stats(rows)
    wanted = Counter((r.doc_id, *brute_stats(r.text)) for r in rows.collect())
    assert Counter(tuple(r)[:6] for r in statistics.collect()) == wanted

    forest = quality_forest.fit_labelled(statistics, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = quality_forest.judge(statistics, forest).collect()
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.anomaly > forest.threshold)
    kept = quality_forest.keep_good(docs, forest)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged if r.kept and r.doc_id is not None and r.doc_id < 10**6}
    alone = quality_forest.judge(statistics, None).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)
    assert quality_forest.fit_labelled(statistics, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    points = rng.normal(0, 1, (500, 3))
    forest = quality_forest.Forest(points)
    scores = forest.score(np.vstack([points, np.full((3, 3), 9.0)]))
    assert scores[500:].min() > np.quantile(scores[:500], 0.99)
    assert (forest.score(points) == quality_forest.Forest(points).score(points)).all()


# Toxicity

def test_toxicity_learns_without_held_out_labels(spark):
    rng = random.Random(1)
    bad = [f"vile{x}" for x in ("a", "b", "ing", "est", "o")]

    def text(toxic):
        words = ["".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    labelled = [(i, int(rng.random() < 0.2)) for i in range(900)]
    docs = spark.createDataFrame([(i, text(t), "x") for i, t in labelled] + [(5000, None, "x"), (5001, "", "x"), (None, "vilea", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in labelled}
    assert all(found[i].held_out == out[i] for i in out) and not found[None].held_out
    right = [found[i].predicted == t for i, t in labelled if out[i]]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    # Held-out labels never matter.
    flipped = spark.createDataFrame([(i, 1 - t if out[i] else t) for i, t in labelled], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert all(again[i] == found[i].score for i in again)
    none = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0")))
    assert none.filter("score > 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


# Tokens

def test_tokens_equal_the_library(spark):
    reference = Tokenizer.from_file(public_tokenizers.path(BPE_FILE))
    rng = random.Random(1)
    alphabets = ["ab", "abcdefghij klm", "aeiou ", "  \n\t x", "<|endoftext|> a", "0123 ", "!=-_ .", "éèüßñ日本 ", "'s't're ", "\u00a0\u2003 x\x1c"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(120)]
    texts += [rng.choice(a) * 3000 for a in alphabets] + ["", None, " ", "a<|endoftext|><|endoftext|>b", "x " * 90000, "é" * 70000, " " * 70000 + "b", "\n" * 70000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in bpe.round_trip(docs, bpe_vocabulary(), ["doc_id"]).collect()}
    digests = {r.doc_id: r.n_tokens for r in bpe.round_trip_digests(docs, bpe_vocabulary()).collect()}
    for i, text in enumerate(texts):
        expected = reference.encode(text or "", add_special_tokens=False).ids
        assert found[i].ids == expected and digests[i] == len(expected)
        assert found[i].decoded == reference.decode(expected, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0), bpe_vocabulary(), ["doc_id"]).collect() == []


def test_pieces_do_not_change_ids(monkeypatch):
    model = bpe.Bpe(Path(public_tokenizers.path(BPE_FILE)).read_text())
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(rng.choice(["ab", "x y", " \n", "01", "é!", "etaoin shrdlu"])) for _ in range(rng.choice([10, 400, 2500])))
        monkeypatch.setattr(bpe, "PIECE_CHARS", 1 << 16)
        whole = bpe.encode(model, text)
        monkeypatch.setattr(bpe, "PIECE_CHARS", rng.choice([50, 300]))
        assert bpe.encode(model, text) == whole
        assert bpe.decode(model, whole, 1) == text


def test_long_runs_need_bounded_memory():
    model = bpe.Bpe(Path(public_tokenizers.path(BPE_FILE)).read_text())
    rng = random.Random(8)
    data = bytes(rng.choice(b"etaoinshrdlu") for _ in range(30000))
    run, ids, most = bpe.Run(model), [], 0
    for k in range(0, len(data), 500):
        ids += run.feed(data[k : k + 500])
        most = max(most, len(run.held))
    ids += run.close()
    assert ids == model.merge([model.byte_ids[b] for b in data])
    assert most <= 4 * (model.lookahead + model.max_token)


# URLs

def test_rules_and_aliases(spark):
    def page(target, kind="canonical"):
        return f'<LINK rel="{kind}" HREF="{target}">' if kind == "canonical" else f'<meta http-equiv=refresh content="0; url={target}">'

    rows = [
        (1, "http://A.example.com/en/x", None), (2, "https://www.example.com/en/x", None), (3, "http://shop.net/es/1", ""),
        (4, "http://other.org/a", page("https://shop.net/es/1")), (5, "http://far.org/b?q=1#frag", page("/c", "refresh")),
        (6, "http://far.org/c", page("http://other.org/a", "refresh")), (7, "http://ok.com/", page("http://shop.net/es/1")),
        (8, None, "<p>"), (9, "no scheme", page("http://shop.net/es/1")), (10, "http://plain.org", None),
        (11, "http://notexample.com/en/", None), (12, "http://net/fr/?x", None), (13, "x://other.org/a", None), (None, "http://q.net/fr", None),
        (14, "http://far.org/sub/d", '<link href="e" rel=canonical>'), (15, "http://far.org/sub/e", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    judged = url_filters.judge(pages.select("page_id", "url", "host"), url_filters.links(pages), URL_RULES)
    found = {r.page.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert found == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        3: ("shop.net", "/es/1", "net/es/", "block"), 4: ("other.org", "/a", None, "block"), 5: ("far.org", "/b", None, "block"),
        6: ("far.org", "/c", None, "block"), 7: ("ok.com", "/", "com/", "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("plain.org", "", None, "allow"), 11: ("notexample.com", "/en/", "com/", "allow"), 12: ("net", "/fr/", "net/fr/", "block"),
        13: ("other.org", "/a", None, "block"), None: ("q.net", "/fr", None, "allow"), 14: ("far.org", "/sub/d", None, "allow"),
        15: ("far.org", "/sub/e", None, "allow"),
    }
    assert url_filters.judge(pages.limit(0), url_filters.links(pages.limit(0)), URL_RULES).count() == 0


@pytest.mark.parametrize("column", ["n_dup_lines", "n_repeat_words"])
def test_the_forest_reads_repetition(column):
    """Texts like good ones in all else are rejected for lines or words that repeat beyond what good texts do."""
    rng = np.random.default_rng(3)
    n = 600
    table = np.zeros((n, len(quality_forest.STATS)), np.int64)
    words = rng.integers(100, 400, n)
    for name, value in (("n_words", words), ("word_chars", words * 5), ("n_lines", words // 8), ("n_upper", words // 9), ("n_marks", words // 50)):
        table[:, quality_forest.STATS.index(name)] = value
    whole = table[:, quality_forest.STATS.index("n_lines" if column == "n_dup_lines" else "n_words")]
    junk = np.arange(n) % 10 == 0
    share = np.where(junk, rng.uniform(0.4, 0.49, n), rng.uniform(0, 0.2, n))
    table[:, quality_forest.STATS.index(column)] = whole * share
    forest = quality_forest.fit(table[: n // 2], ~junk[: n // 2])
    failed, kept, _ = quality_forest.verdicts(table[n // 2 :], forest)
    assert not failed.any()
    # Nothing else tells them apart, so without these statistics as many junk texts as good ones would stay.
    assert kept[~junk[n // 2 :]].mean() > 0.97 and kept[junk[n // 2 :]].mean() < 0.8
