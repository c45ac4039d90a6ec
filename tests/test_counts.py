"""Counting operators against plain Python on small and skewed inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstat.functions.lexing import WORDS
from glyphstat.operators import records
from glyphstat.operators.counts import (
    count_histogram,
    document_file_counts,
    document_keys,
    exclude_files,
    file_counts,
    file_key_counts,
    file_lengths,
    number_rows,
    ratio_histogram,
    token_keys,
)
from glyphstat.sources import records as record_files

TOKENS = "uuid string, dataset string, path string, token_num int, token_text string, token_type string"


def table(spark, files):
    """files: {(dataset, file): [(text, type), …]}"""
    rows = [
        (f"{d}-{f}-{i}", d, f, i, text, kind)
        for (d, f), tokens in files.items()
        for i, (text, kind) in enumerate(tokens)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TOKENS)


@pytest.fixture(scope="module")
def files():
    rng = random.Random(3)
    made = {
        ("A", "hot"): [(rng.choice("abcdefgh"), rng.choice("xy")) for _ in range(3000)],
        ("A", "one"): [("a", "x")],
        ("A", "two"): [("a", "x"), ("b", "y")],
        ("B", "three"): [("a", "x"), ("NULL", "x"), ("b", "y")],
        ("B", "na"): [(None, "x"), ("nan", "y"), ("", "y"), ("c", "x"), ("<EOF>", "EOF")],
    }
    return made


def expected_pairs(tokens, which, all_pairs=False):
    na = {None, "NULL", "nan", ""}
    keys = ["<<UNK>>" if t[which] in na else t[which] for t in tokens]
    keys = keys if all_pairs else keys[:-1]
    return Counter(f"{a}<<>>{b}" for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("block", [3, 7, 100, 100_000])
@pytest.mark.parametrize("all_pairs", [False, True])
def test_pairs_do_not_depend_on_blocks(spark, files, block, all_pairs):
    keys = token_keys(table(spark, files), "bigram_text", block=block, all_pairs=all_pairs)
    got = {(r["dataset"], r["path"], r["key"]): r["n"] for r in file_key_counts(keys).collect()}
    expected = {
        (*file, key): n for file, tokens in files.items()
        for key, n in expected_pairs(tokens, 0, all_pairs).items()
    }
    assert got == expected


def test_all_kinds_at_once(spark, files):
    got = {
        (r["dataset"], r["path"], r["kind"], r["key"]): r["n"]
        for r in file_counts(table(spark, files), block=50).collect()
    }
    for file, tokens in files.items():
        for kind, which in (("bigram_text", 0), ("bigram_type", 1)):
            mine = {k[3]: n for k, n in got.items() if k[:2] == file and k[2] == kind}
            assert mine == expected_pairs(tokens, which)
    assert got["B", "na", "token_text", "<<UNK>>"] == 3
    assert got["B", "three", "token_text", "<<UNK>>"] == 1


def test_spellings_of_missing_are_kept_on_request(spark, files):
    keys = token_keys(table(spark, files), "token_text", pandas_na=False)
    got = Counter(r["key"] for r in keys.filter("path = 'na'").collect())
    assert got == {"<<UNK>>": 1, "nan": 1, "": 1, "c": 1, "<EOF>": 1}


def test_numbering_does_not_depend_on_buckets(spark):
    rng = random.Random(5)
    times = [rng.randrange(10_000) for _ in range(2000)]
    rows = [("A", "hot" if i % 3 else "cold", t if i % 50 else None, i) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "dataset string, path string, t int, i int")
    order = {
        f: sorted(((t, i) for _, g, t, i in rows if g == f), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for f in ("hot", "cold")
    }
    for width in (1, 60, 100_000):
        numbered = number_rows(frame, ["t", "i"], F.floor(F.col("t") / width)).collect()
        assert len(numbered) == len(rows)
        assert all(order[r["path"]][r["token_num"]] == (r["t"], r["i"]) for r in numbered)


def test_ratio_buckets_round_half_to_even(spark):
    counts = spark.createDataFrame(
        [("A", f"f{i}", "k", n) for i, n in enumerate((1, 3, 5, 31))],
        "dataset string, path string, key string, n bigint",
    )
    lengths = spark.createDataFrame(
        [("A", "f0", 20_000), ("A", "f1", 20_000), ("A", "f2", 20_000), ("A", "f3", 31)],
        "dataset string, path string, num_tokens bigint",
    )
    got = {r["num"]: r["n_files"] for r in ratio_histogram(counts, lengths).collect()}
    expected = Counter(round(float(np.round(n / size, 4)) * 10_000) for n, size in ((1, 20_000), (3, 20_000), (5, 20_000), (31, 31)))
    assert got == expected


def test_golden_ratios(spark):
    counts = spark.createDataFrame(
        [("A", "f", k, n) for k, n in (("p", 5), ("q", 3), ("r", 2), ("s", 1))],
        "dataset string, path string, key string, n bigint",
    )
    lengths = spark.createDataFrame([("A", "f", 31)], "dataset string, path string, num_tokens bigint")
    got = {r["key"]: r["num"] for r in ratio_histogram(counts, lengths).collect()}
    assert got == {"p": 1613, "q": 968, "r": 645, "s": 323}


def test_weighted_histogram_restores_counts(spark, files):
    counts = file_key_counts(token_keys(table(spark, files), "token_text"))
    back = count_histogram(counts).groupBy("dataset", "key").agg(F.sum(F.col("num") * F.col("n_files")).alias("n"))
    direct = counts.groupBy("dataset", "key").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, direct.collect()))


def test_excluded_prefix_concerns_one_corpus(spark):
    rows = [("A", "._x.c"), ("A", "x.c"), ("B", "._x.c")]
    frame = spark.createDataFrame(rows, "dataset string, path string")
    assert sorted(map(tuple, exclude_files(frame, "A", "._").collect())) == [("A", "x.c"), ("B", "._x.c")]


@pytest.mark.parametrize("n_parts", [1, 5])
def test_records_hold_every_count(spark, files, tmp_path, n_parts):
    tokens = table(spark, files)
    made = records.file_records(file_counts(tokens), records.file_heads(tokens), n_parts)
    record_files.write(made, str(tmp_path / "r"), max_lines=2)
    read, rejects = record_files.read(spark, str(tmp_path / "r"))
    assert rejects.count() == 0
    for kind in ("token_text", "bigram_type"):
        got = {(r["dataset"], r["path"], r["key"]): r["n"] for r in records.record_counts(read, kind).collect()}
        keys = file_key_counts(token_keys(tokens, kind))
        assert got == {(r["dataset"], r["path"], r["key"]): r["n"] for r in keys.collect()}
    lengths = {tuple(r) for r in records.record_lengths(read).collect()}
    assert lengths == {tuple(r) for r in file_lengths(tokens).collect()}
    assert {r["id"] for r in read.filter("filename = 'hot'").collect()} == {"A-hot-0"}
    assert read.count() == n_parts * len(files)


def test_index_documents_reject_shared_ids(spark, files, tmp_path):
    tokens = table(spark, files)
    made = records.index_documents(records.file_records(file_counts(tokens), records.file_heads(tokens)))
    record_files.write_index(made, str(tmp_path / "ok"))
    assert record_files.read_index(spark, str(tmp_path / "ok")).count() == len(files)
    with pytest.raises(ValueError, match="duplicate"):
        record_files.write_index(made.withColumn("id", F.lit("same")), str(tmp_path / "bad"))


@pytest.mark.parametrize("kind", ["token_text", "token_type", "bigram_text", "bigram_type"])
def test_counts_inside_a_row_equal_grouped_counts(spark, kind):
    texts = ["a b a, a NULL b", "", "x", "1 2 1 2 1", None, "nan b nan b"]
    docs = spark.createDataFrame([("A", f"d{i}/main.c", t) for i, t in enumerate(texts)], "dataset string, path string, text string")
    counted = document_file_counts(docs, WORDS, kind)
    grouped = file_key_counts(document_keys(docs, WORDS, kind), with_length=True)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, grouped.collect()))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
