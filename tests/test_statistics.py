"""Statistics against numpy or enumeration."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstat.functions.kolmogorov import p_series
from glyphstat.functions.numeric import log_ratio, relative_difference, scaled, significant
from glyphstat.operators import compare, distance, merge
from glyphstat.operators import quantiles as quantile_module
from glyphstat.operators.quantiles import describe, quantiles
from glyphstat.operators.tfidf import tfidf_histogram

HIST = "dataset string, key string, count bigint"
FILES = "dataset string, key string, num bigint, n_files bigint"


def rows(frame, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in frame.collect()}


# ------------------------------------------------------------ expressions


def test_rounding_and_division(spark):
    frame = spark.createDataFrame([(0.00005,), (0.00015,), (0.00025,)], "x double")
    got = [r[0] / 10_000 for r in frame.select(scaled(F.col("x"), 4)).collect()]
    assert got == [float(np.round(x, 4)) for x in (0.00005, 0.00015, 0.00025)]
    pairs = spark.createDataFrame(
        [(0.0, 0.0), (1.0, 0.0), (0.0, 2.0), (3.0, 2.0)], "a double, b double"
    )
    diff = pairs.select(
        relative_difference(F.col("a"), F.col("b")), relative_difference(F.col("a"), F.col("b"), True),
        log_ratio(F.col("a"), F.col("b")),
    ).collect()
    assert [r[0] for r in diff] == [None, math.inf, -1.0, 0.5]
    assert [r[1] for r in diff] == [None, None, -1.0, 0.5]
    assert [r[2] for r in diff] == [None, None, None, math.log(1.5)]


# ------------------------------------------------------------ quantiles


@pytest.mark.parametrize("sorted_values", [1, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, sorted_values):
    monkeypatch.setattr(quantile_module, "PIECES", 4 if sorted_values == 1 else 512)
    rng = random.Random(11)
    groups = {
        "few": [3.0], "two": [1.0, 4.0], "ties": [5.0] * 500 + [1.0] * 300 + [9.0] * 7,
        "signed": [rng.uniform(-1e3, 1e3) for _ in range(999)],
        "small": [10 ** rng.uniform(-9, 9) for _ in range(1000)], "zeros": [0.0] * 10 + [1e-300, -2.0],
        "same": [1.0 + i * 1e-12 for i in range(200)], "inf": [1.0, 2.0, 3.0, math.inf],
        None: [1.0, 2.0], "near": [1e300 * (1 + i * 1e-13) for i in range(40)],
    }
    data = [(g, v) for g, values in groups.items() for v in values] + [("few", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["q"]): r["v"] for r in quantiles(frame, ["g"], "v", qs, sorted_values).collect()}
    for g, values in groups.items():
        for q in qs:
            if g == "inf" and q >= 0.75:
                assert got[g, q] == math.inf
            else:
                assert got[g, q] == pytest.approx(float(np.quantile(values, q)), rel=1e-12), (g, q)
    summary = {r["g"]: r for r in describe(frame, ["g"], "v", sorted_values).collect()}
    assert summary["few"]["count"] == 1 and summary["few"]["std"] is None
    assert summary["signed"]["std"] == pytest.approx(np.std(groups["signed"], ddof=1))
    assert summary["ties"]["q75"] == 5.0


# ------------------------------------------------------------ Kolmogorov-Smirnov


def test_limiting_p_value(spark):
    cases = [(0.0, 5, 7), (1.0, 1, 1), (0.5, 8, 9), (0.02, 9000, 8000), (0.025, 5000, 9999), (0.0, 10**13, 10**13), (0.5, 10**13, 10**13)]
    frame = spark.createDataFrame(cases, "d double, n bigint, m bigint")
    for (d, n, m), row in zip(cases, frame.select(p_series(F.col("d"), F.col("n"), F.col("m"))).collect(), strict=True):
        z = d * math.sqrt(n * m / (n + m))
        # Jacobi's form of the distribution, which converges where the alternating series does not.
        below = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in range(1, 200)) if 0 < z < 20 else 0
        assert row[0] == pytest.approx(1 - math.sqrt(2 * math.pi) / z * below if 0 < z < 20 else float(z == 0), abs=1e-9)


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("width", [1, 64])
def test_ks_equals_samples(spark, width):
    rng = random.Random(2)
    hist, samples = [], {}
    for key in "pq":
        for d, width in (("A", 30), ("B", 40), ("W", 50)):
            counts = {rng.randrange(width): rng.randint(1, 9) for _ in range(12)}
            samples[key, d] = [v for v, n in counts.items() for _ in range(n)]
            hist += [(d, key, v, n) for v, n in counts.items()]
    hist += [("A", "only-a", 1, 3), ("W", "only-w", 1, 3), ("A", "same", 1, 2), ("W", "same", 1, 2)]
    hist += [("B", "apart", 1, 4), ("W", "apart", 9, 4), ("A", "big", 1, 10_001), ("W", "big", 2, 5)]
    tests = distance.ks_test(spark.createDataFrame(hist, FILES), "W", width).collect()
    got = {(r["key"], r["dataset"]): r for r in tests}
    for (key, d), sample in samples.items():
        if d != "W":
            assert got[key, d]["statistic"] == pytest.approx(brute_ks(sample, samples[key, "W"]), abs=1e-15)
    assert not [k for k in got if k[0].startswith("only")]
    assert (got["same", "A"]["statistic"], got["same", "A"]["p_value"]) == (0.0, 1.0)
    assert got["apart", "B"]["statistic"] == 1.0
    assert got["apart", "B"]["p_value"] == pytest.approx(2 * (math.exp(-4) - math.exp(-16)))
    assert got["big", "A"]["statistic"] == 1.0 and got["big", "A"]["p_value"] < 0.01


# ------------------------------------------------------------ distances


@pytest.mark.parametrize("width", [100, 10_000])
def test_energy_distance_equals_expectations(spark, width):
    weights = {
        "A": {100: 3, 250: 5}, "B": {100: 3, 250: 5}, "C": {400: 2}, "D": {0: 1, 250: 2, 900: 4},
    }
    data = [(d, bucket, n) for d, w in weights.items() for bucket, n in w.items()]
    hist = spark.createDataFrame(data, "dataset string, bucket bigint, file_count bigint")
    got = rows(
        distance.energy_distances(hist, digits=9, width=width), "dataset_a", "dataset_b", "distance"
    )

    def mean_gap(a, b):
        pairs = [(p * q, abs(x - y) / 1000) for x, p in a.items() for y, q in b.items()]
        return sum(w * gap for w, gap in pairs) / sum(w for w, _ in pairs)

    for a, wa in weights.items():
        for b, wb in weights.items():
            square = 2 * mean_gap(wa, wb) - mean_gap(wa, wa) - mean_gap(wb, wb)
            assert got[a, b] == pytest.approx(math.sqrt(max(square, 0)), abs=1e-7)
            assert got[a, b] == got[b, a]
    assert got["A", "B"] == got["C", "C"] == 0


def test_kernel_density_equals_formula(spark):
    x, w = np.array([1.0, 2.0, 4.0, 9.0]), np.array([0.1, 0.4, 0.3, 0.2])
    frame = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(x, w)], "g string, x double, w double")
    got = distance.kernel_density(frame, ["g"], "x", "w", grid_size=50).orderBy("point").collect()
    mean = (w * x).sum()
    h = math.sqrt((w * (x - mean) ** 2).sum() / (1 - (w**2).sum())) * ((w**2).sum()) ** 0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 50)
    density = [(w * np.exp(-0.5 * ((g - x) / h) ** 2)).sum() / (h * math.sqrt(2 * math.pi)) for g in grid]
    assert [r["x"] for r in got] == pytest.approx(list(grid))
    assert [r["density"] for r in got] == pytest.approx(density)

    counts = spark.createDataFrame([("A", 1.0, 2), ("A", 3.0, 5), ("B", 1.0, 4)], "g string, x double, w int")
    got = distance.kernel_density(counts, ["g"], "x", "w", frequency=True, cut=0, grid_size=3).collect()
    sample = np.array([1.0] * 2 + [3.0] * 5)
    h = sample.std(ddof=1) * 7 ** (-0.2)
    at_one = np.exp(-0.5 * ((1.0 - sample) / h) ** 2).sum() / (7 * h * math.sqrt(2 * math.pi))
    assert {r["g"] for r in got} == {"A"}
    assert [r["density"] for r in got if r["x"] == 1.0] == [pytest.approx(at_one)]


def test_tfidf_buckets_are_negative(spark):
    hist = spark.createDataFrame(
        [("A", "all", 1, 6), ("A", "all", 2, 4), ("A", "rare", 4, 1), ("A", "rare", 5, 1)], FILES
    )
    got = {(r["key"], r["num"]): r["n_files"] for r in tfidf_histogram(hist).collect()}
    weight = math.log(2 / 10)
    assert got == {("all", 0): 10, ("rare", round(4 * weight)): 1, ("rare", round(5 * weight)): 1}


def test_bucket_difference(spark):
    hist = spark.createDataFrame(
        [("A", "k", 1, 3), ("A", "k", 2, 1), ("W", "k", 1, 1), ("W", "k", 3, 1), ("A", "mine", 1, 1)], FILES
    )
    got = rows(distance.bucket_difference(hist, "A", "W"), "key", "num", "diff")
    assert got == {("k", 1): 0.5, ("k", 2): math.inf, ("k", 3): -1.0}


# ------------------------------------------------------------ comparison


@pytest.fixture(scope="module")
def hist(spark):
    data = {"A": {"x": 8, "y": 2, "z": 10}, "B": {"x": 1}, "W": {"x": 4, "y": 4, "w": 2}}
    return spark.createDataFrame([(d, k, n) for d, c in data.items() for k, n in c.items()], HIST)


def test_comparison_invariants(spark, hist):
    cells = compare.comparison(hist, "W")
    assert cells.count() == 7 and compare.complete(cells).count() == 12
    sums = rows(compare.shares(cells).groupBy("dataset").agg(F.sum("share").alias("s")), "dataset", "s")
    assert all(v == pytest.approx(1) for v in sums.values())
    gap = {r["dataset"]: r for r in compare.vocab_gap(cells, listed=True).collect()}
    mass = rows(compare.absent_reference_mass(cells, "W"), "dataset", "pct")
    assert all(gap[d]["used_share"] * 100 == pytest.approx(mass[d,]) for d in "AB")
    assert (gap["A"]["missing"], gap["A"]["tokens"], gap["A"]["used_share"]) == (1, "w", 0.2)
    assert (gap["W"]["missing"], gap["W"]["tokens"], gap["W"]["used_share"]) == (1, "z", 0.0)
    assert compare.out_of_reference_mass(cells, "W").first()[0] == 0.5
    absent = {(r["dataset"], r["key"]) for r in compare.absent_keys(cells).collect()}
    assert absent == {("A", "w"), ("B", "y"), ("B", "z"), ("B", "w"), ("W", "z")}


def test_percent_difference(spark, hist):
    cells = compare.complete(compare.comparison(hist, "W"))
    got = rows(compare.pct_diff(cells, "W"), "key", "dataset", "diff")
    assert got["x", "A"] == pytest.approx(-0.2) and got["y", "A"] == pytest.approx(-0.8)
    assert got["z", "A"] == math.inf and got["w", "A"] is None and got["z", "B"] is None
    finite = compare.pct_diff(cells, "W", drop_keys=("x",), inf_as_null=True)
    assert rows(finite, "key", "dataset", "diff")["z", "A"] is None
    top = compare.pct_diff_topk(compare.pct_diff(cells, "W"), 2).orderBy("dataset", "rank").collect()
    assert [(r["dataset"], r["rank"], r["key"]) for r in top] == [("A", 1, "z"), ("A", 2, "y"), ("B", 1, "x")]


def test_sparse_cells_say_the_same_as_all_cells(spark):
    rng = random.Random(4)
    data = [(d, f"k{k}", rng.randint(1, 50)) for d in ("A", "B", "C", "W") for k in range(60) if rng.random() < 0.4]
    hist = spark.createDataFrame(data, HIST)
    cells = compare.comparison(hist, "W")
    whole = {(r["key"], r["dataset"]): r for r in compare.complete(cells).collect()}
    keys = {k for _, k, _ in data}
    assert set(whole) == {(k, d) for k in keys for d in "ABCW"}
    for d, r in {r["dataset"]: r for r in compare.divergence_table(cells, "W").collect()}.items():
        mine = [c for (_, corpus), c in whole.items() if corpus == d]
        gaps = [abs(c["count"] / c["total"] - c["ref_count"] / c["ref_total"]) for c in mine]
        logs = [abs(math.log(c["count"] / c["total"] * c["ref_total"] / c["ref_count"])) for c in mine if c["count"] and c["ref_count"]]
        assert r["diff_sum"] == pytest.approx(sum(gaps)) and r["diff_mean"] == pytest.approx(sum(gaps) / len(keys))
        assert r["log_diff_sum"] == pytest.approx(sum(logs)) and r["missing_share"] == pytest.approx(1 - len(logs) / len(keys))
    frequent = compare.frequent(cells, 0.05)
    kept = {k for (k, _), c in whole.items() if c["count"] / c["total"] > 0.05}
    assert {r["key"] for r in frequent.collect()} == kept
    for d, r in {r["dataset"]: r for r in compare.divergence_table(frequent, "W").collect()}.items():
        gaps = [abs(c["count"] / c["total"] - c["ref_count"] / c["ref_total"]) for (k, x), c in whole.items() if x == d and k in kept]
        assert r["diff_mean"] == pytest.approx(sum(gaps) / len(kept))


NAMES = ["a.b", "key", "count", "null", "`x`", None]


@pytest.mark.parametrize("reference", NAMES)
def test_corpora_of_any_name(spark, reference):
    data = [(d, f"k{k}", 1 + i + k) for i, d in enumerate(NAMES) for k in range(i + 1)]
    hist = spark.createDataFrame(data, HIST)
    cells = compare.comparison(hist, reference)
    assert cells.count() == 21 and compare.complete(cells).count() == 36
    totals = {d: sum(n for x, _, n in data if x == d) for d in NAMES}
    counts = {(d, k): n for d, k, n in data}
    for r in compare.shares(compare.complete(cells)).collect():
        assert r["share"] == counts.get((r["dataset"], r["key"]), 0) / totals[r["dataset"]]
        assert r["ref_share"] == counts.get((reference, r["key"]), 0) / totals[reference]
    assert {(r["dataset"], r["missing"]) for r in compare.vocab_gap(cells).collect()} == {(d, 5 - i) for i, d in enumerate(NAMES)}
    assert {(r["dataset"], r["key"]) for r in compare.absent_keys(cells).collect()} == {
        (d, f"k{k}") for i, d in enumerate(NAMES) for k in range(i + 1, 6)
    }
    assert {r["dataset"] for r in compare.divergence_table(cells, reference).collect()} == set(NAMES) - {reference}
    datasets = merge.datasets_of(hist)
    assert set(datasets) == set(NAMES)
    wide = merge.merge_outer(hist, datasets)
    assert {tuple(r)[0]: tuple(r)[1:] for r in wide.collect()}["k2"] == tuple(counts.get((d, "k2"), 0) for d in datasets)
    melted = merge.melt(merge.arrange(wide, ["key"]), datasets, ["key"])
    assert sorted(map(str, melted.filter("count > 0").select("dataset", "key", "count").collect())) == sorted(map(str, hist.collect()))
    assert compare.presence_matrix(wide, datasets, reference).count() == 5 - (reference == NAMES[0])
    assert merge.column_order(wide, datasets)[0] is None
    lacking = merge.missing_keys(hist, None, ["a.b", "key"]).collect()
    assert len(lacking) == 9 and {r["dataset"] for r in lacking} == {"a.b", "key"}


def test_significant_digits(spark):
    values = [0.0, 1e-10, -1e-10, 1 / 3, -2 / 3e-30, 123456789.123, 1.5e300, math.inf, -math.inf, 0.1 + 0.2, 999999999.7, 5e-320]
    rows_ = spark.createDataFrame([(v,) for v in [*values, None]], "x double").select(significant(F.col("x"), 9).alias("y"))
    got = [r["y"] for r in rows_.collect()]
    assert got[-1] is None and got[1] == 1e-10
    assert got[:-2] == [pytest.approx(float(f"{v:.8e}"), rel=1e-15) for v in values[:-1]]


def test_presence_and_order(spark, hist):
    wide = merge.merge_outer(hist, ["A", "B", "W"])
    got = {r["key"]: (r["A"], r["B"], r["total"]) for r in compare.presence_matrix(wide, ["A", "B", "W"], "W").collect()}
    assert got == {"y": (1, 0, 1), "z": (1, 0, 1), "w": (0, 0, 0)}
    assert merge.column_order(wide, ["A", "B", "W"]) == ["A", "W", "B"]
    assert merge.datasets_of(hist) == ["A", "B", "W"]


def test_minimum_count_applies_before_the_join(spark, hist):
    got = {r["key"]: (r["A"], r["W"]) for r in merge.merge_outer(hist, ["A", "W"], min_count=4, fill=False).collect()}
    assert got == {"x": (8, None), "z": (10, None)}


def test_null_keys_meet(spark):
    data = [("A", None, 1), ("B", None, 2), ("A", "k", 3)]
    frame = spark.createDataFrame(data, HIST)
    got = {r["key"]: (r["A"], r["B"]) for r in merge.merge_outer(frame, ["A", "B"]).collect()}
    assert got == {None: (1, 2), "k": (3, 0)}
