"""Distances between corpora that look at distributions over files.

Input histograms are ``(dataset, key, num, n_files)`` or ``(dataset, bucket, weight)``. All windows
run over aggregated buckets: at most one row per distinct bucket of a key, whatever the number of
files.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.functions.kolmogorov import p_series
from glyphstat.functions.numeric import ratio, relative_difference, scaled, unscaled
from glyphstat.operators.merge import is_dataset, merge_outer
from glyphstat.operators.quantiles import describe

LOG_DECIMALS = 3


def log_length_histogram(lengths: DataFrame, decimals: int = LOG_DECIMALS) -> DataFrame:
    """(dataset, bucket, file_count, share) over log10 of the file length, rounded."""
    bucket = scaled(F.log10(F.col("tokens_count")), decimals)
    summed = lengths.groupBy("dataset", bucket.alias("bucket")).agg(
        F.sum("file_count").alias("file_count")
    )
    total = F.sum("file_count").over(Window.partitionBy("dataset"))
    return summed.withColumn("share", F.col("file_count") / total)


def cumulative_shares(hist: DataFrame) -> DataFrame:
    """Distribution function of each (dataset, key) at its own buckets."""
    group = Window.partitionBy("dataset", "key").orderBy("num")
    upto = F.sum("n_files").over(group)
    total = F.sum("n_files").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hist.select("dataset", "key", "num", (upto / total).alias("cdf"))


# Buckets that share a range in which running sums are formed.
RANGE_BUCKETS = 64


def running_sums(cells: DataFrame, group: list[str], at: str, value: str, width: int = RANGE_BUCKETS) -> DataFrame:
    """Add ``upto``, the sum of ``value`` over a group's buckets up to each one, and ``total``.

    Sums run inside ranges of ``width`` buckets; ranges, a row each, are shifted by the sums of those before them. So a group
    with any number of buckets is spread over as many tasks as it has ranges.
    """
    ranged = cells.withColumn("_range", F.floor(F.col(at) / width))
    inside = Window.partitionBy(*group, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range")
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *(F.col(c).alias(f"_of_{c}") for c in (*group, "_range")), (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("total"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, "_range")]
    placed = ranged.withColumn("_inside", F.sum(value).over(inside)).join(offsets, same)
    return placed.select(*cells.columns, (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def energy_distances(
    hist: DataFrame, value: str = "file_count", decimals: int = LOG_DECIMALS, digits: int = 3, width: int = RANGE_BUCKETS
) -> DataFrame:
    """Matrix of energy distances between corpora as (dataset_a, dataset_b, distance).

    Corpora are rows: the plan is the same for any number of them. Each bucket of any corpus holds the distribution
    functions of all; its pairs are formed in its row and summed before they are shuffled.
    """
    buckets = hist.select("bucket").distinct()
    corpora = hist.select("dataset").distinct().agg(F.collect_list(F.struct("dataset"))).scalar()
    # The next bucket is in the same range, or the first of the next range that has any.
    inside = Window.partitionBy("_range").orderBy("bucket")
    ranged = buckets.withColumn("_range", F.floor(F.col("bucket") / width))
    firsts = ranged.groupBy("_range").agg(F.min("bucket").alias("_first"))
    # One row per range.
    follow = firsts.select(F.col("_range").alias("_r"), F.lead("_first").over(Window.orderBy("_range")).alias("_follow"))
    gaps = ranged.withColumn("_next", F.lead("bucket").over(inside)).join(follow, F.col("_range") == F.col("_r")).select(
        "bucket", unscaled(F.coalesce("_next", "_follow") - F.col("bucket"), decimals).alias("gap")
    )
    grid = buckets.select("bucket", F.inline(corpora))
    own = hist.select(F.col("dataset").alias("_d"), F.col("bucket").alias("_b"), F.col(value).alias("_v"))
    filled = grid.join(own, F.col("dataset").eqNullSafe(F.col("_d")) & (F.col("bucket") == F.col("_b")), "left").select(
        "dataset", "bucket", F.coalesce("_v", F.lit(0)).alias("_v")
    )
    shares = running_sums(filled, ["dataset"], "bucket", "_v", width).select("bucket", "dataset", ratio(F.col("upto"), F.col("total")).alias("f"))
    rows = shares.groupBy("bucket").agg(F.collect_list(F.struct("dataset", "f")).alias("fs")).join(gaps, "bucket")
    left = rows.select("gap", "fs", F.explode("fs").alias("a"))
    pairs = left.select("gap", "a", F.explode("fs").alias("b"))
    square = F.pow(F.col("a.f") - F.col("b.f"), F.lit(2.0)) * F.col("gap")
    summed = pairs.groupBy(F.col("a.dataset").alias("dataset_a"), F.col("b.dataset").alias("dataset_b")).agg(
        F.coalesce(F.sum(square), F.lit(0.0)).alias("s")
    )
    return summed.select("dataset_a", "dataset_b", F.round(F.sqrt(2 * F.col("s")), digits).alias("distance"))


def kernel_density(
    hist: DataFrame, group: list[str], x: str, weight: str, frequency: bool = False,
    cut: float = 3.0, grid_size: int = 200, support: DataFrame | None = None,
) -> DataFrame:
    """Gaussian kernel density per group on an even grid: (group…, point, x, density).

    ``hist`` holds one row per distinct x of a group. Weights are relative importances, or numbers
    of equal observations with ``frequency``. Bandwidth is Scott's factor times the weighted
    deviation. The grid spans the x of ``support`` (default: of the group itself), widened by
    ``cut`` bandwidths. Every bucket contributes to a fixed number of grid points and contributions
    are summed before they are shuffled.
    """
    hist = hist.select(*group, F.col(x).alias("_x"), F.col(weight).cast("double").alias("_w"))
    members = Window.partitionBy(*group)
    mean = F.sum(F.col("_w") * F.col("_x")).over(members) / F.sum("_w").over(members)
    moments = hist.withColumn("_mean", mean).groupBy(*group).agg(
        F.sum("_w").alias("w"), F.sum(F.pow("_w", F.lit(2.0))).alias("w2"),
        F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("_mean"), F.lit(2.0))).alias("spread"),
        F.min("_x").alias("low"), F.max("_x").alias("high"),
    )
    if support is not None:
        ends = support.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias("e")).scalar()
        moments = moments.withColumn("_ends", ends).withColumns(
            {"low": F.col("_ends.low"), "high": F.col("_ends.high")}
        )
    w, w2 = F.col("w"), F.col("w2")
    if frequency:
        size, variance = w, ratio(F.col("spread"), w - 1)
    else:
        size, variance = w * w / w2, ratio(F.col("spread") / w, 1 - w2 / (w * w))
    params = (
        moments.filter(w > 0)
        .withColumn("h", F.sqrt(variance) * F.pow(size, F.lit(-0.2)))
        .filter(F.col("h") > 0)
        .select(
            *group, "w", "h", (F.col("low") - cut * F.col("h")).alias("from"),
            ((F.col("high") - F.col("low") + 2 * cut * F.col("h")) / (grid_size - 1)).alias("step"),
        )
    )
    points = hist.filter(F.col("_w") > 0).join(params, group).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1)))
    )
    at = F.col("from") + F.col("step") * F.col("point")
    z = (at - F.col("_x")) / F.col("h")
    kernel = F.col("_w") * F.exp(-0.5 * z * z) / (F.col("w") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        points.select(*group, "point", at.alias("x"), kernel.alias("kernel"))
        .groupBy(*group, "point", "x").agg(F.sum("kernel").alias("density"))
    )


def ks_test(hist: DataFrame, reference: str | None, width: int = RANGE_BUCKETS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of every (key, corpus) against the reference.

    (key, dataset, n, n_ref, statistic, p_value), without keys that either sample lacks. The p-value
    is that of the limiting distribution, for samples of every size. Corpora are rows: the reference's buckets of a key stand
    next to those of each corpus that has it, and both distribution functions are running sums over them.
    """
    own = hist.filter(~is_dataset(reference)).select("key", "dataset", "num", F.col("n_files").alias("a"), F.lit(0).cast("long").alias("r"))
    theirs = hist.filter(is_dataset(reference)).select(F.col("key").alias("_key"), "num", F.col("n_files").alias("r"))
    compared = own.select("key", "dataset").distinct().join(theirs, F.col("key").eqNullSafe(F.col("_key"))).select(
        "key", "dataset", "num", F.lit(0).cast("long").alias("a"), "r"
    )
    cells = own.unionByName(compared).groupBy("key", "dataset", "num").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    group = ["key", "dataset"]
    both = running_sums(cells, group, "num", "a", width).withColumnsRenamed({"upto": "a_upto", "total": "n"})
    both = running_sums(both, group, "num", "r", width).withColumnRenamed("total", "n_ref").filter("n > 0 AND n_ref > 0")
    gap = F.abs(F.col("a_upto") / F.col("n") - F.col("upto") / F.col("n_ref"))
    tests = both.groupBy(*group).agg(F.max("n").alias("n"), F.max("n_ref").alias("n_ref"), F.max(gap).alias("statistic"))
    p_value = p_series(F.col("statistic"), F.col("n"), F.col("n_ref"))
    return tests.select("key", "dataset", "n", "n_ref", "statistic", p_value.alias("p_value"))


def ks_pass_counts(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Per corpus the keys whose p-value, and whose statistic, exceeds the level."""
    return tests.groupBy("dataset").agg(
        F.count_if(F.col("p_value") > level).alias("p_above"),
        F.count_if(F.col("statistic") > level).alias("statistic_above"),
    )


def ks_mean_by_key(tests: DataFrame) -> DataFrame:
    return tests.groupBy("key").agg(F.avg("statistic").alias("avg_statistic")).orderBy("avg_statistic", "key")


def ks_describe(tests: DataFrame) -> DataFrame:
    return describe(tests, ["dataset"], "statistic")


def bucket_difference(hist: DataFrame, dataset: str | None, reference: str | None, inf_as_null: bool = False) -> DataFrame:
    """Relative difference of two corpora's share of files per (key, bucket).

    Only keys of both corpora and buckets of either have a value.
    """
    wide = merge_outer(hist, [dataset, reference], "n_files", on=["key", "num"]).toDF("key", "num", "_own", "_ref")
    members = Window.partitionBy("key")
    mine, theirs = (ratio(F.col(d), F.sum(d).over(members)) for d in ("_own", "_ref"))
    both = wide.select("key", "num", mine.alias("share"), theirs.alias("ref_share"))
    diff = relative_difference(F.col("share"), F.col("ref_share"), inf_as_null)
    return both.select("key", "num", diff.alias("diff")).filter(F.col("diff").isNotNull())


def key_density(
    hist: DataFrame, datasets: list[str], reference: str, key: str, max_x: float,
    decimals: int = 4,
) -> DataFrame:
    """Density of one key's share per file in the chosen corpora, with each corpus' statistic.

    (dataset, statistic, point, x, density) for x from 0 to ``max_x``.
    """
    valued = hist.withColumn("x", unscaled(F.col("num"), decimals))
    chosen = valued.filter((F.col("key") == key) & F.col("dataset").isin(datasets))
    curves = kernel_density(chosen, ["dataset"], "x", "n_files", support=valued)
    compared = datasets if reference in datasets else [*datasets, reference]
    one_key = hist.filter((F.col("key") == key) & F.col("dataset").isin(compared))
    tests = ks_test(one_key, reference).select("dataset", "statistic")
    return curves.filter(F.col("x").between(0, max_x)).join(tests, "dataset", "left")
