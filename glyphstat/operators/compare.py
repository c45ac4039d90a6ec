"""How the key distribution of each corpus differs from a reference corpus.

All operators start from the cells that exist: one row for every key of every corpus that has it, with its own
count, the reference's count of the key, both corpora's totals and peaks, and the number of all keys. What
an operator says of absent keys follows from the totals less the sum over the present ones, so tables grow with
the histograms and not with keys times corpora. Only results that list absent cells (``complete``, ``absent_keys``) make them.

Totals come from an aggregation with one row per corpus that is broadcast; a window over a corpus would
put its whole vocabulary into one task. Corpora are data here: names with dots, ``key`` and null are names like any other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.functions.numeric import log_ratio, relative_difference
from glyphstat.operators.merge import by_place, is_dataset, titled
from glyphstat.operators.quantiles import describe, named_quantiles, reduced

_CONSTANTS = ["ref_total", "ref_peak", "n_keys"]


def _share() -> Column:
    return F.col("count") / F.col("total")


def _reference_share() -> Column:
    return F.col("ref_count") / F.col("ref_total")


def comparison(hist: DataFrame, reference: str | None, min_count: int = 0) -> DataFrame:
    """(key, dataset, count, ref_count, total, peak, ref_total, ref_peak, n_keys) for the keys that a corpus has.

    One exchange brings a key's counts together; a key has at most one per corpus. ``min_count`` keeps only
    counts above it, per corpus and before anything else.
    """
    if min_count:
        hist = hist.filter(F.col("count") > min_count)
    keyed = hist.groupBy("key").agg(
        F.coalesce(F.sum(F.when(is_dataset(reference), F.col("count"))), F.lit(0)).alias("ref_count"),
        F.collect_list(F.struct("dataset", "count")).alias("present"),
    )
    whole = keyed.agg(
        F.sum("ref_count").alias("ref_total"), F.max("ref_count").alias("ref_peak"), F.count(F.lit(1)).alias("n_keys")
    )
    constants = whole.select(F.struct(*_CONSTANTS)).scalar()
    # One row per corpus.
    totals = hist.groupBy(F.col("dataset").alias("_dataset")).agg(F.sum("count").alias("total"), F.max("count").alias("peak"))
    cells = keyed.select("key", "ref_count", F.inline("present"))
    joined = cells.join(F.broadcast(totals), F.col("dataset").eqNullSafe(F.col("_dataset"))).withColumn("_whole", constants)
    return joined.select(
        "key", "dataset", "count", "ref_count", "total", "peak", *(F.col(f"_whole.{name}").alias(name) for name in _CONSTANTS)
    )


def _corpora(cells: DataFrame, *columns: str) -> Column:
    """All corpora with some of their columns, as one array."""
    names = cells.groupBy("dataset").agg(*(F.max(c).alias(c) for c in columns))
    return names.agg(F.collect_list(F.struct("dataset", *columns))).scalar()


def absent_cells(cells: DataFrame) -> DataFrame:
    """The cells that ``cells`` leaves out: keys of other corpora, with a count of 0."""
    keyed = cells.groupBy("key").agg(
        F.max("ref_count").alias("ref_count"), F.collect_list(F.struct("dataset", "total", "peak")).alias("present"),
        *(F.max(name).alias(name) for name in _CONSTANTS),
    )
    lacking = F.array_except(_corpora(cells, "total", "peak"), F.col("present"))
    return keyed.select("key", "ref_count", F.inline(lacking), *_CONSTANTS).withColumn("count", F.lit(0).cast("long")).select(*cells.columns)


def complete(cells: DataFrame) -> DataFrame:
    """Every key with every corpus, for results that list all of them."""
    return cells.unionByName(absent_cells(cells))


def _others(cells: DataFrame, reference: str | None) -> DataFrame:
    return cells.filter(~is_dataset(reference))


def vocab_gap(cells: DataFrame, listed: bool = False) -> DataFrame:
    """Keys each corpus lacks: how many, their part of the vocabulary and of the reference.

    ``listed`` adds all of them in one text, for vocabularies that fit in one; ``absent_keys`` gives them as rows.
    """
    missing = F.max("n_keys") - F.count(F.lit(1))
    gaps = cells.groupBy("dataset").agg(
        missing.alias("missing"), (missing / F.max("n_keys")).alias("missing_share"),
        ((F.max("ref_total") - F.sum("ref_count")) / F.max("ref_total")).alias("used_share"),
    )
    if listed:
        texts = absent_cells(cells).groupBy(F.col("dataset").alias("_dataset")).agg(F.array_sort(F.collect_list("key")).alias("_keys"))
        joined = gaps.join(texts, F.col("dataset").eqNullSafe(F.col("_dataset")), "left")
        gaps = joined.select(*gaps.columns, F.coalesce(F.array_join("_keys", ", "), F.lit("")).alias("tokens"))
    return gaps.orderBy("used_share", "dataset")


def absent_keys(cells: DataFrame) -> DataFrame:
    return absent_cells(cells).select("dataset", "key", _reference_share().alias("ref_share"))


def out_of_reference_mass(cells: DataFrame, reference: str | None, decimals: int = 3) -> DataFrame:
    """Summed share that the other corpora give to keys the reference lacks: one row."""
    unseen = F.sum(F.when(F.col("ref_count") == 0, F.col("count")).otherwise(0))
    per_dataset = _others(cells, reference).groupBy("dataset").agg(
        (unseen / F.max("total")).alias("share")
    )
    return per_dataset.agg(F.round(F.sum("share"), decimals).alias("mass"))


def max_normalized(cells: DataFrame) -> DataFrame:
    """Counts relative to each corpus' most frequent key."""
    return cells.select(
        "key", "dataset", (F.col("count") / F.col("peak")).alias("norm"),
        (F.col("ref_count") / F.col("ref_peak")).alias("ref_norm"),
    )


def pct_diff(
    cells: DataFrame, reference: str | None, drop_keys: tuple[str, ...] = (), inf_as_null: bool = False
) -> DataFrame:
    """Relative difference of max-normalized counts to the reference; null where the key is absent.

    Summaries leave nulls out, so they need no absent cells.
    """
    norm = max_normalized(_others(cells, reference))
    if drop_keys:
        norm = norm.filter(~F.col("key").isin(list(drop_keys)))
    diff = relative_difference(F.col("norm"), F.col("ref_norm"), inf_as_null)
    return norm.select("key", "dataset", F.nullif(diff, F.lit(-1.0)).alias("diff"))


def pct_diff_describe(diff: DataFrame) -> DataFrame:
    return describe(diff.select("dataset", F.abs("diff").alias("abs_diff")), ["dataset"], "abs_diff")


def pct_diff_summary(diff: DataFrame, decimals: int = 1) -> DataFrame:
    """Median, mean and sum of the absolute difference per corpus, in percent."""
    size = diff.select("dataset", F.abs("diff").alias("size"))
    values = reduced(size, ["dataset"], "size")
    v, w = F.col("v"), F.col("w")
    sums = values.groupBy("_g").agg((F.sum(v * w) / F.sum(w)).alias("mean"), F.sum(v * w).alias("sum"))
    found = sums.join(named_quantiles(values, {0.5: "median"}), "_g")
    corpora = diff.select(F.struct("dataset").alias("_g")).distinct()
    return corpora.join(found, "_g", "left").select(
        F.col("_g.dataset").alias("dataset"), *(F.round(F.col(c) * 100, decimals).alias(c) for c in ("mean", "sum", "median"))
    )


def summary_means(summary: DataFrame) -> DataFrame:
    """The summary's columns averaged over the corpora."""
    return summary.agg(*[F.avg(c).alias(c) for c in ("median", "mean", "sum")])


def box_plot(diff: DataFrame) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outliers of the absolute difference."""
    values = reduced(diff.select("dataset", F.abs("diff").alias("size")), ["dataset"], "size")
    q = named_quantiles(values, {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    reach = (F.col("q75") - F.col("q25")) * 1.5
    v, w = F.col("v"), F.col("w")
    inside = (v >= F.col("q25") - reach) & (v <= F.col("q75") + reach)
    # One row of quartiles per corpus.
    return values.join(F.broadcast(q), "_g").groupBy(F.col("_g.dataset").alias("dataset"), "q25", "q50", "q75").agg(
        F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"),
        F.sum(F.when(inside, 0).otherwise(w)).alias("outliers"),
    )


def pct_diff_topk(diff: DataFrame, k: int) -> DataFrame:
    """The k keys of each corpus that differ most, as (dataset, rank, key, pct)."""
    largest = Window.partitionBy("dataset").orderBy(F.desc(F.abs("diff")), "key")
    return (
        diff.filter(F.col("diff").isNotNull())
        .withColumn("rank", F.row_number().over(largest))
        .filter(F.col("rank") <= k)
        .select("dataset", "rank", "key", (F.col("diff") * 100).alias("pct"))
    )


def shares(cells: DataFrame) -> DataFrame:
    """Share of every cell's key in its corpus next to its share of the reference."""
    return cells.select("key", "dataset", _share().alias("share"), _reference_share().alias("ref_share"))


def reference_frequency(cells: DataFrame, reference: str) -> DataFrame:
    """Share of every key in the reference, most frequent first."""
    del reference  # a cell carries the reference's counts
    keyed = cells.groupBy("key").agg(F.max(_reference_share()).alias("share"))
    return keyed.orderBy(F.desc("share"), "key")


def frequent(cells: DataFrame, min_share: float = 1e-4) -> DataFrame:
    """Cells of keys whose share exceeds ``min_share`` in any corpus; the number of keys is that of the keys kept."""
    top = cells.withColumn("_top", F.max(_share()).over(Window.partitionBy("key"))).filter(F.col("_top") > min_share)
    kept = top.select("key").distinct().agg(F.count(F.lit(1))).scalar()
    return top.drop("_top").withColumn("n_keys", kept)


def log_ratios(shares_: DataFrame, reference: str | None) -> DataFrame:
    return _others(shares_, reference).select(
        "key", "dataset", "ref_share", log_ratio(F.col("share"), F.col("ref_share")).alias("log_ratio")
    )


def log_ratio_range(cells: DataFrame, reference: str | None, trim_ends: bool = False) -> DataFrame:
    """Smallest and largest log ratio; ``trim_ends`` ignores the reference's top and bottom key."""
    if trim_ends:
        by_share = F.struct("ref_count", "key")
        ends = cells.agg(F.max(by_share).alias("top"), F.min(by_share).alias("bottom"))
        ends = ends.select(F.explode(F.array("top.key", "bottom.key")).alias("key"))
        # Two rows.
        cells = cells.join(F.broadcast(ends), "key", "left_anti")
    return log_ratios(shares(cells), reference).agg(F.min("log_ratio").alias("y_min"), F.max("log_ratio").alias("y_max"))


def divergence_table(cells: DataFrame, reference: str | None) -> DataFrame:
    """Mean and summed distance of shares and of log ratios to the reference, per corpus.

    A key that a corpus lacks is as far from the reference as its share there; together that is the part of the
    reference's kept keys that no cell of the corpus covers.
    """
    gap = F.abs(_share() - _reference_share())
    ratio: Column = log_ratio(_share(), _reference_share())
    kept = cells.groupBy("key").agg(F.max("ref_count").alias("r")).agg(F.sum("r")).scalar()
    summed = F.sum(gap) + (F.first("_kept") - F.sum("ref_count")) / F.first("ref_total")
    return (
        _others(cells, reference).withColumn("_kept", kept).groupBy("dataset")
        .agg(
            (summed / F.max("n_keys")).alias("diff_mean"), summed.alias("diff_sum"),
            F.avg(F.abs(ratio)).alias("log_diff_mean"), F.sum(F.abs(ratio)).alias("log_diff_sum"),
            (1 - F.count(ratio) / F.max("n_keys")).alias("missing_share"),
        )
        .orderBy("diff_sum", "dataset")
    )


def presence_matrix(wide: DataFrame, datasets: list[str | None], reference: str | None) -> DataFrame:
    """1 where a corpus has the key, for keys that not all corpora have; rarest keys first.

    ``wide`` holds the key, then the corpora in the order of ``datasets``.
    """
    others = [i for i, d in enumerate(datasets) if d != reference]
    placed = by_place(wide)
    flags = placed.select("_0", *((F.coalesce(F.col(f"_{i + 1}"), F.lit(0)) > 0).cast("int").alias(f"_{i + 1}") for i in others))
    total = sum((F.col(f"_{i + 1}") for i in others), F.lit(0))
    found = flags.withColumn("_total", total).filter(F.col("_total") < len(others)).orderBy("_total", "_0")
    return titled(found, ["key", *(datasets[i] for i in others), "total"])


def absent_reference_mass(cells: DataFrame, reference: str | None) -> DataFrame:
    """Percentage of the reference's tokens whose key a corpus lacks."""
    lost = (F.max("ref_total") - F.sum("ref_count")) / F.max("ref_total")
    return _others(cells, reference).groupBy("dataset").agg((lost * 100).alias("pct"))
