"""Exact quantiles and summaries per group, for groups of any size.

The built-in exact percentile holds a map of all distinct values of a group in one task. Here the values are first reduced to
(group, value, weight), which is stored; it is all that quantiles and moments are taken from, so the input is read once. A
quantile's neighbours in rank are then found by division: values are counted in coarse buckets that keep their order, a bucket with
a wanted rank is an interval that is cut into equal pieces, only the pieces that hold a wanted rank are kept, and so on until those are small enough to be
sorted. Steps meet at a group and a bucket, never at a group alone.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.functions.numeric import INF
from glyphstat.sources.scratch import materialize

# Pieces of an interval, and values in an interval that one task sorts.
PIECES = 512
SORTED_VALUES = 10_000


_INFINITE = 1_000_000


def _coarse(value: Column) -> Column:
    """A bucket that never decreases with the value: 1/256 of an octave."""
    size = F.when(F.abs(value) == INF, F.lit(_INFINITE)).otherwise(
        F.floor(F.log2(F.abs(value)) * 256).cast("int") + _INFINITE // 2
    )
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)


def reduced(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(_g, v, w, bucket): the distinct values of each group with their weights, stored; ``_g`` holds the group, nulls included."""
    key = F.struct(*(F.col(c) for c in group)).alias("_g")
    values = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v"))
    return materialize(values.agg(F.count(F.lit(1)).alias("w")).withColumn("bucket", _coarse(F.col("v"))), "values")


def _wanted(qs: list[float]) -> Column:
    """Quantiles with the ranks on both sides of their position among ``n`` values."""
    sides = []
    for q in qs:
        position = (F.col("n") - 1) * float(q)
        sides += [
            F.struct(F.lit(float(q)).alias("q"), position.alias("pos"), side(position).alias("rank")) for side in (F.floor, F.ceil)
        ]
    return F.array(*sides)


def _held(wanted: str | Column, before: Column, upto: Column) -> Column:
    return F.filter(wanted, lambda t: (t["rank"] >= before) & (t["rank"] < upto))


def _piece(value: Column) -> Column:
    """The piece of the interval [low, high] that a value is in. Intervals are within an octave, so their ends are finite if they differ."""
    width = F.col("high") - F.col("low")
    place = F.floor(F.when(width > 0, (value - F.col("low")) / width).otherwise(F.lit(0.0)) * PIECES)
    return F.least(F.greatest(place, F.lit(0)), F.lit(PIECES - 1)).cast("int")


def wanted_values(values: DataFrame, qs: list[float], sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(_g, q, pos, v) for ``reduced`` values: each quantile's position and the values in rank on both sides of it.

    One round divides all intervals that are still too large, whatever the number of groups; a piece of a
    piece is narrower by the factor ``PIECES``, so there are few rounds.
    """
    sizes = values.groupBy("_g", "bucket").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    upto = F.sum("w").over(Window.partitionBy("_g").orderBy("bucket"))
    counted = sizes.withColumns({"upto": upto, "n": F.sum("w").over(Window.partitionBy("_g"))})
    open_ = counted.select(
        "_g", "bucket", (F.col("upto") - F.col("w")).alias("before"), "size", "low", "high",
        _held(_wanted(qs), F.col("upto") - F.col("w"), F.col("upto")).alias("wanted"),
    ).filter(F.size("wanted") > 0)
    inside = values.select(F.col("_g").alias("_h"), F.col("bucket").alias("_b"), "v", "w")
    at = (F.col("_g") == F.col("_h")) & (F.col("bucket") == F.col("_b")) & F.col("v").between(F.col("low"), F.col("high"))
    done = []
    while True:
        small = (F.col("size") <= sorted_values) | (F.col("low") == F.col("high"))
        open_ = materialize(open_, "intervals")
        done.append(open_.filter(small))
        open_ = open_.filter(~small)
        if open_.isEmpty():
            break
        keys = ["_g", "bucket", "low", "high"]
        pieces = inside.join(open_.select(*keys), at).groupBy(*keys, _piece(F.col("v")).alias("piece")).agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("size"), F.min("v").alias("new_low"), F.max("v").alias("new_high")
        )
        # At most PIECES rows of one interval.
        upto = F.sum("w").over(Window.partitionBy(*keys).orderBy("piece"))
        counted = pieces.withColumn("upto", upto).join(open_.select(*keys, F.col("before").alias("base"), F.col("wanted").alias("all")), keys)
        first = F.col("base") + F.col("upto") - F.col("w")
        open_ = counted.select(
            "_g", "bucket", first.alias("before"), "size", F.col("new_low").alias("low"), F.col("new_high").alias("high"),
            _held("all", first, F.col("base") + F.col("upto")).alias("wanted"),
        ).filter(F.size("wanted") > 0)
    intervals = done[0]
    for more in done[1:]:
        intervals = intervals.unionByName(more)
    order = Window.partitionBy("_g", "bucket", "low", "high").orderBy("v")
    placed = inside.join(intervals, at).withColumn("last", F.col("before") + F.sum("w").over(order))
    hits = placed.select("_g", "v", F.explode(_held("wanted", F.col("last") - F.col("w"), F.col("last"))).alias("t"))
    return hits.select("_g", "t.q", "t.pos", "v")


def _between(found: DataFrame) -> DataFrame:
    """(_g, q, value): linear interpolation between the two neighbouring ranks."""
    low, high, part = F.min("v"), F.max("v"), F.max(F.col("pos") - F.floor("pos"))
    between = F.when(low == high, low).otherwise(low + (high - low) * part)
    return found.groupBy("_g", "q").agg(between.alias("value"))


def quantiles_of(values: DataFrame, qs: list[float], sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(_g, q, value) for ``reduced`` values."""
    return _between(wanted_values(values, qs, sorted_values))


def quantiles(df: DataFrame, group: list[str], value: str, qs: list[float], sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(group…, q, value): linear interpolation between the two neighbouring ranks."""
    found = quantiles_of(reduced(df, group, value), qs, sorted_values)
    return found.select(*(F.col(f"_g.{c}").alias(c) for c in group), "q", F.col("value").alias(value))


def named_quantiles(values: DataFrame, names: dict[float, str], sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(_g, one column per quantile) for ``reduced`` values."""
    found = quantiles_of(values, list(names), sorted_values)
    return found.groupBy("_g").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in names.items()))


def describe(df: DataFrame, group: list[str], value: str, sorted_values: int = SORTED_VALUES) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of the non-null values per group."""
    kind = df.schema[value].dataType
    values = reduced(df, group, value)
    x, w = F.col("v"), F.col("w")
    basics = values.groupBy("_g").agg(
        F.sum(w).alias("count"), (F.sum(x * w) / F.sum(w)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    basics = materialize(basics, "basics")
    # Squares of the distance to the mean, so that large means cost no digits. One row per group.
    spread = values.join(basics.select("_g", "mean", "count"), "_g").groupBy("_g", "count").agg(
        F.sum(F.pow(x - F.col("mean"), F.lit(2.0)) * w).alias("squares")
    )
    spread = spread.select("_g", F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))).alias("std"))
    quartiles = named_quantiles(values, {0.25: "q25", 0.5: "q50", 0.75: "q75"}, sorted_values)
    # Groups without any value keep a row.
    groups = df.select(F.struct(*(F.col(c) for c in group)).alias("_g")).distinct()
    joined = groups.join(basics, "_g", "left").join(spread, "_g", "left").join(quartiles, "_g", "left")
    return joined.select(
        *(F.col(f"_g.{c}").alias(c) for c in group), F.coalesce("count", F.lit(0)).alias("count"), "mean", "std",
        F.col("min").cast(kind).alias("min"), F.col("max").cast(kind).alias("max"), "q25", "q50", "q75",
    )
