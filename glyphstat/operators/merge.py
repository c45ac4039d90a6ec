"""Corpora side by side: long form to one column per corpus and back.

A corpus may have any name, ``key``, one with dots and null included. Its name is data in long form; in wide form it is the
title of a column, and columns are told apart by their place, never by their title.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def datasets_of(df: DataFrame) -> list[str | None]:
    """The corpora present, sorted, a missing name last."""
    names = [row[0] for row in df.select("dataset").distinct().collect()]
    return sorted(names, key=lambda name: (name is None, name or ""))


def keys_of(hist: DataFrame) -> DataFrame:
    return hist.select("key").distinct().orderBy("key")


def is_dataset(name: str | None) -> Column:
    return F.col("dataset").eqNullSafe(F.lit(name))


def by_place(df: DataFrame) -> DataFrame:
    """Columns named ``_0``, ``_1`` and so on, whatever their titles."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def titled(df: DataFrame, titles: list[str | None]) -> DataFrame:
    return df.toDF(*(str(title) if title is not None else "null" for title in titles))


def merge_outer(
    hist: DataFrame, datasets: list[str | None], value: str = "count", on: list[str] | None = None,
    min_count: int = 0, fill: bool = True,
) -> DataFrame:
    """Full outer join of all corpora on the key: one aggregation instead of a chain of joins.

    ``min_count`` keeps only values above it, per corpus and before the join.
    """
    if min_count:
        hist = hist.filter(F.col(value) > min_count)
    on = on or ["key"]
    sums = [F.sum(F.when(is_dataset(d), F.col(value))) for d in datasets]
    columns = [(F.coalesce(s, F.lit(0)) if fill else s).alias(f"_d{i}") for i, s in enumerate(sums)]
    return titled(hist.groupBy(*on).agg(*columns), [*on, *datasets])


def melt(wide: DataFrame, datasets: list[str | None], ids: list[str], value: str = "count") -> DataFrame:
    """Rows ``(ids, dataset, value)`` of a wide table; the ids are the first columns of their titles."""
    titles = list(wide.columns)
    at_ids = [titles.index(name) for name in ids]
    left = [i for i in range(len(titles)) if i not in at_ids]
    cells = []
    for d in datasets:
        at = next(i for i in left if titles[i] == ("null" if d is None else d))
        left.remove(at)
        cells.append(F.struct(F.lit(d).alias("dataset"), F.col(f"_{at}").alias(value)))
    placed = by_place(wide)
    return placed.select(*(F.col(f"_{i}").alias(name) for i, name in zip(at_ids, ids)), F.inline(F.array(*cells)))


def arrange(wide: DataFrame, first: list[str]) -> DataFrame:
    """The named columns first, the others in alphabetical order."""
    titles = list(wide.columns)
    front = [titles.index(name) for name in first]
    rest = sorted((i for i in range(len(titles)) if i not in front), key=lambda i: titles[i])
    order = [*front, *rest]
    return titled(by_place(wide).select(*(f"_{i}" for i in order)), [titles[i] for i in order])


def row_totals(long: DataFrame, value: str) -> DataFrame:
    """Sum and mean of each key's values over the corpora."""
    return long.groupBy("key").agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))


def outer_join_pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two tables on one key column where a null key matches a null key."""
    other = right.withColumnRenamed(key, "_key")
    joined = left.join(other, left[key].eqNullSafe(other["_key"]), "full_outer")
    return joined.withColumn(key, F.coalesce(key, "_key")).drop("_key")


def missing_keys(hist: DataFrame, dataset: str | None, others: list[str | None]) -> DataFrame:
    """(dataset, key): the keys of one corpus that each of the others lacks."""

    def name(value: Column) -> Column:
        return F.struct(value.alias("dataset"))

    holders = hist.groupBy("key").agg(F.collect_set(name(F.col("dataset"))).alias("holders"))
    lacking = F.array_except(F.array(*(name(F.lit(d).cast("string")) for d in others)), F.col("holders"))
    return holders.filter(F.array_contains("holders", name(F.lit(dataset).cast("string")))).select(F.inline(lacking), "key")


def column_order(wide: DataFrame, datasets: list[str | None], ids: int = 1) -> list[str | None]:
    """Corpora by descending column total; one row of sums reaches the driver. They stand after ``ids`` columns."""
    placed = by_place(wide)
    totals = placed.agg(*(F.sum(f"_{ids + i}") for i in range(len(datasets)))).first()
    order = sorted(range(len(datasets)), key=lambda i: (-(totals[i] or 0), datasets[i] is None, datasets[i] or ""))
    return [datasets[i] for i in order]


def pivot_buckets(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Buckets of every corpus as rows and keys as columns: the given ones, or all keys of a vocabulary that fits in columns."""
    if keys is None:
        keys = [row[0] for row in keys_of(hist).collect()]
    sums = [F.coalesce(F.sum(F.when(F.col("key").eqNullSafe(F.lit(key)), F.col("n_files"))), F.lit(0)).alias(f"_k{i}") for i, key in enumerate(keys)]
    chosen = hist.filter(F.col("key").isin(keys))
    return titled(chosen.groupBy("dataset", "num").agg(*sums), ["dataset", "num", *keys])
