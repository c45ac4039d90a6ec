"""Constraint checks on the token table."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstat.schemas import TOKEN_LENGTH_LIMITS, TOKENS
from glyphstat.sources.scratch import materialize


# Hashes that are kept before they are sorted.
_REPEATS = 1 << 20


class _Repeats:
    """Numbers that come more than once. Different ones are kept sorted, so one that is most of the data takes no room."""

    def __init__(self):
        self.new, self.n_new = [], 0
        self.seen, self.twice = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, numbers: np.ndarray) -> None:
        self.new.append(numbers)
        self.n_new += len(numbers)
        # As many as are kept already, so that all is sorted a few times only.
        if self.n_new > max(_REPEATS, len(self.seen)):
            self._merge()

    def _merge(self) -> None:
        met = np.concatenate([self.seen, *self.new])
        self.new, self.n_new = [], 0
        met.sort()
        again = met[1:] == met[:-1]
        self.twice = np.union1d(self.twice, met[1:][again])
        self.seen = met[np.concatenate([np.ones(min(1, len(met)), bool), ~again])]

    def found(self) -> np.ndarray:
        self._merge()
        return self.twice


def constraint_report(tokens: DataFrame) -> DataFrame:
    """(rule, column_name, violations): missing values, too long values, repeated ids.

    The tokens are made once: 64 bits of every id and a bit for every rule it breaks are exchanged, and where they meet both the violations
    and the bits that recur are found. Only ids whose bits recur are then compared whole.
    """
    rules = [("not_null", f.name, F.col(f.name).isNull()) for f in TOKENS if not f.nullable]
    rules += [("max_length", name, F.length(name) > limit) for name, limit in TOKEN_LENGTH_LIMITS.items()]
    counted = [f"r{i}" for i in range(len(rules))]
    no_id = [(rule, name) for rule, name, _ in rules].index(("not_null", "uuid"))
    bits = [F.when(broken, F.lit(1 << i).cast("bigint")).otherwise(0) for i, (_, _, broken) in enumerate(rules)]
    ids = tokens.filter(F.col("uuid").isNotNull()).select("uuid", F.xxhash64("uuid").alias("h"))
    # Rows without an id are dealt out by their place.
    dealt = F.when(F.col("uuid").isNull(), F.xxhash64("path", "token_num")).otherwise(F.xxhash64("uuid"))
    exchanged = tokens.select(dealt.alias("h"), reduce(Column.bitwiseOR, bits).alias("broken")).repartition("h")
    schema = pa.schema([(name, pa.int64()) for name in ("h", *counted)])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every hash that recurs, and one without a hash that has the violations."""
        sums, repeats = np.zeros(len(counted), np.int64), _Repeats()
        for batch in batches:
            h, broken = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            repeats.add(h[broken >> no_id & 1 == 0])
            broken = broken[broken != 0]
            sums += [int((broken >> i & 1).sum()) for i in range(len(counted))]
        found = repeats.found()
        for at in range(0, len(found), _REPEATS):
            some = pa.array(found[at : at + _REPEATS])
            yield pa.RecordBatch.from_arrays([some, *[pa.nulls(len(some), pa.int64())] * len(counted)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([int(n)], pa.int64()) for n in sums)], schema=schema)

    found = materialize(exchanged.mapInArrow(met, ", ".join(f"{name} long" for name in ("h", *counted))), "recurring-ids")
    recurring = found.filter("h IS NOT NULL").select("h")
    sums = found.filter("h IS NULL").agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counted))
    if recurring.isEmpty():
        sums = sums.withColumn("repeats", F.lit(0).cast("bigint"))
    else:
        whole = ids.join(recurring, "h", "left_semi").groupBy("uuid").agg((F.count(F.lit(1)) - 1).alias("more"))
        sums = sums.crossJoin(whole.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeats")))
    reported = [(rule, name, column) for (rule, name, _), column in zip(rules, counted)] + [("unique", "uuid", "repeats")]
    cells = [
        F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column_name"), F.col(column).alias("violations")) for rule, name, column in reported
    ]
    return sums.select(F.inline(F.array(*cells)))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and distinct values per column: (column_name, n_rows, n_distinct)."""
    per_column = [
        df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("v").alias("n_distinct"))
        .select(F.lit(c).alias("column_name"), "n_rows", "n_distinct")
        for c in columns
    ]
    result = per_column[0]
    for more in per_column[1:]:
        result = result.unionByName(more)
    return result


def survivors(hist: DataFrame, min_count: int) -> DataFrame:
    """Per corpus the keys before and after the minimum-count filter."""
    return hist.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("count") > min_count).alias("n_kept")
    )
