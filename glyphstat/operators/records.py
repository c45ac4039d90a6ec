"""One nested record per file: its id, length and the four count maps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstat.functions.text import base_name
from glyphstat.operators.counts import FILE
from glyphstat.schemas import KINDS


def file_heads(tokens: DataFrame) -> DataFrame:
    """(dataset, path, id, num_tokens); the id is the first token's."""
    return tokens.groupBy(*FILE).agg(
        F.min_by("uuid", "token_num").alias("id"), F.count(F.lit(1)).alias("num_tokens")
    )


def file_records(counts: DataFrame, heads: DataFrame, n_parts: int = 1) -> DataFrame:
    """Records as maps, from counts of all kinds and the files' heads.

    Every file has ``n_parts`` records, whatever its size: they share its id and length and split
    its keys by hash, and a part without keys has empty maps.
    """
    part = F.pmod(F.xxhash64("kind", "key"), F.lit(n_parts)).cast("int")
    maps = [
        F.map_from_entries(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))
        ).alias(kind)
        for kind in KINDS
    ]
    nested = counts.withColumn("part", part).groupBy(*FILE, "part").agg(*maps)
    parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    empty = F.from_json(F.lit("{}"), "map<string, bigint>")
    return parts.join(nested, [*FILE, "part"], "left").select(
        "id", "path", base_name(F.col("path")).alias("filename"), "dataset", "num_tokens", "part",
        *[F.coalesce(kind, empty).alias(kind) for kind in KINDS],
    )


def index_documents(records: DataFrame) -> DataFrame:
    """Records with each map as a list of (key, val), sorted by key."""
    lists = [
        F.array_sort(
            F.transform(
                F.map_entries(kind), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("val"))
            )
        ).alias(kind)
        for kind in KINDS
    ]
    return records.select("id", "path", "filename", "dataset", "num_tokens", "part", *lists)


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that more than one file claims."""
    return (
        records.filter(F.col("part") == 0)
        .groupBy("id").agg(F.count(F.lit(1)).alias("files"))
        .filter(F.col("files") > 1)
    )


def record_counts(records: DataFrame, kind: str) -> DataFrame:
    """Records back to counts per file (dataset, path, key, n)."""
    return records.select(
        "dataset", "path", F.explode(kind).alias("key", "n")
    )


def record_lengths(records: DataFrame) -> DataFrame:
    return records.filter(F.col("part") == 0).select(
        "dataset", "path", "num_tokens"
    )
