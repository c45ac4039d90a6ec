"""The given tables as corpora of token sequences."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.functions.lexing import WORDS, Profile
from glyphstat.operators.counts import (
    FILE,
    corpus_histogram,
    count_histogram,
    document_file_counts,
    document_keys,
    document_lengths,
    length_histogram,
    number_rows,
    ratio_histogram,
)
from glyphstat.operators.merge import datasets_of

DOCS_REFERENCE = "en"
EVENTS_REFERENCE = "W0"
EVENTS_DATASETS = ["W0", "W1", "W2", "W3", "W4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# How many tasks lex a table of documents; by default as many as Spark makes of its files. A caller whose table is one
# small file sets it, as bench.py does.
input_partitions: int | None = None


def spread(docs: DataFrame) -> DataFrame:
    return docs.repartition(input_partitions) if input_partitions else docs


def document_path() -> Column:
    return F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"), F.lit("main.c"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the corpus of their language, all of one base name."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("lang").alias("dataset"), document_path().alias("path"), "text")


def paths_of(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    """(path): the documents whose id is in ``chosen``."""
    docs = table(spark, sf_dir, "documents").join(chosen.select("doc_id"), "doc_id", "left_semi")
    return docs.select(document_path().alias("path"))


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    return datasets_of(table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as files, one corpus per top-level domain."""
    domain = F.regexp_extract("url", r"^https?://[^/]*\.([a-z]+)(?:[:/]|$)", 1)
    return spread(table(spark, sf_dir, "pages")).select(
        domain.alias("dataset"), F.concat(F.col("page_id").cast("string"), F.lit("/index.html")).alias("path"),
        F.col("html").alias("text"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens: one corpus per week of the month, one file per user, ordered by time."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("W"), week).alias("dataset"), F.concat(F.col("user_id").cast("string"), F.lit("/events.log")).alias("path"),
        F.col("event_type").alias("token_text"), F.col("event_type").alias("token_type"),
        "ts", "event_id",
    )
    # Minutes since the epoch, without a time zone in between.
    day = F.unix_date(F.to_date("ts"))
    minute = (day * 24 + F.hour("ts")) * 60 + F.minute("ts")
    return number_rows(rows, ["ts", "event_id"], minute).select(
        *FILE, "token_num", "token_text", "token_type"
    )


def histogram(spark: SparkSession, sf_dir: str, kind: str, profile: Profile = WORDS) -> DataFrame:
    return corpus_histogram(document_keys(documents(spark, sf_dir), profile, kind))


def counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return document_file_counts(documents(spark, sf_dir), WORDS, kind)


def counts_histogram(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return count_histogram(counts(spark, sf_dir, kind))


def ratios_histogram(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return ratio_histogram(counts(spark, sf_dir, kind))


def lengths_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(document_lengths(documents(spark, sf_dir), WORDS))
