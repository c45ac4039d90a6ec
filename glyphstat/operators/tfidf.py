"""Histograms of counts weighted by how many files have the key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf_histogram(hist: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(dataset, key, num, n_files) with ``num`` = round(count * ln(files with key / files)).

    The logarithm of a share is never positive, so neither are the buckets. The number of files of a
    corpus is that of its most widespread key, or ``documents`` (dataset, n_docs) when given.
    """
    files = F.sum("n_files").over(Window.partitionBy("dataset", "key"))
    counted = hist.withColumn("_files", files)
    if documents is None:
        documents = counted.groupBy("dataset").agg(F.max("_files").alias("n_docs"))
    weight = F.rint(F.col("num") * F.ln(F.col("_files") / F.col("n_docs"))).cast("bigint")
    # One row per corpus.
    return (
        counted.join(F.broadcast(documents), "dataset")
        .groupBy("dataset", "key", weight.alias("num"))
        .agg(F.sum("n_files").alias("n_files"))
    )


def document_counts(lengths: DataFrame) -> DataFrame:
    """True number of files per corpus."""
    return lengths.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_docs"))
