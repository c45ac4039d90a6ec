"""Histogram tables as CSV, one file or folder per corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstat.functions.text import base_name, decoded_path, path_stem


def write(hist: DataFrame, path: str, sort: tuple[str, ...] = ("count", "key")) -> None:
    """A folder per corpus whose files are sorted, and ordered among each other, by ``sort``.

    ``sort`` ends in a unique column, as rows that tie cannot be split over files.
    """
    (
        hist.repartitionByRange("dataset", *sort).sortWithinPartitions("dataset", *sort)
        .write.partitionBy("dataset").option("header", True).option("escape", '"').csv(path)
    )


def write_merged(wide: DataFrame, path: str, key: str = "key") -> None:
    wide.orderBy(key).write.option("header", True).option("escape", '"').csv(path)


def _reader(spark: SparkSession, schema: T.StructType):
    return spark.read.schema(schema).option("header", True).option("escape", '"')


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tables written by ``write``; ``schema`` lists the columns without the corpus."""
    with_dataset = T.StructType([*schema.fields, T.StructField("dataset", T.StringType())])
    return _reader(spark, with_dataset).csv(path)


def read_named_files(spark: SparkSession, path: str, schema: T.StructType, metric: str) -> DataFrame:
    """One ``<corpus>.csv`` per corpus; ``<metric>.csv`` is the merged table and left out."""
    rows = _reader(spark, schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return rows.withColumn("dataset", path_stem(base_name(decoded_path(F.col("_metadata.file_path"))))).filter(
        F.col("dataset") != metric
    )
