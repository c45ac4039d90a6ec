"""Tokenize documents as they arrive.

The stream's checkpoint remembers which input files are done, so each run takes only new ones and a
run that dies half-way is repeated without duplicates.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glyphstat.functions.lexing import Profile
from glyphstat.operators.tokenize import tokenize


def arriving_documents(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """A stream over a folder of Parquet files with columns (dataset, path, text)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def tokenize_available(docs: DataFrame, profile: Profile, out: str, checkpoint: str) -> StreamingQuery:
    """Append the tokens of everything that has arrived, then stop."""
    return (
        tokenize(docs, profile).writeStream.format("parquet").partitionBy("dataset")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
