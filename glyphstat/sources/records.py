"""Per-file records as JSON lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstat.operators.records import duplicate_ids
from glyphstat.schemas import INDEX_DOCUMENT, RECORD

# Records per JSON file.
SHARD_LINES = 100_000

_CORRUPT = "_corrupt"


def write(records: DataFrame, path: str, max_lines: int = SHARD_LINES) -> None:
    records.write.option("maxRecordsPerFile", max_lines).json(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): malformed lines are set aside instead of failing the scan."""
    schema = T.StructType([*RECORD.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    parsed = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"),
    )
    records = parsed.filter(F.col(f"r.{_CORRUPT}").isNull()).select(
        *[F.col(f"r.{f.name}") if f.name != "part" else F.coalesce("r.part", F.lit(0)).alias("part") for f in RECORD]
    )
    rejects = parsed.filter(F.col(f"r.{_CORRUPT}").isNotNull()).select(
        "path", F.col(f"r.{_CORRUPT}").alias("line")
    )
    return records, rejects


def count(records: DataFrame) -> int:
    return records.count()


def write_index(documents: DataFrame, path: str) -> None:
    """Write index documents; an id that two files claim is an error."""
    clash = duplicate_ids(documents).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate document id {clash[0]['id']}")
    documents.write.json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_DOCUMENT).json(path)
