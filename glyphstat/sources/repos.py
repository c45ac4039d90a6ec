"""Repository lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.schemas import REPO_JSON, REPOS


def flatten(raw: DataFrame) -> DataFrame:
    """JSON objects in ``value`` to repository rows, repeated rows removed."""
    parsed = raw.select(F.from_json("value", REPO_JSON).alias("r"))
    return parsed.select(
        "r.language", "r.full_name", "r.fork", "r.size", F.col("r.stargazers_count").alias("stars")
    ).dropDuplicates()


def popular(repos: DataFrame, language: str, min_stars: int, max_stars: int = 100_000_000) -> DataFrame:
    wanted = (F.lower("language") == language.lower()) & F.col("stars").between(min_stars, max_stars)
    return repos.filter(wanted).orderBy(F.desc("stars"), "full_name")


def write(repos: DataFrame, path: str) -> None:
    repos.write.option("header", True).option("escape", '"').csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPOS).option("header", True).option("escape", '"').csv(path)
