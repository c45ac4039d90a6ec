"""Re-runs that only process what is new."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.functions.text import path_stem
from glyphstat.operators.counts import FILE
from glyphstat.schemas import MANIFEST, REJECTS, TOKENS
from glyphstat.sources import tokens as token_files
from glyphstat.sources import tree


def manifest(paths: DataFrame, source_root: str, target_root: str, extension: str) -> DataFrame:
    """(src_file, dst_file): each source path and its place in the mirrored target tree."""
    relative = F.regexp_replace(
        F.col("path"), F.lit(rf"^(?:file:)?/*\Q{source_root.strip('/')}\E/"), F.lit("")
    )
    name = F.element_at(F.split(relative, "/"), -1)
    folder = F.substr(relative, F.lit(1), F.length(relative) - F.length(name))
    target = F.concat(F.lit(target_root.rstrip("/") + "/"), folder, path_stem(name), F.lit(extension))
    return paths.select(F.col("path").alias("src_file"), target.alias("dst_file"))


def pending(files: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Manifest rows whose target is not in ``done(dst_file)`` nor source in ``failed(path)``."""
    return files.join(done, "dst_file", "left_anti").join(
        failed.select(F.col("path").alias("src_file")), "src_file", "left_anti"
    ).select("src_file", "dst_file")


def finished(spark: SparkSession, target_root: str, pattern: str) -> DataFrame:
    """(dst_file): the targets that exist below ``target_root``, so a re-run needs no list of its own."""
    return tree.listing(spark, target_root, pattern).select(F.col("path").alias("dst_file"))


def save_manifest(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def append_rejects(rejects: DataFrame, path: str) -> None:
    rejects.select("path", "reason").write.mode("append").parquet(path)


def load_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REJECTS).parquet(path)


class Runs:
    """Outputs of several runs in one place, of which only committed ones count.

    A run writes what it has made, what it rejects and which sources are done under a name of its own. Only then one row with that
    name is appended to the list of commits, in a single file that Spark moves into place. A run that stops before leaves
    files that no reader takes, and its sources stay pending.
    """

    OUTPUTS, REJECTED, DONE = "outputs", "rejects", "done"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, run: str, outputs: DataFrame, rejects: DataFrame, done: DataFrame) -> None:
        """Write a run's tables: outputs, ``rejects(path, reason)`` and ``done(dst_file)``. Nothing counts yet."""
        for name, table in ((self.OUTPUTS, outputs), (self.REJECTED, rejects.select("path", "reason")), (self.DONE, done.select("dst_file"))):
            table.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def commit(self, run: str) -> None:
        """Make a run count. A run that is committed twice counts once."""
        row = self.spark.createDataFrame([(run,)], "run string").coalesce(1)
        row.write.mode("append").parquet(f"{self.root}/commits")

    def committed(self) -> DataFrame:
        """(run): the runs that count."""
        return _read_or_empty(self.spark, f"{self.root}/commits", "run string").distinct()

    def table(self, name: str, schema) -> DataFrame:
        """One of the tables with the name of the ``run``, of committed runs only; one row per run is broadcast."""
        plain = self.spark.createDataFrame([], schema).schema
        whole = _read_or_empty(self.spark, f"{self.root}/{name}", plain.add("run", "string"))
        return whole.join(F.broadcast(self.committed()), "run", "left_semi")

    def pending(self, files: DataFrame) -> DataFrame:
        """The rows of a manifest that no committed run has done or rejected."""
        return pending(files, self.table(self.DONE, "dst_file string").distinct(), self.table(self.REJECTED, REJECTS))


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_files_only(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (documents or tokens) of files the existing token table does not have yet.

    Each file has exactly one first token, so first tokens identify files without a distinct.
    """
    return rows.join(existing.filter(F.col("token_num") == 0).select(*FILE), FILE, "left_anti")


def append_tokens(spark: SparkSession, rows: DataFrame, path: str, lexer: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append the files that are not in the table yet; running it again changes nothing.

    ``rows`` are tokens, or documents with the ``lexer`` that makes tokens of them. Then one row a file is joined, not
    one a token, only new files are lexed and no token is stored or moved before it is written.
    """
    new = new_files_only(rows, _read_or_empty(spark, path, TOKENS))
    token_files.write(lexer(new) if lexer else new, path, mode="append")
