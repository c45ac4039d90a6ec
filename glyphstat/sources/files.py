"""Source files as rows."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstat.functions.text import decode_latin1
from glyphstat.schemas import FILES
from glyphstat.sources import tree
from glyphstat.sources.scratch import materialize

# Rows per Parquet file of the packaged sources.
CHUNK_ROWS = 99_999


def scan(spark: SparkSession, root: str, pattern: str = "*.c*") -> DataFrame:
    """(path, modificationTime, length, content) of all matching files below ``root``, hidden and empty ones too.

    The default pattern takes every extension that begins with c, such as .cc and .css.
    """
    return tree.contents(tree.listing(spark, root, pattern), root)


def scan_visible(spark: SparkSession, root: str, pattern: str = "*.c*") -> DataFrame:
    """As ``scan`` for stores that only Spark reaches; its file sources leave out hidden files and those of zero bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(root)
    )


def only_extensions(files: DataFrame, extensions: tuple[str, ...] = ("c", "cpp")) -> DataFrame:
    return files.filter(F.col("path").rlike(rf"\.(?:{'|'.join(extensions)})$"))


def path_parts(relative: Column) -> dict[str, Column]:
    """repo = the first two folders, path = what follows, name = the last part."""
    parts = F.split(relative, "/")
    return {
        "repo": F.array_join(F.slice(parts, 1, 2), "/"),
        "path": F.array_join(F.slice(parts, 3, 2**31 - 1), "/"),
        "name": F.element_at(parts, -1),
    }


def package(files: DataFrame, root: str) -> DataFrame:
    """Scanned files as the files relation, with their text decoded."""
    relative = F.regexp_replace(
        F.col("path"), F.lit(rf"^(?:file:)?/*\Q{root.strip('/')}\E/"), F.lit("")
    )
    return files.select(
        *[column.alias(name) for name, column in path_parts(relative).items()],
        F.col("length").alias("size"),
        decode_latin1(F.col("content")).alias("contents"),
    )


def in_path_order(files: DataFrame, chunk: int = CHUNK_ROWS, path: Column | None = None) -> DataFrame:
    """Add ``position``, the place of each file in path order, and ``chunk``, the number of its chunk.

    Files are sorted in ranges of paths and numbered inside their range; ranges, a row each, are shifted by the sizes
    of those before them. So no task sorts or numbers all files.
    """
    path = F.concat_ws("/", "repo", "path") if path is None else path
    ranged = files.withColumn("_path", path).repartitionByRange("_path").sortWithinPartitions("_path", *files.columns)
    # The number tells range and place: it begins with the partition.
    placed = materialize(ranged.drop("_path").withColumn("_id", F.monotonically_increasing_id()), "ordered-files")
    placed = placed.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    # One row per partition.
    moved = placed.join(F.broadcast(before), F.col("_range") == F.col("_r"))
    position = (F.col("_before") + F.col("_place")).alias("position")
    return moved.select(*files.columns, position).withColumn("chunk", F.floor(F.col("position") / chunk))


def write_chunks(files: DataFrame, path: str, chunk: int = CHUNK_ROWS) -> None:
    """Write files in path order, a folder of one Parquet file for every chunk."""
    ordered = in_path_order(files, chunk).repartition("chunk").sortWithinPartitions("chunk", "position")
    ordered.write.partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The files with their ``position`` and ``chunk``."""
    return spark.read.parquet(path)


def write_packaged(files: DataFrame, path: str, chunk: int = CHUNK_ROWS) -> None:
    files.write.option("maxRecordsPerFile", chunk).parquet(path)


def read_packaged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)

