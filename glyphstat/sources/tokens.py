"""Token dumps and token tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.functions.text import base_name, decoded_path, token_uuid
from glyphstat.schemas import TOKENS
from glyphstat.sources import tree
from glyphstat.sources.scratch import shuffles_removed

# Fixed value: the printed form of a token.
DUMP_LINE = r"(?s)\[@(\d+),(\d+):(-?\d+)='(.*)',<(.+)>,(?:channel=(\d+),)?(\d+):(\d+)\]"

# A path with a part that Spark's file sources leave out.
_HIDDEN = r"(?:^|/)(?:\.|_(?!(?:common_)?metadata[^/]*/)[^=/]*(?:/|$))|\._COPYING_(?:/|$)"

# Groups of the pattern with the token text, group 4, last.
_ORDER = (1, 2, 3, 5, 6, 7, 8, 4)
_SEPARATOR = "\x01"

_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
# Bytes of a row group while several files are open.
_ROW_GROUP = 1 << 24
# Numbers that rise within a file are stored as differences, and ids without a dictionary, which each column is tried with first.
_RISING = ("token_num", "char_start", "char_end", "line_char")
# Rows of a CSV file: compressed files are not split, so a reader has a task per so many.
CSV_ROWS = 1_000_000


def read_dump(spark: SparkSession, path: str, dataset: str, pattern: str = "*.{tokens,tokens.gz}") -> DataFrame:
    """(path, dataset, value): the lines of all dump files below ``path``; names that begin with ``.`` or ``_`` are left out.

    A folder that Python workers reach is listed and read by tasks (links to folders below it are not followed); Spark's file source, which
    lists on the driver and plans a task for few files, reads all else.
    """
    root = tree.readable_folder(path)
    if root is None:
        read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
        lines = read.select(decoded_path(F.col("_metadata.file_path")).alias("path"), "value")
    else:
        relative = F.substring("path", len(root) + 2, 2**31 - 1)
        # The same glob as Spark's, as a regular expression.
        named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        fits = F.substring_index(relative, "/", -1).rlike(f"(?s)^(?:{named})$")
        lines = tree.lines(tree.listing(spark, root).filter(fits & ~relative.rlike(_HIDDEN)), root)
    return lines.select("path", F.lit(dataset).alias("dataset"), "value")


def unreadable_files(lines: DataFrame) -> DataFrame:
    """(path, reason) of the files with a line that is no token."""
    bad = lines.filter(~F.col("value").rlike(DUMP_LINE)).select("path").distinct()
    return bad.select("path", F.lit("unparsable").alias("reason"))


def parse_dump(lines: DataFrame, rejects: DataFrame) -> DataFrame:
    """Dump lines to tokens. One unreadable line has put its whole file into ``rejects``."""
    # One match per line; the text comes last because only it can contain the separator.
    joined = F.regexp_replace("value", f"(?s)^.*?{DUMP_LINE}.*$", _SEPARATOR.join(f"${i}" for i in _ORDER))
    fields = F.split(joined, _SEPARATOR, len(_ORDER))
    good = lines.join(rejects.select("path"), "path", "left_anti").withColumn("f", fields)

    def number(i: int) -> Column:
        return F.nullif(F.col("f")[i], F.lit("")).try_cast("int")

    num, start, end, kind, channel, row, column, text = range(len(_ORDER))
    return good.select(
        token_uuid(F.col("dataset"), F.col("path"), number(num)).alias("uuid"),
        "dataset", "path", base_name(F.col("path")).alias("file_name"), number(num).alias("token_num"), number(start).alias("char_start"),
        number(end).alias("char_end"), F.col("f")[text].alias("token_text"),
        F.translate(F.col("f")[kind], "'", "").alias("token_type"), number(channel).alias("channel"),
        number(row).alias("line"), number(column).alias("line_char"),
    )


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Token CSVs, plain or compressed, with doubled quotes. ``line_breaks`` allows them inside a cell, one task per file.

    Files that ``write_csv`` wrote from a token table have none.
    """
    return (
        spark.read.schema(TOKENS).option("header", True).option("escape", '"').option("multiLine", line_breaks)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,csv.gz}").csv(path)
    )


def write_csv(tokens: DataFrame, path: str, max_rows: int = CSV_ROWS) -> None:
    """Compressed files of at most ``max_rows`` rows."""
    # An empty text is written as "" and a missing one as nothing. Ids have no repeats to look for: the quickest level takes less than
    # half of the default's time for a twentieth more room.
    (
        tokens.write.option("header", True).option("escape", '"').option("emptyValue", '""').option("zlib.compress.level", "BEST_SPEED")
        .option("compression", "gzip").option("maxRecordsPerFile", max_rows).csv(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(path)


def write(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder per corpus. Ids are hexadecimal digits, which only a codec that counts symbols makes smaller.

    A task keeps the files of some corpora open, with small row groups, instead of sorting its tokens by corpus. Shuffle files of what
    makes the tokens go once these are written.
    """
    conf = tokens.sparkSession.conf
    before = conf.get(_OPEN_FILES)
    conf.set(_OPEN_FILES, "16")
    writer = tokens.write.mode(mode).option("parquet.block.size", _ROW_GROUP).option("parquet.writer.version", "v2")
    # Higher levels take chance repeats of ids for matches, which makes them larger.
    writer = writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1)
    for name in ("uuid", *_RISING):
        writer = writer.option(f"parquet.enable.dictionary#{name}", False)
    try:
        with shuffles_removed(tokens.sparkSession):
            writer.partitionBy("dataset").parquet(path)
    finally:
        conf.set(_OPEN_FILES, before)


def write_jdbc(tokens: DataFrame, url: str, table: str = "tokens", properties: dict | None = None) -> None:
    """Append to a relational table; pass tokens through ``new_files_only`` to skip loaded files."""
    tokens.write.jdbc(url, table, mode="append", properties=properties)
