"""A corpus from raw documents to token ids: each stage takes what the one before it kept."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.llm import bpe, line_dedup, mixing, quality_forest, superminhash
from glyphstat.llm.queries import bpe_vocabulary, table
from glyphstat.llm.storage import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the forest reject."""
    forest = quality_forest.fit_labelled(quality_forest.stats(docs), table(spark, sf_dir, "labels"))
    return quality_forest.keep_good(docs, forest)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that stand in an earlier document; drop documents that lose every word.

    ``n_chars``, where there is one, follows the text. A null text and a text that had no words from the start stay; rows
    without an id are documents that no block is taken from; equal rows keep the same lines. Other columns
    travel in the row, whatever their names.
    """
    found = line_dedup.without_common_blocks(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    stays = (F.col("n_removed") == 0) | F.col("kept_text").rlike(mixing.WORD)
    changed = F.col("n_removed") > 0

    def column(name: str) -> Column:
        if name == "text":
            return F.col("kept_text").alias("text")
        kept = F.col("row")[name]
        if name == "n_chars":
            kept = F.when(changed, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(kept)
        return kept.alias(name)

    return found.filter(stays).select(*(column(name) for name in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that with the least id.

    Rows that share an id are told apart by their texts: of equal ids the text with the least hash stays, of equal rows one.
    Null and empty texts are in no group and all stay, as do rows without an id. Other columns travel in the row, whatever
    their names.
    """
    found = superminhash.near_duplicates(docs.select("doc_id", "text"), groups=True).filter("group_id IS NOT NULL")
    places = found.groupBy("group_id", F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(F.count("*").alias("_rows"))
    first = F.min(F.struct("_id", "_fp")).alias("first")
    firsts = places.groupBy("group_id").agg(first).select("first.*")
    same = ["_id", "_fp"]
    gone = places.select(*same).distinct().join(firsts, same, "left_anti")
    repeated = places.filter("_rows > 1").select(*same).join(firsts, same, "left_semi")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_fp"), F.struct(*docs.columns).alias("row")
    )
    kept = rows.join(gone, same, "left_anti")
    # Equal rows that stay together are few: of each one stays.
    once = kept.join(repeated, same, "left_semi").groupBy(*same).agg(F.first("row").alias("row"))
    return kept.join(repeated, same, "left_anti").select("row.*").unionByName(once.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents until every source has its target of words."""
    return mixing.mixed(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    return bpe.round_trip(docs, bpe_vocabulary(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", bpe_round_trip),
]

# The forest, the aligner and the tokenizer have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each writing Parquet to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
