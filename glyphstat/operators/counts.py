"""Occurrences, counts per file and histograms over files.

A file is its path within a corpus; base names repeat. The relations build on each other: occurrences
``(dataset, path, key)`` are counted per file ``(dataset, path, key, n)`` or per corpus ``(dataset, key, count)``, and counts per file are
counted again into the number of files per count ``(dataset, key, num, n_files)``. Every step is a
hash aggregation with a map-side part, so a key or file that dominates the data costs one partial
row per task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.functions.lexing import Profile
from glyphstat.functions.numeric import scaled
from glyphstat.functions.text import base_name, bigram_key, fill_unknown
from glyphstat.operators.tokenize import (
    document_pairs,
    document_tokens,
    found_tokens,
    listed_tokens,
    n_tokens,
    shown,
    with_eof,
)
from glyphstat.schemas import KINDS

FILE = ["dataset", "path"]

# Rows of one file that share a task when neighbours are paired.
BLOCK_TOKENS = 100_000


def exclude_files(df: DataFrame, dataset: str, prefix: str) -> DataFrame:
    """Drop one corpus' files whose name starts with ``prefix``."""
    return df.filter(~((F.col("dataset") == dataset) & base_name(F.col("path")).startswith(prefix)))


def _filled(tokens: DataFrame, pandas_na: bool) -> DataFrame:
    return tokens.withColumns(
        {name: fill_unknown(F.col(name), pandas_na) for name in ("token_text", "token_type")}
    )


def number_rows(df: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Add ``token_num``, the 0-based position of each row within its file.

    ``bucket`` is an expression that never decreases along ``order``. Rows are ranked inside their
    bucket and shifted by the size of the earlier buckets, so a file's rows are spread over as many
    tasks as it has buckets.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*FILE, "_bucket"]
    in_order = Window.partitionBy(*FILE).orderBy("_bucket")
    offsets = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        .select("_before", *[F.col(k).alias(f"_of_{k}") for k in keys])
    )
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    # Rows without a bucket come first and have to find their offset too.
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return ranked.join(offsets, same).withColumn(
        "token_num", F.col("_before") + F.col("_rank") - 1
    ).drop("_rank", "_before", "_bucket", *[f"_of_{k}" for k in keys])


def with_next(tokens: DataFrame, block: int = BLOCK_TOKENS, all_pairs: bool = False) -> DataFrame:
    """Add the following token's text and type to each token, null where no pair starts.

    ``token_num`` counts 0, 1, 2, … within a file. A file is cut into blocks of that many tokens and
    each block also gets the first two tokens of the next one, which makes the window exact without
    holding a whole file in one task.

    By default a pair needs a third token after it, so the pair that ends in the last token is not
    formed.
    """
    mine = F.floor(F.col("token_num") / block)
    edge = (F.col("token_num") % block < 2) & (mine > 0)
    spread = tokens.withColumn(
        "_block", F.explode(F.when(edge, F.array(mine, mine - 1)).otherwise(F.array(mine)))
    )
    w = Window.partitionBy(*FILE, "_block").orderBy("token_num")
    paired = F.lead(F.lit(True), 1 if all_pairs else 2).over(w)
    return (
        spread.withColumns(
            {
                "_paired": paired,
                "next_text": F.lead("token_text").over(w),
                "next_type": F.lead("token_type").over(w),
            }
        )
        .filter(F.floor(F.col("token_num") / block) == F.col("_block"))
        .withColumns({c: F.when(F.col("_paired"), F.col(c)) for c in ("next_text", "next_type")})
        .drop("_block", "_paired")
    )


def token_keys(
    tokens: DataFrame, kind: str, pandas_na: bool = True, block: int = BLOCK_TOKENS, all_pairs: bool = False
) -> DataFrame:
    """(dataset, path, key): one row per occurrence of a text, type or pair of them."""
    tokens = _filled(tokens, pandas_na)
    if kind.startswith("token_"):
        return tokens.select(*FILE, F.col(kind).alias("key"))
    column = kind.removeprefix("bigram_")
    pairs = with_next(tokens, block, all_pairs).filter(F.col(f"next_{column}").isNotNull())
    return pairs.select(*FILE, bigram_key(F.col(f"token_{column}"), F.col(f"next_{column}")).alias("key"))


def document_keys(docs: DataFrame, profile: Profile, kind: str, pandas_na: bool = True) -> DataFrame:
    """``token_keys`` straight from documents, without building the token table or a shuffle.

    Rows also carry their document's length as ``num_tokens``.
    """
    if kind.startswith("token_"):
        tokens = document_tokens(docs, profile)
        return tokens.select(*FILE, "num_tokens", fill_unknown(F.col(kind), pandas_na).alias("key"))
    column = kind.removeprefix("bigram_")
    left, right = (
        fill_unknown(F.col(f"{side}_{column}"), pandas_na) for side in ("left", "right")
    )
    return document_pairs(docs, profile).select(*FILE, "num_tokens", bigram_key(left, right).alias("key"))


def listed_keys(docs: DataFrame, profile: Profile, kind: str, pandas_na: bool = True) -> DataFrame:
    """(dataset, path, num_tokens, keys): the occurrences of ``document_keys`` as one array per document."""
    listed = listed_tokens(docs, profile)
    column = kind.removeprefix("token_").removeprefix("bigram_")

    def value(raw: Column) -> Column:
        return shown(raw, profile) if column == "text" else profile.classify(raw)

    # Two steps: the second names its value several times, and would find a type anew each time.
    keys = F.transform(F.transform(with_eof(), value), lambda made: fill_unknown(made, pandas_na))
    if kind.startswith("bigram_"):
        n = F.greatest(F.size("found") - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice("values", F.lit(1), n).alias("l"), F.slice("values", F.lit(2), n).alias("r"))
        listed = listed.withColumn("values", keys)
        keys = F.transform(pairs, lambda p: bigram_key(p["l"], p["r"]))
    return listed.select(*FILE, "num_tokens", keys.alias("keys"))


def file_key_counts(keys: DataFrame, with_length: bool = False) -> DataFrame:
    """(dataset, path, key, n), with ``num_tokens`` where the occurrences carry it."""
    length = ["num_tokens"] if with_length else []
    return keys.groupBy(*FILE, *length, "key").agg(F.count(F.lit(1)).alias("n"))


def file_counts(tokens: DataFrame, pandas_na: bool = True, block: int = BLOCK_TOKENS) -> DataFrame:
    """All four kinds of counts of every file in one pass: (dataset, path, kind, key, n)."""
    wide = with_next(_filled(tokens, pandas_na), block)
    keys = {
        "token_text": F.col("token_text"),
        "token_type": F.col("token_type"),
        "bigram_text": F.when(
            F.col("next_text").isNotNull(), bigram_key(F.col("token_text"), F.col("next_text"))
        ),
        "bigram_type": F.when(
            F.col("next_type").isNotNull(), bigram_key(F.col("token_type"), F.col("next_type"))
        ),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in KINDS]))
    rows = wide.select(*FILE, each.alias("k")).select(*FILE, "k.kind", "k.key")
    return (
        rows.filter(F.col("key").isNotNull())
        .groupBy(*FILE, "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    )


def document_file_counts(
    docs: DataFrame, profile: Profile, kind: str, pandas_na: bool = True
) -> DataFrame:
    """(dataset, path, num_tokens, key, n) straight from documents, one document per file.

    A document's keys are counted inside its row: they are sorted, and the distances between the
    places where the sorted key changes are the counts. Nothing is moved.
    """
    sorted_ = listed_keys(docs, profile, kind, pandas_na).withColumn("keys", F.sort_array("keys"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("keys")),
        lambda i: (i == 1) | (F.element_at("keys", i) != F.element_at("keys", F.greatest(i - 1, F.lit(1)))),
    )
    placed = sorted_.filter(F.size("keys") > 0).withColumn("starts", starts)
    counted = F.transform(
        "starts",
        lambda p, j: F.struct(
            F.element_at("keys", p).alias("key"),
            (F.coalesce(F.get("starts", j + 1), F.size("keys") + 1) - p).cast("bigint").alias("n"),
        ),
    )
    return placed.select(*FILE, "num_tokens", F.inline(counted))


def corpus_histogram(keys: DataFrame) -> DataFrame:
    return keys.groupBy("dataset", "key").agg(F.count(F.lit(1)).alias("count"))


def histogram_of_counts(counts: DataFrame) -> DataFrame:
    """The corpus histogram from counts per file."""
    return counts.groupBy("dataset", "key").agg(F.sum("n").alias("count"))


def file_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(*FILE).agg(F.count(F.lit(1)).alias("num_tokens"))


def document_lengths(docs: DataFrame, profile: Profile) -> DataFrame:
    """Tokens per document, one document per file: no row is exploded or moved."""
    size = n_tokens(found_tokens(F.col("text"), profile))
    return docs.filter(F.col("text").isNotNull()).select(*FILE, size.alias("num_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("dataset", F.col("num_tokens").alias("tokens_count")).agg(
        F.count(F.lit(1)).alias("file_count")
    )


def count_histogram(counts: DataFrame) -> DataFrame:
    """Number of files in which a key occurs exactly ``num`` times."""
    return counts.groupBy("dataset", "key", F.col("n").alias("num")).agg(
        F.count(F.lit(1)).alias("n_files")
    )


def ratio_histogram(counts: DataFrame, lengths: DataFrame | None = None, decimals: int = 4) -> DataFrame:
    """Number of files per share of a key in its file; ``num`` is in units of 10^-decimals.

    ``lengths`` is needed for counts without ``num_tokens``.
    """
    if lengths is not None:
        counts = counts.join(lengths, FILE)
    bucket = scaled(F.col("n") / F.col("num_tokens"), decimals)
    return counts.groupBy("dataset", "key", bucket.alias("num")).agg(F.count(F.lit(1)).alias("n_files"))
