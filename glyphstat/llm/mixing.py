"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share a number of words by weight, none getting more than ``MAX_REPEAT`` times its own. The
words are handed out in blocks of equal size: first to sources, then, within a source, to its
shards, always to the highest quotient words / (2 * blocks + 1). A shard's documents stand in an
order that depends on the seed only; a quota of q whole passes and r blocks takes every word q times
and the words of the first r blocks once more, so at most one document of a shard is cut.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of
its own and comes last; rows with equal ids are separate documents of equal rank, ordered by size; a
null id has a rank like any other; without words every target is 0; clashing column names are safe,
as only ``doc_id``, ``source`` and ``text`` are read by name and other columns pass through.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_REPEAT = 2
SEED = 17

# Words in a block, and words and documents that a shard holds on average.
BLOCK = 32
SHARD = 1 << 21

# The parts of a row that this module adds; a prefix keeps them apart from the table's own columns.
_SIZE, _RANK, _SHARD = "mix_size", "mix_rank", "mix_shard"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows with a source and a size.

    A source is cut off at its limit if an even share of what the sources with relatively lower
    limits leave would exceed it; in the order of limit / weight those sources come first.
    """
    sizes = sized.groupBy("source").agg(F.sum(_SIZE).alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1) % len(WEIGHTS) + 1))
        .withColumn("limit", MAX_REPEAT * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(SHARE_PERCENT) / F.lit(100.0))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        # The first source whose limit is above its share sets the level for itself and all after it.
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")), F.lit(0.0)))
        .select("source", "source_size", "n_docs", "target")
    )


def apportion(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str, name: str) -> DataFrame:
    """Add ``name``: the seats of each row, ``seats`` per group, by highest quotients vote / (2k + 1).

    With p parties all divisors between votes / (seats + p / 2) and votes / (seats - p / 2) are
    tried by their bounds: the first gives at least, the second at most the wanted seats. So only
    the quotients between the two bounds are ranked, about two per party.
    """
    whole = Window.partitionBy(*group)
    parties, total = F.count("*").over(whole), F.nullif(F.sum(vote).over(whole), F.lit(0))
    spread = F.col(vote) / total
    low = F.floor(spread * (F.col(seats) - parties / 2) + 0.5) - 1
    high = F.floor(spread * (F.col(seats) + parties / 2) + 0.5) + 1
    quotients = (
        votes.withColumn("_low", F.greatest(F.coalesce(low, F.lit(0)), F.lit(0)))
        .withColumn("_high", F.greatest(F.coalesce(high, F.lit(0)), F.lit(0)))
        .withColumn("_k", F.explode(F.sequence("_low", "_high")))
        .withColumn("_quotient", F.col(vote) / (2 * F.col("_k") + 1))
    )
    fixed = F.sum(F.when(F.col("_k") == F.col("_low"), F.col("_low"))).over(whole)
    order = whole.orderBy(F.desc("_quotient"), *(F.col(c).asc_nulls_last() for c in key))
    ranked = quotients.withColumn("_left", F.col(seats) - fixed).withColumn("_place", F.row_number().over(order))
    return ranked.groupBy(*votes.columns).agg(
        (F.first("_low") + F.count_if(F.col("_place") <= F.col("_left"))).alias(name)
    )


def plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_size``, ``source_size``, ``target``, ``whole`` (passes over all words) and ``extra``.

    ``extra`` words, from the document's first on, are taken once more.
    """
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.withColumns({_SIZE: n_words(F.col("text")), _RANK: seeded})
    targets = source_targets(sized.select("source", _SIZE))
    targets = targets.withColumn("n_shards", F.ceil((F.col("source_size") + F.col("n_docs")) / F.lit(SHARD)))
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long")
    targets = apportion(targets.withColumn("blocks", blocks), [], ["source"], "target", "blocks", "quota")
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target", "n_shards", "quota")
    place = F.conv(F.substring(_RANK, 1, 8), 16, 10).cast("long") % F.col("n_shards")
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(_SHARD, place)
    shards = (
        dealt.groupBy("of_source", _SHARD).agg(F.sum(_SIZE).alias("words"), F.first("quota").alias("quota"))
        .withColumn("n_blocks", F.ceil(F.col("words") / BLOCK))
    )
    shards = apportion(shards, ["of_source"], [_SHARD], "words", "quota", "blocks").withColumn(
        "blocks", F.least("blocks", F.col("n_blocks") * MAX_REPEAT)
    )
    in_shard = F.nullif(F.col("n_blocks"), F.lit(0))
    shards = shards.select(
        F.col("of_source").alias("s_source"), F.col(_SHARD).alias("s_shard"),
        F.coalesce(F.floor(F.col("blocks") / in_shard), F.lit(0)).alias("whole"),
        F.coalesce(F.col("blocks") % in_shard * BLOCK, F.lit(0)).alias("shard_extra"),
    )
    line = Window.partitionBy("of_source", _SHARD).orderBy(_RANK, F.col("doc_id").asc_nulls_last(), _SIZE)
    end = F.sum(_SIZE).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        dealt.withColumn("mix_end", end)
        .join(shards, F.col("of_source").eqNullSafe(F.col("s_source")) & (F.col(_SHARD) == F.col("s_shard")))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("shard_extra") - F.col("mix_end") + F.col(_SIZE), F.col(_SIZE))))
    )


def mix_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document."""
    return plan(docs.select("doc_id", "source", "text"), seed).select(
        "doc_id", F.col(_SIZE).alias("size"), "source_size", "target",
        (F.col("whole") * F.col(_SIZE) + F.col("extra")).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, one row per copy, with the columns of ``docs``.

    A copy that takes only the first words of a document has those, joined by one space, as its text
    and their number of characters as ``n_chars``.
    """
    names = docs.columns
    kept = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*names).alias("mix_row"))
    copies = F.concat(
        F.array_repeat(F.lit(False), F.col("whole").cast("int")),
        F.array_repeat(F.lit(True), (F.col("extra") > 0).cast("int")),
    )
    rows = plan(kept, seed).select("mix_row", _SIZE, "extra", F.explode(copies).alias("mix_part"))
    part = F.col("mix_part") & (F.col("extra") < F.col(_SIZE))
    words = F.regexp_extract_all(F.col("mix_row")["text"], F.lit(WORD), F.lit(0))
    text = F.when(part, F.array_join(F.slice(words, 1, F.col("extra").cast("int")), " ")).otherwise(F.col("mix_row")["text"])
    rows = rows.withColumn("mix_text", text)
    out = []
    for field in docs.schema:
        column = F.col("mix_row")[field.name]
        if field.name == "text":
            column = F.col("mix_text")
        elif field.name == "n_chars":
            column = F.when(part, F.length("mix_text").cast(field.dataType)).otherwise(column)
        out.append(column.alias(field.name))
    return rows.select(*out)
