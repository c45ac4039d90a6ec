"""Spelling variants: words one edit apart, and the more frequent form that each belongs to.

Two words are near if one inserted, deleted or replaced code point leads from one to the other. They
are found with asymmetric chunks. The shorter word x (of equally long ones the lesser) has L code
points and gives two disjoint chunks, its first and its last ``L // 2`` code points; a single edit
leaves one of them whole. The other word gives its positional grams of that length, and a chunk joins
a gram that stands at most one place off: at the same place for the first chunk, and counted from the
end for the last, as an edit before it shifts it by the difference of the lengths. Grams farther off
can join nothing and are not made. Very many words may share a half, so the join key also holds the
same argument once more: what stands beside the whole chunk is again two disjoint chunks, one of them
whole. Keys therefore hold about three quarters of a word, and no group grows with the vocabulary.
Every joined pair is verified by its edit distance.

Defined cases: null and empty texts have no words; a word's letters are those of one maximal run
after the deletion below, if any; ties between forms go to the smaller word; forms grow at least by
``FACTOR`` along a chain, so chains end; without documents there are no rows. Only ``doc_id`` and
``text`` are read, whatever other columns are called. A null ``doc_id`` is an empty string in the hash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.storage import store

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
SLIP_EVERY = 97
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, slip_every: int | None = SLIP_EVERY) -> DataFrame:
    """``word``: every run of letters of every text, with A-Z lower-cased.

    With ``slip_every`` a run whose hash h, that of its document and itself, is a multiple of it
    loses the code point at ``h % length``.
    """
    found = docs.select(F.col("doc_id").cast("string").alias("_doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"))
    found = found.select("_doc", F.translate("_run", _UPPER, _LOWER).alias("word"))
    if not slip_every:
        return found.select("word")
    h = F.crc32(F.concat(F.coalesce("_doc", F.lit("")), F.lit(":"), F.col("word")))
    at = (F.col("_h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + F.lit(2), F.length("word")))
    return found.select("word", h.alias("_h")).select(
        F.when(F.col("_h") % slip_every == 0, cut).otherwise(F.col("word")).alias("word")
    )


def frequent_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` for the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _keys(short: Column, long: Column) -> Column:
    """Join keys of a word of ``long`` code points towards words of ``short`` ones (its own length: its chunks)."""
    q = F.floor(short / 2).cast("int")
    r = F.floor((short - q) / 2).cast("int")

    def piece(start: Column, length: Column) -> Column:
        return F.substring("word", start + F.lit(1), length)

    first, last = piece(F.lit(0), q), piece(long - q, q)
    pairs = [
        (first, piece(q, r)), (first, piece(long - r, r)),
        (last, piece(F.lit(0), r)), (last, piece(long - q - r, r)),
    ]
    return F.array(*(F.concat_ws(" ", F.lit(i), short, a, b) for i, (a, b) in enumerate(pairs)))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b, a_n, b_n)``: every pair of near words once, for ``words(word, n)`` of three code points or more."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(length, length)).alias("key"))
    grams = words.select(
        F.col("word").alias("b"), F.col("n").alias("b_n"), length.alias("b_length"),
        F.explode(F.concat(_keys(length, length), _keys(length - 1, length))).alias("key"),
    )
    same_length = F.length("a") == F.col("b_length")
    joined = chunks.join(grams, "key").filter(~same_length | (F.col("a") < F.col("b")))
    return joined.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``(word, n, n_near, form, form_n)``: the most frequent near word, if ``factor`` times as frequent."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_best")
    )
    is_form = -F.col("_best.m") >= factor * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("_best.w")).alias("form"), F.when(is_form, -F.col("_best.m")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``(word, root)`` for the words of ``found(word, form)`` that have a form: the end of their chain.

    Each round lets every word skip to where its target points, so rounds grow with the logarithm of
    the longest chain, which itself grows with that of the largest count.
    """
    links = store(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = store(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = jumped.select("word", "root")
        if jumped.filter("_moved").isEmpty():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word."""
    found = store(forms(store(frequent_words(runs(docs)))))
    ends = roots(found)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
