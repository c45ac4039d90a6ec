"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, in tiles of a block of queries and a group of vectors.
A first pass counts the scores of each query in wide bins; the counts of all tiles add up to a
global histogram, whose bin with the k-th highest score is divided again until bins are one score
wide. Then the k-th value of each query is known, and a last pass keeps the scores that reach it,
with ties broken by vector id. A tile sends only the highest bins that hold k of its scores, which
is all the k-th value can depend on, so neither equal vectors nor large groups of ties grow what is sent.

Scores are inner products of floor(scale * component). Defined cases: vectors that are null or hold
a null or non-finite component take no part, nor do rows without an id; vectors are compared with
vectors of their own length only; a vector is no candidate for the query with its id; of rows with
equal ids the least vector is the query and all are candidates; queries without candidates give no
rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstat.llm.storage import cut

QUERY_BLOCK = 4096
VECTOR_GROUP = 4096
BINS = 1024

# Scores of one tile that are in memory at a time.
TILE_SCORES = 2_000_000


def quantized(table: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, vec, dim)``: valid vectors as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        table.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite)
        .select(
            F.col("vec_id").cast("long"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
            F.size("embedding").alias("dim"),
        )
    )


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def _scored(queries: pa.Table, vectors: pa.Table):
    """Blocks of (rows of queries, scores); an own vector's score is the least integer."""
    q, v = _matrix(queries, "vec"), _matrix(vectors, "vec")
    if not len(q) or not len(v):
        return
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    v = v.T.astype(kind)
    ids, own = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    step = max(1, TILE_SCORES // len(ids))
    for start in range(0, len(q), step):
        scores = (q[start : start + step].astype(kind) @ v).astype(np.int64)
        scores[own[start : start + step, None] == ids[None, :]] = np.iinfo(np.int64).min
        yield start, scores


def _tiles(queries: DataFrame, vectors: DataFrame, n_blocks: int, n_groups: int):
    """Both sides with the tile keys: each query goes to all groups, each vector to all blocks."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(n_groups))
    all_groups, all_blocks = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (n_groups, n_blocks))
    left = queries.withColumn("block", block).withColumn("group", all_groups)
    right = vectors.withColumn("group", group).withColumn("block", all_blocks)
    key = ["dim", "block", "group"]
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def _histogram(k: int, span: int, width: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, low = queries.column("query_id").to_numpy(), queries.column("low").to_numpy()
        found = []
        for start, scores in _scored(queries, vectors):
            n = len(scores)
            base = low[start : start + n, None]
            # Only the bin that the pass before chose counts; the own score lies below all bins.
            inside = (scores >= base) & (scores < base + span)
            rows, _ = np.nonzero(inside)
            place = (scores[inside] - low[start + rows]) // width
            counts = np.bincount(rows * BINS + place, minlength=n * BINS).reshape(n, BINS)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            row, bin_ = np.nonzero((counts > 0) & (above < k))
            found.append((ids[start + row], bin_, counts[row, bin_]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": parts[0], "bin": parts[1].astype(np.int64), "n": parts[2].astype(np.int64)})

    return run


def _best(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, low = queries.column("query_id").to_numpy(), queries.column("low").to_numpy()
        of = vectors.column("vec_id").to_numpy()
        found = []
        for start, scores in _scored(queries, vectors):
            reach = scores >= low[start : start + len(scores), None]
            row, column = np.nonzero(reach)
            value, vec = scores[row, column], of[column]
            order = np.lexsort((vec, -value, row))
            row, value, vec = row[order], value[order], vec[order]
            first = np.searchsorted(row, row)
            top = np.arange(len(row)) - first < k
            found.append((ids[start + row[top]], vec[top], value[top]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    return run


def top_k(table: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of all other vectors for the rows in ``is_query``."""
    vectors = quantized(table, scale)
    queries = vectors.filter(is_query).groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.min("vec").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    size = vectors.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    n_queries = queries.count()
    # By the inequality of Cauchy and Schwarz no score is larger than the largest squared length.
    bound = int(size["square"] or 0) + 1
    n_groups, n_blocks = max(1, -(-size["n"] // VECTOR_GROUP)), max(1, -(-n_queries // QUERY_BLOCK))
    state = queries.withColumns({"low": F.lit(-bound).cast("long"), "need": F.lit(k).cast("long")})
    width = 2 * bound + 1
    while width > 1:
        span, width = width, -(-width // BINS)
        tiles = _tiles(state.drop("need"), vectors, n_blocks, n_groups)
        counts = tiles.applyInArrow(_histogram(k, span, width), "query_id long, bin long, n long")
        total = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = total.withColumn("reached", F.sum("n").over(above)).join(state.select("query_id", "need"), "query_id")
        kth = ranked.filter("reached >= need").groupBy("query_id").agg(
            F.max("bin").alias("bin"), F.max_by(F.col("need") - F.col("reached") + F.col("n"), "bin").alias("left")
        )
        # A query with fewer than k candidates has no such bin: its bound stays and all are kept.
        state = cut(
            state.join(kth, "query_id", "left").select(
                "query_id", "dim", "vec", (F.col("low") + F.coalesce("bin", F.lit(0)) * width).alias("low"),
                F.coalesce("left", "need").alias("need"),
            )
        )
    best = _tiles(state.drop("need"), vectors, n_blocks, n_groups).applyInArrow(
        _best(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
