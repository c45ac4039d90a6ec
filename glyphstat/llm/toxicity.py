"""Toxicity by non-negative positive-unlabelled learning.

Training sees texts confirmed as toxic and unlabelled texts, which hold toxic ones in the share of
the class prior. The risk of a linear classifier on hashed words is prior * (loss of the positives)
plus the loss of the negatives, which is estimated as (loss of the unlabelled as negatives) minus
prior * (loss of the positives as negatives). Where that estimate falls below zero the classifier has
begun to fit single texts, and the step goes the other way (Kiryo et al., 2017).

Defined cases: null and empty texts have no words and get the score of the bias alone; repeated rows
get equal scores; rows without an id are never learned from and count as not held out; without
positives in the training part the prior is 0 and so is every score; other columns are never read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.words import Words, as_bytes, chunks, mix

BUCKETS = 1 << 20

# Besides whole words, their first bytes are features: insults are inflected and disguised at the end.
BEGINNINGS = (4, 6)

# Confirmed texts that a feature is in at least; rarer ones only tell single texts apart.
MIN_POSITIVE = 4

# Share of confirmed texts among those with a feature, as the prior lets expect it, at least. Common
# words have the prior's share; their many small weights would make long texts score at random.
MIN_SHARE = 0.3

# Bounds of the sample that the classifier is fitted on.
MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000

THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is ever read."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of all texts, and the bounds of each text."""
    w = Words(texts, punctuation=True)
    kinds = []
    for size in (None, *BEGINNINGS):
        hashed = w.hashes(lower=True, first_bytes=size) ^ np.uint64(size or 0)
        kinds.append(w.doc.astype(np.int64) * BUCKETS + (mix(hashed) % np.uint64(BUCKETS)).astype(np.int64))
    joint = np.unique(np.concatenate(kinds))
    return joint % BUCKETS, np.searchsorted(joint, np.arange(w.n + 1) * BUCKETS)


def _sums(weights: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[features], dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Classifier:
    """Weights of hashed words, a bias, and the scale that puts the best cut at the threshold."""

    def __init__(self):
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        self.cut, self.slope = np.inf, 1.0

    def raw(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sums(self.weights, features, bounds) + self.bias

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.cut):
            return np.zeros(len(bounds) - 1)
        logit = np.log(THRESHOLD / (1 - THRESHOLD))
        return _sigmoid(self.slope * (self.raw(features, bounds) - self.cut) + logit)


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
    rounds: int = 60, batch: int = 500, rate: float = 0.03, decay: float = 1e-3, seed: int = 11,
) -> Classifier:
    """Minimize the non-negative risk with logistic loss in shuffled batches (Adam steps)."""
    model = Classifier()
    in_positive, in_any = (np.bincount(np.concatenate(texts), minlength=BUCKETS) for texts in (positive, unlabelled))
    share = prior * (in_positive / len(positive)) / (np.maximum(in_any, 1) / len(unlabelled))
    # Only these are trained, under numbers of their own.
    frequent = (in_positive >= MIN_POSITIVE) & (share >= MIN_SHARE)
    number, size = np.cumsum(frequent) - 1, int(frequent.sum())
    positive, unlabelled = ([number[t[frequent[t]]] for t in texts] for texts in (positive, unlabelled))
    model.weights, model.bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    rng = np.random.default_rng(seed)
    n_batches = max(1, len(unlabelled) // batch)
    moment, square, t = np.zeros(size + 1), np.zeros(size + 1), 0

    def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.int64), *texts]), np.cumsum([0, *map(len, texts)])

    for _ in range(rounds):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(n_batches):
            p = [positive[i] for i in order_p[k::n_batches]] or [positive[order_p[k % len(positive)]]]
            u = [unlabelled[i] for i in order_u[k::n_batches]]
            (fp, bp), (fu, bu) = flat(p), flat(u)
            zp, zu = model.raw(fp, bp), model.raw(fu, bu)
            negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative_risk >= 0:
                dp = -prior * _sigmoid(-zp) / len(p) - prior * _sigmoid(zp) / len(p)
                du = _sigmoid(zu) / len(u)
            else:
                dp, du = prior * _sigmoid(zp) / len(p), -_sigmoid(zu) / len(u)
            gradient = np.bincount(fp, np.repeat(dp, np.diff(bp)), size) + np.bincount(fu, np.repeat(du, np.diff(bu)), size)
            gradient = np.append(gradient + decay * model.weights, dp.sum() + du.sum())
            t += 1
            moment = 0.9 * moment + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
            model.weights -= step[:-1]
            model.bias -= step[-1]
    weights = np.zeros(BUCKETS)
    weights[frequent] = model.weights
    model.weights = weights
    return model


def calibrate(model: Classifier, raw: np.ndarray, toxic: np.ndarray) -> None:
    """Put the cut with the best F1 of labelled training rows at the threshold."""
    order = np.argsort(-raw)
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + max(1, toxic.sum()))
    # A cut lies between two different values.
    ends = np.append(raw[order][1:] != raw[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    following = raw[order][best + 1] if best + 1 < len(raw) else raw[order][best] - 1
    model.cut = float(raw[order][best] + following) / 2
    model.slope = 1.0


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Train on bounded samples, chosen by a hash of the ids, of the part that is not held out."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).dropna()
    marks = marks.filter(~held_out(F.col("doc_id")))
    prior = marks.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < prior < 1:
        return Classifier()
    order = F.xxhash64("doc_id", F.lit(11)), "doc_id"
    positive = marks.filter("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id", F.lit(1).alias("part"))
    labelled = marks.orderBy(*order).limit(max_unlabelled).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    unlabelled = ids.distinct().orderBy(*order).limit(max_unlabelled).select("doc_id", F.lit(2).alias("part"))
    wanted = (
        positive.union(unlabelled).union(labelled.select("doc_id", F.lit(4).alias("part"))).groupBy("doc_id").agg(F.sum("part").alias("part"))
        .join(labelled, "doc_id", "left")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            features, bounds = word_features(as_bytes(batch.column("text")))
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(features.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("toxic"), lists], names=["part", "toxic", "features"]
            )

    # At most max_positive + 2 * max_unlabelled ids, so the broadcast is bounded.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    rows = chosen.select("part", "toxic", "text").mapInArrow(run, "part long, toxic int, features array<int>").toArrow()
    part, toxic = rows.column("part").to_numpy(), rows.column("toxic").to_pylist()
    texts = [x.values.to_numpy() for x in rows.column("features").combine_chunks()]
    # The order of collected rows is not fixed; training needs one that is.
    order_of = sorted(range(len(texts)), key=lambda i: texts[i].tobytes())
    texts, part, toxic = [texts[i] for i in order_of], part[order_of], [toxic[i] for i in order_of]
    positives = [t for t, p in zip(texts, part, strict=True) if p & 1]
    unlabelled_texts = [t for t, p in zip(texts, part, strict=True) if p & 2]
    if not positives or not unlabelled_texts:
        return Classifier()
    model = train(positives, unlabelled_texts, prior)
    known = [i for i, x in enumerate(toxic) if x is not None]
    if known:
        flat = np.concatenate([np.zeros(0, np.int64), *(texts[i] for i in known)])
        bounds = np.cumsum([0, *(len(texts[i]) for i in known)])
        calibrate(model, model.raw(flat, bounds), np.array([toxic[i] for i in known]))
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            scores = model.scores(*word_features(as_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
