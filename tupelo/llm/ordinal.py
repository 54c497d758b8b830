"""Quality classifier: ordinal cumulative-link regression on hashed text.

A document's grade y is one of 0 .. K. One weight per hashed feature is shared by all grades, and
ordered thresholds part them: P(y <= k) = logistic(threshold k - weights . x). Features are each
word (A-Z in lower case), its last three bytes and its first `stems`, hashed into `buckets`; a
feature's value is log2(1 + count), at most 2, so that one strong word shows even in a long text.
None is cut: the less a feature goes with the grade in the training texts, the smaller it is scaled,
so that the penalty holds its weight down, but words of a rare kind of text keep what they tell.

Where lower grades mean faults (`faults`), no weight is positive: otherwise ordinary words speak
for a text, and a long text with a grave fault outweighs a short one without any.

From the probabilities of the grades come the expected grade and the tail probability of reaching
the best one, by which documents are selected. The cut is calibrated on graded rows that the fit
hasn't seen: at most `false_share` of those with the best grade are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import own_columns, saved, scratch, ship
from .quality_rules import calibrate
from .textvec import LOWER, U64, Texts, mix, ngram_sums, owner, pieces


def features(t: Texts, buckets: int, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and value of every feature, and how many come before each text; stems: sizes in bytes."""
    data = LOWER[t.data]
    prefix = t.prefix(data)
    start, end, before = t.words()
    found = [t.spans(prefix, start, end, data), mix(t.spans(prefix, np.maximum(start, end - 3), end, data) + U64(1))]
    found += [mix(t.spans(prefix, start, np.minimum(end, start + k), data) + U64(100 + k)) for k in stems]
    bucket = np.concatenate(found) & U64(buckets - 1)
    of = np.tile(owner(before), len(found))
    key, count = np.unique(of.astype(np.int64) * buckets + bucket.astype(np.int64), return_counts=True)
    text, bucket = key // buckets, key % buckets
    return bucket, np.minimum(np.log2(1 + count), 2.0), np.searchsorted(text, np.arange(len(t) + 1))


def evidence(bucket: np.ndarray, own: np.ndarray, grade: np.ndarray, buckets: int, chance: float) -> np.ndarray:
    """The scale of each bucket, 0 .. 1: by chi-squared of its presence over the grades. `chance`, about
    the most that chance gives any of so many buckets, is halfway before the power that parts them."""
    n = len(grade)
    sizes = np.bincount(grade)
    seen = np.stack([np.bincount(bucket[grade[own] == k], minlength=buckets) for k in range(len(sizes))])
    total = seen.sum(0)
    expected = total[None, :] * (sizes[:, None] / n)
    chi = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) * n / np.maximum(n - total, 1)
    return (chi / (chi + chance)) ** 3


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float
    stems: tuple[int, ...] = ()

    def tails(self, at: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1 .. K, one column each, of texts whose weights sum up to `at`."""
        return _logistic(at[:, None] - self.thresholds[None, :])

    def score(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The expected grade and the probability of the best one."""
        bucket, value, before = features(t, len(self.weights), self.stems)
        tails = self.tails(ngram_sums(self.weights[bucket] * value, before))
        return tails.sum(1), tails[:, -1]


def fit(bucket: np.ndarray, value: np.ndarray, before: np.ndarray, grade: np.ndarray, top: int, buckets: int, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4, chance: float = 30.0, faults: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood with a small penalty on scaled weights, by Adam over all rows.
    With `faults` among weights that aren't positive.

    Thresholds are the first one and positive steps from it, so that they stay in order.
    """
    n, own = len(grade), owner(before)
    scale = evidence(bucket, own, grade, buckets, chance)
    value = value * scale[bucket]
    names, bucket = np.unique(bucket, return_inverse=True)
    bucket, own, value = bucket.astype(np.int32), own.astype(np.int32), value.astype(np.float32)
    # The same features bucket by bucket, for the sums of the other direction.
    by = np.argsort(bucket, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=len(names)))])
    own, value_by = own[by], value[by]
    del by
    share = np.array([(grade < k).mean() for k in range(1, top + 1)])
    start = np.log((share * n + 1) / ((1 - share) * n + 1))
    p = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, rounds + 1):
        w, steps = p[: len(names)], np.exp(p[len(names) + 1 :])
        cuts = p[len(names)] + np.concatenate([[0], np.cumsum(steps)])
        z = ngram_sums(value * w.astype(np.float32)[bucket], before)
        below = np.concatenate([np.zeros((n, 1)), _logistic(cuts[None, :] - z[:, None]), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        chance = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        dz = (slope[rows, grade + 1] - slope[rows, grade]) / chance
        dcut = np.zeros((n, top + 2))
        dcut[rows, grade + 1] -= slope[rows, grade + 1] / chance
        dcut[rows, grade] += slope[rows, grade] / chance
        per_cut = dcut[:, 1:-1].sum(0) / n
        after = np.cumsum(per_cut[::-1])[::-1]
        g = np.concatenate([ngram_sums(value_by * dz.astype(np.float32)[own], first) / n + decay * w, after[:1], after[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if faults:
            p[: len(names)] = np.minimum(p[: len(names)], 0)
    weights = np.zeros(buckets)
    weights[names] = p[: len(names)] * scale[names]
    return weights, p[len(names)] + np.concatenate([[0], np.cumsum(np.exp(p[len(names) + 1 :]))])


def train(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", most: int = 6000, buckets: int = 1 << 20, false_share: float = 0.005, seed: int = 13, most_grades: int = 100, stems: tuple[int, ...] = (4, 5), faults: bool = False) -> Model | None:
    """A model from about `most` rated documents, those with the smallest seeded hashes: a documented
    bound. A fifth of them sets the cut, the others the weights. Where grades below the best one mean
    faults, say so by `faults`.

    A document with several ratings has the lowest one; of an id with several texts one counts, the
    one with the smallest hash. Null ids, ratings and texts take no part. None if fewer than two
    grades are left, as with an empty table of either kind; more than `most_grades` raise
    ValueError. Columns other than these, whatever their names, play no part.
    """
    ship(docs.sparkSession)
    rated = own_columns(ratings, doc_id, grade).toDF("_doc", "_grade").dropna().groupBy("_doc").agg(F.min("_grade").alias("_grade"))
    spark = docs.sparkSession
    with scratch(spark):
        rated = saved(rated.join(own_columns(docs, doc_id), F.col("_doc") == F.col(f"`{doc_id}`"), "left_semi"), "rated")
        got, grades = _sampled(docs, rated, doc_id, text, most, buckets, seed, most_grades, stems)
    return _model(got, grades, buckets, false_share, stems, faults) if got is not None and len(got) else None


def _sampled(docs: DataFrame, rated: DataFrame, doc_id: str, text: str, most: int, buckets: int, seed: int, most_grades: int, stems: tuple[int, ...]) -> tuple[pa.RecordBatch | None, list]:
    """Features of the sample (h, y, apart, bucket, value), one row per document, and the grades."""
    grades = sorted(r[0] for r in rated.select("_grade").distinct().limit(most_grades + 1).collect())
    if len(grades) > most_grades:
        raise ValueError(f"more than {most_grades} grades")
    if len(grades) < 2:
        return None, grades
    index = F.create_map(*[F.lit(x) for i, g in enumerate(grades) for x in (g, i)])
    dice = F.xxhash64("_doc", F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5
    picked = rated.where(dice <= min(1.0, most / rated.count())).select("_doc", index[F.col("_grade")].alias("y"), (F.pmod(F.xxhash64("_doc", F.lit(seed + 1)), F.lit(5)) == 0).alias("apart"))
    base = own_columns(docs, doc_id, text).toDF("_id", "text").where("text IS NOT NULL")
    rows = base.join(F.broadcast(picked), F.col("_id") == F.col("_doc")).select("text", "y", "apart", F.xxhash64("_id", F.lit(seed)).alias("h"), F.xxhash64("text").alias("t"))  # picked: about `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in pieces(batch.column(0)):
                bucket, value, before = features(t, buckets, stems)
                lists = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in (1, 2, 3, 4)], *lists], names=["y", "apart", "h", "t", "bucket", "value"])

    found = rows.mapInArrow(run, "y int, apart boolean, h long, t long, bucket array<int>, value array<float>")
    # One row per document, however often its id is repeated: partial minima come before the shuffle.
    one = found.groupBy("h", "y", "apart").agg(F.min(F.struct("t", "bucket", "value")).alias("x"))
    return one.select("h", "y", "apart", "x.bucket", "x.value").orderBy("h", "y").toArrow().combine_chunks(), grades


def _model(got: pa.Table, grades: list, buckets: int, false_share: float, stems: tuple[int, ...], faults: bool) -> Model | None:
    y, apart = got.column("y").to_numpy(), got.column("apart").to_numpy()
    bucket, value = (np.concatenate([c.flatten().to_numpy() for c in got.column(n).chunks]) for n in ("bucket", "value"))
    before = np.concatenate([[0], np.cumsum(np.concatenate([c.value_lengths().to_numpy() for c in got.column("bucket").chunks]))])
    if len(np.unique(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
        if len(np.unique(y)) < 2:
            return None
    of = owner(before)
    learn = ~apart
    use = learn[of]
    counts = np.diff(before)[learn]
    weights, thresholds = fit(bucket[use].astype(np.int64), value[use].astype(np.float64), np.concatenate([[0], np.cumsum(counts)]), y[learn], len(grades) - 1, buckets, faults=faults)
    model = Model(weights, thresholds, 0.0, stems)
    judged = apart if apart.any() else learn
    odd = 1 - model.tails(ngram_sums(weights[bucket] * value, before)[judged])[:, -1]
    cut = calibrate(odd, y[judged] == len(grades) - 1, false_share)
    return Model(weights, thresholds, 1 - cut, stems)


def grade(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, expected_grade (0 .. K), tail_probability of the best grade, and kept.

    Null and empty texts have no features, so their grade is that of the thresholds alone. Without
    a model all rows are kept, with null grades. Null ids and repeated rows are judged like others;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    base = own_columns(docs, doc_id, text).toDF("doc_id", "text")
    if model is None:
        return base.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(model)  # a weight per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in pieces(batch.column(1)):
                expected, tail = sent.value.score(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(expected), pa.array(tail), pa.array(tail >= sent.value.cut)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")
