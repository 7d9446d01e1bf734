"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is one of 0 (toxic), 1 (poor) and 2 (good). Words are hashed
to weights that all grades share; their sum over the distinct units of a text,
x, meets ordered thresholds: P(grade <= k) = sigmoid(theta_k - x). The weights
and thresholds are fitted by gradient steps (Adam) with an L2 penalty. Features
are presences of hashed units: lower-cased words and the marks between them, with
the magnitudes of the text's length and of its share of distinct units.
The sum can be damped by the number of distinct units, as long texts hold more
of everything: x = sum(w) / (DAMP + n) ** POWER. POWER is 0: it is not damped.

Scores: the expected grade and the tail probability P(grade = 2). A document is
kept when P(grade = 0) and P(grade <= 1) both stay below one half, that is, when
its most likely side of every threshold is the better one.

Fitting uses a bounded sample of labelled rows, the SAMPLE smallest by a hash of
the id (a documented parameter); scoring reads every document.

Defined results: a null or empty text has the feature of its length only; labels that
are null, or whose document is missing, take no part; repeated labels count
their smallest; a null id passes through scoring; without labels or without two
grades among them, all weights are 0 and every document is kept; other columns
are ignored by `score` and kept by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, Block, Rolling, blocks, mix, units

BITS = 20
SAMPLE = 16_384
GRADES = 3
DAMP = 1.0
EPOCHS, RATE, PENALTY, POWER = 200, 0.05, 2e-5, 0.0
TELLING = 20.0
SCORES = "doc_id long, latent double, expected_grade double, p_good double, p_toxic double, keep boolean"


def features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of each row, and where each row's begin."""
    start, end, _, data, first = units(block)
    rows = len(block)
    key = (Rolling(data).of(start, end) >> U64(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    packed = np.unique(row << bits | key)
    total, distinct = np.diff(first), np.bincount(packed >> bits, minlength=rows)
    long = np.flatnonzero(total >= 16)
    shape = (mix((8 * distinct[long] // total[long]).astype(U64) + U64(1 << 40)) >> U64(64 - bits)).astype(np.int64)
    length = (mix(np.log2(total + 1).astype(U64) + U64(1 << 41)) >> U64(64 - bits)).astype(np.int64)
    packed = np.unique(np.concatenate([packed, long << bits | shape, np.arange(rows) << bits | length]))
    return packed & ((1 << bits) - 1), np.searchsorted(packed >> bits, np.arange(rows + 1))


def latent(weights: np.ndarray, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[keys])])
    return (total[offsets[1:]] - total[offsets[:-1]]) / (DAMP + np.diff(offsets)) ** POWER


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def informative(seen: np.ndarray, rows: np.ndarray, least: float = TELLING) -> np.ndarray:
    """Whether a feature's presence tells grades apart: the G statistic of its table of presence (rows of seen) by grade is at least so much."""
    share = seen.sum(axis=1, keepdims=True) / rows.sum()
    g = np.zeros(len(seen))
    for observed, part in ((seen, share), (rows - seen, 1 - share)):
        g += 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-300) / np.maximum(part * rows, 1e-300)), 0).sum(axis=1)
    return g >= least


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def below(self, x: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last."""
        return sigmoid(self.theta[None, :] - x[:, None])


def fit(keys: np.ndarray, offsets: np.ndarray, grade: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with an L2 penalty; full batches, so the result depends on nothing but the rows."""
    weights, theta = np.zeros(1 << bits), np.array([-2.0, -1.0])
    if len(np.unique(grade)) < 2:
        return Model(weights, theta - 10)
    n = np.diff(offsets)
    scale = 1 / (DAMP + n) ** POWER
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    of = grade.astype(np.int8)[row]
    seen = np.stack([np.bincount(keys[of == g], minlength=1 << bits) for g in range(GRADES)], axis=1).astype(float)
    telling = informative(seen, np.bincount(grade, minlength=GRADES))
    pick = telling[keys]
    used, row, place = np.flatnonzero(telling), row[pick], (np.cumsum(telling) - 1)[keys[pick]]
    del of, seen, pick
    w = np.zeros(len(used))
    params = np.array([0.0, 0.0])  # theta_0 and the log of the step to theta_1
    state = [np.zeros(len(used) + 2), np.zeros(len(used) + 2)]
    for t in range(1, epochs + 1):
        cuts = np.array([params[0], params[0] + np.exp(params[1])])
        x = np.bincount(row, w[place] * scale[row], len(n))
        up = np.concatenate([sigmoid(cuts[None, :] - x[:, None]), np.ones((len(n), 1))], axis=1)
        low = np.concatenate([np.zeros((len(n), 1)), up[:, :-1]], axis=1)
        i = np.arange(len(n))
        hi, lo = up[i, grade], low[i, grade]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_x = d_hi - d_lo  # of minus log likelihood
        at_hi = [d_lo[grade == k + 1].sum() - d_hi[grade == k].sum() for k in range(2)]
        g = np.concatenate([np.bincount(place, (g_x * scale)[row], len(used)), [at_hi[0] + at_hi[1], at_hi[1] * np.exp(params[1])]]) / len(n)
        g[:-2] += PENALTY * w
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = RATE * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= step[:-2]
        params -= step[-2:]
    weights[used] = w
    return Model(weights, np.array([params[0], params[0] + np.exp(params[1])]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each labelled document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """A model of the sample of labelled documents; their features, not texts, come to the driver."""
    some = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                keys, offsets = features(block, bits)
                keys = keys.astype(np.int32)
                found = [keys[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([batch.column(k).slice(block.first, len(block)) for k in (0, 1)] + [pa.array(found, pa.binary())], names=["doc_id", "grade", "keys"])

    rows = texts.mapInArrow(run, "doc_id long, grade int, keys binary").toPandas()
    rows = rows.sort_values(["doc_id", "keys"]).drop_duplicates("doc_id").drop_duplicates(["keys", "grade"])
    keys = [np.frombuffer(k, np.int32) for k in rows["keys"]]
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
    return fit(np.concatenate(keys) if keys else np.zeros(0, np.int32), offsets, rows["grade"].to_numpy(np.int64), bits)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id, latent, expected_grade, p_good, p_toxic and keep of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                x = latent(m.weights, *features(block, bits))
                below = m.below(x)
                expected = GRADES - 1 - below.sum(axis=1)
                keep = (below < 0.5).all(axis=1)
                ids = batch.column(0).slice(block.first, len(block))
                yield pa.record_batch([ids, *map(pa.array, (x, expected, 1 - below[:, -1], below[:, 0], keep))], names=["doc_id", "latent", "expected_grade", "p_good", "p_toxic", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.schema.get_field_index("text")
            keep = [(m.below(latent(m.weights, *features(block, bits))) < 0.5).all(axis=1) for block in blocks(batch.column(text))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
