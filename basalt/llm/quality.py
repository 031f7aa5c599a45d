"""Quality scores by naive Bayes support vectors.

Features are indicators of n-grams: byte trigrams of the text, and one- to
three-grams of word shapes (case, trailing signs, and whether a word repeats the
one before), all found by numpy without a table that a worker would keep.  They are scaled by the log-count ratio of the two classes, the
vector is brought to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent; the margin becomes a score by a fitted sigmoid.

The fit uses at most ``SAMPLE`` labelled rows, those of least hash of their ids
among the rows whose crc32(doc_id as text) mod 5 isn't 0; labels, language,
source and id are no features.  Every whole text is scored.

Defined results: a null or empty text has no features and its score is the
sigmoid of the bias; null ids are neither held out nor labelled; repeated rows
are all scored; rows repeated in the labels count once, as quality 1 if any says so; of rows
of one labelled id the fit takes that of the least digest of its text; without
labels of both classes every score is 0.5, and no document is rejected; an
empty table of documents gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import column_bytes, few, lean, ship, table, taken, wanted

SAMPLE = 12_000
THRESHOLD = 0.3
FOLDS = 5
GRAMS = 1 << 16
SHAPES = 16
DIMS = GRAMS + SHAPES + SHAPES**2 + SHAPES**3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 15
SEED = 42
_PIECE = 1 << 18
_SLICE = 128


# ASCII capitals, small letters (bytes of other letters count as small), and signs.
_CAPITAL = np.zeros(256, np.int32)
_CAPITAL[0x41:0x5B] = 1
_SMALL = np.zeros(256, np.int32)
_SMALL[0x61:0x7B] = _SMALL[0x80:] = 1
_SIGN = np.ones(256, bool)
_SIGN[0x30:0x3A] = _SIGN[0x41:0x5B] = _SIGN[0x61:0x7B] = _SIGN[0x80:] = False


def _shapes(words: list[bytes]) -> np.ndarray:
    """0..15 for each word: case (2 bits), whether it ends in two signs or more, whether it repeats the word before."""
    joined = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    capitals, smalls = (np.concatenate([[0], np.cumsum(kind[joined])]) for kind in (_CAPITAL, _SMALL))
    upper, lower = capitals[end] - capitals[start], smalls[end] - smalls[start]
    case = np.where((upper > 0) & (lower == 0) & (size > 1), 3, np.where(_CAPITAL[joined[start]] > 0, 2, np.where((lower > 0) & (upper == 0), 1, 0)))
    signs = (size > 1) & _SIGN[joined[end - 1]] & _SIGN[joined[np.maximum(end - 2, 0)]]
    same = np.zeros(len(words), np.int64)
    same[1:] = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, len(words) - 1)
    return 2 * case + signs + 8 * same


def features(raw: bytes) -> np.ndarray:
    """Sorted numbers of the n-grams that a text (UTF-8) has."""
    seen = np.zeros(DIMS, bool)
    data = np.frombuffer(raw, np.uint8)
    for i in range(0, max(0, len(data) - 2), _PIECE):
        b = data[i : i + _PIECE + 2].astype(np.uint32)
        gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        seen[(gram * np.uint32(2654435761)) >> np.uint32(16)] = True
    words = raw.split()
    for i in range(0, len(words), _PIECE):
        shape = _shapes(words[max(0, i - 2) : i + _PIECE])
        seen[GRAMS + shape] = True
        pair = SHAPES * shape[:-1] + shape[1:]
        seen[GRAMS + SHAPES + pair] = True
        seen[GRAMS + SHAPES + SHAPES**2 + SHAPES * pair[:-1] + shape[2:]] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """weight of each feature (ratio times the hinge model's), ratio, bias, and the sigmoid's line."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(r @ r))
        return (float(self.weight[found] @ r) / norm if norm else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -700, 700))))


def log_count_ratio(found: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each feature among those of class 1, over that of class 0."""
    of = np.repeat(labels, np.diff(ends, prepend=0))
    count = np.stack([np.bincount(found[of == y], minlength=DIMS) for y in (0, 1)]) + SMOOTHING
    share = count / count.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(found: np.ndarray, ends: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(weight, bias, margins) of the hinge-loss model on unit vectors, by dual coordinate descent.

    Row i has the features found[ends[i - 1] : ends[i]]; its values are their
    ratios over the row's length, looked up when the row's turn comes.
    """
    n, starts = len(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    row = [found[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    length = np.array([np.sqrt(float(ratio[f] @ ratio[f])) for f in row])
    scale = np.divide(1.0, length, out=np.zeros(n), where=length > 0)
    y, alpha, weight, bias, rng = 2.0 * labels - 1, np.zeros(n), np.zeros(DIMS), 0.0, np.random.default_rng(SEED)
    # one feature of value 1 holds the bias; a vector's square is then 2, or 1 if it is empty
    square = 1.0 + (length > 0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            f = row[i]
            v = ratio[f]
            slope = y[i] * (float(weight[f] @ v) * scale[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                weight[f] += (step * scale[i]) * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias, np.array([float(weight[f] @ ratio[f]) * s + bias for f, s in zip(row, scale.tolist(), strict=True)])


def fit(found: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Model:
    """Log-count ratios, dual coordinate descent on the hinge loss, then the sigmoid by Newton's steps."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, 0.0)
    ratio = log_count_ratio(found, ends, labels)
    weight, bias, margin = descend(found, ends, labels, ratio)
    line = np.zeros(2)
    n1 = float(labels.sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        line -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return Model(ratio, weight, bias, float(line[0]), float(line[1]))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of labelled rows; of one id's rows in a task only those whose digest is less than all before."""
    least: dict[int, bytes] = {}  # ids of the sample
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, y, text in zip(taken(batch, "doc_id").to_pylist(), taken(batch, "y").to_pylist(), column_bytes(batch, "text"), strict=True):
            mark = hashlib.blake2b(text, digest_size=16).digest()
            if doc_id not in least or mark < least[doc_id]:
                least[doc_id] = mark
                rows.append((doc_id, y, mark, features(text).tobytes()))
            if len(rows) >= _SLICE:
                yield _columns(rows)
                rows = []
    yield _columns(rows)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "y", "mark", "found"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, size, labels = [np.empty(0, np.int32)], [], []
    for batch in batches:
        col = taken(batch, "found")
        size.append(pc.binary_length(col).to_numpy(zero_copy_only=False) // 4)
        found.append(np.frombuffer(b"".join(col.to_pylist()), np.int32))
        labels.append(taken(batch, "y").to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.concatenate(size or [np.empty(0)]), dtype=np.int64)
    m = fit(np.concatenate(found), ends, np.concatenate(labels or [np.empty(0)]).astype(np.int64))
    data = [m.ratio.astype("<f8").tobytes(), m.weight.astype("<f8").tobytes()]
    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in data), *(pa.array([x]) for x in (m.bias, m.slope, m.shift))], ["ratio", "weight", "bias", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, fitted by one task on rows put in order."""
    ship(docs.sparkSession)
    known = wanted(labels, doc_id="bigint", quality="int").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    # each label has a document, so the sample is of the size meant
    once = known.groupBy("doc_id").agg(F.max("quality").alias("y"))
    some = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = wanted(docs, doc_id="bigint", text="string").join(F.broadcast(some), "doc_id")  # SAMPLE rows of two numbers
    found = rows.mapInArrow(lean(_featured), "doc_id bigint, y int, mark binary, found binary")
    least = found.groupBy("doc_id", "y").agg(F.min(F.struct("mark", "found")).alias("least")).select("doc_id", "y", "least.found")
    one = least.repartition(1).sortWithinPartitions("doc_id")
    r = one.mapInArrow(lean(_fitted), "ratio binary, weight binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(r["ratio"], "<f8"), np.frombuffer(r["weight"], "<f8"), r["bias"], r["slope"], r["shift"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([taken(batch, "doc_id"), pa.array([shared.value.score(features(x)) for x in column_bytes(batch, "text")], pa.float64())], ["doc_id", "score"])

    rows = wanted(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, unchanged."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in few(batch):
                yield some.filter(pa.array([shared.value.score(features(x)) >= THRESHOLD for x in column_bytes(some, "text")], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
