"""Operator 2: quality classifier, hashed word n-grams under logistic regression with FTRL-proximal updates.

A text's features are n-grams of its words and of its words' shapes (letter case, digits, marks), each hashed into one
of BUCKETS weights. In every family of n-grams a feature's value is the root of its share, so that texts of any length
have features of the same size. A score is the logistic function of the sparse dot product.

Training takes at most SAMPLE labelled rows, the least by a hash of their ids; that is the only bound, a parameter.
They are featurised on executors and trained in one task; weights (BUCKETS floats) are the only thing sent back.

Defined results: null and empty texts have the bias as their score; ids that occur twice in labels are trained twice;
without any label every score is 0.5; null ids count as the empty text for the held-out remainder; an empty table gives
no rows; other columns of the inputs are ignored, or kept by classify().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

BUCKETS = 1 << 18
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
THRESHOLD = 0.7
HELD_OUT = (4, 2)
WORDS_KEPT = 100_000
_FAMILY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA6BC2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def _shape(word: bytes) -> bytes:
    """Case or digit class, then the marks at the end: b'Uu' + b'!!' for b'HAND!!'."""
    core = word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    marks = word[len(core):][:4]
    if not core:
        kind = b"m"
    elif any(48 <= c <= 57 for c in core):
        kind = b"d"
    elif len(core) > 1 and core.upper() == core and core.lower() != core:
        kind = b"U"
    elif 65 <= core[0] <= 90:
        kind = b"C"
    else:
        kind = b"l"
    return kind + marks


class _Words(dict):
    """word -> 32 bits of its hash, 32 of its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = self[word] = (xxhash.xxh32_intdigest(word) << 31 | xxhash.xxh32_intdigest(_shape(word)) >> 1) & 0x7FFFFFFFFFFFFFFF
        return code


_words = _Words()


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((a ^ (a >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket numbers and their values."""
    words = common.words(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    code = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    shape = code & np.uint64(0x7FFFFFFF)
    with np.errstate(over="ignore"):
        families = [_mix(code * _FAMILY[0]), _mix(shape * _FAMILY[1])]
        if len(words) > 1:
            families.append(_mix(code[:-1] * _FAMILY[2] + code[1:] * _FAMILY[3]))
            families.append(_mix(shape[:-1] * _FAMILY[4] + shape[1:] * _FAMILY[0]))
            families.append(_mix((code[:-1] == code[1:]).astype(np.uint64) + _FAMILY[5]))
    at, value = [], []
    for family in families:
        bucket, count = np.unique(family, return_counts=True)
        at.append(bucket)
        value.append(np.sqrt(count / len(family)))
    bucket, inverse = np.unique(np.concatenate(at), return_inverse=True)
    return bucket, np.bincount(inverse, np.concatenate(value)).astype(np.float32)


def score(weights: np.ndarray, bias: float, text: str | None) -> float:
    bucket, value = features(text)
    margin = bias + float(weights[bucket] @ value) if len(bucket) else bias
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over the examples; per coordinate z and n as in FTRL-proximal."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weight(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for bucket, value, label in examples:
            at = np.append(bucket, BUCKETS)
            x = np.append(value, 1.0)
            l1 = np.full(len(at), L1)
            l1[-1] = 0
            w = weight(z[at], n[at], l1)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    l1 = np.full(BUCKETS + 1, L1)
    l1[-1] = 0
    w = weight(z, n, l1)
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows that are not held out, or on `sample` of them.

    The bound holds for labelled ids and again for their rows in docs, as one id may have any number of them: of more than
    `sample` rows those with the least hash of id and features are taken, so each task sends and the fitting one keeps so many.
    """
    modulus, held = HELD_OUT
    learnt = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label"))
    learnt = learnt.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (common.remainder_column(F.col("doc_id"), modulus) != held))
    share = 2 * sample / max(1, learnt.count())
    if share < 0.5:  # so that a task sends few rows; with some 2 * sample of them left, the least are among these
        learnt = learnt.where(F.xxhash64("doc_id") < F.lit(int(2**64 * share) - 2**63))
    learnt = learnt.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)  # bounded: it is broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(learnt), "doc_id")

    example = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("value", pa.binary())])
    weighed = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "doc_id", "label", "text"):
            yield common.record_batch(example, [(i, y, *(x.tobytes() for x in features(t))) for i, y, t in part])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for part in common.rows(batches, *example.names) for row in part]
        held.sort(key=lambda row: (xxhash.xxh64_intdigest(str(row[0])), row[1], row[2]))
        weights, bias = ftrl([(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), y) for _, y, b, v in held])
        yield common.record_batch(weighed, [(weights.tobytes(), bias)])

    numbers = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    examples = numbers.mapInArrow(featurise, "doc_id long, label int, bucket binary, value binary")
    bounded = examples.orderBy(F.xxhash64(*example.names), "doc_id").limit(sample)
    fitted = bounded.coalesce(1).mapInArrow(fit, "weights binary, bias double").collect()
    return (np.frombuffer(fitted[0]["weights"], np.float32), fitted[0]["bias"]) if fitted else (np.zeros(BUCKETS, np.float32), 0.0)


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A column function text -> score."""
    sent = spark.sparkContext.broadcast(model)

    def make():
        weights, bias = sent.value
        return lambda texts: pa.array([score(weights, bias, t) for t in texts], pa.float64())

    return common.text_function("double", make)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `held_out`, `score` and `predicted`, which replace columns of these names."""
    run = scorer(docs.sparkSession, train(docs, labels))
    modulus, held = HELD_OUT
    return docs.withColumns({"held_out": common.remainder_column(F.col("doc_id"), modulus) == held, "score": run("text")}).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with their columns."""
    run = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(run("text") >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")
