"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of hashed word and character n-grams:
words, pairs of neighbouring words (with one shared bucket for a repeated word),
runs of four bytes, and runs of three character shapes.  Every kind is averaged over
the whole text, then the kinds are averaged.  A softmax over the two classes stands
on top.  Vectors and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows, at most ``PER_CLASS`` of each class.

Once trained, softmax and averaging are linear in the vectors, so a document's logit
is the same average of one number per bucket; that table is all that tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.labelled import held_out, training_sample
from corpusmill.llm.segments import forget
from corpusmill.llm.shingles import mix, slices, word_hashes

_U = np.uint64
BUCKET_BITS = 13
KINDS = 4
BUCKETS = KINDS << BUCKET_BITS
DIMENSIONS = 16
PER_CLASS = 1000
EPOCHS = 12
RATE = 4.0
THRESHOLD = 0.7
SEED = 7
SCALE = 1 << 24

# Shapes: upper, lower, digit and other-language letters; space; each ASCII sign for itself.
_SHAPE = np.zeros(256, np.uint64)
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64) + (kind << BUCKET_BITS)


def features(texts: list[str | None]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each slice of texts, per kind: the bucket of every n-gram, and the first n-gram of each text and its end.

    An n-gram lies within one text; a text too short for a kind has none of it.
    """
    with np.errstate(over="ignore"):
        for _, raws in slices(texts):
            words, _, _, data, first = word_hashes(raws, lower=False)
            begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)))
            follows = np.append(words[1:], _U(0))
            pairs = _buckets(mix(words * _U(3) + follows[: len(words)]), 1)
            pairs[words == follows[: len(words)]] = 1 << BUCKET_BITS
            wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(_U)
            fours = wide[:-3] | wide[1:-2] << _U(8) | wide[2:-1] << _U(16) | wide[3:] << _U(24)
            shape = _SHAPE[wide.astype(np.uint8)]
            threes = (shape[:-3] << _U(14)) | (shape[1:-2] << _U(7)) | shape[2:-1]
            golden = _U(0x9E3779B97F4A7C15)
            kinds = [_buckets(words, 0), pairs, _buckets(mix(fours), 2), _buckets(threes * golden, 3)]
            # A text is followed by one byte that is not its own; its last k - 1 units open no gram of k.
            spans = [(first, 0), (first, 1), (begins, 4), (begins, 3)]
            yield [(ids, edge[:-1], np.maximum(edge[1:] - cut, edge[:-1])) for ids, (edge, cut) in zip(kinds, spans, strict=True)]


def fixed_point(table: np.ndarray) -> np.ndarray:
    """Whole multiples of 2**-24: their sums are exact, so a score is a function of its text alone."""
    return np.rint(table * SCALE).astype(np.int64)


def _means(table: np.ndarray, kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Average over the kinds of the averages of the fixed-point ``table`` over each text's n-grams."""
    total = np.zeros(len(kinds[0][1]))
    for ids, begin, end in kinds:
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(table[ids])))
        total += np.where(end > begin, (sums[end] - sums[begin]) / np.maximum(end - begin, 1), 0.0)
    return total / (KINDS * SCALE)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, y, ids, weights)``: a text's buckets and their share in its average, at most ``BUCKETS`` of them."""
    for batch in batches:
        held = []
        for kinds in features(batch.column(2).to_pylist()):
            for i in range(len(kinds[0][1])):
                share = np.zeros(BUCKETS)
                for ids, begin, end in kinds:
                    if end[i] > begin[i]:
                        share += np.bincount(ids[begin[i] : end[i]], minlength=BUCKETS) / ((end[i] - begin[i]) * KINDS)
                held.append(np.flatnonzero(share).astype(np.int32))
                held.append(share[held[-1]].astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in held[0::2]], pa.binary()), pa.array([x.tobytes() for x in held[1::2]], pa.binary())],
            names=["key", "y", "ids", "weights"],
        )


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], totals: dict[int, int]) -> tuple[np.ndarray, float]:
    """Logit of class 1 per bucket and its constant, from ``(class, buckets, weights)`` bags.

    Classes are weighted so that the sample counts as all rows that it stands for.
    """
    have = {y: sum(bag[0] == y for bag in bags) for y in (0, 1)}
    if not have[0] or not have[1]:
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    softmax, constant = np.zeros((2, DIMENSIONS)), np.zeros(2)
    for epoch in range(EPOCHS):
        order = random.permutation(len(bags))
        for step, i in enumerate(order):
            rate = RATE * (1 - (epoch + step / len(bags)) / EPOCHS)
            y, ids, weights = bags[i]
            mean = weights @ vectors[ids]
            logits = softmax @ mean + constant
            p = np.exp(logits - logits.max())
            error = -p / p.sum()
            error[y] += 1
            back = softmax.T @ error
            softmax += rate * 0.25 * np.outer(error, mean)
            constant += rate * 0.02 * error
            vectors[ids] += (rate * 50 / DIMENSIONS) * weights[:, None] * back
    # The sample is balanced; the constant moves to the share of the classes among all rows.
    shift = np.log(totals[1] / totals[0]) - np.log(have[1] / have[0])
    return vectors @ (softmax[1] - softmax[0]), float(constant[1] - constant[0] + shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample: ``2 * per_class`` bags of at most ``BUCKETS`` buckets reach the driver."""
    sample, totals = training_sample(docs, labels, label, per_class)
    bags = sample.select("doc_id", "y", "text").mapInArrow(_bags, "key bigint, y int, ids binary, weights binary")
    rows = sorted(bags.collect(), key=lambda row: row.key)
    return train([(r.y, np.frombuffer(r.ids, np.int32), np.frombuffer(r.weights, np.float32).astype(float)) for r in rows], totals)


def _scores(texts: list[str | None], table: np.ndarray, constant: float) -> np.ndarray:
    """Probabilities of class 1, from the fixed-point ``table`` of logits per bucket."""
    means = [_means(table, kinds) for kinds in features(texts)]
    logits = np.concatenate(means) + constant if means else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; score is the probability of quality 1.

    A score is a function of the text and the trained model alone: neither the rows
    beside it nor the partitions matter.  Null and empty texts and texts of white space
    without a run of three signs get the constant's probability.  Repeated rows are
    scored each, null ids as well (held out: false).  Without labels of both classes
    every score is the share of class 1.  An empty table gives none.  Other columns are
    ignored.
    """
    table, constant = fit(docs, labels, per_class=per_class)
    table = fixed_point(table)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(1).to_pylist(), table, constant)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scores = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id bigint, score double")
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all their columns as they are.

    Nulls, blanks, repeated rows and missing labels count as in :func:`score_quality`.
    """
    table, constant = fit(docs, labels, per_class=per_class)
    table = fixed_point(table)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), table, constant) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
