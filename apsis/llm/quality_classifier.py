"""Quality classifier (operator 2): random Fourier features, ridge regression, isotonic calibration.

Document statistics (one pass over whole texts, written once) are standardised and mapped to random cosines and sines, whose
inner products approximate a Gaussian kernel; the model is linear in these features alone. Every partition sums its part of
the normal equations; Spark adds the sums a row of the matrix at a time, the driver solves one fixed-size system. Raw scores are calibrated by pool-adjacent-violators over a fixed number of score
bins that Spark counts. Only the model (a few hundred kilobytes at any input size) passes through the driver.

Cases: null or empty text has statistics of zero and is scored like any other; rows without a label, or with a null
label or null id, are scored but not learned from; a document with several labels is learned once with each; repeated
rows are scored alike, and equal scores calibrate alike; a very long text is read whole, alone in its block; without any label of a class all scores are the share of the other; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize
from .doc_stats import COUNTS, FEATURES, count_block, document_counts, features


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # upper raw score of each calibration step
    levels: np.ndarray  # its calibrated score

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def expand(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), self.fourier(x)])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features whose inner products are near exp(-gamma * squared distance) of the standardised statistics."""
        angle = self.standard(x) @ self.directions
        return np.hstack([np.cos(angle), np.sin(angle)]) / np.sqrt(angle.shape[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS})


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to values, by weighted squares."""
    level, mass, size = [], [], []
    for v, w in zip(values, weights, strict=True):
        level.append(v)
        mass.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = mass[-2] + mass[-1]
            level[-2] = (level[-2] * mass[-2] + level[-1] * mass[-1]) / total
            mass[-2], size[-2] = total, size[-2] + size[-1]
            level.pop(), mass.pop(), size.pop()
    return np.repeat(level, size)


def fit(train: DataFrame, label: str, n_features: int = 256, gamma: float = 0.04, ridge: float = 0.3, bins: int = 512, seed: int = 20) -> Model:
    """train: COUNTS and a 0/1 label column. Three Spark passes over it: moments, normal equations, calibration counts."""
    random, d = np.random.default_rng(seed), len(FEATURES)
    model = Model(np.zeros(d), np.ones(d), random.normal(0, np.sqrt(2 * gamma), (d, n_features // 2)), np.zeros(1 + n_features // 2 * 2), np.zeros(1), np.full(1, 0.5))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d))
        n = 0
        for batch in batches:
            x = _matrix(batch)
            total += [x.sum(0), (x * x).sum(0)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({"k": list(range(2 * d + 1)), "v": [*total.ravel().tolist(), float(n)]})

    summed = dict(train.mapInArrow(moments, "k bigint, v double").groupBy("k").agg(F.sum("v")).collect())
    n = summed.get(2 * d, 0.0)
    if not n:
        return model
    first = np.array([summed[k] for k in range(d)]) / n
    model.mean, model.scale = first, np.sqrt(np.maximum(np.array([summed[d + k] for k in range(d)]) / n - first**2, 1e-6))
    m = len(model.weights)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((m, m + 1))
        for batch in batches:
            z = model.expand(_matrix(batch))
            gram[:, :m] += z.T @ z
            gram[:, m] += z.T @ batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one index are in one task, which holds a sum per index."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m + 1)
            for i, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                total[i] = total[i] + row if i in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])

    labelled = train.select(*COUNTS, F.col(label).cast("double").alias("_y"))
    parts = labelled.mapInArrow(normal, "i bigint, row array<double>").repartition("i").mapInArrow(add, "i bigint, row array<double>").collect()
    gram = np.zeros((m, m + 1))
    for part in parts:
        gram[part["i"]] = part["row"]
    penalty = np.full(m, ridge)
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(gram[:, :m] + np.diag(penalty), gram[:, m])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((bins, 3))
        for batch in batches:
            raw = model.raw(_matrix(batch))
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
            at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            for k, v in enumerate((np.ones(len(y)), y, raw)):
                seen[:, k] += np.bincount(at, v, bins)
        hit = np.flatnonzero(seen[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(seen[hit, k]) for k in range(3))], names=["bin", "n", "ones", "raw"])

    counted = sorted(labelled.mapInArrow(count, "bin long, n double, ones double, raw double").groupBy("bin").agg(F.sum("n"), F.sum("ones"), F.sum("raw")).collect())
    size, ones, raw = (np.array([r[k] for r in counted]) for k in (1, 2, 3))
    model.edges = np.maximum.accumulate(raw / size)
    model.levels = np.clip(isotonic(ones / size, size), 0, 1)
    return model


def apply(counts: DataFrame, model: Model) -> DataFrame:
    """Adds score to a table of COUNTS."""
    kept = [c for c in counts.columns if c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.round(model.score(_matrix(batch)), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(score)], names=[*kept, "score"])

    return counts.mapInArrow(run, ", ".join([*(f"{c} {dict(counts.dtypes)[c]}" for c in kept), "score double"]))


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text, by remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits the rows of a counts table (`_id`, COUNTS) that have a label and are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out(F.col(id_col)))
    return fit(counts.join(known, "_id"), "_label")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per document: id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold)."""
    counts = materialize(document_counts(docs, id_col, text_col), "quality-counts")
    scored = apply(counts, learn(counts, labels, id_col, label_col))
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts. Texts are read twice and never shuffled."""
    model = learn(materialize(document_counts(docs, id_col, text_col), "quality-counts"), labels, id_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                score = np.round(model.score(features(count_block(part.column(at)))), 6)
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
