"""Quality rules (operator 6): hard rules on base statistics, then an isolation forest on rule statistics.

Each tree splits a random sample of documents at random; a document that random splits isolate early is anomalous.
The forest is fitted on a bounded sample (sample_rows documents with the smallest hash of id and statistics, a
parameter); every document is scored. The threshold comes from labelled rows: among fixed score bins counted by Spark, the
one with the best difference of rejected bad and rejected good rows, that rejects at most max_good_loss of the good.

Cases: null text counts as empty (no words: it fails the base rule); without labels of both kinds only the base rules
reject; several labels of one document each count; repeated rows are judged alike, as are rows that tie at the threshold (they go);
a very long text is read whole, alone in its block; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .doc_stats import COUNTS, document_counts


def rule_statistics(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: roots of the shares of symbols, bars, exclamation marks, capitals and other marks.

    Shares are taken over a little more than the text has, so that a short text is not anomalous by chance. Repeats are
    the base rule's matter and size alone is no anomaly.
    """
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars = c["n_words"] + 30, c["n_chars"] + 150
    return np.sqrt(np.column_stack([c["n_symbols"] / words, c["n_bars"] / words, c["n_cries"] / words, c["n_upper"] / chars, c["n_marks"] / chars]))



@dataclass
class Forest:
    """Trees as arrays: the split feature (-1: leaf), the split value, the left child (the right is next), path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies, under 0.5 for the usual."""
        total = np.zeros(len(x))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] >= value[at]
                at = np.where(inner, child[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(expected_path(self.sample), 1e-9))


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 6) -> Forest:
    random = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(sample, 2)))) + 2
    built = []
    for _ in range(trees if sample else 0):
        nodes = [[-1, 0.0, 0, 0.0]]
        todo = [(0, x[random.choice(len(x), sample, replace=False)], 0)]
        while todo:
            node, rows, level = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0))
            if level >= depth or len(rows) < 2 or not len(spread):
                nodes[node][3] = level + expected_path(len(rows))
                continue
            f = int(random.choice(spread))
            cut = random.uniform(rows[:, f].min(), rows[:, f].max())
            nodes[node][:3] = f, cut, len(nodes)
            todo += [(len(nodes) + k, rows[(rows[:, f] >= cut) == bool(k)], level + 1) for k in (0, 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        built.append(np.array(nodes))
    most = max((len(b) for b in built), default=1)
    padded = np.zeros((len(built), most, 4))
    padded[:, :, 0] = -1
    for k, b in enumerate(built):
        padded[k, : len(b)] = b
    return Forest(padded[:, :, 0].astype(np.int64), padded[:, :, 1], padded[:, :, 2].astype(np.int64), padded[:, :, 3], sample)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_words: int = 20, max_repeat_percent: int = 30, sample_rows: int = 20_000, max_good_loss: float = 0.01, bins: int = 1000) -> DataFrame:
    """Per document: id, the base statistics, base_failed, anomaly (0 to 1) and kept."""
    counts = materialize(document_counts(docs, id_col, text_col), "rule-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    passed = counts.where(~failed)
    # The rows of smallest hash. A cut at twice their expected share keeps what tasks send the driver bounded.
    mark = F.pmod(F.xxhash64("_id", *COUNTS), F.lit(1 << 40))
    cut = min(1.0, 2 * sample_rows / max(1, passed.count()))
    rows = passed.where(mark <= int(cut * (1 << 40))).select(*COUNTS).orderBy(mark, *COUNTS).limit(sample_rows).toPandas()
    forest = grow(rule_statistics({c: rows[c].to_numpy() for c in COUNTS}))
    kept = ["_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rule_statistics({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(np.round(forest.score(x), 9))], names=[*kept, "anomaly"])

    scored = materialize(counts.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in counts.dtypes), "anomaly double"])), "rule-scores")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    seen = scored.where(~failed).join(known, "_id").groupBy(F.floor(F.col("anomaly") * bins).alias("bin")).agg(F.sum(F.col("_label")).alias("good"), F.sum(1 - F.col("_label")).alias("bad")).orderBy("bin").collect()
    threshold = calibrate([(r["bin"] / bins, r["good"], r["bad"]) for r in seen], max_good_loss)
    return scored.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("anomaly") < threshold)).alias("kept"), "anomaly")


def calibrate(counted: list[tuple[float, int, int]], max_good_loss: float) -> float:
    """The least anomaly that is rejected, from (lower edge, good rows, bad rows) per bin; 2 if none should be."""
    good, bad = sum(g for _, g, _ in counted), sum(b for *_, b in counted)
    best, threshold, lost, found = 0.0, 2.0, 0, 0
    for edge, g, b in sorted(counted, reverse=True):
        lost, found = lost + g, found + b
        if good and bad and lost <= max_good_loss * good and found / bad - lost / good > best:
            best, threshold = found / bad - lost / good, edge
    return threshold
