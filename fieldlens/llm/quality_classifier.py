"""Quality classifier: kernel ridge scores by random Fourier features, with isotonic calibration.

Document statistics are standardised and mapped to random cosine features, whose inner products
approximate a Gaussian kernel. Every partition sums the normal equations of its labelled rows; the sums
are added up by Spark and one small system is solved for the ridge weights. The raw scores of all learning
rows are then counted by bins, and a non-decreasing step function of the score is fitted to the share of
good labels, which makes the score a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import fold
from fieldlens.llm.statistics import COUNTS, FEATURES, count_matrix, counts_of, features_of, statistics
from fieldlens.session import stored

FOLDS = 5  # fold 0 is held out
COSINES = 192
KERNEL_WIDTH = 3.0  # in standard deviations of the statistics
RIDGE = 1.0
BINS = 400
PREDICT_ABOVE = 0.3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None  # None: nothing to learn from
    edges: np.ndarray | None = None  # raw scores at the middle of the calibration blocks
    levels: np.ndarray | None = None
    prior: float = 0.5

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(17)
        spread = rng.normal(size=(len(FEATURES), COSINES)) / KERNEL_WIDTH
        phase = rng.uniform(0, 2 * np.pi, COSINES)
        waves = np.sqrt(2 / COSINES) * np.cos(self.standard(rows) @ spread + phase)
        return np.column_stack([np.ones(len(rows)), waves])

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros(len(rows)) if self.weights is None else self.cosines(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.prior)
        return np.interp(self.raw(rows), self.edges, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, w, n = pools.pop()
            u, x, m = pools[-1]
            pools[-1] = [(u * x + v * w) / (x + w), x + w, m + n]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else values


def _sums(learning: DataFrame, task, parts: int) -> dict[tuple[int, int], float]:
    """Add up the (i, j, value) entries that each partition makes."""
    entries = learning.repartition(parts).mapInArrow(task, "i int, j int, value double")
    return {(r.i, r.j): r.v for r in entries.groupBy("i", "j").agg(F.sum("value").alias("v")).collect()}


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(matrix)
    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(matrix[i, j])]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield features_of(count_matrix(batch)), batch.column("label").to_numpy().astype(float)


def fit(learning: DataFrame, parts: int) -> Model:
    """Fit on all rows of ``learning``: COUNTS and label (0 or 1). Three passes over narrow rows.

    What reaches the driver is a matrix of COSINES + 2 rows and columns, and BINS counts.
    """
    width = len(FEATURES)

    def moments(batches):
        total = np.zeros((3, width + 1))
        for rows, label in _labelled(batches):
            total[0] += [*rows.sum(0), len(rows)]
            total[1] += [*(rows**2).sum(0), label.sum()]
        yield _entries(total)

    first = _sums(learning, moments, parts)
    n, good = first.get((0, width), 0.0), first.get((1, width), 0.0)
    if not 0 < good < n:
        return Model(np.zeros(width), np.ones(width), prior=good / n if n else 0.5)
    mean = np.array([first.get((0, i), 0.0) for i in range(width)]) / n
    square = np.array([first.get((1, i), 0.0) for i in range(width)]) / n
    model = Model(mean, np.sqrt(np.maximum(square - mean**2, 1e-12)), prior=good / n)
    size = COSINES + 1

    def normal(batches):
        total = np.zeros((size + 1, size))
        for rows, label in _labelled(batches):
            waves = model.cosines(rows)
            total[:size] += waves.T @ waves
            total[size] += label @ waves
        total[:size] = np.triu(total[:size])
        yield _entries(total)

    system = np.zeros((size + 1, size))
    for (i, j), value in _sums(learning, normal, parts).items():
        system[i, j] = value
    gram = system[:size] + np.triu(system[:size], 1).T
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(size), system[size])

    def binned(batches):
        total = np.zeros((BINS, 2))
        for rows, label in _labelled(batches):
            at = np.clip(((model.raw(rows) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total[:, 0] += np.bincount(at, minlength=BINS)
            total[:, 1] += np.bincount(at, label, minlength=BINS)
        yield _entries(total)

    counts = np.zeros((BINS, 2))
    for (i, j), value in _sums(learning, binned, parts).items():
        counts[i, j] = value
    used = np.flatnonzero(counts[:, 0])
    model.edges = (used + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(counts[used, 1] / counts[used, 0], counts[used, 0])
    return model


def _model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    counted = stored(statistics(docs), "statistics")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    learning = counted.where(fold(F.col("doc_id"), FOLDS) > 0).join(known, "doc_id").select(*COUNTS, "label")
    learning = stored(learning, "learning")
    rows_per_part = 20_000
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), learning.count() // rows_per_part))
    return counted, fit(learning, parts)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Learns from rows of folds 1 to 4 (CRC-32 of doc_id as text, modulo 5) whose label in ``labels`` is 0
    or 1; a row without id is neither held out nor learned from. ``score`` is the probability of label
    1; null and empty texts are scored by their zero counts. Without labels of both kinds the score is
    the share of good labels, or 0.5. Repeated rows are each answered; other columns are not read; an
    empty table gives an empty result.
    """
    counted, model = _model(docs, labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(model.scores(features_of(count_matrix(batch))), 0, 1)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= PREDICT_ABOVE).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = counted.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), *COUNTS)
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns.

    Rows are judged where they are, so the texts are not shuffled, and repeated rows or ids need no join.
    """
    _, model = _model(docs, labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = ((t.as_py() or "").encode("utf-8") for t in batch.column("text"))
            counts = np.array([counts_of(b) for b in bodies], np.int64).reshape(-1, len(COUNTS))
            yield batch.filter(pa.array(model.scores(features_of(counts)) >= PREDICT_ABOVE))

    return docs.mapInArrow(task, docs.schema)
