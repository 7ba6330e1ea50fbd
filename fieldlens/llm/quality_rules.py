"""Quality rules: base thresholds, then gradient-boosted trees over document statistics.

The trees are grown on histograms of a bounded sample of labelled rows with Newton steps of the logistic
loss. On chosen features they are monotonic: a split whose children's values run against the direction is
not made, and the middle of the two values bounds everything below. The trees are then flattened into
node arrays; scoring walks all rows of a batch down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.statistics import COUNTS, FEATURES, count_matrix, features_of, statistics
from fieldlens.session import stored

# More of these never raises the score.
MONOTONIC = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "marks": -1}
# Labelled rows the trees are fitted on at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
# Rows below this probability of the good label are turned away; low, to keep clean documents.
KEEP_ABOVE = 0.2
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30


@dataclass
class Forest:
    """Trees as flat arrays; node 0 of each tree is its root, leaves have feature -1."""

    base: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: int = 0

    def add(self, feature: int = -1, cut: float = 0.0, value: float = 0.0) -> int:
        self.feature.append(feature)
        self.cut.append(cut)
        self.below.append(len(self.below))  # a leaf leads to itself
        self.above.append(len(self.above))
        self.value.append(value)
        return len(self.value) - 1

    def flat(self) -> Forest:
        arrays = {n: np.array(getattr(self, n)) for n in ("roots", "feature", "cut", "below", "above", "value")}
        return Forest(base=self.base, depth=self.depth, **arrays)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(rows), self.base)
        at = np.tile(np.asarray(self.roots, int), (len(rows), 1))
        every = np.arange(len(rows))[:, None]
        feature, cut, below, above = (np.asarray(x) for x in (self.feature, self.cut, self.below, self.above))
        for _ in range(self.depth):
            at = np.where(rows[every, feature[at]] <= cut[at], below[at], above[at])
        return self.base + np.asarray(self.value)[at].sum(axis=1)


def fit_forest(
    rows: np.ndarray, labels: np.ndarray, monotonic: Mapping[int, int], trees: int = 60, depth: int = 3,
    rate: float = 0.2, bins: int = 48, smooth: float = 5.0,
) -> Forest:
    """Grow a forest; without rows of both labels it gives every row the same score."""
    good = float(labels.mean()) if len(labels) else 0.5
    forest = Forest(base=float(np.log((good + 1e-3) / (1 - good + 1e-3))), depth=depth)
    if not len(labels) or not 0 < good < 1:
        return forest.flat()
    cuts = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in rows.T]
    binned = np.column_stack([np.searchsorted(c, column) for c, column in zip(cuts, rows.T)])
    margin = np.full(len(rows), forest.base)

    def grow(at: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, level: int) -> int:
        g, h = grad[at].sum(), hess[at].sum()
        best = (1e-3, -1, 0, 0.0, 0.0)
        for f in range(rows.shape[1]) if level < depth else ():
            width = len(cuts[f]) + 1
            left_g = np.bincount(binned[at, f], grad[at], width).cumsum()[:-1]
            left_h = np.bincount(binned[at, f], hess[at], width).cumsum()[:-1]
            a = np.clip(-left_g / (left_h + smooth), low, high)
            b = np.clip(-(g - left_g) / (h - left_h + smooth), low, high)
            worth = -(left_g * a + 0.5 * (left_h + smooth) * a * a) - ((g - left_g) * b + 0.5 * (h - left_h + smooth) * b * b)
            allowed = (left_h > 1) & (h - left_h > 1) & ((b - a) * monotonic.get(f, 0) >= 0)
            worth = np.where(allowed, worth, -np.inf)
            if len(worth) and worth.max() - _worth(g, h, smooth, low, high) > best[0]:
                k = int(worth.argmax())
                best = (worth[k] - _worth(g, h, smooth, low, high), f, k, a[k], b[k])
        if best[1] < 0:
            return forest.add(value=rate * float(np.clip(-g / (h + smooth), low, high)))
        _, f, k, a, b = best
        node = forest.add(feature=f, cut=float(cuts[f][k]))
        middle, sign = (a + b) / 2, monotonic.get(f, 0)
        goes_below = binned[at, f] <= k
        forest.below[node] = grow(at[goes_below], grad, hess, middle if sign < 0 else low, middle if sign > 0 else high, level + 1)
        forest.above[node] = grow(at[~goes_below], grad, hess, middle if sign > 0 else low, middle if sign < 0 else high, level + 1)
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        start = len(forest.value)
        root = grow(np.arange(len(rows)), p - labels, np.maximum(p * (1 - p), 1e-6), -np.inf, np.inf, 0)
        forest.roots.append(root)
        alone = Forest(roots=[root], depth=depth, **{n: getattr(forest, n) for n in ("feature", "cut", "below", "above", "value")})
        margin += alone.margins(rows)
        if len(forest.value) == start + 1:  # nothing left to split
            break
    return forest.flat()


def _worth(g: float, h: float, smooth: float, low: float, high: float) -> float:
    v = np.clip(-g / (h + smooth), low, high)
    return -(g * v + 0.5 * (h + smooth) * v * v)


def labelled_sample(counted: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled rows, those of the smallest hashes."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("_label is not null and doc_id is not null")
    chosen = counted.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)
    found = chosen.select(*COUNTS, "_label").toArrow()
    counts = np.column_stack([found.column(c).to_numpy() for c in COUNTS])
    return features_of(counts), found.column("_label").to_numpy().astype(float)


def quality_rules(docs: DataFrame, labels: DataFrame, keep_above: float = KEEP_ABOVE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base rule and verdict of every row.

    Returns doc_id, the counts, base_failed (fewer than 20 words, or over 30 % of the words in repeated
    8-word windows), quality (probability of the good label) and kept: not base_failed and quality at
    least ``keep_above``. ``labels`` has doc_id and quality; rows with nulls in them are not learned
    from. Null and empty texts have zero counts and fail the base rule. Repeated rows are each
    answered; other columns are not read; an empty table gives an empty result, and without labels of
    both kinds the verdict is the base rule alone.
    """
    # Narrow, and read twice: for the sample and for the scores.
    counted = stored(statistics(docs), "statistics")
    rows, good = labelled_sample(counted, labels, "quality", sample_rows)
    forest = fit_forest(rows, good, {FEATURES.index(f): sign for f, sign in MONOTONIC.items()})
    decide = bool(len(forest.roots))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_matrix(batch)
            c = {name: counts[:, i] for i, name in enumerate(COUNTS)}
            quality = 1 / (1 + np.exp(-forest.margins(features_of(counts))))
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
            kept = ~failed & ((quality >= keep_above) | (not decide))
            names = [*batch.schema.names, "base_failed", "quality", "kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (failed, quality, kept))], names)

    schema = ", ".join(f"{n} {t}" for n, t in counted.dtypes)
    return counted.mapInArrow(task, f"{schema}, base_failed boolean, quality double, kept boolean")
