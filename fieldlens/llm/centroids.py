"""Centroid clustering over a vector approximation file.

Vectors are integers per component. Beside each stands its approximation: the cell it lies in, of a few per
dimension, four bits each. For a set of centroids, tables give the least and the largest squared distance
between a cell and a centroid, so adding up table entries by a vector's cells bounds its distance to every
centroid. Where only one centroid's interval reaches below all upper bounds, the vector belongs to it
without being looked at. Full vectors are fetched where intervals overlap, and where a vector may have
changed its centroid, for the sums that move the centroids. Sums are kept and changed by the vectors that moved.

All numbers are integers, so results do not depend on partitions or order. What leaves the tasks in a round is
one sum per centroid and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.session import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
START = "1:"
CELL_BITS = 4  # so that a byte has two dimensions
# Larger components count as this, so that every distance fits a long.
LARGEST = 1 << 27
_ROWS = 4096  # bounded at a time


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and vector, integers floor(scale * x), of the rows whose vector is whole."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size(x) == dimensions) & finite)

    def number(v):
        bounded = F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v.cast("double") * scale))
        return F.floor(bounded).cast("int")

    return kept.select("vec_id", F.transform(x, number).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int, start: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``start`` and their id, in that order; ties by components."""
    named = vectors.where("vec_id is not null").withColumn("_hash", F.sha2(F.concat(F.lit(start), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy("_hash", "vector").limit(clusters).select("vector").collect()  # ``clusters`` rows at most
    return np.array([r.vector for r in rows], np.int64)


class Cells:
    """Cells per dimension: upper[d, c] is the largest number in cell c, lower[d, c] the smallest."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = CELL_BITS):
        n = 1 << bits
        # As if the numbers were normally distributed, all cells hold equally many. Any cuts are right.
        quantiles = np.array([NormalDist().inv_cdf(i / n) for i in range(1, n)])
        cuts = np.floor(mean[:, None] + deviation[:, None] * quantiles).astype(np.int64)
        cuts = np.clip(cuts, low[:, None], high[:, None])
        self.cuts = cuts
        self.upper = np.concatenate([cuts, high[:, None]], axis=1)
        self.lower = np.concatenate([low[:, None], np.minimum(cuts + 1, high[:, None])], axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Two dimensions' cells per byte."""
        cell = np.empty(vectors.shape, np.uint8)
        for d in range(vectors.shape[1]):
            cell[:, d] = np.searchsorted(self.cuts[d], vectors[:, d], side="left")
        if cell.shape[1] % 2:
            cell = np.pad(cell, ((0, 0), (0, 1)))
        return cell[:, 0::2] | (cell[:, 1::2] << CELL_BITS)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distances by byte of the code, its value, and centroid."""
        below = self.lower[:, :, None] - centroids.T[:, None, :]
        above = centroids.T[:, None, :] - self.upper[:, :, None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(below**2, above**2)
        if len(least) % 2:
            least, most = (np.concatenate([t, np.zeros_like(t[:1])]) for t in (least, most))
        value = np.arange(256)
        one, two = value & 15, value >> CELL_BITS
        return least[0::2][:, one] + least[1::2][:, two], most[0::2][:, one] + most[1::2][:, two]


def exact_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of the two."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # Products by floating point while every sum is an exact integer there.
    kind = np.float64 if 4 * vectors.shape[1] * largest**2 < 1 << 53 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v**2).sum(1)[:, None] - 2 * (v @ c.T) + (c**2).sum(1)[None, :]).astype(np.int64)


class Assigner:
    """Nearest centroids by bounds; ``fetch`` gives the full vectors of the rows asked for."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self._centroids = centroids
        self._least, self._most = cells.tables(centroids)

    def bounded(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid with the smallest lower bound, and which centroids are possible."""
        least = np.zeros((len(codes), len(self._centroids)), np.int64)
        most = np.zeros_like(least)
        for at in range(codes.shape[1]):
            least += self._least[at][codes[:, at]]
            most += self._most[at][codes[:, at]]
        return least.argmin(1), least <= most.min(1)[:, None]

    def nearest(self, codes: np.ndarray, fetch) -> tuple[np.ndarray, int]:
        """The nearest centroid of each row (ties: the smaller number), and how many rows were fetched."""
        cluster, possible = self.bounded(codes)
        open_ = np.flatnonzero(possible.sum(1) > 1)
        if len(open_):
            distance = exact_distances(fetch(open_), self._centroids)
            distance[~possible[open_]] = np.iinfo(np.int64).max
            cluster[open_] = distance.argmin(1)
        return cluster, len(open_)


def _numbers(column: pa.Array, rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Full vectors of some rows of a binary column."""
    taken = column.take(pa.array(rows))
    return np.frombuffer(b"".join(taken.to_pylist()), "<i4").reshape(len(rows), dimensions).astype(np.int64)


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _cells_of(vectors: DataFrame, dimensions: int) -> Cells | None:
    """Cells that fit the numbers of all vectors: one row per dimension comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        low, high = np.full(dimensions, LARGEST, np.int64), np.full(dimensions, -LARGEST, np.int64)
        for batch in batches:
            numbers = batch.column("vector").flatten().to_numpy().reshape(-1, dimensions)
            if not len(numbers):
                continue
            n += len(numbers)
            total += numbers.sum(0, dtype=np.float64)
            squares += (numbers.astype(np.float64) ** 2).sum(0)
            low, high = np.minimum(low, numbers.min(0)), np.maximum(high, numbers.max(0))
        if n:
            columns = [np.arange(dimensions), np.full(dimensions, n), total, squares, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "n", "total", "squares", "low", "high"])

    parts = vectors.select("vector").mapInArrow(task, "d bigint, n bigint, total double, squares double, low bigint, high bigint")
    whole = parts.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(whole.collect())
    if not rows:
        return None
    n, total, squares, low, high = (np.array([r[c] for r in rows]) for c in ("n", "total", "squares", "low", "high"))
    mean = total / n
    return Cells(mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), low, high)


def _approximated(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vec_id, code and vector, the last two as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = cells.codes(numbers)
            columns = [[row.tobytes() for row in codes], [row.tobytes() for row in numbers.astype("<i4")]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c, pa.binary()) for c in columns)], ["vec_id", "code", "vector"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(task, f"vec_id {kind}, code binary, vector binary")


def _moved(table: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Change of the counts and sums of the clusters from one set of centroids to the next.

    Without ``before`` nothing was assigned. Also how many rows were read and fetched.
    """
    dimensions, width = now.shape[1], (now.shape[1] + 1) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        old, new = Assigner(cells, before) if before is not None else None, Assigner(cells, now)
        read = fetched = 0
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                codes, vectors = _codes(batch.column("code"), width), batch.column("vector")

                def fetch(rows: np.ndarray, vectors: pa.Array = vectors) -> np.ndarray:
                    return _numbers(vectors, rows, dimensions)

                target, open_ = new.nearest(codes, fetch)
                source = np.full(len(target), -1)
                if old is not None:
                    source, more = old.nearest(codes, fetch)
                    open_ = max(open_, more)
                moved = np.flatnonzero(target != source)
                read, fetched = read + len(target), fetched + max(open_, len(moved))
                numbers = fetch(moved)
                np.add.at(sums, target[moved], numbers)
                count += np.bincount(target[moved], minlength=len(count))
                if old is not None:
                    np.subtract.at(sums, source[moved], numbers)
                    count -= np.bincount(source[moved], minlength=len(count))
        table = np.concatenate([sums, count[:, None]], axis=1)
        cluster, d = (i.reshape(-1) for i in np.indices(table.shape))
        columns = [np.append(cluster, [-1, -1]), np.append(d, [0, 1]), np.append(table.reshape(-1), [read, fetched])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "d", "n"])

    parts = table.select("code", "vector").mapInArrow(task, "cluster bigint, d bigint, n bigint")
    rows = parts.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # clusters x dimensions
    count, sums = np.zeros(len(now), object), np.zeros(now.shape, object)
    done = {"read": 0, "fetched": 0}
    for r in rows:
        if r.cluster < 0:
            done["fetched" if r.d else "read"] = int(r.n)
        elif r.d < dimensions:
            sums[r.cluster, r.d] = int(r.n)
        else:
            count[r.cluster] = int(r.n)
    return count, sums, done


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    start: str = START,
    notes: list[dict[str, int]] | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector.

    Vectors with another number of components than ``dimensions``, or with a null or non-finite one, are left
    out. Repeated rows are vectors of their own; rows without id are assigned but never first centroids. Equal
    distances go to the smaller number, so of equal first centroids the later ones stay empty and keep
    their place. Fewer vectors than clusters: as many clusters as vectors. Components beyond 2^27 after
    scaling count as 2^27, so that distances fit a long; an inertia that does not is null. An empty
    table gives an empty result. Other columns are not read. ``notes`` takes rows read and fetched by round.
    """
    whole = stored(whole_vectors(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(whole, clusters, start)
    cells = _cells_of(whole, dimensions)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    if cells is None or not len(centroids):
        empty = whole.sparkSession.createDataFrame([], schema)
        long = F.lit(None).cast("bigint")
        return empty.withColumns({"cluster_inertia": long, "inertia": long, "centroid_sha256": F.lit(None).cast("string")})
    table = stored(_approximated(whole, cells), "approximations")
    count, sums = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
    before = None
    for _ in range(rounds):
        more, change, done = _moved(table, cells, before, centroids)
        if notes is not None:
            notes.append(done)
        count, sums = count + more, sums + change
        before, centroids = centroids, centroids.copy()
        for c in range(len(centroids)):
            if count[c]:
                centroids[c] = [s // count[c] for s in sums[c]]
    width = (dimensions + 1) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(cells, centroids)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                # The distance is part of the result, so here every vector is fetched, for one centroid.
                numbers = _numbers(batch.column("vector"), np.arange(batch.num_rows), dimensions)
                cluster, _ = assigner.nearest(_codes(batch.column("code"), width), numbers.__getitem__)
                distance = ((numbers - centroids[cluster]) ** 2).sum(1)
                columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(task, schema), "assigned")
    parts = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # one row per cluster
    inertia = {r.cluster: int(r.n) for r in parts}

    def long(n: int) -> int | None:
        return n if n < 1 << 63 else None

    total = long(sum(inertia.values()))
    described = [
        (c, long(inertia.get(c, 0)), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
    ]
    fields = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    by_cluster = whole.sparkSession.createDataFrame(described, fields)
    return assigned.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, start: str = START) -> str:
    """The same by all distances, for unique ids."""
    steps = [
        f"""whole AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
comps AS (
  SELECT vec_id, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM whole, range(1, {dimensions + 1}) r(i)),
firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{start}' || vec_id)) - 1 AS c FROM whole
  QUALIFY c < {clusters}),
c0 AS (SELECT c, i, x AS m FROM firsts JOIN comps USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM comps JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM comps JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS (
  SELECT c, i, CAST(CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS m
  FROM c{r} LEFT JOIN s{r} USING (c, i))"""
            )
    return f"""WITH {', '.join(steps)},
shas AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN shas USING (c)"""
