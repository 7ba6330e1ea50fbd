"""Centroid clustering against plain distances."""

import hashlib
import math

import numpy as np
import pytest

from fieldlens.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, clusters=16, rounds=3, dimensions=64):
    """By all distances, in Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    firsts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    at = [v for _, v in firsts]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in at]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        target = [c for _, c in assign()]
        for c in range(len(at)):
            own = [v for (_, v), t in zip(kept, target) if t == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own)]
    last = assign()
    inertia = [sum(d for d, t in last if t == c) for c in range(len(at))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia), shas[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def listed(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(seed, n, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (12, 64))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(0, 12)] + rng.normal(0, spread, 64)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_equals_all_distances(spark, spread):
    rows = vectors(3, 400, spread)
    notes = []
    got = listed(centroids.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5), notes=notes))
    assert got == plain(rows)
    assert [n["read"] for n in notes] == [400] * 3 and notes[0]["fetched"] == 400
    if spread == 0.02:  # far apart: bounds decide, and few vectors are fetched
        assert notes[2]["fetched"] < 200


def test_bounds_hold():
    rng = np.random.default_rng(1)
    numbers = rng.integers(-60, 60, (500, 7))
    numbers[:, 3] = 5  # one cell only
    cells = centroids.Cells(numbers.mean(0), numbers.std(0), numbers.min(0), numbers.max(0))
    at = rng.integers(-90, 90, (9, 7))
    codes = cells.codes(numbers)
    least, most = cells.tables(at)
    exact = centroids.exact_distances(numbers, at)
    low = sum(least[b][codes[:, b]] for b in range(codes.shape[1]))
    high = sum(most[b][codes[:, b]] for b in range(codes.shape[1]))
    assert (low <= exact).all() and (exact <= high).all()
    assert (exact == ((numbers[:, None, :] - at[None]) ** 2).sum(2)).all()


def test_ties_copies_and_odd_vectors(spark):
    some = vectors(5, 30)
    nan, inf = float("nan"), float("inf")
    odd = [
        (100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.5] * 63), (105, [nan] + [0.5] * 63),
        (106, [-inf] + [0.5] * 63), (None, some[4][1]), (107, some[7][1]), (7, some[7][1]), (7, some[7][1]),
        (108, [0.0] * 64), (109, [0.0] * 64), (110, [-0.0] * 64),
    ]
    rows = some + odd + [(i, some[0][1]) for i in range(200, 260)]
    assert listed(centroids.clustered(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_few_vectors_and_none(spark, clashing):
    rows = vectors(6, 5)
    table = spark.createDataFrame(rows, SCHEMA)
    got = listed(centroids.clustered(table))
    assert got == plain(rows) and {r[1] for r in got} == set(range(5))
    assert listed(centroids.clustered(clashing(table).withColumn("cluster", centroids.F.lit("x")).withColumn("code", centroids.F.lit(1)))) == got
    assert listed(centroids.clustered(table.where("vec_id < 0"))) == []
    assert centroids.clustered(table.where("vec_id < 0")).columns == centroids.clustered(table).columns


def test_huge_components(spark):
    rows = vectors(8, 20) + [(50, [3e38] * 64), (51, [-3e38] * 64), (52, [3e38] * 32 + [0.0] * 32)]
    got = listed(centroids.clustered(spark.createDataFrame(rows, SCHEMA)))
    clipped = [(i, [max(min(x, 2.0**21), -(2.0**21)) for x in v]) for i, v in rows]
    assert got == plain(clipped)


def test_sql_equals_query(spark):
    import duckdb

    from fieldlens.llm import queries

    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cursor = base.execute(centroids.oracle_sql())
    names = [c[0] for c in cursor.description]
    order = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()), key=str)
    assert listed(queries.op12_centroid_clustering(spark, folder)) == want
