"""SimHash near duplicates against all pairs."""

import numpy as np
import pytest
import xxhash

from fieldlens.llm import simhash


def plain_fingerprint(text, words=4):
    split = (text or "").encode().lower().split()
    if not split:
        return 0
    shingles = [b" ".join(split[i : i + words]) for i in range(max(len(split) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """Smallest id reachable over all pairs of (id, fingerprint)."""
    ids = sorted(rows)
    values = np.array([rows[i] for i in ids], np.uint64)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for at, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[at]) <= radius).tolist():
            a, b = sorted((root(i), root(ids[j])))
            label[b] = a
    return {i: root(i) for i in ids}


def found(df):
    return {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in df.collect()}


def near_values(rng, centres, copies, most):
    """Random fingerprints, and copies of each with up to ``most`` bits changed, by chains too."""
    out = set()
    for centre in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        last = centre
        out.add(last)
        for _ in range(copies):
            changed = centre if rng.random() < 0.5 else last
            for p in rng.choice(64, rng.integers(1, most + 1), replace=False).tolist():
                changed ^= 1 << p
            out.add(changed)
            last = changed
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 3, 4])
@pytest.mark.parametrize("large", [1 << 15, 20])
def test_links_equal_all_pairs(spark, radius, large):
    rng = np.random.default_rng(radius)
    values = near_values(rng, 40, 40, radius + 2)
    rows = [(i, int(np.uint64(v).view(np.int64))) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "node bigint, fingerprint bigint")
    label = simhash.components(simhash.links(nodes, radius, large))
    got = {i: i for i in range(len(values))} | {r.id: r.label for r in label.collect()}
    assert got == plain_components(dict(enumerate(values)), radius)


def test_bit_sliced_equals_counted():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, (3, 64), dtype=np.uint64)
    values[1] = values[0, 0] ^ (np.uint64(1) << rng.integers(0, 64, 64, dtype=np.uint64))
    planes = simhash.bit_planes(values)
    word, query = np.array([0, 1, 2, 1]), np.array([values[0, 0]] * 3 + [values[2, 0]])
    for radius in (0, 1, 2, 4, 7, 30):
        got = simhash.within_radius(planes, word, query, radius)
        for row in range(4):
            near = np.bitwise_count(values[word[row]] ^ query[row]) <= radius
            assert [bool(int(got[row]) >> t & 1) for t in range(64)] == near.tolist()


def test_dense_bucket_is_one_forest():
    """Thousands of fingerprints that all are within the radius of a chain."""
    rng = np.random.default_rng(2)
    values = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 40, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 3000, dtype=np.uint64)))
    a, b = simhash.linked_in_buckets(np.array([len(values)]), values, 4)
    assert len(a) == len(values) - 1 and set(b.tolist()) == {0}


def test_documents_equal_brute_force(spark, documents):
    texts = [
        None, "", " \t\n", "one", "One  two three", "one two three four", "ONE two three four five", "one two three four five six",
        "É one two\x0bthree", "x " * 9, "x " * 10,
    ]
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    for _ in range(30):
        body = rng.choice(words, 300).tolist()
        texts.append(" ".join(body))
        for _ in range(3):
            body[int(rng.integers(0, 300))] = "changed"
            texts.append(" ".join(body))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(9000, texts[20])]
    got = found(simhash.simhash_duplicates(documents(rows)))
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == plain_components(want)
    assert got[1][1] == got[4][1] == got[7][1] == 1  # null, empty and blank are linked


def test_odd_rows(spark, documents, clashing):
    assert simhash.simhash_duplicates(documents([])).count() == 0
    long = "alpha beta gamma delta epsilon " * 40_000
    rows = [(5, long), (4, long), (4, long), (None, long), (None, None), (7, "other text of no use at all")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_duplicates(clashing(documents(rows))).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (4, 4), (None, None), (None, None), (7, 7)], key=str)


def test_query_equals_brute_force(spark):
    from fieldlens.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = found(queries.op13_simhash_dedup(spark, folder))
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == plain_components(want)
