"""Near duplicates against all pairs, and the parts they are made of."""

import random

import numpy as np
import pytest

from fieldlens.llm import near_dedup
from tests.conftest import listed


def plain(rows, words, percent):
    sets, ids = {}, []
    for doc_id, text in rows:
        own = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
        found = {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()
        ids.append((doc_id, len(found)))
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(found)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(i, n, None if i is None else top(i), i is None or top(i) == i) for i, n in ids]


def corpus(seed, size=140):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=40)
    rows = []
    bases = [draw.choices(vocabulary, k=draw.choice([3, 8, 30, 90, 200])) for _ in range(12)]
    for i in range(size):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 8])):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        if draw.random() < 0.3:
            text = text[:60] + passage
        rows.append((i * 7 % 1009, draw.choice([" ", "\n", "\t"]).join(text)))
    return rows


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 85), (2, 5, 80)])
def test_components_equal_all_pairs(documents, clashing, seed, words, percent):
    rows = corpus(seed)
    odd = [(5001, None), (5002, ""), (5003, " \n"), (5004, "One two"), (5005, "oNE  TWO"), (5006, "x"), (5006, "x"), (None, "One two"), (5007, "long word " * 9000), (5008, "long word " * 8999)]
    mine = listed(near_dedup.near_duplicates(clashing(documents(rows + odd)), words, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(mine, key=str) == sorted(plain(rows + odd, words, percent), key=str)


def templates():
    """One text with four slots of 1200 words: linked are those that agree in a slot, 0.84 alike the others."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for doc_id in range(600):
        text = list(base)
        for at in (20, 50, 80, 110):
            text[at] = f"s{draw.randrange(1200)}"
        rows.append((doc_id * 7 % 1009, " ".join(text)))
    return rows


def test_slot_templates_equal_all_pairs(documents):
    rows = templates()
    found = listed(near_dedup.near_duplicates(documents(rows), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(found) == sorted(plain(rows, 3, 85))


def test_repeated_ids(documents):
    rows = [(1, "one two"), (2, "one two"), (2, "p q r s"), (3, "P q r s"), (2, "alone here")]
    found = listed(near_dedup.near_duplicates(documents(rows)), "doc_id", "component_id")
    assert found == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2)]


def test_empty_and_filter(documents, clashing):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    table = clashing(documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "")]))
    left = near_dedup.without_near_duplicates(table)
    assert left.columns == table.columns
    assert sorted(listed(left, "doc_id"), key=str) == sorted([(1,), (3,), (4,), (None,)], key=str)


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(900, i) for i in range(300, 340)] + [(draw.randrange(50), draw.randrange(50)) for _ in range(30)] + [(7, 7)]
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = dict(listed(near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "label"))
    assert all(found[x] == up[x] for e in edges if e[0] != e[1] for x in e)
    assert near_dedup.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")) is None


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    for size in (400, 30):
        agree, truth = [], []
        for _ in range(60):
            whole = np.unique(rng.integers(0, 1 << 63, size * 2, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(whole[: int(size * 1.6)]), np.sort(whole[int(size * 0.3) :])
            agree.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
            truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree) - np.mean(truth)) < 0.05


def test_candidates_are_stars(spark):
    members = spark.createDataFrame(
        [(1, n, False, n, 10 if n == 4 else 1) for n in range(2, 30)], "key bigint, node bigint, served boolean, label bigint, popularity int"
    )
    stars = near_dedup._stars(members)
    assert stars.count() == 28 and {r.hub for r in stars.collect()} == {4}
