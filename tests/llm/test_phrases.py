"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from fieldlens.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=100, longest=5, top=2000, percent=100):
    """All phrases of every piece, in Python integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        body = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, words[i : i + m]) for i in range(len(words) - m + 1))
    often = {k: a for k, a in f.items() if a >= least}
    covered = set()
    for (lang, words), b in often.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words) and 100 * b >= percent * f[lang, words[i:j]]:
                    covered.add((lang, words[i:j]))
    by_lang = {}
    for (lang, words), a in often.items():
        if len(words) < 2 or (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def listed(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def corpus(seed, docs=60, vocabulary=40):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(vocabulary - 3)] + ["Über", "ÄB", "x" * 70])
    chance = 1 / np.arange(1, vocabulary + 1)
    rows = []
    for i in range(docs):
        body = rng.choice(words, 200, p=chance / chance.sum()).tolist()
        for _ in range(5):
            at = int(rng.integers(0, 190))
            body[at : at + 4] = ["New", "york", "City", "hall"]
            body[int(rng.integers(0, 200))] += str(rng.choice([".", ",", "; ", "!\n", "\x0b", "\t", "?!", ":"]))
        rows.append((["en", "de", None, "und"][i % 4], " ".join(body)))
    return rows


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")

    return make


@pytest.mark.parametrize(
    ("ranks", "tiling"),
    [
        (1 << 18, phrases.Tiling()),
        (7, phrases.Tiling(bits=2, dense_share=0.5)),
        (0, phrases.Tiling()),
        (1000, phrases.Tiling(bits=3, dense_share=1e-9, tasks=1)),
        (3, phrases.Tiling(name_bits=4)),  # first hashes stand for many things, and longer ones are tried
    ],
)
def test_equals_plain_counting(table, ranks, tiling):
    """With all words ranked, with most known by hash only, and with dense tiles and without."""
    rows = corpus(1)
    got = listed(phrases.collocations(table(rows).repartition(3), min_count=8, ranks=ranks, tiling=tiling))
    want = plain(rows, least=8)
    assert len(want) > 100 and got == want


def test_top_and_share(table):
    rows = corpus(2)
    assert listed(phrases.collocations(table(rows), min_count=5, top=7, covered_percent=60, max_words=4)) == plain(rows, 5, 4, 7, 60)


def test_counts_beyond_64_bits(spark):
    """The score of counts whose products need more than 64 bits."""
    row = spark.createDataFrame([(3 * 10**11, 9 * 10**11, 4 * 10**11, 7 * 10**11)], "a bigint, n bigint, l bigint, r bigint")
    score = row.selectExpr(
        "(1000 * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as score"
    ).first()["score"]
    assert score == 1000 * 3 * 10**11 * 9 * 10**11 // (4 * 10**11 * 7 * 10**11)


def test_odd_rows(spark, table, clashing):
    odd = [(None, None), ("en", ""), ("en", " \t \n"), ("de", ".,;"), ("fr", "one two"), ("", "a b a b a b a b"), ("en", "\x00 \x7f" * 9)]
    rows = odd + [("en", "good day " * 50_000)] + [("en", "good day")] * 4
    got = listed(phrases.collocations(clashing(table(rows).withColumn("phrase", phrases.F.lit(1))).repartition(4), min_count=3))
    assert got == plain(rows, 3)
    assert listed(phrases.collocations(table([]))) == []
    assert phrases.collocations(table([])).columns == COLUMNS
    assert listed(phrases.collocations(table(odd))) == []


def test_tiles_count_like_a_counter(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(phrases, "HELD", 150_000)
    tiles, want = phrases.Tiles(), Counter()
    for _ in range(3):
        left, right = (np.minimum(rng.zipf(1.3, 200_000), 200_000).astype(np.int64) - 1 for _ in "lr")
        tiles.add(left, right)
        want.update(zip(left.tolist(), right.tolist()))
    assert tiles._dense and tiles._sparse
    back = phrases.Tiles()
    for bucket, blob in tiles.blobs(7):
        assert 0 <= bucket < 7
        back.add_counted(*phrases._unblob(blob, 8))
    keys, counts = back.counted()
    assert dict(zip(zip(*(x.tolist() for x in back.pairs(keys))), counts.tolist())) == dict(want) and max(counts) > 255


def test_sql_equals_query(spark):
    import duckdb

    from fieldlens.llm import queries

    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(base.execute(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.oracle_sql()})").fetchall())
    assert len(want) > 50 and listed(queries.op11_phrase_mining(spark, folder)) == want
