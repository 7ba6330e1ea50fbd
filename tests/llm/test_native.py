"""Exact duplicates, shards and licences on small cases and against plain Python."""

import hashlib
import re
import zlib

import pytest

from fieldlens.llm import exact_dedup, licences, sharding
from tests.conftest import listed

LONG = "word " * 4000
CASES = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (7, "a b "), (8, None), (2, ""), (1, LONG), (4, LONG), (6, LONG + "x"),
    (10, "é" * 3000), (11, "é" * 3000), (12, "é" * 2999 + "e"), (13, " "), (None, "a b"), (14, LONG + LONG),
]


def plain_exact(rows):
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(body, []).append((doc_id is None, doc_id or 0, at, doc_id))
    return {
        at: (doc_id, min(g)[3], len(g), (none, d, at, doc_id) == min(g), hashlib.sha256(body.encode()).hexdigest())
        for body, g in groups.items()
        for none, d, at, doc_id in g
    }


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_duplicates(documents, clashing, block):
    mine = listed(exact_dedup.exact_duplicates(clashing(documents(CASES)), block), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(mine, key=str) == sorted(plain_exact(CASES).values(), key=str)


def test_exact_repeated_rows_and_empty(documents, clashing):
    rows = [(1, "x"), (1, "x"), (2, "x"), (3, None), (3, None)]
    found = exact_dedup.exact_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.kept) for r in found) == [(1, False), (1, True), (2, False), (3, False), (3, True)]
    left = exact_dedup.without_duplicates(clashing(documents(rows)))
    assert listed(left, "doc_id", "text") == [(1, "x"), (3, None)]
    assert left.columns == clashing(documents(rows)).columns
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    from pyspark.sql import functions as F

    cells = spark.range(1 << dims * bits).select(
        *[F.expr(f"cast((id >> {bits * j}) & {(1 << bits) - 1} as int)").alias(f"c{j}") for j in range(dims)]
    )
    rows = cells.select("*", sharding.hilbert_index([F.col(f"c{j}") for j in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[f"c{j}"] - b[f"c{j}"]) for j in range(dims)) == 1


def test_shards(documents, clashing):
    rows = [(i, "t" * (i % 37), ["en", "de", None][i % 3], None if i % 5 == 0 else f"src{i % 7}") for i in range(101)]
    rows += [(None, None), (4, "tttt", "de", "src4")]
    found = sharding.sharded(clashing(documents(rows))).collect()
    assert len(found) == len(rows)
    per = {}
    for r in found:
        per.setdefault(r.shard, []).append(r)
    assert sorted(per) == list(range(8)) and {len(p) for p in per.values()} <= {12, 13}
    for part in per.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    ends = sorted((min(r.curve for r in p), max(r.curve for r in p)) for p in per.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    by_id = {r.doc_id: r for r in found}
    assert by_id[10].size == 11 and by_id[10].text_crc32 == zlib.crc32(b"t" * 10) and by_id[None].size == 1
    assert sharding.sharded(documents([])).count() == 0


def plain_cells(values, bits):
    """Cells by counting the values below each."""
    def less(a, b):
        return b is not None and (a is None or a < b)

    return [0 if v is None else sum(less(u, v) for u in values) * (1 << bits) // len(values) for v in values]


def test_cells_of_texts_that_share_a_beginning(documents):
    names = [f"common_crawl_{y}" for y in range(2012, 2025)] + ["a", "zzz", None, "common_crawl"]
    rows = [(i, "t", None, names[(i + i // 40) % 17]) for i in range(400)]
    docs = documents(rows)
    cells = sharding.quantised(docs, ["source"], 5)
    found = [(r.doc_id, r.cell) for r in docs.select("doc_id", cells[0].alias("cell")).collect()]
    assert sorted(found) == list(enumerate(plain_cells([r[3] for r in rows], 5)))
    assert len({c for _, c in found}) > 12


def test_sharding_equals_brute_force(spark):
    """The whole query: cells, places in order, shards and slots."""
    from fieldlens.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    columns = [plain_cells([v if v is None or isinstance(v, int) else v.encode() for v in (r[c] for r in rows)], 5) for c in ("source", "lang", "n_chars")]
    found = {r.doc_id: r for r in queries.op8_sharding(spark, folder).collect()}
    order = sorted((found[r.doc_id].curve, r.doc_id) for r in rows)
    n = len(rows)
    assert len(found) == n
    for rank, (_, doc_id) in enumerate(order):
        shard = rank * 8 // n
        assert (found[doc_id].shard, found[doc_id].slot) == (shard, rank - -(-shard * n // 8))
    # One curve for all: points with equal cells have one place, others different ones.
    point = {r.doc_id: p for r, p in zip(rows, zip(*columns))}
    assert len({(point[i], found[i].curve) for i in found}) == len(set(point.values())) == len({found[i].curve for i in found})
    for r in rows:
        assert found[r.doc_id].size == len((r.text or "").encode()) + 1 and found[r.doc_id].text_crc32 == zlib.crc32((r.text or "").encode())


def test_write_shards(spark, documents, tmp_path):
    rows = [(i, "t" * i, "en", f"src{i % 4}") for i in range(40)] + [(None, None)]
    sharding.write_shards(documents(rows), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 41 and back.select("_shard").distinct().count() == 8


def test_licences(spark, documents, clashing):
    mit = dict((k, v) for k, v in reversed(licences.KNOWN) if len(v) > 500)["MIT"]
    rows = [
        (1, "Some text.\n  RELEASED under the MIT licence!\nmore"),
        (2, mit.replace("Copyright (c) [year] [fullname]", "copyright 2020 Some One").replace(", ", " ,\n ")),
        (3, "Released under the MIT License. And more."),
        (4, None), (5, ""), (6, "...\n\n"), (7, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (7, "Licensed under CC BY-NC 4.0."), (None, "GPLv3\n" * 3),
    ]
    found = listed(licences.licence_scan(clashing(documents(rows)), licences.known_digests(spark)), "doc_id", "whole_licence", "licences", "n_notices")
    assert sorted(found, key=str) == sorted(
        [
            (1, None, "MIT", 1), (2, "MIT", "MIT", 0), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0),
            (7, None, "Apache-2.0,CC-BY-NC-4.0", 2), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (None, None, "", 0),
        ],
        key=str,
    )
    assert licences.licence_scan(documents([]), licences.known_digests(spark)).count() == 0
    # The shuffled join gives the same.
    licences.BROADCAST_ROWS, before = 0, licences.BROADCAST_ROWS
    try:
        assert listed(licences.licence_scan(documents(rows), licences.known_digests(spark)), "doc_id", "whole_licence", "licences", "n_notices") == found
    finally:
        licences.BROADCAST_ROWS = before


def test_whole_licence_texts(spark, documents):
    folder = "/usr/share/common-licenses"
    named = {
        "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
        "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
    }
    texts = [(name, open(f"{folder}/{file}", encoding="utf-8").read()) for file, name in named.items()]
    data = {n: t for n, t in licences.KNOWN if n.startswith("BSD-") and t.startswith("BSD") and "\n\n" in t}
    assert len(data) == 2
    rows, expected = [], []
    for name, text in texts + sorted(data.items()):
        lined = re.sub(r"\n[ \t]*\n", "\n\n\n", text).replace("\n", " \r\n")
        flowed = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
        other = re.sub(r"(?m)^([ \t]*)Copyright \(c\) .*$", r"\1Copyright 2021 Some One Else", text, flags=re.I)
        for body in (text, text.upper(), other, lined, flowed, text + "\nand more"):
            expected.append((len(rows), None if body.endswith("more") else name))
            rows.append((len(rows), body))
    found = licences.licence_scan(documents(rows), licences.known_digests(spark))
    assert sorted((r.doc_id, r.whole_licence) for r in found.collect()) == expected


def test_whole_licences_at_any_width(spark, documents):
    """Every stored text with its lines broken anew, at all widths from 50 to 120."""
    import textwrap

    whole = [(n, t) for n, t in licences.KNOWN if len(t) > 500]
    assert len(whole) >= 20
    rows, expected = [], []
    for name, text in whole:
        paragraphs = re.split(r"\n\s*\n", text)
        for width in range(50, 121):
            body = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)
            rows.append((len(rows), body))
            expected.append(name)
    found = {r.doc_id: r.whole_licence for r in licences.licence_scan(documents(rows), licences.known_digests(spark)).collect()}
    texts = {}
    for name, text in whole:  # the same words under two names go by the last
        texts.setdefault(" ".join(re.findall(r"[a-z0-9]+", text.lower())), []).append(name)
    missed = [(name, i % 71 + 50) for i, name in enumerate(expected) if found[i] is None]
    assert missed == [] and sum(found[i] == name for i, name in enumerate(expected)) == len(rows)


def test_other_holder_at_any_width(spark, documents):
    import textwrap

    mit = max((t for n, t in licences.KNOWN if n == "MIT"), key=len)
    title, _, rest = mit.split("\n", 2)
    rows = [
        (width, f"{title}\n\nCopyright (c) 2019-2024 Some One <one@example.org>\n\n" + textwrap.fill(rest, width, break_on_hyphens=False))
        for width in range(50, 121)
    ]
    found = licences.licence_scan(documents(rows), licences.known_digests(spark)).collect()
    assert [r.doc_id for r in found if r.whole_licence != "MIT"] == []
