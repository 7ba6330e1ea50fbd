"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidates.

Each document is the set of its word shingles. One pass hashes the shingles once; the smallest hash in
each of 128 ranges of hash values is the signature, and empty ranges borrow the value of another range,
chosen by a fixed random order per range (optimal densification). Bands of the signature name buckets.

Equal sets are one node. In a bucket, candidates are star-shaped: a hub with all other members, so their
number is that of the members and not of the pairs. The hub is the member that lies in the largest
buckets: edits take a copy out of the buckets of its group, so this is the text most copies derive from.
Candidates are confirmed on full sets, and nodes move to the label of what they are linked with. Buckets
whose members then still have several labels get a hub from another of them, for a few rounds.

The rounds only save work. The confirmed links are then contracted to components, and
members of buckets that still hold several of them are at last joined exactly: two sets that are similar enough share one of the few first shingles of each in any fixed order,
and the order puts rare shingles first. Only pairs of different components are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import unused
from fieldlens.llm.statistics import word_hashes
from fieldlens.session import stored

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
RANGES = 128
# 25 bands of 5: texts of similarity 0.85 share a bucket but for 1 in 2 million, of 0.80 for 1 in 20,000.
BAND_RANGES = 5
BANDS = RANGES // BAND_RANGES
# Rounds of stars before the exact join; more find fewer links each and cost as much.
ROUNDS = 3
# Common shingles are told from rare ones by counts in this many slots, over about this many sets. They
# order the shingles, no more: any order gives the same links.
COMMON_SLOTS = 1 << 21
COMMON_SETS = 20_000

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PROBES = np.stack([np.random.default_rng(1000 + i).permutation(RANGES) for i in range(RANGES)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[4]
    x = (x ^ (x >> np.uint64(27))) * _MIX[5]
    return x ^ (x >> np.uint64(31))


def shingle_set(body: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z count as a-z."""
    hashes = word_hashes(body.lower().split())
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, words)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * _MIX[i % 4] + _mixed(hashes[i : n - width + 1 + i] + np.uint64(i))
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value in each range of hash values; empty ranges borrow."""
    shift = np.uint64(64 - RANGES.bit_length() + 1)
    starts = np.searchsorted(shingles, np.arange(RANGES, dtype=np.uint64) << shift)
    ends = np.append(starts[1:], len(shingles))
    filled = starts < ends
    values = shingles[np.minimum(starts, len(shingles) - 1)] << np.uint64(RANGES.bit_length() - 1)
    empty = np.flatnonzero(~filled)
    if len(empty):
        donors = _PROBES[empty]
        values[empty] = values[donors[np.arange(len(empty)), filled[donors].argmax(1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket name per band."""
    rows = values[: BANDS * BAND_RANGES].reshape(BANDS, BAND_RANGES)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_RANGES):
        total = _mixed(total * _MIX[i % 4] + rows[:, i])
    return total.view(np.int64)


def digests(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, two halves of a 128-bit digest of the set, and the bucket names.

    Digest and names are null for documents without words or without id: they link with nothing.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, highs, lows, keys = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                shingles = shingle_set(text.as_py() or b"", shingle_words)
                sizes.append(len(shingles))
                if not len(shingles) or not doc_id.is_valid:
                    highs.append(None), lows.append(None), keys.append(None)
                    continue
                high, low = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
                highs.append(high), lows.append(low)
                keys.append(band_keys(signature(shingles)))
            long = pa.int64()
            columns = [pa.array(sizes, long), pa.array(highs, long), pa.array(lows, long), pa.array(keys, pa.list_(long))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "high", "low", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, high bigint, low bigint, keys array<bigint>"
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(task, schema)


def confirmed(pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Of rows (hub, node, hub_text, node_text), those whose full sets are similar enough: a, b."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            keep = []
            for hub, node in zip(batch.column("hub_text"), batch.column("node_text")):
                hub, node = hub.as_py(), node.as_py()
                if hub != last_text:
                    last_text, last_set = hub, shingle_set(hub, shingle_words)
                own = shingle_set(node, shingle_words)
                small, large = sorted((len(own), len(last_set)))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate([own, last_set])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column("hub"), chosen.column("node")], ["a", "b"])

    return pairs.mapInArrow(task, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame | None:
    """The smallest id reachable from each id: id, label. ``edges`` has a and b; None if it is empty.

    In each step every id moves to the smallest of its neighbours and itself and the graph is contracted,
    so a star is done in one step. Only tables of ids are held, in the shared folder.
    """
    labels = None
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("near"))
        parent = stored(nearest.select(F.col("a").alias("id"), F.least("a", "near").alias("up")), "parents")
        if labels is None:
            labels = parent.select("id", F.col("up").alias("label"))
        else:
            ups = parent.select(F.col("id").alias("label"), "up")
            labels = stored(labels.join(ups, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
        of_a, of_b = (parent.select(F.col("id").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        moved = edges.join(of_a, "a").join(of_b, "b").where("up_a <> up_b")
        edges = stored(
            moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges"
        )
    return labels


def _stars(members: DataFrame) -> DataFrame:
    """Members of unfinished buckets with their bucket's hub: the most popular one not served yet.

    ``members``: key, node, label, popularity, served. A bucket is finished when its members have one label, or
    each has served as hub.
    """
    rank = F.struct("popularity", (-F.col("node")).alias("order"), "node", "label")
    buckets = members.groupBy("key").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.max(F.when(~F.col("served"), rank)).alias("_hub")
    )
    open_ = buckets.where("_low < _high and _hub is not null").select("key", F.col("_hub.node").alias("hub"), F.col("_hub.label").alias("hub_label"))
    return members.join(open_, "key")


def _common(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """How often shingles occur in a sample of the sets, by slots of their hashes."""
    share = min(1.0, COMMON_SETS / max(texts.count(), 1))
    sample = texts.where(F.pmod(F.xxhash64("node", F.lit("common")), F.lit(1 << 30)) < int(share * (1 << 30)))
    shift = np.uint64(64 - COMMON_SLOTS.bit_length() + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COMMON_SLOTS, np.int32)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(total, (shingle_set(text.as_py(), shingle_words) >> shift).astype(np.int64), np.int32(1))
        used = np.flatnonzero(total > 0)
        for at in range(0, len(used), 1 << 18):
            some = used[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["slot", "n"])

    found = sample.select("text").mapInArrow(task, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    found = found.where("n > 1").toArrow()  # one number per slot at most
    out = np.zeros(COMMON_SLOTS, np.int32)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _firsts(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The first shingles of each set, rare ones first, as a stored table: shingle, node, label, n, at, low.

    A set of n shingles that is similar to one not larger shares at least percent x n / 100 of them, and to
    one not smaller at least 2 x percent x n / (100 + percent); so the first shared one has a place ``at``
    among the n less that many. ``low`` marks the fewer places of the second kind.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle_words))
    shift = np.uint64(64 - COMMON_SLOTS.bit_length() + 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        names = ["shingle", "node", "label", "n", "at", "low"]
        for batch in batches:
            rows, found, sizes, places, lows = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                shingles = shingle_set(text.as_py(), shingle_words)
                n = len(shingles)
                if not n:
                    continue
                most = n + (-percent * n) // 100 + 1
                least = n + (-2 * percent * n) // (100 + percent) + 1
                often = common[(shingles >> shift).astype(np.int64)]
                found.append(shingles[np.argsort(often, kind="stable")[:most]].view(np.int64))  # equal counts by hash
                rows.append(np.full(most, row))
                sizes.append(np.full(most, n))
                places.append(np.arange(most))
                lows.append(np.arange(most) < least)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            columns = [
                pa.array(np.concatenate(found)), batch.column("node").take(at), batch.column("label").take(at),
                pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)),
                pa.array(np.concatenate(lows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shingle bigint, node bigint, label bigint, n int, at int, low boolean"
    found = stored(texts.select("node", "label", "text").mapInArrow(task, schema), "firsts")
    shared.destroy()
    return found


def _across(texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Candidates hub, node among all pairs of different labels; none that is similar enough is left out.

    ``texts``: node, label, text. Shingles of one component are dropped, and the pairs of components at a
    shingle are made before those of their members, so a large component is not paired with itself.
    """
    firsts = _firsts(texts, shingle_words, percent)
    mixed = firsts.groupBy("shingle").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    firsts = stored(firsts.join(mixed.select("shingle"), "shingle", "left_semi"), "mixed-firsts")
    small = firsts.where("low").select("shingle", F.col("label").alias("label_a"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    large = firsts.select("shingle", F.col("label").alias("label_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    # Pairs of components first, without those whose sizes and places allow no pair of members.
    rest_a, rest_b = F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")
    of_a = small.groupBy("shingle", "label_a").agg(F.min("n_a").alias("low_a"), F.max("n_a").alias("high_a"), F.max(rest_a).alias("most_a"))
    of_b = large.groupBy("shingle", "label_b").agg(F.min("n_b").alias("low_b"), F.max("n_b").alias("high_b"), F.max(rest_b).alias("most_b"))
    sizes = (F.col("low_a") <= F.col("high_b")) & (F.lit(100) * F.col("high_a") >= F.lit(percent) * F.col("low_b"))
    most = F.least("most_a", "most_b").cast("bigint")
    places = most * (100 + percent) >= (F.col("low_a") + F.col("low_b")).cast("bigint") * percent
    possible = of_a.join(of_b, "shingle").where((F.col("label_a") != F.col("label_b")) & sizes & places)
    labels = possible.select("shingle", "label_a", "label_b")
    pairs = labels.join(small, ["shingle", "label_a"]).join(large, ["shingle", "label_b"])
    # The smaller set is a. At the first shared shingle, what follows it must hold the rest of the overlap.
    ordered = F.expr("n_a < n_b or (n_a = n_b and a < b)")
    fits = F.lit(100) * F.col("n_a") >= F.lit(percent) * F.col("n_b")
    rest = F.least(rest_a, rest_b).cast("bigint")
    enough = rest * (100 + percent) >= (F.col("n_a") + F.col("n_b")).cast("bigint") * percent
    return pairs.where(ordered & fits & enough).select(F.col("b").alias("hub"), F.col("a").alias("node")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked when 100 x |common shingles| >= percent x |union|, by sets of distinct
    ``shingle_words``-word shingles (a shorter text is one shingle). component_id is the smallest doc_id
    reachable over links; kept says whether it is the row's own. Null and empty texts, and texts without
    words, have an empty set and link with nothing, nor do rows without id (component_id null, kept).
    Ids are taken to be unique; rows that repeat an id with another text are each answered by the links of
    their own text. Other columns are not read; an empty table gives an empty
    result.
    """
    known = stored(digests(docs, shingle_words), "digests")
    linkable = known.where("high is not null")
    sets = stored(linkable.groupBy("high", "low").agg(F.min("doc_id").cast("bigint").alias("node")), "sets")
    first = linkable.join(sets, ["high", "low"]).where(F.col("doc_id") == F.col("node"))
    nodes = first.select("node", F.posexplode("keys").alias("band", "key"))
    # Only buckets with company matter; most names occur once.
    shared = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stored(nodes.join(shared, "key"), "buckets")
    popularity = stored(buckets.groupBy("node").agg(F.sum("size").alias("popularity")), "popularity")
    sizes = first.select("node", F.col("n_shingles").alias("n")).groupBy("node").agg(F.max("n").alias("n"))
    sizes = stored(popularity.select("node").join(sizes, "node"), "sizes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.encode("text", "UTF-8").alias("text"))
    texts = stored(texts.join(popularity, "node", "left_semi").dropDuplicates(["node", "text"]), "texts")

    label = popularity.select("node", F.col("node").alias("label"))
    members = buckets.select("key", "node", F.lit(False).alias("served"))
    tested = links = None
    for _ in range(ROUNDS):
        stars = stored(_stars(members.join(popularity, "node").join(label, "node")), "stars")
        spokes = stars.where("label <> hub_label").select("hub", "node").distinct()
        if tested is not None:
            spokes = spokes.join(tested, ["hub", "node"], "left_anti")
        spokes = stored(_alike(spokes, sizes, percent), "spokes")
        found = _links(spokes, texts, shingle_words, percent)
        if found.isEmpty():
            break
        links = found if links is None else links.unionAll(found)
        tested = spokes if tested is None else tested.unionAll(spokes)
        served = F.col("served") | (F.col("node") == F.col("hub"))
        members = stars.select("key", "node", served.alias("served"))
        label = _moved(label, found)

    label = popularity.select("node", F.col("node").alias("label"))
    label = label if links is None else _contracted(label, links)
    # Links between members that were no hubs: whatever still lies in a bucket with another component.
    of_key = stored(buckets.select("key", "node").join(label, "node"), "labelled")
    mixed = of_key.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    opened = of_key.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct()
    across = stored(_across(stored(texts.join(opened, "node"), "open-texts"), shingle_words, percent), "across")
    label = _contracted(label, _links(across, texts, shingle_words, percent))

    by_set = sets.join(label, "node", "left").select("high", "low", F.coalesce("label", "node").alias("label"))
    linked = known.join(stored(by_set, "set-labels"), ["high", "low"], "left")
    component = F.coalesce("label", F.col("doc_id").cast("bigint"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _links(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The confirmed of the pairs hub, node, as a stored table a, b."""
    hubs = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
    bodies = pairs.join(texts, "node").join(hubs, "hub").select("hub", "node", "hub_text", F.col("text").alias("node_text"))
    return stored(confirmed(bodies, shingle_words, percent), "links")


def _contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after all that links connect is one component."""
    of_a, of_b = (label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    joined = components(links.join(of_a, "a").join(of_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    if joined is None:
        return label
    ups = joined.select(F.col("id").alias("label"), F.col("label").alias("up"))
    return stored(label.join(ups, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def _moved(label: DataFrame, links: DataFrame) -> DataFrame:
    """Each label moved to the smallest that a link joins it with, twice over: nodes of one label are connected,
    though connected nodes can still have several."""
    of_a, of_b = (label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    pairs = links.join(of_a, "a").join(of_b, "b").where("label_a <> label_b")
    both = pairs.select("label_a", "label_b").unionAll(pairs.select("label_b", "label_a"))
    up = both.groupBy(F.col("label_a").alias("label")).agg(F.min("label_b").alias("_up"))
    up = stored(up.select("label", F.least("label", "_up").alias("up")), "ups")
    again = up.select(F.col("label").alias("up"), F.col("up").alias("top"))
    twice = up.join(again, "up").select("label", "top")
    return stored(label.join(twice, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _alike(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity; so the texts of a pair are of like length too."""
    own = sizes.select("node", F.col("n").alias("_n"))
    hubs = sizes.select(F.col("node").alias("hub"), F.col("n").alias("_m"))
    fits: Column = 100 * F.least("_n", "_m") >= percent * F.greatest("_n", "_m")
    return pairs.join(own, "node").join(hubs, "hub").where(fits).select("hub", "node")


def without_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component one document."""
    gone = near_duplicates(docs, shingle_words, percent).where("not kept").select(F.col("doc_id").alias("_gone"))
    row = unused(docs, "_gone")
    return docs.join(gone.withColumnRenamed("_gone", row).distinct(), F.col("doc_id") == F.col(row), "left_anti")
