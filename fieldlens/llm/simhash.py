"""Near duplicates by SimHash, compared bit-sliced.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints
that differ in at most ``radius`` bits, cut into radius + 2 parts, agree in two parts at least; so every
pair that is linked shares a bucket named by two parts. Only fingerprints that differ are put there, once each.

Inside a bucket the fingerprints stand vertically: bit p of 64 of them is one 64-bit word, a bit plane. One
fingerprint is compared with 64 at a time: the planes it differs in are added up by carry-save adders
into bitwise counters, eight planes a turn, and a word is abandoned once all 64 are beyond the radius. What
a task finds it hands on as a forest, so dense groups do not give all their pairs.

A bucket too large for one task is split without loss: two fingerprints within the radius have a third one
halfway between, so its members are put to all fingerprints within half the radius of them, which hold
few members each whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import partitions
from fieldlens.llm.near_dedup import components
from fieldlens.session import stored

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
# Members of a bucket that are compared in one task; larger ones are split.
BUCKET_MEMBERS = 1 << 15
# More parts must agree once a bucket would hold more than this on average.
MEAN_MEMBERS = 256
# Rows of (fingerprint, word) that are compared at a time, and members gathered before that.
COMPARED_ROWS = 1 << 16
GATHERED = 1 << 16
PLANES = 8  # added in one turn

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(body: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as an unsigned number; A-Z count as a-z. No words: 0."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = len(words) - shingle_words + 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :].tolist())], "<u8")
    often = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        often += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * often > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fingerprint, a signed long with the same bits, of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py() or b"", shingle_words) for text in batch.column("text")]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(task, f"doc_id {kind}, fingerprint bigint")


# --- Comparison inside buckets. ---


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[p, w]: bit t is bit p of values[w, t]; values has 64 fingerprints in a row."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), 64, 8), axis=2, bitorder="little")
    turned = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(turned).view("<u8").reshape(BITS, len(values))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the bitwise sum of three and the carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where the bitwise counter is larger than the radius."""
    larger, equal = over, ~over
    for at in reversed(range(len(counters))):
        if radius >> at & 1:
            equal = equal & counters[at]
        else:
            larger = larger | (equal & counters[at])
            equal = equal & ~counters[at]
    return larger


def within_radius(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int, skip: int = 0) -> np.ndarray:
    """For each row, which of the 64 fingerprints of ``word`` are within the radius of ``query``.

    ``skip`` marks bits in which all rows agree with their words.
    """
    depth = radius.bit_length()
    used = [p for p in range(BITS) if not skip >> p & 1]
    out = np.zeros(len(word), np.uint64)
    rows = np.arange(len(word))
    counters = [np.zeros(len(word), np.uint64) for _ in range(depth)]
    over = np.zeros(len(word), np.uint64)
    for turn in range(0, len(used), PLANES):
        levels: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
        for p in used[turn : turn + PLANES]:
            levels[0].append(planes[p, word] ^ (np.uint64(0) - (query >> np.uint64(p) & _ONE)))
        for at in range(depth):
            waiting = levels[at]
            while len(waiting) > 1:
                counters[at], carry = _add(counters[at], waiting.pop(), waiting.pop())
                levels[at + 1].append(carry)
            if waiting:
                last = waiting.pop()
                levels[at + 1].append(counters[at] & last)
                counters[at] = counters[at] ^ last
        for carry in levels[depth]:
            over = over | carry
        beyond = _beyond(counters, over, radius)
        open_ = np.flatnonzero(beyond != _ALL)
        if len(open_) < len(rows):
            rows, word, query, over, beyond = rows[open_], word[open_], query[open_], over[open_], beyond[open_]
            counters = [c[open_] for c in counters]
        if not len(rows):
            return out
    out[rows] = ~beyond
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of n nodes to the smallest that edges a-b connect it with; none to itself."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
        different = label[a] != label[b]
        a, b = a[different], b[different]
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def linked_in_buckets(sizes: np.ndarray, values: np.ndarray, radius: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b of a forest of linked fingerprints; buckets lie one after another in ``values``."""
    n_words = -(-sizes // 64)
    first_word = np.cumsum(n_words) - n_words
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(values)) - np.repeat(first, sizes)
    own_word = np.repeat(first_word, sizes) + place // 64
    lane = place % 64
    table = np.zeros((int(n_words.sum()), 64), np.uint64)
    member = np.full(table.shape, -1, np.int64)
    table[own_word, lane], member[own_word, lane] = values, np.arange(len(values))
    planes = bit_planes(table)
    # Every member meets its own word and the later ones of its bucket; the last member meets nobody.
    many = np.repeat(first_word + n_words, sizes) - own_word
    many[(place + 1 == np.repeat(sizes, sizes)) & (lane < 63)] = 0
    ends = np.cumsum(many)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0
    at = 0
    while at < len(values):
        # Members whose rows fit; a member has at most BUCKET_MEMBERS / 64 rows.
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + COMPARED_ROWS, side="right")), at + 1)
        some = many[at:stop]
        asked = np.repeat(np.arange(at, stop), some)
        offset = np.arange(len(asked)) - np.repeat(np.cumsum(some) - some, some)
        word = own_word[asked] + offset
        hits = within_radius(planes, word, values[asked], radius, skip)
        # In its own word a member looks at the lanes behind it, elsewhere at all that are filled.
        later = (_ALL << lane[asked].astype(np.uint64)) << _ONE
        hits = np.where(offset == 0, hits & later, hits)
        row = np.flatnonzero(hits)
        bits = np.unpackbits(hits[row].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        which, t = np.nonzero(bits)
        b = member[word[row[which]], t]
        filled = b >= 0
        found_a.append(asked[row[which]][filled])
        found_b.append(b[filled])
        held += int(filled.sum())
        if held > 4 * COMPARED_ROWS:  # contract what was found, so that dense buckets stay small
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b), len(values))
            found_a, found_b, held = [a], [b], 0
        at = stop
    return forest(np.concatenate(found_a), np.concatenate(found_b), len(values))


def _turns(radius: int, agreeing: int) -> list[int]:
    """Masks of the bits that must agree: all choices of ``agreeing`` parts out of radius + agreeing."""
    n = radius + agreeing
    cuts = [BITS * i // n for i in range(n + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(n), agreeing)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _halfway(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Members of large buckets, once for every fingerprint in their bucket within half the radius.

    ``turn`` is that of the bucket plus the number of masks, so their names do not meet.
    """
    flips = []
    for mask in masks:
        free = [p for p in range(BITS) if not mask >> p & 1]
        some = [sum(1 << p for p in chosen) for n in range((radius + 1) // 2 + 1) for chosen in combinations(free, n)]
        flips.append(np.array(some, np.uint64).view(np.int64))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for turn, fingerprint, node in zip(*(batch.column(c).to_pylist() for c in ("turn", "fingerprint", "node"))):
                key = flips[turn] ^ np.int64(fingerprint)
                n = len(key)
                columns = [pa.array(np.full(n, turn + len(masks), np.int32)), pa.array(key), pa.array(np.full(n, fingerprint)), pa.array(np.full(n, node))]
                yield pa.RecordBatch.from_arrays(columns, ["turn", "key", "fingerprint", "node"])

    return members.mapInArrow(task, "turn int, key bigint, fingerprint bigint, node bigint")


def links(nodes: DataFrame, radius: int = RADIUS, bucket_members: int = BUCKET_MEMBERS) -> DataFrame:
    """Links a, b between nodes, which connect whatever is within the radius of each other.

    ``nodes``: node and fingerprint, every fingerprint once.
    """
    agreeing, many = 2, nodes.count()
    while many >> (BITS * agreeing // (radius + agreeing)) > MEAN_MEMBERS:
        agreeing += 1
    masks = _turns(radius, agreeing)
    keys = F.array(*[F.struct(F.lit(i).alias("turn"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("node", "fingerprint", F.inline(keys)).select("turn", "key", "fingerprint", "node")
    large = stored(rows.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_members).drop("n"), "large")
    if not large.isEmpty():
        split = _halfway(rows.join(large, ["turn", "key"], "left_semi"), masks, radius)
        rows = rows.join(large, ["turn", "key"], "left_anti").unionAll(split)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["turn", "key", "fingerprint", "node"]
        held: list[np.ndarray] = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in names[1:])]

        def compared(turn: np.ndarray, key: np.ndarray, value: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (turn[1:] != turn[:-1])])
            start = np.flatnonzero(new)
            sizes = np.diff(np.append(start, len(key)))
            company = np.repeat(sizes > 1, sizes)
            turn, value, node = turn[company], value[company].view(np.uint64), node[company]
            turn_of, sizes = turn[np.cumsum(sizes[sizes > 1]) - 1] if len(turn) else turn, sizes[sizes > 1]
            for t in np.unique(turn_of):
                inside = turn == t
                skip = masks[t % len(masks)]  # both kinds of buckets agree in these bits
                own = node[inside]
                a, b = linked_in_buckets(sizes[turn_of == t], value[inside], radius, skip)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < GATHERED:
                continue
            held = [np.concatenate([h, *(b.column(c).to_numpy() for b in waiting)]) for h, c in zip(held, names)]
            waiting = []
            # The last bucket may go on in the next batch.
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(same) - int(same.sum())
            if cut:
                yield from compared(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        held = [np.concatenate([h, *(b.column(c).to_numpy() for b in waiting)]) for h, c in zip(held, names)]
        if len(held[0]):
            yield from compared(*held)

    dealt = rows.repartition(partitions(nodes), "turn", "key").sortWithinPartitions("turn", "key")
    return dealt.mapInArrow(task, "a bigint, b bigint").distinct()


def simhash_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_members: int = BUCKET_MEMBERS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id reachable. A null text is empty; texts without words have fingerprint 0 and link like any other,
    with each other at least; a text of fewer words than a shingle is one shingle. A bit that exactly half
    of the shingles have is 0. Texts are read whole, however long. Rows without id have a fingerprint and no component, and connect nothing. Ids are
    taken to be unique; rows that repeat an id with another text are answered by their own fingerprint each.
    Other columns are not read; an empty table gives an empty result.
    """
    known = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = known.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").cast("bigint").alias("node"))
    nodes = stored(nodes, "nodes")
    label = components(links(nodes, radius, bucket_members))
    if label is not None:
        nodes = stored(nodes.join(label.withColumnRenamed("id", "node"), "node", "left").select("fingerprint", F.coalesce("label", "node").alias("node")), "labelled")
    joined = known.join(nodes, "fingerprint", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("component_id"),
    )
