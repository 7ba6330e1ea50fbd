"""Phrase collocations by direct-address tiling.

Everything is counted per language. Words that are frequent enough get numbers by rank, and texts become
runs of those numbers. Pairs of neighbours are counted in tiles of the square of all pairs of ranks: a
tile that fills up is an array addressed by the pair itself and counted with ``bincount``, in the others the pairs
are sorted and counted by runs. Pairs that are frequent are ranked and numbered in their turn: the run of
words becomes a run of overlapping pairs, whose neighbours are phrases of three words, and so on. A phrase
is never more frequent than its parts, so nothing is lost by numbering only what is frequent. Tasks send
what they counted tile by tile, some two bytes a pair, and a tile is summed up as an array.

Ranks, and so tiles and what is sent to the tasks, are bounded: beyond them a word or pair is known by a hash of
it, as a negative number, and a bitmap of fixed size tells which hashes are worth counting. It is checked that no
hash stands for two things, and another is tried then.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import partitions
from fieldlens.session import stored

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
# A phrase is dropped when a longer one around it has this share of its occurrences.
COVERED_PERCENT = 100
# Ranks, and bytes of a word that has one; so 16 MB of words at most go to the tasks.
RANKS, RANKED_BYTES = 1 << 18, 64
BITMAP = 1 << 24  # bits
GATHERED = 1 << 20  # pairs counted at a time
HELD = 1 << 21  # distinct pairs, or words, that a task holds before it hands them on
RUN = 1 << 14  # numbers in a row, more only where a run is longer



class Tiling(NamedTuple):
    """How pairs are counted; none of it changes a result."""

    bits: int = 8  # a tile is 256 x 256 pairs, 0.5 MB of counts; a place in it has two bytes, so 8 at most
    dense_tiles: int = 128  # in a task
    dense_share: float = 0.125  # pairs at a time for each cell of a tile that make it dense
    buckets: int = 4  # parts of the tiles, for each shuffle partition
    tasks: int = 256  # tasks whose counts of a tile meet in one task; sums of more are summed up in turn
    name_bits: int = 62  # of hashes at first


_BREAK = -1  # no phrase goes over it
_MARK = b"\xff"  # a byte that UTF-8 does not have
_TO_MARKS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + _MARK * 10)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def marked_words(body: bytes) -> list[bytes]:
    """The words of a text, A-Z as a-z, with a mark between its pieces."""
    return body.translate(_TO_MARKS).replace(_MARK, b" \xff ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text")).where("text is not null")


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (bytes) and n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                words.pop(_MARK, None)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts.setdefault(lang, Counter()).update(marked_words(text.as_py()))
            if sum(map(len, counts.values())) > HELD // 4:
                yield from flush()
        yield from flush()

    return _texts(docs).mapInArrow(task, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- Names: ranks for the most frequent, hashes beyond. ---


class Hashing(NamedTuple):
    """Which hashes name what has no rank: numbers of ``bits`` bits, other ones with each attempt."""

    bits: int
    attempt: int = 0

    def next(self) -> Hashing:
        return Hashing(min(self.bits + 8, 62), self.attempt + 1)


def _word_name(lang: str, word: bytes, how: Hashing) -> int:
    """The hash of a word as a number below the break; the same as ``_word_name_column``."""
    seed = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(str(how.attempt).encode(), 42))
    value = xxhash.xxh64_intdigest(word, seed)
    return -(value >> (64 - how.bits)) - 2


def _word_name_column(how: Hashing) -> Column:
    value = F.xxhash64(F.lit(str(how.attempt)), "lang", "word")
    return -F.shiftrightunsigned(value, 64 - how.bits) - 2


def _pair_names(left: np.ndarray, right: np.ndarray, how: Hashing) -> np.ndarray:
    """Hashes of pairs as numbers below the break."""
    value = np.full(len(left), how.attempt, np.uint64)
    for part in (left, right):
        value = (value + part.astype(np.int64).view(np.uint64)) * _MIX[0]
        value = (value ^ (value >> np.uint64(30))) * _MIX[1]
        value = (value ^ (value >> np.uint64(27))) * _MIX[2]
        value = value ^ (value >> np.uint64(31))
    return -(value >> np.uint64(64 - how.bits)).astype(np.int64) - 2


def _bitmap(named: DataFrame) -> np.ndarray | None:
    """Which slots the hashes among the names fall into; None if there are no hashes. At most BITMAP / 64 rows."""
    slot = F.col("name").bitwiseAND(F.lit(BITMAP - 1))
    words = named.where("name < 0").groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(name & 63 as int))")).alias("bits"))
    found = words.toArrow()
    if not found.num_rows:
        return None
    out = np.zeros(BITMAP // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(out.astype("<i8").view(np.uint8), bitorder="little").view(bool)


class Names:
    """The names of the words, or pairs, of one level: what a task needs to number a run."""

    def __init__(self, ranked: pa.Table, bitmap: np.ndarray | None, how: Hashing):
        self._bitmap, self._how = bitmap, how
        self.kind = np.dtype("<i4" if bitmap is None else "<i8")  # ranks alone need four bytes
        self._words: dict[str, dict[bytes, int]] = {}
        if "word" in ranked.column_names:
            for lang, word, rank in zip(*(ranked.column(c).to_pylist() for c in ("lang", "word", "name"))):
                self._words.setdefault(lang, {})[word] = rank
        else:
            key = (ranked.column("left").to_numpy() << 31) | ranked.column("right").to_numpy()
            order = np.argsort(key)
            self._keys, self._ranks = key[order], ranked.column("name").to_numpy()[order]

    def _filtered(self, names: np.ndarray) -> np.ndarray:
        return np.where(self._bitmap[names & (BITMAP - 1)], names, _BREAK)

    def of_words(self, lang: str, words: list[bytes]) -> np.ndarray:
        ranks = self._words.get(lang, {})
        out = np.array(list(map(ranks.get, words, repeat(_BREAK))), np.int64)
        if self._bitmap is not None:
            at = [i for i in np.flatnonzero(out == _BREAK).tolist() if words[i] != _MARK]
            out[at] = self._filtered(np.array([_word_name(lang, words[i], self._how) for i in at], np.int64))
        return out

    def of_pairs(self, run: np.ndarray) -> np.ndarray:
        """Of each number and the one behind it; one less than the run has."""
        left, right = run[:-1], run[1:]
        out = np.full(len(left), _BREAK, np.int64)
        ranked = np.flatnonzero((left >= 0) & (right >= 0))
        if len(self._keys):
            key = (left[ranked] << 31) | right[ranked]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            out[ranked] = np.where(self._keys[at] == key, self._ranks[at], _BREAK)
        if self._bitmap is not None:
            rest = np.flatnonzero((out == _BREAK) & (left != _BREAK) & (right != _BREAK))
            out[rest] = self._filtered(_pair_names(left[rest], right[rest], self._how))
        return out


def _ranked(frequent: DataFrame, keys: list[str], ranks: int) -> DataFrame:
    """The most frequent of a table with their rank as ``name``: at most ``ranks`` rows, by one task."""
    rankable = frequent.where(F.octet_length("word") <= RANKED_BYTES) if "word" in keys else frequent.where("left >= 0 and right >= 0")
    top = rankable.orderBy(F.desc("n"), *keys).limit(ranks).select(*keys).toArrow()
    top = top.append_column("name", pa.array(np.arange(top.num_rows)))
    return frequent.sparkSession.createDataFrame(top)


def _named(
    count: Callable[[int], DataFrame], keys: list[str], min_count: int, ranks: int, by_hash: Callable[[DataFrame, Hashing], DataFrame], bits: int
) -> tuple[DataFrame, Names]:
    """Rows found ``min_count`` times with their ``name``, and the names for the tasks.

    ``count`` gives the counted rows from a least count on.
    """
    frequent = stored(count(min_count), "frequent")
    ranked = stored(_ranked(frequent, keys, ranks), "ranked")
    how = Hashing(bits)
    while True:
        tail = by_hash(frequent.join(ranked, keys, "left_anti"), how)
        named = stored(frequent.join(ranked, keys).unionByName(tail.select(*frequent.columns, "name")), "named")
        bitmap = _bitmap(named)
        if bitmap is None:
            return named, Names(ranked.toArrow(), None, how)
        # A hash must stand for one thing, also among those that are not frequent.
        every = by_hash(count(1).join(ranked, keys, "left_anti"), how)
        if every.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            return named, Names(ranked.toArrow(), bitmap, how)
        how = how.next()


# --- Runs of names, and counts of neighbours. ---


def _compact(run: np.ndarray) -> np.ndarray:
    """A run without what can be in no pair: single breaks stay where something was."""
    if not len(run):
        return run
    valid = run != _BREAK
    paired = valid[:-1] & valid[1:]
    keep = np.append(paired, False) | np.insert(paired, 0, False)
    after = np.insert(keep[:-1], 0, False) & ~keep
    return np.where(keep, run, _BREAK)[keep | after]


def _rows(runs: Iterator[np.ndarray], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Runs as rows of bytes, some 4 MB at a time; long ones are cut at breaks."""
    held: list[bytes] = []
    size = 0
    for run in runs:
        run = _compact(run).astype(kind)
        while len(run):
            cut = len(run)
            if cut > RUN:
                later = np.flatnonzero(run[RUN:] == _BREAK)
                cut = RUN + int(later[0]) + 1 if len(later) else cut
            held.append(run[:cut].tobytes())
            size += len(held[-1])
            run = run[cut:]
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["run"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["run"])


def _word_runs(docs: DataFrame, names: Names) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs() -> Iterator[np.ndarray]:
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                    yield shared.value.of_words(lang, marked_words(text.as_py()))

        yield from _rows(runs(), shared.value.kind)

    out = stored(_texts(docs).mapInArrow(task, "run binary"), "runs")
    shared.destroy()
    return out


def _pair_runs(runs: DataFrame, names: Names, kind: np.dtype) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[np.ndarray]:
            for batch in batches:
                for run in batch.column("run"):
                    yield shared.value.of_pairs(np.frombuffer(run.as_py(), kind).astype(np.int64))

        yield from _rows(pairs(), shared.value.kind)

    out = stored(runs.mapInArrow(task, "run binary"), "runs")
    shared.destroy()
    return out


def _blob(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """Counts of places in tiles: three bytes each, more only for large counts, and the tiles once each."""
    tile = keys >> 2 * bits
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    large = counts >= 255
    return b"".join(
        [
            len(first).to_bytes(4, "little"), len(keys).to_bytes(4, "little"), tile[first].astype("<i8").tobytes(),
            np.diff(np.append(first, len(keys))).astype("<i4").tobytes(), (keys & ((1 << 2 * bits) - 1)).astype("<u2").tobytes(),
            np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes(),
        ]
    )


def _unblob(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n_tiles, n = (int.from_bytes(blob[at : at + 4], "little") for at in (0, 4))
    at = 8 + 8 * n_tiles
    tile = np.repeat(np.frombuffer(blob, "<i8", n_tiles, 8), np.frombuffer(blob, "<i4", n_tiles, at))
    at += 4 * n_tiles
    counts = np.frombuffer(blob, np.uint8, n, at + 2 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<i8", -1, at + 3 * n)
    return tile << 2 * bits | np.frombuffer(blob, "<u2", n, at), counts


class Tiles:
    """Counts of pairs of ranks. Dense tiles are arrays; what is in none is sorted and counted by runs."""

    def __init__(self, tiling: Tiling = Tiling()) -> None:
        self._tiling = tiling
        self._dense: dict[int, np.ndarray] = {}
        self._sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    @staticmethod
    def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and their counts."""
        if not len(keys):
            return keys, np.zeros(0, np.int64)
        order = None if counts is None else np.argsort(keys, kind="stable")
        keys = np.sort(keys) if order is None else keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        if order is None:
            return keys[first], np.diff(np.append(first, len(keys)))
        return keys[first], np.add.reduceat(counts[order], first)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Count pairs. A key is the tile, by the upper bits of both ranks, and the place in it, by the lower."""
        bits, mask = self._tiling.bits, (1 << self._tiling.bits) - 1
        tile = (left >> bits << (31 - bits)) | (right >> bits)
        self.add_counted(*self._runs(tile << 2 * bits | (left & mask) << bits | (right & mask)))

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of some keys."""
        bits, mask = self._tiling.bits, (1 << self._tiling.bits) - 1
        tile, cell = keys >> 2 * bits, keys & ((1 << 2 * bits) - 1)
        return (tile >> (31 - bits) << bits) + (cell >> bits), ((tile & ((1 << (31 - bits)) - 1)) << bits) + (cell & mask)

    def add_counted(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of keys; those of a tile follow one another."""
        cells = 1 << 2 * self._tiling.bits
        tile = keys >> 2 * self._tiling.bits
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(tile))
        upto = np.concatenate([[0], np.cumsum(counts)])
        pairs = upto[ends] - upto[starts]
        dense = np.isin(tile[starts], list(self._dense)) if self._dense else np.zeros(len(starts), bool)
        full = np.flatnonzero(~dense & (pairs >= self._tiling.dense_share * cells))
        dense[full[np.argsort(-pairs[full], kind="stable")][: self._tiling.dense_tiles - len(self._dense)]] = True
        rest = np.ones(len(tile), bool)
        for start, end in zip(starts[dense].tolist(), ends[dense].tolist()):
            counted = self._dense.setdefault(int(tile[start]), np.zeros(cells, np.int64))
            counted += np.bincount(keys[start:end] & (cells - 1), counts[start:end], cells).astype(np.int64)
            rest[start:end] = False
        self._sparse.append((keys[rest], counts[rest]))
        self.held += len(self._sparse[-1][0])
        if self.held > HELD:  # equal pairs of several turns are one
            self._sparse = [self._runs(*[np.concatenate(c) for c in zip(*self._sparse)])]
            self.held = len(self._sparse[0][0])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and their counts; nothing is left then."""
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, cells in self._dense.items():
            used = np.flatnonzero(cells)
            keys.append(name << 2 * self._tiling.bits | used)
            counts.append(cells[used])
        for some, n in self._sparse:
            keys.append(some)
            counts.append(n)
        self.__init__(self._tiling)
        return self._runs(np.concatenate(keys), np.concatenate(counts))

    def blobs(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """What was counted, dealt out by tiles: (bucket, blob). Nothing is left then."""
        keys, counts = self.counted()
        tile = (keys >> 2 * self._tiling.bits).view(np.uint64)
        bucket = ((tile * _MIX[0]) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist()):
            yield int(bucket[start]), _blob(keys[start:end], counts[start:end], self._tiling.bits)


def _joined_runs(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """Runs with breaks between, many numbers at a time."""
    gap = np.array([_BREAK], kind).tobytes()
    waiting: list[bytes] = []
    size = 0
    for batch in batches:
        for run in batch.column("run"):
            waiting.append(run.as_py())
            size += len(waiting[-1])
            if size > kind.itemsize * GATHERED:
                yield np.frombuffer(gap.join(waiting), kind).astype(np.int64)
                waiting, size = [], 0
    if waiting:
        yield np.frombuffer(gap.join(waiting), kind).astype(np.int64)


def _ranked_pairs(runs: DataFrame, kind: np.dtype, tiling: Tiling, least: int) -> DataFrame:
    """left, right and n of pairs of ranks that are neighbours at least ``least`` times."""
    buckets = partitions(runs) * tiling.buckets

    def rows(bucket: list[int], part: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(bucket, pa.int64()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "part", "counts"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, part = Tiles(tiling), TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, bytes]] = []
            for found in tiles.blobs(buckets):
                held.append(found)
                if len(held) == 256:
                    yield rows([f[0] for f in held], [part] * len(held), [f[1] for f in held])
                    held = []
            if held:
                yield rows([f[0] for f in held], [part] * len(held), [f[1] for f in held])

        for run in _joined_runs(batches, kind):
            at = np.flatnonzero((run[:-1] >= 0) & (run[1:] >= 0))
            tiles.add(run[at], run[at + 1])
            if tiles.held > HELD:
                yield from flush()
        yield from flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Tiles]]:
        """The tiles of each (bucket, part), whose rows follow one another."""
        held, tiles = None, Tiles(tiling)
        for batch in batches:
            for key, blob in zip(zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist()), batch.column("counts")):
                if key != held and held is not None:
                    yield *held, tiles
                held = key
                tiles.add_counted(*_unblob(blob.as_py(), tiling.bits))
        if held is not None:
            yield *held, tiles

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, tiles in summed(batches):
            yield rows([bucket], [0], [_blob(*tiles.counted(), tiling.bits)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tiles in summed(batches):
            keys, counts = tiles.counted()
            often = counts >= least
            left, right = tiles.pairs(keys[often])
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(counts[often])], ["left", "right", "n"])

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(runs), "bucket", "part").sortWithinPartitions("bucket", "part")

    schema = "bucket bigint, part int, counts binary"
    counted = runs.mapInArrow(task, schema)
    groups = -(-runs.rdd.getNumPartitions() // tiling.tasks)
    if groups > 1:
        counted = together(counted.withColumn("part", F.col("part") % groups)).mapInArrow(again, schema)
    one = counted.withColumn("part", F.lit(0))
    return together(one).mapInArrow(pairs, "left bigint, right bigint, n bigint")


def _hashed_pairs(runs: DataFrame, kind: np.dtype) -> DataFrame:
    """left, right and n of pairs with a part that has no rank."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _joined_runs(batches, kind):
            left, right = run[:-1], run[1:]
            at = np.flatnonzero((left != _BREAK) & (right != _BREAK) & ((left < 0) | (right < 0)))
            names, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
            keys, counts = Tiles._runs(place[: len(at)] * len(names) + place[len(at) :])
            columns = [pa.array(names[keys // max(len(names), 1)]), pa.array(names[keys % max(len(names), 1)]), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["left", "right", "n"])

    return runs.mapInArrow(task, "left bigint, right bigint, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _pair_counts(runs: DataFrame, kind: np.dtype, tiling: Tiling, least: int) -> DataFrame:
    """left, right and n of all pairs of neighbours in the runs that are found at least ``least`` times."""
    pairs = _ranked_pairs(runs, kind, tiling, least)
    if kind.itemsize == 4:
        return pairs
    return pairs.unionAll(_hashed_pairs(runs, kind).where(F.col("n") >= least))


def _hash_words(rows: DataFrame, how: Hashing) -> DataFrame:
    return rows.withColumn("name", _word_name_column(how))


def _hash_pairs(rows: DataFrame, how: Hashing) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _pair_names(batch.column("left").to_numpy(), batch.column("right").to_numpy(), how)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], [*batch.schema.names, "name"])

    return rows.select("left", "right", "n").mapInArrow(task, "left bigint, right bigint, n bigint, name bigint")


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    covered_percent: int = COVERED_PERCENT,
    ranks: int = RANKS,
    tiling: Tiling = Tiling(),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language.

    Phrases of 2 to ``max_words`` words inside pieces of texts, found at least ``min_count`` times (a). The score is floor(1000 a n / (l r))
    for the cut into two parts, found l and r times, that makes it least (ties: the earlier cut); n is the
    number of words of the language. Ranks go by score, then a, then the phrase's bytes. A null language
    is ``und``; null, empty and blank texts have no words, and an empty table gives an empty result. Every
    row counts, also repeated ones and those without id; texts are read whole, however long. Other columns are not read. Numbers are
    decimals of 38 digits between, so nothing overflows below 10^12 words of one language.
    """
    words = stored(_word_counts(docs), "words")
    named, names = _named(lambda least: words.where(F.col("n") >= least), ["lang", "word"], min_count, ranks, _hash_words, tiling.name_bits)
    text = F.decode("word", "UTF-8")
    counts = F.array("n")
    level = named.select("lang", "name", "n", text.alias("phrase"), text.alias("last"), counts.alias("starts"), counts.alias("ends"))
    runs = _word_runs(docs, names)
    found: list[DataFrame] = []
    for _ in range(2, max_words + 1):
        named, more = _named(partial(_pair_counts, runs, names.kind, tiling), ["left", "right"], min_count, ranks, _hash_pairs, tiling.name_bits)
        if named.isEmpty():
            break
        # The counts of a phrase's first 1, 2, ... words and of its last ones come from its two parts.
        first = level.select("lang", F.col("name").alias("left"), "phrase", "starts")
        second = level.select(F.col("name").alias("right"), F.col("last").alias("_last"), "ends")
        level = stored(
            named.join(first, "left").join(second, "right").select(
                "lang", "name", "n", F.concat_ws(" ", "phrase", "_last").alias("phrase"), F.col("_last").alias("last"),
                F.concat("starts", F.array("n")).alias("starts"), F.concat("ends", F.array("n")).alias("ends"), "left", "right",
            ),
            "level",
        )
        found.append(level)
        if len(found) < max_words - 1:
            runs = _pair_runs(runs, more, names.kind)
        names = more
    if not found:
        schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
        return docs.sparkSession.createDataFrame([], schema)

    open_: list[DataFrame] = []
    for at, phrases in enumerate(found):
        if at + 1 < len(found):
            # Any longer phrase around one has one word more on a side in between, found as often at least.
            longer = found[at + 1]
            around = longer.select(F.col("left").alias("name"), F.col("n").alias("_n")).unionAll(longer.select("right", "n"))
            phrases = phrases.join(around.groupBy("name").agg(F.max("_n").alias("_longest")), "name", "left")
            phrases = phrases.where(F.col("_longest").isNull() | (F.lit(100) * F.col("_longest") < F.lit(covered_percent) * F.col("n")))
        open_.append(phrases.select("lang", "phrase", F.col("n").alias("a"), "starts", "ends"))
    candidates = open_[0]
    for more in open_[1:]:
        candidates = candidates.unionAll(more)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    cut = F.expr(
        "array_min(transform(sequence(1, size(starts) - 1), k -> struct("
        "(1000 * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div "
        "(cast(starts[k - 1] as decimal(19,0)) * cast(ends[size(starts) - k - 1] as decimal(19,0))) as score, k as k, "
        "starts[k - 1] as l, ends[size(starts) - k - 1] as r)))"
    )
    scored = candidates.join(sizes, "lang").withColumn("_cut", cut).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    # The best of parts of a language first, so no task ranks all of a language's phrases.
    order = "ORDER BY score DESC, a DESC, phrase"
    part = F.expr(f"pmod(xxhash64(phrase), {partitions(docs)})")
    some = scored.withColumn("_part", part).withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY lang, _part {order})")).where(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.expr(f"cast(row_number() OVER (PARTITION BY lang {order}) as bigint)")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> str:
    """The same by all phrases of every piece."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM runs, range(1, {max_words + 1}) t(m) WHERE len(w) >= m),
counted AS (
  SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE f >= {min_count}),
cuts AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM often WHERE m >= 2),
scores AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.k, x.f AS l, y.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN often x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = s.lang AND o.f = s.a AND o.m > s.m AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {top}"""
