"""Best-fit packing by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths, at most ``capacity`` numbers, goes to the driver. There a linear program over configurations
(multisets of lengths that fit into a sequence) covers the histogram with few sequences: the prices of the
lengths fall by small factors as they are covered, a knapsack dynamic program finds the best filling of every
room and bounds the optimum from below, and each round takes, for every length, the best configuration that
holds it, if that is close to the best of all. So all lengths are covered from the first round on. The steps
are averaged and rounded to whole sequences, the most used configurations first, as long as there are
pieces; what is left of the histogram is packed best-fit decreasing, many equal pieces at a time. The plan says for each length
which places its 1st, 2nd, ... piece takes, so pieces need only a number among those of their length to find their own place.
"""

from __future__ import annotations

import bisect
import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.session import stored

CAPACITY = 2048
# Rounds of pricing at most, each with a configuration for every length; more come closer to the linear optimum.
ROUNDS = 100
# A round covers this share of one length's pieces; a covered share of 1 lowers a price by e^-RATE; configurations
# whose price is this close to the best are taken; a solution this close to its lower bound is good enough.
STEP, RATE, NEAR, GAP = 0.1, 1.0, 0.02, 1e-3
# Shares of the rounded solution that are tried; best-fit decreasing packs the rest.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)
_CACHE_WORDS = 300_000
_CACHE_WORD_BYTES = 40


def _little(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next
    free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    words one after another; recent words are remembered. Two generations bound the memory. Words of
    plain Latin letters, with one mark after them at most, are not changed by the tokenizer's
    normalisation beyond lower case and are split before the mark, so they go to its model directly. The
    tokenizer's special strings are found in the text as it is, and have their ids.
    """

    _PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?]?)")

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        # They are cut out below, before a text is lowered; what is left is ordinary text.
        self._tokenizer.encode_special_tokens = True
        special = {t.content.encode(): i for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special}
        self._special = {text: _little([i]) for text, i in special.items()}
        self._cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + b")") if special else None
        self._pieces = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _plain(self, word: bytes) -> bytes | None:
        text = word.decode("utf-8", "replace").lower()
        match = self._PLAIN.fullmatch(text)
        if match is None:
            return None
        letters, mark = match.groups()
        if not letters.isascii():
            letters = letters.encode("utf-8").decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._pieces(letters)]
        if mark:
            ids += [t.id for t in self._pieces(mark)]
        return _little(ids)

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        parts: dict[int, list[bytes]] = {}  # of the texts with special strings: text, string, text, ...
        if self._special:
            for at, body in enumerate(bodies):
                if any(text in body for text in self._special):
                    parts[at] = self._cut.split(body)
        if not parts:
            return self._ordinary(bodies)
        flat = [b for at, body in enumerate(bodies) for b in (parts[at][::2] if at in parts else [body])]
        coded = iter(self._ordinary(flat))
        out = []
        for at in range(len(bodies)):
            ids = next(coded)
            for text in parts.get(at, [])[1::2]:
                ids += self._special[text] + next(coded)
            out.append(ids)
        return out

    def _ordinary(self, bodies: list[bytes]) -> list[bytes]:
        texts = [b.lower().split() for b in bodies]  # lower case of A-Z, as the tokenizer does itself
        known: dict[bytes, bytes] = {}
        unknown = []
        for word in set().union(*texts):
            ids = self._new.get(word)
            if ids is None:
                ids = self._old.get(word) or self._plain(word)
                if ids is None:
                    unknown.append(word)
                    continue
                if len(word) <= _CACHE_WORD_BYTES:
                    self._new[word] = ids
            known[word] = ids
        asked = [w.decode("utf-8", "replace") for w in unknown]
        for word, coded in zip(unknown, self._tokenizer.encode_batch_fast(asked, add_special_tokens=False)):
            known[word] = ids = _little(coded.ids)
            if len(word) <= _CACHE_WORD_BYTES:
                self._new[word] = ids
        if len(self._new) > _CACHE_WORDS:
            self._old, self._new = self._new, {}
        return [b"".join(map(known.__getitem__, words)) for words in texts]


@lru_cache(1)
def _tokens(tokenizer_file: str) -> WordTokens:
    return WordTokens(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the numbers packing needs.

    ``part`` and ``nth`` number the pieces of one length: by task, and inside it.
    """
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = _tokens(tokenizer_file), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, found = [], []
                bodies = [b or b"" for b in some.column("text").to_pylist()]
                for row, ids in enumerate(own.encode(bodies)):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        body = ids[start : start + 4 * capacity]
                        length = len(body) // 4
                        rows.append(row)
                        found.append((piece, start // 4, length, zlib.crc32(body), part, seen[length]))
                        seen[length] += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                ids = some.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(task, schema)


# --- The plan, made on the driver from the histogram alone. ---

Configuration = list[tuple[int, int]]  # (length, how many), longest first


def _fillings(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room the largest total price that fits, and the length it takes (0: nothing fits).

    ``prices`` are those of one piece of each of the rising ``lengths``; equal totals take the longest piece.
    """
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    longest, price = lengths[::-1].copy(), prices[::-1].copy()
    fits = len(lengths) - np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        at = fits[room]
        totals = price[at:] + best[room - longest[at:]]
        chosen = int(totals.argmax())
        best[room], taken[room] = totals[chosen], longest[at + chosen]
    return best, taken


def _bundle(lengths: np.ndarray, best: np.ndarray, taken: np.ndarray, capacity: int) -> np.ndarray:
    """A row for each length: itself and the best filling of the room it leaves, 0 where nothing follows."""
    room = capacity - lengths
    columns = [lengths]
    while True:
        following = np.where(best[room] > 0, taken[room], 0)
        if not following.any():
            return np.stack(columns, axis=1)
        columns.append(following)
        room = room - following


def fractional_cover(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[Configuration, float]], float, float]:
    """Configurations and how often each is taken, how often a piece is covered on average, and a lower bound.

    Multiplicative weights: a piece's price starts as its length, which is the price of a perfect packing, and
    falls exponentially with the share of the pieces of its length that is covered. All steps together,
    scaled so that the least covered length is covered once, are a solution of the program; the prices of all
    pieces over the largest price of a configuration are a bound of it.
    """
    lengths = np.flatnonzero(counts > 0)
    if not len(lengths):
        return [], 1.0, 0.0
    need = counts[lengths].astype(float)
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    first = np.log(lengths)
    covered = np.zeros(len(lengths))
    sums: dict[tuple[int, ...], float] = {}
    total, bound = 0.0, 0.0
    for _ in range(rounds):
        logs = first - RATE * covered
        prices = np.exp(logs - logs.max())
        best, taken = _fillings(prices, lengths, capacity)
        value = prices + best[capacity - lengths]
        bound = max(bound, float(prices @ need / value.max()))
        near = np.flatnonzero(value >= (1 - NEAR) * value.max())
        rows = _bundle(lengths[near], best, taken, capacity)
        often = need[near]
        used = rows > 0
        share = np.bincount(place[rows[used]], np.repeat(often[:, None], rows.shape[1], axis=1)[used], len(lengths)) / need
        step = STEP / share.max()
        covered += step * share
        total += step * float(often.sum())
        for row, n in zip((-np.sort(-rows, axis=1)).tolist(), (step * often).tolist()):
            key = tuple(x for x in row if x)
            sums[key] = sums.get(key, 0.0) + n
        if covered.min() > 0 and total / covered.min() <= bound * (1 + GAP):
            break
    mean = float((covered * need * lengths).sum() / (need @ lengths))
    cover = [(sorted(Counter(key).items(), reverse=True), often) for key, often in sums.items()]
    return cover, mean, bound


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Configuration, int]]:
    """Whole numbers of sequences by configuration, which hold exactly the pieces counted.

    counts[l] is the number of pieces of length l, 1 to ``capacity``. Of the rounded solution as much is used
    as gives the fewest sequences, with best-fit decreasing for the rest; see :func:`program_share`.
    """
    left = counts.astype(np.int64).copy()
    made: list[tuple[Configuration, int]] = []
    if left[capacity]:
        made.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    solved, rest = _solved(left, capacity, rounds)
    return made + solved + rest


def program_share(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[int, int, float]:
    """Sequences with room to fill that come from the program, all of them, and the program's lower bound."""
    left = counts.astype(np.int64).copy()
    left[capacity] = 0
    solved, rest = _solved(left, capacity, rounds)
    many = sum(often for _, often in solved)
    return many, many + sum(often for _, often in rest), fractional_cover(left, capacity, rounds)[2]


def _solved(counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[Configuration, int]], list[tuple[Configuration, int]]]:
    """The sequences that come from the program, and those of the rest."""
    cover, mean, _ = fractional_cover(counts, capacity, rounds)
    left = counts.copy()
    rounded: list[tuple[Configuration, int]] = []
    for chosen, often in sorted(cover, key=lambda c: -c[1]):
        # Covered once on average, and up, while there are pieces.
        whole = min([int(np.ceil(often / mean - 1e-9)), *(int(left[length]) // many for length, many in chosen)])
        if whole > 0:
            rounded.append((chosen, whole))
            for length, many in chosen:
                left[length] -= whole * many
    most = sum(often for _, often in rounded)
    best: tuple[list[tuple[Configuration, int]], list[tuple[Configuration, int]]] = ([], [])
    fewest = np.inf
    for share in SHARES:
        part, open_ = [], int(share * most)
        left = counts.copy()
        for chosen, often in rounded:
            often = min(often, open_)
            if often:
                part.append((chosen, often))
                open_ -= often
                for length, many in chosen:
                    left[length] -= often * many
        rest = _best_fit(left, capacity)
        n = sum(often for _, often in part) + sum(often for _, often in rest)
        if n < fewest:
            fewest, best = n, (part, rest)
        if n * capacity < int(counts @ np.arange(capacity + 1)) + capacity:
            break  # no packing can have fewer
    return best


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Best-fit decreasing over a histogram; open sequences of equal content are one group."""
    groups: dict[int, list[tuple[Configuration, int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, content: Configuration, many: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((content, many))

    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, rest)
                put(capacity - each * length, [(length, each)], rest // each)
                rest %= each
                continue
            room = rooms[at]
            content, many = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = min(room // length, rest)
            filled = min(many, rest // each)
            if filled < many:
                put(room, content, many - filled)
            put(room - each * length, [*content, (length, each)], filled)
            rest -= filled * each
    return [group for in_room in groups.values() for group in in_room]


class Places:
    """Sequence and offset of the nth piece of a length."""

    def __init__(self, made: list[tuple[Configuration, int]]):
        used: dict[int, int] = {}
        rows = []
        first = 0
        for chosen, often in made:
            offset = 0
            for length, many in chosen:
                rows.append((length, used.get(length, 0), first, offset, many))
                used[length] = used.get(length, 0) + often * many
                offset += length * many
            first += often
        rows.sort()
        self.sequences = first
        self._length, self._from, self._first, self._offset, self._many = np.array(rows or [(0, 0, 0, 0, 1)], np.int64).T.copy()
        self._key = self._length * (1 << 48) + self._from

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, length * (1 << 48) + nth, side="right") - 1
        rest = nth - self._from[at]
        return self._first[at] + rest // self._many[at], self._offset[at] + rest % self._many[at] * length


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text, and one of white space only, is the end id alone. Special strings of the tokenizer
    in a text have their ids, as its file says. Every piece has a place, also those of repeated rows. Other columns of ``docs`` are not read. An empty table gives an empty
    result. Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # one row per length
        counts[length] = n
    places = Places(plan(counts, capacity))
    # How many pieces of a length earlier tasks hold: one row per task and length.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("nth")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            columns = [*batch.columns[:-1], *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(task, schema)
