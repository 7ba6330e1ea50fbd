"""Byte-level BPE as a reduction over a tree of text halves.

Encodings form a monoid: the encoding of a text follows from those of its two halves. Both halves are
encoded, recursively, and joined by encoding again a window around the cut that grows until the tokens
outside it are proven to stay:

- A place where white space follows another character ends a match of the splitting pattern, whatever
  stands around it. A window from the last such place before the cut to the first one after it is enough.
- In a run without such a place one match may be very long. Its tokens are joined by their own tree: a
  sequence of tokens is the encoding of its bytes exactly when each two neighbours are the encoding of
  theirs, so a window grows token by token until its seams pass that test.

Decoding concatenates the halves' bytes up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

LEAF_CHARS = 1024
LEAF_TOKENS = 1024
LONG_MATCH_BYTES = 128

# Not white space in any definition, then ASCII white space.
_BREAK = re.compile(r"[^\s\x1c-\x1f](?=[ \t\n\r])")


class TreeCodec:
    """Encoder and decoder for a file of ranks and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(n) for n in range(len(self.tokens))]
        self.pattern = regex.compile(pattern)
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._stays = lru_cache(100_000)(self._stays_uncached)

    # --- texts ---

    def encode(self, text: str) -> list[int]:
        return self._half(text, 0, len(text))

    def _half(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= LEAF_CHARS:
            return self._leaf.encode_ordinary(text[low:high])
        cut = (low + high) // 2
        return self._join(text, low, cut, high, self._half(text, low, cut), self._half(text, cut, high))

    def _join(self, text: str, low: int, cut: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end, reach = low, high, 32
        while cut - reach > low:
            breaks = [m.end() for m in _BREAK.finditer(text, cut - reach, cut)]
            # The lookahead stops at ``cut``, so both characters lie in the left half.
            if breaks:
                start = breaks[-1]
                break
            reach *= 4
        reach = 32
        while cut + reach < high:
            found = _BREAK.search(text, cut, cut + reach)
            if found:
                end = found.end()
                break
            reach *= 4
        keep = len(left) - self._count(reversed(left), text[start:cut]) if start > low else 0
        skip = self._count(right, text[cut:end]) if end < high else len(right)
        window = text[start:end]
        middle = self._leaf.encode_ordinary(window) if len(window) <= LEAF_CHARS else self._run(window)
        return left[:keep] + middle + right[skip:]

    def _count(self, tokens, part: str) -> int:
        """How many tokens, in the order given, make up the bytes of a part of the text."""
        rest, n = len(part.encode("utf-8")), 0
        for token in tokens:
            if rest <= 0:
                break
            rest -= len(self.tokens[token])
            n += 1
        return n

    def _run(self, text: str) -> list[int]:
        """A text with few or no breaks: match by match, long matches by their own tree."""
        out: list[int] = []
        for match in self.pattern.finditer(text):
            body = match.group().encode("utf-8")
            out += self._piece(body) if len(body) > LONG_MATCH_BYTES else self._merge(body)
        return out

    # --- one match of the pattern ---

    def _piece(self, body: bytes) -> list[int]:
        if len(body) <= LONG_MATCH_BYTES:
            return self._merge(body)
        cut = len(body) // 2
        left, right = self._piece(body[:cut]), self._piece(body[cut:])
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self._merge(b"".join(self.tokens[t] for t in left[a:] + right[:b]))
            if (a == 0 or self._stays(left[a - 1], window[0])) and (b == len(right) or self._stays(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def _stays_uncached(self, first: int, second: int) -> bool:
        return self._merge(self.tokens[first] + self.tokens[second]) == [first, second]

    def _merge(self, body: bytes) -> list[int]:
        """Merge neighbours by lowest rank, leftmost first."""
        whole = self.ranks.get(body)
        if whole is not None:
            return [whole]
        parts = [body[i : i + 1] for i in range(len(body))]
        ranks = self.ranks
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    # --- back to bytes ---

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@lru_cache(2)
def codec(rank_file: str, pattern: str) -> TreeCodec:
    """One codec per Python worker."""
    return TreeCodec(rank_file, pattern)


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row. A null text has the ids of the empty text: none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, ids array<int>")


def decoded(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and body (binary) of every row of ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            bodies = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(task, f"doc_id {kind}, body binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without moving ids through the JVM.

    Null and empty texts have no tokens. Repeated rows are each answered; other columns are not read.
    An empty table gives an empty result. Texts of any length: a task holds a batch of them at a time.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(task, schema)
