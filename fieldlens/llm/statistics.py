"""Counts over whole texts, from which the quality operators make their features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8

# Counted for each text; "symbols" are #*$%&|<> and words are runs of anything but ASCII white space.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_lower", "n_digits", "n_marks", "n_bars", "n_non_ascii", "n_space",
)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


_CONTINUED = _bytes((0x80, 0xBF))
_CLASSES = {
    "n_symbols": np.isin(np.arange(256), list(b"#*$%&|<>")),
    "n_upper": _bytes((65, 90)),
    "n_lower": _bytes((97, 122)),
    "n_digits": _bytes((48, 57)),
    "n_marks": np.isin(np.arange(256), list(b"!?")),
    "n_bars": np.isin(np.arange(256), list(b"|")),
    "n_non_ascii": _bytes((0xC0, 0xFF)),
    "n_space": _bytes((9, 13), (32, 32)),
}
_MASKS = np.array([*_CLASSES.values(), ~_CONTINUED], float).T


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more."""
    n = len(hashes)
    if n <= window:
        return 0
    sums, width = hashes, 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[: window.bit_length() - 1]:
        sums = (sums[:-width] * np.uint64(factor)) ^ (sums[width:] + (sums[width:] >> np.uint64(31)))
        width *= 2
    ordered = np.sort(sums)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    upto = np.concatenate([[0], np.cumsum(np.isin(sums, ordered[1:][same]))])
    at = np.arange(n)
    return int((upto[np.minimum(at + 1, len(sums))] > upto[np.maximum(at - window + 1, 0)]).sum())


def counts_of(body: bytes) -> list[int]:
    """The counts of one text, given as UTF-8, in the order of COUNTS."""
    if not body:
        return [0] * len(COUNTS)
    by_class = dict(zip([*_CLASSES, "points"], (np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _MASKS).astype(int).tolist()))
    words = body.split()
    lines = [line for line in body.split(b"\n") if line.strip()]
    found = by_class | {
        "n_words": len(words),
        "word_chars": by_class["points"] - by_class["n_space"],
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(word_hashes(words)),
        "n_lines": len(lines),
        "n_distinct_words": len(set(words)),
    }
    return [found[name] for name in COUNTS]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS (bigint) of every row; null counts as the empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(b.as_py() or b"") for b in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.T.copy())], ["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(
        task, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    )


FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "bars",
    "distinct", "non_ascii", "space", "log_line",
)


def features_of(counts: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS: logarithms and shares, finite for empty texts too."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines = np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            np.minimum(chars / words, 50),
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1),
            c["n_digits"] / chars,
            c["n_marks"] / chars,
            c["n_bars"] / words,
            c["n_distinct_words"] / words,
            c["n_non_ascii"] / chars,
            c["n_space"] / (chars + c["n_space"]),
            np.log1p(words / lines),
        ]
    )


def count_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
