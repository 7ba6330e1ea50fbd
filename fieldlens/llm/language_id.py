"""Language identification in two steps: the family first, then the languages inside it.

Whole texts become hashed counts of byte pairs and triples of their letters. One linear support vector
machine per family tells it from the others; inside the chosen family one machine per pair of languages
votes. So closely related languages are separated by weights that need not care about distant ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.common import fold

FOLDS = 5  # fold 0 is held out
BUCKETS = 2048
# Rows learned from, by hash of the id: about this many of each language, and fewer where there are so many
# languages that all would be more than LEARNING_ROWS; but no language is left out.
ROWS_PER_LANGUAGE, LEAST_ROWS = 1200, 20
LEARNING_ROWS = 32 * ROWS_PER_LANGUAGE
# Machines that the driver fits itself; more are fitted in tasks.
DRIVER_MACHINES = 64
UNKNOWN = "und"
# In a filter, rows below this score are turned away; low, to keep clean documents.
MIN_SCORE = 0.05

# ISO 639-1 codes by family. Other values are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn pa gu mr ne ur si",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# ASCII letters in lower case, all other ASCII as white space, bytes of other scripts as they are.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_GAP = b"\0\0"
_BLOCK_BYTES = 1 << 20


def family_of(language: str) -> str:
    return _FAMILY.get(language, language)


def _blocks(bodies: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for body in bodies:
        block.append(body)
        size += len(body)
        if size >= _BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def features(bodies: list[bytes]) -> np.ndarray:
    """One row per text: square roots of the bucket counts, scaled to length 1; zero without letters."""
    parts = []
    for block in _blocks(bodies):
        # Two zero bytes after texts, so that no text's counts depend on its neighbours.
        joined = _GAP.join(b.translate(_LETTERS) for b in block) + _GAP
        lengths = np.array([len(b) + len(_GAP) for b in block])
        a = np.frombuffer(joined, np.uint8).astype(np.uint32)
        base = np.repeat(np.arange(len(block), dtype=np.int64) * BUCKETS, lengths)
        pairs = a[:-1] * np.uint32(256) + a[1:]
        triples = pairs[:-1] * np.uint32(256) + a[2:]
        half = np.uint32(BUCKETS // 2 - 1)
        counts = np.zeros((len(block) + 1) * BUCKETS)
        last = np.cumsum(lengths) - 1
        for grams, start, reach in ((pairs, 0, 1), (triples, BUCKETS // 2, 2)):
            base[last - reach + 1] = len(block) * BUCKETS  # reaches into the next text: counted apart
            slots = base[: len(grams)] + ((grams * np.uint32(2654435761)) >> np.uint32(15) & half) + start
            counts += np.bincount(slots, minlength=len(counts))
        parts.append(np.sqrt(counts.reshape(-1, BUCKETS)[:-1]).astype(np.float32))
    if not parts:
        return np.zeros((0, BUCKETS), np.float32)
    rows = np.concatenate(parts)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def has_letter(body: bytes) -> bool:
    if body.translate(_LETTERS, b"").isspace() or not body:
        return False
    return any(65 <= b <= 90 or 97 <= b <= 122 for b in body[:64]) or any(map(str.isalpha, body.decode("utf-8", "replace")))


def fit_svm(rows: np.ndarray, sign: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps.

    Both classes weigh the same, whatever their sizes.
    """
    return _fit_svm(np.column_stack([rows, np.ones(len(rows), np.float32)]), sign, ridge, steps)


def _fit_svm(x: np.ndarray, sign: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> np.ndarray:
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    weights = np.zeros(x.shape[1], np.float32)
    ahead, rate = weights.copy(), 1 / (2 * 2 + ridge)  # rows have length 1, with the bias sqrt(2)
    for step in range(steps):
        short = np.maximum(0, 1 - sign * (x @ ahead))
        slope = -2 * ((share * sign * short) @ x) + ridge * ahead
        moved = ahead - rate * slope
        ahead = moved + step / (step + 3) * (moved - weights)
        weights = moved
    return weights


@dataclass
class Model:
    languages: list[str]
    families: list[str] = field(default_factory=list)
    by_family: np.ndarray | None = None  # (families, BUCKETS + 1)
    by_pair: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of every row."""
        n = len(rows)
        x = np.column_stack([rows, np.ones(n, np.float32)])
        sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))
        margins = x @ self.by_family.T if len(self.families) > 1 else np.ones((n, 1))
        family = margins.argmax(1)
        score = sure(margins.max(1)) if len(self.families) > 1 else np.ones(n)
        best = np.zeros(n, int)
        for f, name in enumerate(self.families):
            members = [i for i, code in enumerate(self.languages) if family_of(code) == name]
            here = np.flatnonzero(family == f)
            votes = np.zeros((len(here), len(members)))
            least = np.full((len(here), len(members)), np.inf)
            for a, b in combinations(range(len(members)), 2):
                margin = x[here] @ self.by_pair[members[a], members[b]]
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                least[:, a] = np.minimum(least[:, a], margin)
                least[:, b] = np.minimum(least[:, b], -margin)
            finite = np.where(np.isinf(least), 2.0, least)
            winner = (votes + 1e-3 * np.tanh(finite)).argmax(1)  # votes first, then the narrowest margin
            best[here] = np.array(members)[winner]
            if len(members) > 1:
                score[here] *= sure(finite[np.arange(len(here)), winner])
        return best, score


def fit(rows: np.ndarray, languages: np.ndarray, spark: SparkSession | None = None) -> Model:
    """A machine per family and per pair of languages in a family; in tasks of ``spark`` if there are many."""
    codes = sorted(set(languages.tolist()))
    model = Model(codes, sorted({family_of(c) for c in codes}))
    by_name = {f: [] for f in model.families}
    for i, code in enumerate(codes):
        by_name[family_of(code)].append(i)
    place = {code: i for i, code in enumerate(codes)}
    language = np.array([place[c] for c in languages.tolist()])
    family_at = {name: i for i, name in enumerate(model.families)}
    family = np.array([family_at[family_of(c)] for c in codes])[language]
    pairs = [pair for members in by_name.values() for pair in combinations(members, 2)]
    several = len(model.families) if len(model.families) > 1 else 0
    x = np.column_stack([rows, np.ones(len(rows), np.float32)])

    def machine(number: int, x: np.ndarray) -> np.ndarray:
        if number < several:
            return _fit_svm(x, np.where(family == number, 1, -1).astype(np.float32))
        a, b = pairs[number - several]
        used = np.isin(language, [a, b])
        return _fit_svm(x[used], np.where(language[used] == a, 1, -1).astype(np.float32))

    total = several + len(pairs)
    if spark is None or total <= DRIVER_MACHINES:
        found = [machine(i, x) for i in range(total)]
    else:
        shared = spark.sparkContext.broadcast(x)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    weights = machine(number, shared.value).astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([weights], pa.binary())], ["id", "weights"])

        del x  # tasks take the broadcast
        parts = min(total, 4 * spark.sparkContext.defaultParallelism)
        table = spark.range(0, total, 1, parts).mapInArrow(task, "id bigint, weights binary").toArrow().sort_by("id")
        found = [np.frombuffer(w.as_buffer(), np.float32) for w in table.column("weights")]
        shared.unpersist()
    if several:
        model.by_family = np.stack(found[:several])
    model.by_pair = dict(zip(pairs, found[several:]))
    return model


def learn(docs: DataFrame) -> Model | None:
    """A model of every language with labelled rows outside fold 0, from a bounded number of them each.

    The rows are chosen by a hash of their ids, evenly over the table. None without labelled rows. The
    driver holds a number per language and the chosen rows.
    """
    # Documents without text or letters teach nothing.
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    labelled = labelled.where(fold(F.col("doc_id"), FOLDS) > 0)
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return None
    rows_each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, LEARNING_ROWS // len(sizes)))
    spark = docs.sparkSession
    # Languages of few rows are learned whole.
    shares = [(row["lang"], int(min(1.0, rows_each / row["count"]) * (1 << 30))) for row in sizes]
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    bounds = F.broadcast(spark.createDataFrame(shares, "lang string, _share bigint"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.as_py() for b in batch.column("text")]
            kept = [i for i, b in enumerate(bodies) if has_letter(b)]
            rows = features([bodies[i] for i in kept])
            langs = batch.column("lang").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([langs, pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "row"])

    sample = labelled.join(bounds, "lang").where(place < F.col("_share")).select("lang", F.encode("text", "UTF-8").alias("text"))
    sample = sample.mapInArrow(task, "lang string, row binary")
    # The hash keeps about rows_each rows each; the limit holds for tables that repeat an id.
    found = sample.limit(len(sizes) * 2 * rows_each).toArrow()
    if not len(found):
        return None
    rows = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in found.column("row")])
    return fit(rows, np.array(found.column("lang").to_pylist(), object), spark)


def _judge(model: Model | None, bodies: list[bytes]) -> tuple[list[str], np.ndarray]:
    known = np.array([model is not None and has_letter(b) for b in bodies], bool)
    names, scores = np.full(len(bodies), UNKNOWN, object), np.zeros(len(bodies))
    if known.any():
        best, score = model.predict(features([b for b, k in zip(bodies, known) if k]))
        names[known] = np.array(model.languages, object)[best]
        scores[known] = score
    return names.tolist(), scores


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Learns from text and lang of rows outside fold 0 (CRC-32 of doc_id as text, modulo 5); rows with a
    null in doc_id, text or lang teach nothing. A null text, and one without a letter, is ``und`` with
    score 0, and so is every row when there is nothing to learn from. Repeated rows are each answered;
    other columns are not read; an empty table gives an empty result.
    """
    model = learn(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judge(model, [b.as_py() or b"" for b in batch.column("text")])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(task, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a language that was learned, with all their columns.

    Rows that are ``und`` or score below ``min_score`` go; without anything to learn from, all rows with
    a letter stay. Rows are judged where they are, so texts are not shuffled.
    """
    model = learn(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t.as_py() or "").encode("utf-8") for t in batch.column("text")]
            if model is None:
                keep = [has_letter(b) for b in bodies]
            else:
                names, scores = _judge(model, bodies)
                keep = [n != UNKNOWN and s >= min_score for n, s in zip(names, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
