"""Shards along a Hilbert curve over document metadata.

Several metadata columns, texts or numbers, are quantised to a few bits each, by exact quantiles, so that every
cell of the grid holds a like share of the rows. Rows are sorted by their cell's place on the Hilbert curve and the order
is cut into runs. A run covers few neighbouring cells, so a reader that filters on any of the dimensions
can skip most shards by their minima and maxima. Column functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import globally_ranked, utf8
from fieldlens.plans.ordered import ordered_rows
from fieldlens.session import stored

BITS = 5
# Distinct values of a dimension that are put in order at a time.
VALUES_AT_A_TIME = 1_000_000


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Step tables of the curve: place of an octant and next state, at ``state << dims | octant``.

    A state is (entry corner, direction); the rules are those of the reflected Gray code.
    """
    corners, mask = 1 << dims, (1 << dims) - 1
    gray = [w ^ (w >> 1) for w in range(corners)]
    inverse = {g: w for w, g in enumerate(gray)}
    rotate = lambda x, by: ((x << by % dims) | (x >> (dims - by % dims))) & mask
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, corners)]
    trailing_ones = lambda w: ((w ^ (w + 1)).bit_length() - 1) % dims
    turn = [0] + [trailing_ones(w if w % 2 else w - 1) for w in range(1, corners)]
    places, states = [], []
    for state in range(corners * dims):
        corner, direction = divmod(state, dims)
        for octant in range(corners):
            w = inverse[rotate(octant ^ corner, -(direction + 1))]
            places.append(w)
            states.append((corner ^ rotate(entry[w], direction + 1)) * dims + (direction + turn[w] + 1) % dims)
    return places, states


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Place on the curve of a cell, given as one integer of ``bits`` bits per dimension."""
    dims = len(cells)
    places, states = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    octants = F.array(
        *[
            reduce(lambda a, b: a + b, [F.shiftright(c, bit).bitwiseAND(1) * (1 << j) for j, c in enumerate(cells)])
            for bit in reversed(range(bits))
        ]
    )
    start = F.struct(F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("state"))

    def step(at: Column, octant: Column) -> Column:
        slot = at["state"] * (1 << dims) + octant
        return F.struct((at["place"] * (1 << dims) + F.get(places, slot)).alias("place"), F.get(states, slot).alias("state"))

    return F.aggregate(octants, start, step, lambda at: at["place"])


def cuts_of(df: DataFrame, column: str, bits: int) -> list[tuple[int, Any]]:
    """The cells above the lowest that have a value, and the smallest value of each; at most 2^bits - 1.

    A value's cell is its share of the rows below it, times 2^bits, without the rest; nulls are below all.
    Values are counted and put in order by ranges, whole, so texts may share any beginning.
    """
    counted = stored(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), "dimension")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    values = ordered_rows(counted, [], [column], chunk_rows=VALUES_AT_A_TIME).extend(running={"_upto": F.col("_n")}).result()
    cell = F.expr(f"(_upto - _n) * {1 << bits} div {max(total, 1)}")
    lowest = values.where(F.col(column).isNotNull()).groupBy(cell.alias("_cell")).agg(F.min(column).alias("_first"))
    return [(row["_cell"], row["_first"]) for row in lowest.where("_cell > 0").orderBy("_cell").collect()]


def quantised(df: DataFrame, columns: Sequence[str], bits: int) -> list[Column]:
    """Each column's quantile number, from 0 to 2^bits - 1; nulls have 0."""
    cells = []
    for column in columns:
        cell = F.lit(0)
        for number, cut in cuts_of(df, column, bits):
            cell = F.when(F.col(column) >= F.lit(cut), number).otherwise(cell)
        cells.append(cell)
    return cells


def sharded(
    docs: DataFrame, shards: int = 8, dimensions: Mapping[str, Column] | None = None, bits: int = BITS
) -> DataFrame:
    """The shard of every row, by the law ``rows``: counts of shards are at most one apart.

    Returns doc_id, size (bytes of the text, none for null, plus 1), text_crc32, law, shard, slot (place
    in the shard), grown_shard (null: a new number of shards moves rows) and curve. ``dimensions`` names
    expressions over ``docs``; by default source, language and length. Null values of a
    dimension lie in its lowest cell, equal values in one cell. Texts are read whole, however long. Other
    columns are not read. Rows of one cell follow in the order of doc_id, nulls first, then
    of their text's checksum, so hot cells are cut like others. Repeated rows each have a slot. An empty
    table gives an empty result.
    """
    dimensions = dimensions or {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")}
    body = utf8(F.col("text"))
    named = {f"_dimension{i}": value for i, value in enumerate(dimensions.values())}
    narrow = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[value.alias(name) for name, value in named.items()],
    )
    narrow = stored(narrow, "metadata")  # so the texts are read once
    # Cells are columns of their own: the curve reads each several times, and copies of them make huge code.
    cells = quantised(narrow, list(named), bits)
    narrow = narrow.select("doc_id", "size", "text_crc32", *[cell.alias(name) for cell, name in zip(cells, named)])
    curve = hilbert_index([F.col(name) for name in named], bits)
    narrow = narrow.select("doc_id", "size", "text_crc32", curve.alias("curve"))
    ranked = globally_ranked(stored(narrow, "curve"), ["curve", "doc_id", "text_crc32"], "curve-order")
    shard = F.expr(f"rank * {shards} div total")
    return ranked.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(_shard * total + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the rows with all their columns as parquet, one folder per shard.

    Rows meet their shard by doc_id and checksum; the files of a shard follow the curve.
    """
    place = sharded(docs, **options).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    same = docs["doc_id"].eqNullSafe(place["doc_id"]) & (F.crc32(utf8(docs["text"])) == place["text_crc32"])
    rows = docs.join(place, same).select(*[docs[c] for c in docs.columns], place["shard"].alias("_shard"), place["slot"].alias("_slot"))
    ordered = rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    ordered.drop("_slot").write.partitionBy("_shard").parquet(path)
