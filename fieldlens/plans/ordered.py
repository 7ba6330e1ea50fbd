"""Ordered computations over groups that may not fit one task.

Positions, previous values and running sums need a group's rows in order. Without ``chunk_rows`` each
group is sorted in one task by a plain window: one shuffle and one sort, right where every group is known
to fit a task. With ``chunk_rows`` the rows are range-partitioned by (group, order), sorted, cut into chunks
of that many rows and stored, so that a huge group spans many chunks; each chunk is handled by a window of its own, and what a chunk needs from
the chunks before it (their row count, sums, last value) is carried over through a table with at most a
few rows per chunk. Each further step reads what the step before has stored, so the plans do not grow.
The caller chooses; nothing is counted to decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.session import stored

_CHUNK = "_chunk"
# A range holds at least about so many rows; small chunks are several in a range, so tasks grow with the rows only.
_RANGE_ROWS = 100_000


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a grouping and a total order inside each group.

    ``chunked`` tells whether the rows carry a chunk number that follows the order; ``extended`` whether
    they have been extended since they were last stored.
    """

    rows: DataFrame
    group: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool
    extended: bool = False

    def where(self, condition: Column) -> OrderedRows:
        return replace(self, rows=self.rows.where(condition))

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedRows:
        return replace(self, rows=self.rows.withColumns(dict(columns)))

    def regroup(self, *group: str) -> OrderedRows:
        """Use a finer grouping whose groups are contiguous in the present order."""
        return replace(self, group=group)

    def result(self) -> DataFrame:
        return self.rows.drop(_CHUNK)

    @property
    def split_keys(self) -> list[str]:
        """Columns whose values identify the rows one task works on."""
        return [*self.group, _CHUNK] if self.chunked else list(self.group)

    def extend(
        self,
        *,
        position: str | None = None,
        total: str | None = None,
        running: Mapping[str, Column] | None = None,
        previous: Mapping[str, Column] | None = None,
        previous_where: Mapping[str, tuple[Column, Column]] | None = None,
        maximum: Mapping[str, Column] | None = None,
    ) -> OrderedRows:
        """Add order-dependent columns.

        position: 1-based row number; total: rows in the group; running: inclusive running sums;
        previous: value on the row before; previous_where: name -> (value, condition), the value on
        the nearest earlier row that meets the condition, also when that value is null;
        maximum: largest value in the group.
        """
        running, maximum = dict(running or {}), dict(maximum or {})
        lookback = {n: (v, F.lit(True)) for n, v in (previous or {}).items()} | dict(previous_where or {})
        # A struct tells "no earlier row" (null) from "earlier row with a null value".
        boxed = {n: F.when(c, F.struct(v.alias("v"))) for n, (v, c) in lookback.items()}

        if self.chunked and self.extended:
            return replace(self, rows=stored(self.rows, "ordered-step"), extended=False).extend(
                position=position, total=total, running=running, previous=previous,
                previous_where=previous_where, maximum=maximum,
            )
        keys = self.split_keys
        whole = Window.partitionBy(*keys)
        ordered = whole.orderBy(*self.order)
        upto, before = (
            ordered.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1)
        )
        local: dict[str, Column] = {}
        if position:
            local[position] = F.row_number().over(ordered).cast("bigint")
        if total:
            local[total] = F.count(F.lit(1)).over(whole)
        for name, value in running.items():
            local[name] = F.sum(value).over(upto)
        for name, value in maximum.items():
            local[name] = F.max(value).over(whole)
        for name, box in boxed.items():
            if previous and name in previous:
                local[name] = F.lag(box).over(ordered)
            else:
                local[name] = F.last(box, ignorenulls=True).over(before)
        rows = self.rows.withColumns(local)
        if not self.chunked:
            return replace(self, rows=rows.withColumns({n: F.col(n)["v"] for n in boxed}))

        # One row per (group, chunk): what this chunk hands on to the later chunks of its group.
        last_key = F.struct(*self.order)
        handed = {"_n": F.count(F.lit(1))}
        handed |= {f"_sum_{n}": F.sum(v) for n, v in running.items()}
        handed |= {f"_max_{n}": F.max(v) for n, v in maximum.items()}
        handed |= {
            f"_last_{n}": F.max_by(b, F.when(b.isNotNull(), last_key)) for n, b in boxed.items()
        }
        summary = self.rows.groupBy(*keys).agg(*[v.alias(n) for n, v in handed.items()])
        of_group = Window.partitionBy(*self.group)
        earlier = of_group.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.count(F.lit(1)).over(of_group).alias("_chunks"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(of_group).alias("_total"),
            *[F.sum(f"_sum_{n}").over(earlier).alias(f"_sum_{n}") for n in running],
            *[F.max(f"_max_{n}").over(of_group).alias(f"_max_{n}") for n in maximum],
            *[
                F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_last_{n}")
                for n in boxed
            ],
        ).where("_chunks > 1")  # at most the first and last group of every chunk
        carry = stored(carry, "carry")
        same = [rows[k].eqNullSafe(carry[f"_key_{k}"]) for k in keys]
        joined = rows.join(carry, same, "left")
        merged: dict[str, Column] = {}
        if position:
            merged[position] = F.col(position) + F.coalesce("_before", F.lit(0))
        if total:
            merged[total] = F.coalesce("_total", total)
        for name in running:
            carried = F.col(f"_sum_{name}")
            merged[name] = F.coalesce(F.col(name) + carried, F.col(name), carried)
        for name in maximum:
            merged[name] = F.coalesce(f"_max_{name}", name)
        for name in boxed:
            merged[name] = F.coalesce(name, f"_last_{name}")["v"]
        kept = [c for c in rows.columns if c not in merged]
        return replace(
            self,
            rows=joined.select(*[rows[c] for c in kept], *[v.alias(n) for n, v in merged.items()]),
            extended=True,
        )


def ordered_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    sizes: DataFrame | None = None,
    chunk_rows: int | None = None,
) -> OrderedRows:
    """Prepare rows for ordered computations.

    ``order`` must be a total order inside a group (end it with a unique id). ``chunk_rows`` is how many rows a
    chunk holds at most; without it each group stays whole. To know the number of ranges the rows are
    counted: pass ``sizes``, a table with at least as many rows, when counting ``df`` itself would repeat
    an expensive step.
    """
    if chunk_rows is None:
        return OrderedRows(df, tuple(group), tuple(order), False)
    ranges = ceil((df if sizes is None else sizes).count() / max(chunk_rows, _RANGE_ROWS)) + 1
    ranged = df.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    # The id is the partition's number, 31 bits, and the row's place in it, 33 bits.
    numbered = ranged.withColumn(_CHUNK, F.monotonically_increasing_id())
    place = F.col(_CHUNK).bitwiseAND((1 << 33) - 1)
    chunk = F.col(_CHUNK) - place + F.floor(place / F.lit(chunk_rows))
    # Stored, because two reads of one range partitioning may sample different boundaries.
    stored_rows = stored(numbered.withColumn(_CHUNK, chunk), "ordered")
    return OrderedRows(stored_rows, tuple(group), tuple(order), True)
