"""Filters written as text, compiled to column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import schema

# Operators in the order they are looked for.
_OPERATORS = {"==": eq, "!=": ne, ">=": ge, "<=": le, ">": gt, "<": lt}

_INTEGER = r"^\s*[+-]?\d+\s*$"
_DECIMAL = r"^\s*[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def id_list(text: str | None) -> list[int] | None:
    """Integers separated by commas or spaces; None when there are none."""
    tokens = [t for t in re.split(r"[\s,]+", (text or "").strip()) if t]
    wrong = [t for t in tokens if not re.fullmatch(r"[+-]?\d+", t)]
    if wrong:
        raise ValueError(f"expected integers, got {wrong}")
    return [int(t) for t in tokens] or None


def in_list(column: Column, values: Iterable | None, *, ignore_case: bool = False) -> Column:
    """Membership; an empty list keeps every row."""
    values = list(values or [])
    if not values:
        return F.lit(True)
    if ignore_case:
        return F.lower(column).isin([str(v).lower() for v in values])
    return column.isin(values)


def equalities(pairs: Sequence[str]) -> Column:
    """``key=value`` texts, all of which must hold."""
    tests = []
    for pair in pairs:
        key, found, value = pair.partition("=")
        if not found:
            raise ValueError(f"expected key=value, got {pair!r}")
        tests.append(F.col(key.strip()).cast("string") == value.strip())
    return reduce(and_, tests, F.lit(True))


def _literal(text: str) -> int | float | str:
    for kind in (int, float) if "." not in text else (float,):
        if re.match(_DECIMAL if kind is float else _INTEGER, text):
            return kind(text)
    return text


def _compare(df: DataFrame, field: str, name: str, value: int | float | str) -> Column:
    when_unknown = F.lit(name == "!=")
    if field not in df.columns:
        return when_unknown
    cell, is_text = F.col(field), isinstance(df.schema[field].dataType, T.StringType)
    if isinstance(value, str):
        known = cell if is_text else F.lit(None).cast("string")
    elif is_text:
        known = F.when(cell.rlike(_INTEGER) | cell.rlike(_DECIMAL), F.trim(cell).try_cast("double"))
    else:
        known = cell
    return F.coalesce(_OPERATORS[name](known, F.lit(value)), when_unknown)


def expression(df: DataFrame, text: str) -> Column:
    """Predicate of ``field OP value``, where ``a OR b`` or ``a|b`` lists alternatives.

    A numeric literal compares text cells by their number. A missing, null or incomparable cell
    differs from every value and is in no order with it.
    """
    name = next((op for op in _OPERATORS if op in text), None)
    if name is None:
        raise ValueError(f"no operator in filter {text!r}")
    field, _, value = text.partition(name)
    separator = " OR " if " OR " in value else "|"
    values = [_literal(v.strip()) for v in value.strip().split(separator)]
    return reduce(or_, [_compare(df, field.strip(), name, v) for v in values])


def apply_filters(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Rows that meet all filter texts."""
    return df.where(reduce(and_, [expression(df, t) for t in texts], F.lit(True)))


def project(df: DataFrame, fields: Sequence[str], missing: str | None = None) -> DataFrame:
    """The named columns in the given order; absent ones are added."""
    return df.select(
        *[
            F.col(f"`{f}`") if f in df.columns else F.lit(missing).cast("string").alias(f)
            for f in fields
        ]
    )


def known_mime_type(mime_type: Column) -> Column:
    """Whether the archive takes files of a type."""
    return mime_type.isin(list(schema.MIME_TYPES))
