"""Cell-level parsing of exports and forms as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens import schema

# Fixed key orders; the first key present names the subject. Label exports prefer the lower-case
# spelling, the duplicate check the capitalised one.
EXPORT_NAME_KEYS = ("filename", "Filename", "file_name", "name", "display_name")
SUBJECT_NAME_KEYS = ("Filename", "filename", "file_name", "name", "display_name")


def subject_ids(text: Column, *, legacy: bool = False) -> Column:
    """Integers of a comma list, bracketed list or single cell; noisy items keep their digits.

    A semicolon separates too, unless ``legacy``, where it is noise like any other character.
    """
    parts = F.split(text, "," if legacy else "[,;]")

    def number(part: Column) -> Column:
        part = F.trim(part)
        exact = F.when(part.rlike(r"^[+-]?\d+$"), part.try_cast("bigint"))
        return F.coalesce(exact, F.regexp_replace(part, "[^0-9]", "").try_cast("bigint"))

    found = F.filter(F.transform(parts, number), lambda n: n.isNotNull())
    single = F.when(text.rlike("^[0-9]+$"), F.array(text.try_cast("bigint")))
    return F.coalesce(single, found, F.array().cast("array<bigint>"))


def annotations(text: Column) -> Column:
    """Annotation list of an export cell; an empty list when the text is not JSON.

    The JSON reader accepts single-quoted text as well.
    """
    return F.coalesce(F.from_json(text, schema.ANNOTATIONS), F.array().cast(schema.ANNOTATIONS))


def _mixed_values(text: Column) -> Column:
    """Values of a cell in which some are plain strings: those become choices without answers."""

    def element(value: Column) -> Column:
        read = F.from_json(value, schema.ANNOTATION_VALUE)
        is_object = value.startswith("{")
        return F.struct(
            F.when(is_object, read["choice"]).otherwise(value).alias("choice"),
            F.when(is_object, F.coalesce(read["answers"], F.create_map().cast("map<string,string>"))).alias("answers"),
        )

    parsed = F.from_json(text, schema.ANNOTATION_TEXTS)
    values = F.transform(parsed, lambda a: F.coalesce(a["value"], F.array().cast("array<string>")))
    return F.transform(F.flatten(values), element)


def with_values(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add all value elements of all tasks of an annotation cell, in document order.

    A cell is parsed once, typed. Only where a task's values do not fit the type, as with plain
    strings, the cell is read again element by element. Answers are null for plain strings only.
    """
    typed = df.withColumn("_typed", annotations(F.col(text)))
    odd = F.exists("_typed", lambda a: a["value"].isNull())
    values = F.when(odd, _mixed_values(F.col(text))).otherwise(F.flatten(F.col("_typed")["value"]))
    return typed.withColumn(name, values).drop("_typed")


def with_choices(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the value elements that carry a choice with its answers."""
    labelled = F.filter(name, lambda v: (v["choice"] != "") & v["answers"].isNotNull())
    return with_values(df, text, name).withColumn(name, labelled)


def choice_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per choice of an annotation cell: the kept columns, ``pos``, ``choice`` and ``answers``.

    The explode is outer: an inner one would first test the list for emptiness, parsing it once more.
    """
    read = with_choices(df.select(*keep, text), text, "_choices")
    rows = read.select(*keep, F.posexplode_outer("_choices").alias("pos", "_choice")).where("pos IS NOT NULL")
    return rows.select(*keep, "pos", "_choice.choice", "_choice.answers")


def subject_record(subject_data: Column, sid: Column) -> Column:
    """One subject's attributes from the export's subject data."""
    return F.try_element_at(F.from_json(subject_data, schema.SUBJECT_DATA), sid.cast("string"))


def first_key(attributes: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(attributes, F.lit(key)) for key in keys])


def retirement_reason(record: Column) -> Column:
    return F.get_json_object(F.try_element_at(record, F.lit("retired")), "$.retirement_reason")


def labelled_media_id(file_name: Column) -> Column:
    """Leading digits before ``_x_`` in the base name, else null."""
    found = F.regexp_extract(file_name, r"(?:^|/)(\d+)_x_[^/]*$", 1)
    return F.when(found != "", found)


def whole_number(text: Column) -> Column:
    """Integer when the text is all digits, else null."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def annotation_label(parsed: Column) -> Column:
    """First choice, followed by its count in brackets; ``invalid`` when there is no first value."""
    first = F.try_element_at(F.try_element_at(parsed, F.lit(1))["value"], F.lit(1))
    choice = F.coalesce(first["choice"], F.lit("unknown"))
    count = F.try_element_at(first["answers"], F.lit("HOWMANY"))
    shown = F.when(count != "", F.concat(choice, F.lit(" ("), count, F.lit(")")))
    return F.when(first.isNull(), "invalid").otherwise(F.coalesce(shown, choice))


def camera_model(make: Column, model: Column, *, legacy: bool = False) -> Column:
    """Make and model in lower case; the make is dropped when the model starts with it."""
    missing = "none" if legacy else "(unknown)"

    def clean(text: Column) -> Column:
        return F.lower(F.trim(F.coalesce(text, F.lit(missing))))

    make, model = clean(make), clean(model)
    return F.when(model.startswith(make), model).otherwise(F.concat_ws(" ", make, model))


def repaired_text(text: Column) -> Column:
    """Text whose UTF-8 bytes had been read as Latin-1, read again; unchanged when that fails."""
    narrow = text.rlike(r"^[\x{0}-\x{FF}]*$")
    again = F.try_validate_utf8(F.encode(F.when(narrow, text), "ISO-8859-1").cast("string"))
    return F.coalesce(again, text)


def joined_cell(values: Column) -> Column:
    """List cell as text: one element as it is, several joined with ``:::``; empty stays empty."""
    return F.array_join(values, ":::")


def first_or_blank(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def unknown_key(prefix: str, entry_id: Column, digits: int = 12) -> Column:
    """Key for an entry without one. Derived from the entry id, so reruns give the same key."""
    return F.concat(F.lit(prefix + "_"), F.upper(F.sha1(entry_id.cast("string")).substr(1, digits)))
