"""Names, paths and labels as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import schema


@F.pandas_udf(T.StringType())
def _decomposed_ascii(names: pd.Series) -> pd.Series:
    plain = names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
    return plain.where(names.notna(), None)


@F.pandas_udf(T.StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKC").where(names.notna(), None)


def slug(name: Column, *, allow_unicode: bool = False, ascii_input: bool = False) -> Column:
    """Lower-case URL-safe form of a name.

    Only Unicode normalisation needs Python; with ``ascii_input`` the expression stays in the JVM.
    """
    word = "(?U)" if allow_unicode else ""
    text = name
    if not ascii_input:
        text = _composed(name) if allow_unicode else _decomposed_ascii(name)
    text = F.regexp_replace(F.lower(text), word + r"[^\w\s-]", "")
    text = F.regexp_replace(text, word + r"[-\s]+", "-")
    return F.regexp_replace(text, "^[-_]+|[-_]+$", "")


def extension(file_name: Column) -> Column:
    """Lower-cased suffix with its dot, empty when there is none."""
    base = F.regexp_extract(file_name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(?s).(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def natural_key(path: Column) -> Column:
    """Text that sorts as the path does when its digit runs compare as numbers.

    A number of up to 20 digits becomes a low separator and its digits, padded with zeros; a longer one
    a higher separator, its length and its digits. The separators sort before any printable text.
    """
    padded = F.regexp_replace(path, "([0-9]+)", "\u0001" + "0" * 20 + "$1")
    usual = F.regexp_replace(padded, "\u00010*([0-9]{20})(?![0-9])", "\u0001$1")

    def sortable(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        short = F.concat(F.lit("\u0001"), F.lpad(digits, 20, "0"))
        long = F.concat(F.lit("\u0002"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        number = F.when(F.length(digits) <= 20, short).otherwise(long)
        return F.when(run.rlike("^[0-9]"), number).otherwise(run)

    runs = F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    exact = F.array_join(F.transform(runs, sortable), "")
    return F.when(path.rlike("[0-9]{21}"), exact).otherwise(usual)


def collection_name_ok(name: Column) -> Column:
    return name.rlike(schema.COLLECTION_NAME)


def deployment_name_ok(name: Column) -> Column:
    return name.rlike(schema.DEPLOYMENT_NAME)


def name_prefix(deployment: Column) -> Column:
    """Text before the first dash, the whole name when there is none."""
    return F.substring_index(deployment, "-", 1)


def location_of(deployment: Column, *, legacy: bool = False) -> Column:
    """Text after the first dash, empty when there is none; legacy: up to the second dash."""
    pattern = r"^[^-]*-([^-]*)" if legacy else r"(?s)^[^-]*-(.*)$"
    return F.regexp_extract(deployment, pattern, 1)


def content_path(digest: Column) -> Column:
    return F.concat(F.lit("/"), digest.substr(1, 2), F.lit("/"), digest.substr(3, 2), F.lit("/"), digest)


def archive_name(deployment: Column, taken: Column, ordinal: Column, file_name: Column) -> Column:
    """``DEP__YYYYMMDD_IDX.EXT`` in upper case; ``.jpg`` is written ``.jpeg``."""
    suffix = extension(file_name)
    suffix = F.when(suffix == ".jpg", ".jpeg").otherwise(suffix)
    day = F.date_format(taken, "yyyyMMdd")
    return F.upper(F.concat(deployment, F.lit("__"), day, F.lit("_"), ordinal.cast("string"), suffix))


def package_name(
    name: Column, project: Column, stamp: Column, collection: Column, deployment: Column, part: Column
) -> Column:
    stem = F.concat_ws("_", name, project.cast("string"), stamp, collection, deployment)
    return F.concat(stem, F.format_string("_part%03d", part))


def package_fields(file_name: Column) -> dict[str, Column]:
    """Stamp, tail, part and suffix of a package file name; nulls when it has another form.

    Name, project and stamp hold no underscore; the tail is collection and deployment, which may both
    hold some, so only the known collections tell them apart.
    """
    form = r"^[^_]*_[^_]*_([^_]*)_(.+)_part(.*?)(\.yaml|\.zip)$"

    def field(number: int) -> Column:
        return F.when(file_name.rlike(form), F.regexp_extract(file_name, form, number))

    return {"stamp": field(1), "tail": field(2), "part": field(3), "suffix": field(4)}


def label_name(media_id: Column, deployment: Column, file_name: Column) -> Column:
    return F.concat_ws("_x_", media_id.cast("string"), deployment, file_name)


def media_urls(base_url: str, media_id: Column) -> dict[str, Column]:
    """External id and the three addresses of a media file; ``base_url`` ends with a slash."""
    key = media_id.cast("string")

    def url(view: str) -> Column:
        return F.concat(F.lit(f"{base_url}storage/resource/media/"), key, F.lit(f"/{view}/"))

    return {
        "external_id": F.concat(F.lit(f"{base_url}:media:"), key),
        "preview": url("pfile"),
        "link": url("file"),
        "thumbnail": url("tfile"),
    }


def subject_set_name(
    research: Column, research_id: Column, collection: Column, collection_id: Column, month: Column
) -> Column:
    return F.concat_ws(
        "_", research, research_id.cast("string"), collection, collection_id.cast("string"), month
    )


def revision_code(number: Column, location: Column | None = None) -> Column:
    code = F.format_string("R%04d", number)
    return F.upper(code if location is None else F.concat(code, F.lit("-"), location))
