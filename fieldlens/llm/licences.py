"""Licence notices found by the digest of their canonical text.

Known notices and licence texts are brought into a canonical form (case, punctuation, copyright statements,
equivalent spellings) and digested. The texts under test go through the same column expression: every
whole text, and every line of it as a text of its own, because documents carry notices as lines. A
digest that is known names the licence.

Who holds the copyright is said in lines or short paragraphs of their own, but where lines are broken anew any line may
begin with the word. So a text that has the word has up to three canonical forms: with all its words, which
no line break changes, without copyright lines, and without copyright paragraphs. Column functions only.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.common import utf8

# --- Fixed values: notices and licence texts in public use, by SPDX identifier. ---
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "MIT License\nCopyright (c) [year] [fullname]\nPermission is hereby granted, free of charge, to any person "
        "obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
    ("All-Rights-Reserved", "All rights reserved."),
]


# Whole licence texts: a file each, named by identifier and, where there are several, the wording.
for _file in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
    _name = re.sub(r"(\.[a-z-]+)?\.txt$", "", _file.name)
    KNOWN.append((_name, _file.read_text("utf-8")))

# Spellings that mean the same, and their common form; applied in this order.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
    ("gplv3", "gnu general public license version 3"),
    ("gpl", "gnu general public license"),
    ("creative commons attribution", "cc by"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]
# --- End of fixed values. ---

# A line that begins like this states who holds the copyright and is left out; in lower case.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:[#*/;-]+[ \t]*)?(?:copyright|\(c\)|©)[^\n]*$"
# So does a paragraph that is no longer than this and goes on with a sign, a year or a gap for one.
COPYRIGHT_PARAGRAPH = r"(?m)^[ \t]*(?:[#*/;-]+[ \t]*)?(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)|©)[^\n]{0,200}$"
COPYRIGHT_WORDS = ("copyright", "(c)", "©")
# Of ASCII, letters and digits count; other scripts are kept as they are.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©®™“”„‘’–—]+"


# Rows up to which the known digests are sent to every task: 64 bytes each and a name.
BROADCAST_ROWS = 100_000


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Paragraphs as lines: carriage returns, blank lines, other line breaks, and back.
_PARAGRAPHS = [(r"\r", ""), (r"\n[ \t]*(?:\n[ \t]*)+", "\x01"), (r"\n", " "), ("\x01", "\n")]


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def whole_forms(lower: Column) -> Column:
    """The forms of a lowered text: all of it, without copyright lines, and without copyright paragraphs.

    The last two are null where the text has no word for copyright.
    """
    has = lower.contains(COPYRIGHT_WORDS[0])
    for word in COPYRIGHT_WORDS[1:]:
        has = has | lower.contains(word)
    paragraphs = lower
    for pattern, other in _PARAGRAPHS:
        paragraphs = F.regexp_replace(paragraphs, pattern, other)
    lines, short = F.regexp_replace(lower, COPYRIGHT_LINE, ""), F.regexp_replace(paragraphs, COPYRIGHT_PARAGRAPH, "")
    return F.array(lower, F.when(has, lines), F.when(has, short))


FORMS = 3


def canonical(lower: Column) -> Column:
    """Of a lowered text, words of letters and digits in common spellings."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, PUNCTUATION, " ")), F.lit(" "))
    for variant, common in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {common} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Licence and digest of each form of each known text: digest, licence. Its size is that of the list."""
    table = spark.createDataFrame(known if known is not None else KNOWN, "licence string, text string")
    forms = table.select("licence", F.explode(whole_forms(lowered(F.col("text")))).alias("form"))
    body = canonical(F.col("form"))
    rows = forms.select(F.sha2(utf8(body), 256).alias("digest"), "licence").where(body != "")
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences named by each row: doc_id, whole_licence, licences, n_notices, one row per row.

    ``whole_licence`` is the licence whose known text the entire text is, in one of its forms; the last by name if
    there are several. ``licences`` are the sorted, distinct licences of its lines and its whole; ``n_notices``
    counts the lines that matched. Null and empty texts, and texts of punctuation only, match nothing. Texts are
    read whole, however long. Repeated rows and rows without id are each answered; an empty table gives an empty
    result; other columns are not read. ``known`` is a table of digests as :func:`known_digests` makes it.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    # The forms of the whole text come first; its lines follow. A text of one line is its own only line.
    lower = rows.withColumn("_lower", lowered(F.col("text")))
    units = F.concat(whole_forms(F.col("_lower")), F.split("_lower", "\n", -1))
    spread = lower.select("row_id", "doc_id", F.posexplode_outer(units).alias("unit", "body"))
    body = F.when(F.col("unit") < FORMS, F.col("body")).otherwise(F.regexp_replace("body", COPYRIGHT_LINE, ""))
    digests = spread.select("row_id", "doc_id", "unit", F.sha2(utf8(canonical(body)), 256).alias("digest"))
    # A hash join; a unit meets one known digest at most. The lines stay where they are if the known
    # digests are few, and both sides are shuffled if not.
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = digests.join(F.broadcast(known) if small else known, "digest", "left")
    lines = F.sum(F.when((F.col("unit") >= FORMS) & F.col("licence").isNotNull(), 1).otherwise(0))
    whole = F.max(F.when(F.col("unit") < FORMS, 1).otherwise(0))
    # Lines are summed up before the shuffle, so each document sends a row per licence.
    per_licence = found.groupBy("row_id", "doc_id", "licence").agg(lines.alias("lines"), whole.alias("whole"))
    return (
        per_licence.groupBy("row_id", "doc_id")
        .agg(
            F.max(F.when(F.col("whole") == 1, F.col("licence"))).alias("whole_licence"),
            F.array_join(F.array_sort(F.collect_list("licence")), ",").alias("licences"),
            F.sum("lines").cast("bigint").alias("n_notices"),
        )
        .drop("row_id")
    )


# --- The same in DuckDB's SQL. ---


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(lower: str) -> str:
    out = f"' ' || trim(regexp_replace({lower}, {_sql_text(PUNCTUATION)}, ' ', 'g')) || ' '"
    for variant, common in SPELLINGS:
        out = f"replace({out}, {_sql_text(f' {variant} ')}, {_sql_text(f' {common} ')})"
    return f"trim({out})"


def _sql_forms(lower: str) -> str:
    has = " OR ".join(f"contains({lower}, {_sql_text(word)})" for word in COPYRIGHT_WORDS)
    short = lower
    for pattern, other in _PARAGRAPHS:
        short = f"regexp_replace({short}, {_sql_text(pattern)}, {_sql_text(other)}, 'g')".replace("'\x01'", "chr(1)").replace("'\n'", "chr(10)")
    lines = f"regexp_replace({lower}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    short = f"regexp_replace({short}, {_sql_text(COPYRIGHT_PARAGRAPH)}, '', 'g')"
    return f"[{lower}, CASE WHEN {has} THEN {lines} END, CASE WHEN {has} THEN {short} END]"


def oracle_sql() -> str:
    known = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in KNOWN)
    lower = f"translate(body, '{_UPPER}', '{_LOWER}')"
    line = f"regexp_replace(unnest(string_split(lower, chr(10))), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    return f"""
    WITH known AS (
      SELECT sha256({_sql_canonical('form')}) AS digest, min(licence) AS licence
      FROM (SELECT licence, unnest({_sql_forms('lower')}) AS form
            FROM (SELECT licence, {lower} AS lower FROM (VALUES {known}) AS k(licence, body)) l) f
      WHERE {_sql_canonical('form')} <> '' GROUP BY 1
    ), lowers AS (SELECT doc_id, {lower.replace('body', 'text')} AS lower FROM documents),
    units AS (
      SELECT doc_id, 0 AS unit, NULL AS body FROM documents
      UNION ALL SELECT doc_id, 0 AS unit, unnest({_sql_forms('lower')}) AS body FROM lowers
      UNION ALL SELECT doc_id, 1 AS unit, {line} AS body FROM lowers
    ), found AS (
      SELECT doc_id, unit, licence FROM units LEFT JOIN known ON sha256({_sql_canonical("coalesce(body, '')")}) = digest
    )
    SELECT doc_id,
           max(CASE WHEN unit = 0 THEN licence END) AS whole_licence,
           coalesce(array_to_string(list_sort(list(DISTINCT licence) FILTER (WHERE licence IS NOT NULL)), ','), '') AS licences,
           CAST(sum(CASE WHEN unit > 0 AND licence IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_notices
    FROM found GROUP BY doc_id
    """
