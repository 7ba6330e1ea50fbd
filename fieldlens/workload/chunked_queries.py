"""The ordered queries with groups cut into chunks far below their size, against the same SQL."""

from __future__ import annotations

from fieldlens.operators import forms as O
from fieldlens.operators import packaging as P
from fieldlens.operators import rules as R
from fieldlens.operators import sequences as S
from fieldlens.workload import form_queries, package_queries, rule_queries, sequence_queries
from fieldlens.workload.registry import ORACLES, query

# A deployment has some sixty rows here.
CHUNK_ROWS = 45


def _twin(name: str):
    return query(f"{name}_chunked", ORACLES[name])


def _sequenced(df):
    rows = S.ordered_rows(df, ["deployment_id"], ["ts", "media_id"], chunk_rows=CHUNK_ROWS)
    return S.number_sequences(rows, sequence_queries.GAP)


@_twin("w1_gap_sessions")
def _(t):
    found = S.gap_sequences(t.media, sequence_queries.GAP, chunk_rows=CHUNK_ROWS)
    return found.select("deployment_id", "media_id", "ts", "seq_id")


@_twin("w2_middle_human_filter")
def _(t):
    rows = S.drop_middle_humans(_sequenced(sequence_queries._joined(t)))
    return rows.result().select("deployment_id", "seq_id", "media_id")


@_twin("w3_even_sampling")
def _(t):
    sampled = S.sample_sequences(_sequenced(t.media), sequence_queries.IMAGES)
    return sampled.result().select(sequence_queries._COLUMNS)


@_twin("p7_select_sequences")
def _(t):
    return S.select_sequences(
        t.media, t.obs, max_interval=sequence_queries.GAP, n_images=sequence_queries.IMAGES, chunk_rows=CHUNK_ROWS
    )


@_twin("v14_chronology")
def _(t):
    found = R.media_findings(
        t.taken, R.valid_log(t.field_log), tolerance_hours=rule_queries.TOLERANCE, chunk_rows=CHUNK_ROWS
    )
    return found.where("action = 'date order'").select(rule_queries._FINDING)


@_twin("w8_field_sheet_starts")
def _(t):
    return O.field_sheet(form_queries._keyed(t), chunk_rows=CHUNK_ROWS)


@_twin("w9_next_fit_parts")
def _(t):
    return P.pack_parts(package_queries._sizes(t), package_queries.LIMIT, chunk_rows=CHUNK_ROWS)
