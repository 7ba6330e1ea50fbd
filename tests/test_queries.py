"""Every registered query against its checking SQL on the smallest tables, and plan checks."""

import re

import pytest

import __spark_entry__
from tests import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    mine = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert compare.difference(mine, duck.sql(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    """Shuffles by key, without the one that deals out the rows of a costly view."""
    return len(re.findall(r"Exchange hashpartitioning", text)) - len(re.findall(r"Exchange hashpartitioning[^\n]*REPARTITION_BY_NUM", text))


@pytest.mark.parametrize("name, most", [("w1_gap_sessions", 1), ("w3_even_sampling", 1), ("p7_select_sequences", 3), ("w6_top_species", 2)])
def test_shuffles(spark, name, most):
    assert exchanges(plan(spark, name)) <= most


def test_no_pairing_joins(spark):
    for name in ("j7_subjects_present", "j12_collection_deployments", "j2_decision_fan_out", "p2_check_deployments"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "f9_public_media")
    assert "ReadSchema: struct<event_id:bigint>" in text
    text = plan(spark, "f6_id_list")
    assert "PushedFilters: [In(user_id, [14,15,3,92])]" in text and "ReadSchema: struct<user_id:bigint>" in text


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def test_chunked_plans_do_not_grow(spark):
    # One scan of the stored step and one of its carry table, however many steps came before.
    for name in ("w1_gap_sessions_chunked", "w3_even_sampling_chunked", "p7_select_sequences_chunked"):
        text = plan(spark, name)
        assert scans(text) <= 2 and "BroadcastNestedLoop" not in text, name


def test_cells_are_parsed_once(spark):
    # The stored decisions meet the observations: no cell of the export is read again.
    assert "from_json" not in plan(spark, "p9_consensus_observations")


def test_deployment_checks_read_stored_tables(spark):
    assert "supplier" not in plan(spark, "p2_check_deployments")


def test_votes_are_ordered_by_subject_in_few_passes(spark):
    text = plan(spark, "w6_top_species") + plan(spark, "w7_confidence")
    assert len(re.findall(r"\bWindow \[", text)) <= 6  # medians, numbers of choices, ranks: for each query
    orders = re.findall(r"\bSort \[(\w+)#", text)
    assert orders and set(orders) == {"sid"}


def test_no_method_is_too_long_to_be_compiled(spark):
    # HotSpot leaves longer methods to its interpreter; the cells of an export make one of 15,000 bytes.
    QUERIES["a8_species_votes"](spark, FOLDER)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_text_operators_keep_the_limit_they_were_measured_with(spark):
    from fieldlens.llm.common import prepare

    QUERIES["a8_species_votes"](spark, FOLDER)
    assert prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
