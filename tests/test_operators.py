"""Hand-worked cases of rules, sequences, consensus, preparation and the findings algebra."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from tests.conftest import listed
from pyspark.sql import functions as F

from fieldlens.operators import (
    catalogue,
    consensus,
    findings,
    forms,
    packaging,
    preparation,
    progress,
    rules,
    sequences,
)

DAY = datetime(2024, 9, 4)


def media_rows(spark, seconds, deployment="d", kinds=None):
    values = [(i, deployment, DAY + timedelta(seconds=s), (kinds or {}).get(i, ["animal"])) for i, s in enumerate(seconds)]
    return spark.createDataFrame(values, "media_id bigint, deployment_id string, ts timestamp_ntz, observations array<string>")


def test_gap_equal_to_the_limit_stays_in_the_sequence(spark):
    got = sequences.gap_sequences(media_rows(spark, [0, 90, 181]), 90)
    assert [r[1] for r in listed(got, "media_id", "seq_id")] == [1, 1, 2]


def test_gap_counts_fractions_of_seconds(spark):
    got = sequences.gap_sequences(media_rows(spark, [0, 90.000001]), 90)
    assert [r[1] for r in listed(got, "media_id", "seq_id")] == [1, 2]


@pytest.mark.parametrize("seconds, kept", [([0, 1000, 2000], [0, 2]), ([0, 1000], [0, 1]), ([0, 10, 20], [0, 1, 2])])
def test_only_middle_sequences_lose_humans(spark, seconds, kept):
    media = media_rows(spark, seconds, kinds={i: ["animal", "human"] for i in range(3)})
    rows = sequences.number_sequences(sequences.ordered_rows(media, ["deployment_id"], ["ts", "media_id"]), 90)
    assert [r[0] for r in listed(sequences.drop_middle_humans(rows).result(), "media_id")] == kept


def test_selection_keeps_only_public_classified_media(spark):
    media = spark.createDataFrame(
        [(1, "d", DAY, "a", True, False, False), (2, "d", DAY, "b", False, False, False), (3, "d", None, "c", True, False, False),
         (4, "d", DAY, "d", True, True, False), (5, "x", DAY, "e", True, False, False), (6, "d", DAY, "f", True, False, False)],
        "media_id bigint, deployment_id string, ts timestamp_ntz, file_name string, file_public boolean, "
        "private_human boolean, private_vehicle boolean",
    )
    seen = spark.createDataFrame(
        [(i, "animal") for i in (1, 2, 3, 4, 5, 99)] + [(6, "unclassified"), (6, None), (6, "")],
        "media_id bigint, observation_type string",
    )
    got = sequences.select_sequences(media, seen, blacklist=["x"])
    assert listed(got, "media_id", "label_name") == [(1, "1_x_d_x_a")]
    assert [r["media_id"] for r in sequences.undated(media).collect()] == [3]


def test_sample_is_a_subset_with_first_and_last(spark):
    media = media_rows(spark, range(0, 400, 20))
    seen = media.selectExpr("media_id", "'animal' AS observation_type")
    full = media.drop("observations").selectExpr(
        "*", "'f' AS file_name", "true AS file_public", "false AS private_human", "false AS private_vehicle"
    )
    kept = [r[0] for r in listed(sequences.select_sequences(full, seen, n_images=4), "media_id")]
    assert kept[0] == 0 and 19 in kept and len(kept) == 4


def test_leading_within(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([5, 80, 91, 10])], "g string, i int, gap int")
    got = sequences.leading_within(df, ["g"], ["i"], "gap", 90)
    assert [r[1] for r in listed(got, "i", "is_leading")] == [True, True, False, False]


def test_collection_prefix_ignores_case_and_allows_dashes(spark):
    deployments = spark.createDataFrame([("r0001-a-1",), ("R0001x-b",), ("plain",)], "deployment_id string")
    names = spark.createDataFrame([("R0001",), ("R0001-A",)], "collection string")
    got = listed(sequences.collection_deployments(deployments, names), "collection", "deployment_id")
    assert got == [("R0001", "r0001-a-1"), ("R0001-A", "r0001-a-1")]


def test_collection_names(spark):
    df = spark.createDataFrame([("R0001",), ("R0001_x",), ("R001",), ("r0001",)], "collection string")
    got = dict(listed(rules.check_collection_names(df), "identifier", "status"))
    assert got == {"R0001": "success", "R0001_x": "success", "R001": "error", "r0001": "error"}


def name_findings(spark, collection, deployment, files=1, **options):
    df = spark.createDataFrame([(collection, deployment, files)], "collection string, deployment string, n_files int")
    known = spark.createDataFrame([("LOC_1",), ("x",)], "location_id string")
    return listed(rules.check_deployment_names(df, known, **options), "identifier", "status")


def test_deployment_names(spark):
    assert name_findings(spark, "R0033", "R0033-LOC_1") == [("R0033:R0033-LOC_1", "success")]
    assert name_findings(spark, "R0033", "r0033-x") == [("R0033:r0033-x", "success")]
    assert name_findings(spark, "R0033", "R0033-a b") == [("R0033:R0033-a b", "error")]
    assert name_findings(spark, "R0033", "R33-x") == [("R0033:R33-x", "error"), ("R33-x", "error")]
    assert name_findings(spark, "R0033", "R0034-x") == [("R0033:R0034-x", "error"), ("R0034-x", "error")]
    assert name_findings(spark, "R0033", "nodash") == [("R0033:nodash", "error"), ("nodash", "error")]
    assert name_findings(spark, "R0033", "R0033-other") == [("R0033:R0033-other", "error")]
    assert name_findings(spark, "R0033", "R0033-other", validate_locations=False) == [("R0033:R0033-other", "success")]
    assert name_findings(spark, "R0033", "R0033-x", files=0) == []
    assert name_findings(spark, "R0033_s", "R0033-x") == [("R0033_s:R0033-x", "success")]
    assert name_findings(spark, "R0033_s", "R0033-x", legacy=True) == [("R0033-x", "error"), ("R0033_s:R0033-x", "error")]


def log_table(spark, *values):
    return spark.createDataFrame(
        [("c", i + 2, *v) for i, v in enumerate(values)],
        "collection string, row_number bigint, Deployment string, StartDate string, StartTime string, EndDate string, EndTime string",
    )


def test_log_faults(spark):
    good = ("2024:09:04", "3:10:00", "2024:09:05", "03:10:00")
    log = log_table(
        spark, ("a", *good), (" a ", *good), ("b", "2024:09:04", " ", "2024:09:05", "03:10:00"),
        ("c", "2024/09/04", "3:10:00", "2024:09:05", "03:10:00"), ("d", "2024:09:04", "3:10:00", "2024:09:04", "3:10:00"),
    )
    assert [r[1] for r in listed(rules.log_faults(log), "row_number", "fault")] == [
        None, "duplicate deployment", "missing value", "invalid datetime", "start not before end",
    ]
    assert [tuple(r) for r in rules.first_log_fault(log).collect()] == [("c", 3, "duplicate deployment")]
    assert [r["deployment"] for r in rules.valid_log(log).collect()] == ["a"]


def shots(spark, *taken, errors=()):
    values = [
        ("c", "d", f"IMG_{i}.jpg", t, "broken" if i in errors else None) for i, t in enumerate(taken, 1)
    ]
    return spark.createDataFrame(
        values, "collection string, deployment string, rel_path string, taken timestamp_ntz, error string"
    )


def logged(spark, start, end):
    return spark.createDataFrame(
        [("c", "d", start, end)],
        "collection string, deployment string, expected_start timestamp_ntz, expected_end timestamp_ntz",
    )


def hour(h, m=0):
    return DAY + timedelta(hours=h, minutes=m)


def media_actions(spark, media, start, end):
    found = rules.media_findings(media, logged(spark, start, end))
    return [(r[0].split("_")[1], r[1]) for r in listed(found, "identifier", "action")]


def test_single_image_is_tested_against_the_start_only(spark):
    got = media_actions(spark, shots(spark, hour(13)), hour(10), hour(13))
    assert got == [("1.jpg", "image date out of range")]


def test_null_date_resets_the_comparison(spark):
    assert media_actions(spark, shots(spark, hour(10), None, hour(9, 30)), hour(10), hour(10, 1)) == []


def test_error_rows_are_skipped_by_the_comparison(spark):
    media = shots(spark, hour(10), None, hour(9, 30), hour(10), errors={2})
    assert media_actions(spark, media, hour(10), hour(10, 1)) == [("2.jpg", "gather_metadata"), ("3.jpg", "date order")]


def test_error_rows_count_for_positions(spark):
    media = shots(spark, None, hour(12), hour(14), errors={1})
    got = media_actions(spark, media, hour(10), hour(14))
    assert got == [("1.jpg", "gather_metadata")]


def test_check_deployments(spark):
    good = ("2024:09:04", "10:00:00", "2024:09:04", "12:00:00")
    log = log_table(spark, ("d", *good), ("gone", *good), ("empty", *good))
    folders = spark.createDataFrame([("c", "d"), ("c", "empty"), ("other", "e")], "collection string, deployment string")
    found = rules.check_deployments(folders, log, shots(spark, hour(10), hour(12)))
    assert listed(found, "identifier", "status") == [
        ("c:d", "success"), ("c:empty", "success"), ("c:gone", "error"), ("other", "error"),
    ]


CLASSIFICATIONS = [
    ("664345585", [{"task": "T0", "value": [{"choice": "OTHERSPECIES", "answers": {}, "filters": {}}]}]),
    ("673798541", [{"task": "T0", "value": [{"choice": "COMMONGENET", "answers": {"HOWMANY": "1"}, "filters": {}}]}]),
    ("674120196", [{"task": "T0", "value": []}]),
]


def classified(spark, cells, workflow="29186"):
    values = [(key, workflow, f"{workflow}:w:1", 12345, "17", json.dumps(a)) for key, a in cells]
    return spark.createDataFrame(
        values, "classification_id string, workflow_id string, workflow_key string, sid bigint, media_id string, annotations string"
    )


def choice(*names, howmany=None):
    answers = {} if howmany is None else {"HOWMANY": howmany}
    return [{"task": "T0", "value": [{"choice": n, "answers": answers} for n in names]}]


def test_documented_consensus_sample(spark):
    rows = classified(spark, CLASSIFICATIONS)
    assert consensus.k_majority(consensus.tally(rows)).first()["k_majority"] == 1
    got = listed(consensus.decisions(rows), "rank", "observation_type", "scientific_name", "count", "comments")
    text = "Automatically classified by volunteers for subject 12345 with confidence "
    assert got == [(1, "animal", "", None, text + "0.50"), (2, "animal", "Genetta genetta", 1, text + "1.00")]


def test_individuals_are_the_rounded_up_median(spark):
    cells = [(str(i), choice("COW", howmany=h)) for i, h in enumerate(["1", "2", "many"])]
    assert [r["count"] for r in consensus.decisions(classified(spark, cells)).collect()] == [2]


def test_larger_mode_wins_and_large_ones_are_skipped(spark):
    cells = [("1", choice("COW")), ("2", choice("COW", "HORSE")), ("3", choice("A", "B", "C", "D"))]
    assert consensus.k_majority(consensus.tally(classified(spark, cells))).first()["k_majority"] == 2


def test_no_decision_when_all_modes_are_too_large(spark):
    cells = [("1", choice("A", "B", "C", "D")), ("2", choice("A", "B", "C", "D"))]
    rows = classified(spark, cells, workflow="29187")
    assert consensus.decisions(rows).collect() == []
    seen = spark.createDataFrame([(17, 1)], "media_id bigint, obs_id bigint")
    found = consensus.undecided(rows, consensus.decisions(rows), seen)
    assert [r["action"] for r in found.collect()] == ["getting_decision"]
    nothing = spark.createDataFrame([], "media_id bigint, obs_id bigint")
    found = consensus.undecided(rows, consensus.decisions(rows), nothing)
    assert [r["action"] for r in found.collect()] == ["get_observations"]


def test_people_and_blanks(spark):
    cells = [("1", choice("HUMANORVEHICLE", "NOANIMAL")), ("2", choice("HUMANORVEHICLE", "NOANIMAL"))]
    rows = classified(spark, cells)
    assert listed(consensus.decisions(rows), "observation_type", "scientific_name") == [("human", "")]
    assert consensus.decisions(rows, legacy=True).collect() == []
    people = classified(spark, [("1", choice("HUMANORVEHICLE"))])
    assert listed(consensus.decisions(people, legacy=True), "observation_type", "scientific_name") == [("animal", "human")]


def test_taxa_of_the_workflows(spark):
    def taxa(workflow, legacy=False):
        rows = classified(spark, [("1", choice("MYSTERY", "WOLF"))], workflow)
        tallied = consensus.tally(rows, legacy=legacy).where("kind = 'taxon'")
        return [r[0] for r in listed(tallied, "value")]

    assert taxa("29186") == taxa("17553") == ["MYSTERY", "WOLF"]
    assert taxa("29187") == ["Canis lupus", "unknown"]
    assert taxa("29187", legacy=True) == ["MYSTERY", "WOLF"]


def test_user_rule_sees_whole_subjects(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        values = [(f"{s}-{i}", "29186", "w", s, "m", json.dumps(choice(f"C{i}"))) for s in range(40) for i in range(5)]
        rows = spark.createDataFrame(
            values, "classification_id string, workflow_id string, workflow_key string, sid bigint, media_id string, annotations string"
        )

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            taxa = frame[frame["kind"] == "taxon"]
            return taxa.groupby("sid", as_index=False).agg(n=("value", "size"))

        got = consensus.decisions_by_user_rule(consensus.tally(rows), count, "sid bigint, n bigint").collect()
        assert sorted(tuple(r) for r in got) == [(s, 5) for s in range(40)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fan_out_copies_the_first_observation(spark):
    decided = consensus.decisions(classified(spark, CLASSIFICATIONS))
    seen = spark.createDataFrame(
        [(17, 9, "late"), (17, 4, "first"), (17, 9, "again"), (18, 1, "other"), (17, None, "none")],
        "media_id bigint, obs_id bigint, tags string",
    )
    got = listed(consensus.fan_out(decided, seen, classified_by="me", copied=["tags"]), "rank", "obs_id", "tags")
    assert got == [(1, 4, "first"), (1, 9, "first"), (2, 4, "first"), (2, 9, "first")]


def test_choice_histogram_takes_plain_strings(spark):
    cells = [("1", [{"task": "T", "value": ["x", "y"]}]), ("2", choice("y")), ("3", choice("x"))]
    histogram = consensus.choice_histogram(classified(spark, cells))
    assert listed(histogram, "choice", "n") == [("x", 2), ("y", 2)]
    assert consensus.majority_choice(histogram).first()["majority_choice"] == "x"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    once = preparation.upsert(old, new, "k")
    assert listed(once) == listed(preparation.upsert(once, new, "k")) == [("a", 1), ("b", 9), ("c", 3)]


def test_insert_if_absent_ignores_case(spark):
    log = log_table(spark, ("r0001-a", "d", "t", "d", "t"), (" ", "d", "t", "d", "t")).drop("row_number")
    new = spark.createDataFrame(
        [("c", "R0001-A", "x", "x", "x", "x"), ("c", "R0001-B", "x", "x", "x", "x")],
        "collection string, Deployment string, StartDate string, StartTime string, EndDate string, EndTime string",
    )
    assert [r[0] for r in listed(preparation.insert_if_absent(log, new), "Deployment")] == ["R0001-B", "r0001-a"]
    assert listed(preparation.registration_findings(log, new), "identifier", "status") == [
        ("R0001-A", "error"), ("R0001-B", "success"),
    ]


def test_summary_takes_the_first_dated_file(spark):
    rows = spark.createDataFrame(
        [("c", "r1-loc-a", 1, None, None, None, "x"), ("c", "r1-loc-a", 2, hour(5), hour(6), 3600, "cam 2"), ("c", "r1-loc-a", 3, hour(4), hour(5), 3600, "cam 3")],
        "collection string, deployment_id string, file_index bigint, instant timestamp, wall timestamp_ntz, offset_seconds bigint, camera string",
    )
    got = preparation.deployment_summary(rows, convert_to_utc=False).first()
    assert tuple(got) == ("c", "r1-loc-a", "loc-a", "2024-09-04T05:00:00+0100", "2024-09-04T06:00:00+0100", "cam 2")


def finding_rows(spark, *values):
    return spark.createDataFrame(
        [("1", *v, None, DAY) for v in values],
        "run_id string, identifier string, action string, status string, message string, ts timestamp",
    )


@pytest.mark.parametrize(
    "statuses, expected",
    [(["success"], "success"), (["error"], "failed"), (["error", "success"], "partial"), ([], "empty")],
)
def test_report_status(spark, statuses, expected):
    rows = finding_rows(spark, *[("i", "a", s) for s in statuses])
    runs = spark.createDataFrame([("1",)], "run_id string")
    assert findings.summarise(rows, runs).first()["status"] == expected


def test_merge_skips_entries_already_held(spark):
    from fieldlens.schema import FINDINGS

    late = DAY + timedelta(days=1)
    one = [("1", "i", "a", "error", None, {"x": "1", "y": "2"}, late), ("1", "i", "b", "error", "m", {}, DAY), ("1", "i", "b", "error", "m", {}, late)]
    two = [("2", "i", "a", "error", None, {"y": "2", "x": "1"}, DAY), ("2", "i", "a", "error", None, {"x": "2"}, late), ("3", "i", "a", "error", None, {"x": "2"}, DAY)]
    merged = findings.merge(spark.createDataFrame(one, FINDINGS), spark.createDataFrame(two, FINDINGS), run_id="1")
    assert merged.columns == [f.name for f in FINDINGS]
    got = sorted((r["run_id"], r["action"], sorted(r["extra"].items()), r["ts"]) for r in merged.collect())
    # Repeats of the first report stay, equal incoming entries come once, and all belong to one run.
    assert got == [("1", "a", [("x", "1"), ("y", "2")], late), ("1", "a", [("x", "2")], DAY), ("1", "b", [], DAY), ("1", "b", [], late)]


def test_findings_schema(spark):
    from fieldlens.schema import FINDINGS

    made = findings.as_run(finding_rows(spark, ("i", "a", "error")), "7", {"size": F.lit(3)})
    assert [f.name for f in made.schema] == [f.name for f in FINDINGS]
    assert made.first()["extra"] == {"size": "3"}


def test_pages_with_errors_fail(spark):
    page = "errors array<struct<title:string>>, meta struct<current_page:int>, data struct<entries:array<struct<a:int>>>"
    good = spark.createDataFrame([(None, (1,), ([(1,), (2,)],))], page)
    bad = spark.createDataFrame([([("too many requests",)], (1,), None)], page)
    assert listed(forms.entries_of_pages(good)) == [(1,), (2,)]
    with pytest.raises(Exception, match="too many requests"):
        forms.entries_of_pages(good.union(bad)).collect()


def test_field_sheet(spark):
    values = [("e1", "S1", "a", "2024-01-01T00:00:00Z"), ("e2", "S1", "a", "2024-01-03T00:00:00.500Z"),
              ("e3", "S2", "a", "2024-01-02T00:00:00Z"), ("e4", "S3", "a", "soon"), ("e5", " ", "a", "2024-01-04T00:00:00Z")]
    entries = spark.createDataFrame(values, "entry_uuid string, s string, r string, created_at string")
    aliases = spark.createDataFrame([("S2", "North")], "site string, alias string")
    sheet = forms.field_sheet(forms.group_keys(entries, "s", "r", aliases)).orderBy("first_entry").collect()
    assert [r["site"] for r in sheet[:2]] == ["S1", "North"] and sheet[2]["site"].startswith("UNKNOWN_SITE_")
    assert [r["new_start"] for r in sheet] == [None, "2024-01-03T00:00:00.500Z", "2024-01-02T00:00:00Z"]


def test_package_pairs_need_both_files(spark):
    names = ["p_1_2_R0001_r0001-a_part001", "p_1_2_R0001_r0001-a_part002"]
    listing = spark.createDataFrame(
        [(names[0] + ".yaml", 1), (names[0] + ".zip", 5), (names[1] + ".zip", 5), ("x.yaml", 1)], "file_name string, bytes bigint"
    )
    known = spark.createDataFrame([("R0001",), ("R",)], "collection string")
    assert listed(packaging.package_pairs(listing, known), "deployment", "part", "total_bytes") == [("r0001-a", "001", 6)]
    assert packaging.package_pairs(listing, known, ["other"]).collect() == []


def test_package_names_with_underscores(spark):
    names = [
        "package_7_20240101000000_R0001_x_r0001-a_1_part001.yaml", "package_7_20240101000000_R0001_x_r0001-a_1_part001.zip",
        "package_7_20250101000000_R0001_x_r0001-a_1_part001.zip", "package_7_20240101000000_R0001_r0001-a_1_part001.zip",
        "package_7_20240101000000_R0009_r0009-a_part001.zip",
    ]
    listing = spark.createDataFrame([(n, 1) for n in names], "file_name string, bytes bigint")
    known = spark.createDataFrame([("R0001",), ("R0001_x",)], "collection string")
    parsed = listed(packaging.parsed_packages(listing, known), "file_name", "collection", "deployment")
    assert parsed == sorted([(n, "R0001_x", "r0001-a_1") for n in names[:3]] + [(names[3], "R0001", "r0001-a_1")])
    # Neither another stamp nor another collection completes a pair.
    assert listed(packaging.package_pairs(listing, known), "collection", "stamp", "yaml_file") == [("R0001_x", "20240101000000", names[0])]


def test_chunks_and_ledger(spark):
    files = spark.createDataFrame([("f", "/r", 25), ("empty", "/r", 0)], "file string, remote string, size bigint")
    chunks = packaging.chunk_plan(files, 10)
    assert listed(chunks, "chunk_index", "offset", "chunk_len") == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    ledger = chunks.withColumn("completed", F.col("chunk_index") < 2)
    assert [tuple(r) for r in packaging.ledger_status(ledger, files).collect()] == [("f", 3, 2, 20, True)]
    grown = files.withColumn("size", F.col("size") + 1)
    assert packaging.ledger_status(ledger, grown).first()["is_valid"] is False


def test_pending_chunks_shuffle_files_only(spark, rows):
    """Done chunks as bits give what the join by chunk gives, and files dealt out before stay where they are."""
    schema = "file string, chunk_index bigint, size bigint"
    work = [(f, i, 7) for f in ("a", "b", None) for i in (*range(200), None, -1, -64, -65)] + [("a", 5, 8)] * 2
    done = [("a", i, 0) for i in (*range(0, 200, 3), 5, None, -64)] + [("b", 63, 0), ("b", 64, 0), (None, 1, 0), ("c", 1, 0)] * 2
    work, done = rows(work, schema), rows(done, schema)
    keys = ["file", "chunk_index"]
    plain = packaging.pending(work, done, keys)
    bits = packaging.pending(work, done, keys, within="chunk_index")
    assert bits.columns == plain.columns and listed(bits) == listed(plain)
    none = packaging.pending(work, done.limit(0), keys, within="chunk_index")
    assert none.count() == work.count()

    files = rows([("f", "/r", 25), ("g", "/r", 31)], "file string, remote string, size bigint").repartition(8, "file")
    plan = packaging.chunk_plan(files, 10)
    ledger = plan.where("chunk_index <> 1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = packaging.pending(plan, ledger, keys, within="chunk_index")
        assert listed(left, *keys) == [("f", 1), ("g", 1)]
        dealt = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(file" in dealt and dealt.count("Exchange hashpartitioning(") == dealt.count("REPARTITION_BY_NUM")


def test_subjects_present(spark):
    subjects = spark.createDataFrame(
        [(1, "Name A", {}), (2, None, {"filename": "low.jpg", "Filename": " Cap.JPG "}), (3, "", {"Origin": "HTTP://x"})],
        "id bigint, display_name string, metadata map<string,string>",
    )
    wanted = spark.createDataFrame(
        [("id", 1, None, None), ("name", None, " name a", None), ("file", None, "cap.jpg", None),
         ("lower", None, "low.jpg", None), ("origin", None, None, "http://X"), ("no", 9, "z", "z")],
        "candidate string, id bigint, name string, origin string",
    )
    got = [r[0] for r in listed(catalogue.subjects_present(wanted, subjects))]
    assert got == ["file", "id", "name", "origin"]


def test_progress(spark):
    events = spark.createDataFrame(
        [("collection_start:R1", 2), ("deployment_start:R1:d", 3), ("file_progress:R1:d:a:b.jpg", 1), ("deployment_complete:R1:d", 1)],
        "event string, count bigint",
    )
    assert listed(progress.roll_up(events)) == [("R1", None, 2, 0, 0), ("R1", "d", 3, 1, 1)] or listed(
        progress.roll_up(events)
    ) == [("R1", "d", 3, 1, 1), ("R1", None, 2, 0, 0)]


def test_tally_equals_counting(spark):
    """Votes, first votes and medians of drawn classifications, of all rules, against plain Python."""
    import random
    import statistics
    from collections import Counter

    draw = random.Random(3)
    rows = []
    for i in range(400):
        names = draw.choices(["COW", "HORSE", "MYSTERY", "REDFOX", "WOLF"], k=draw.choice([0, 1, 1, 1, 2, 3, 4, 5]))
        cell = [{"task": "T", "value": [{"choice": n, "answers": draw.choice([{}, {"HOWMANY": str(draw.randrange(9))}, {"HOWMANY": "many"}, {"HOWMANY": "12345678901234567"}])} for n in names]}]
        workflow = draw.choice(["29186", "29187", "17553"])
        subject = 1 if i % 3 == 0 else draw.randrange(12)
        rows.append((f"{draw.randrange(10**6)}-{i}", workflow, workflow + ":w", subject, draw.choice(["7", None]), json.dumps(cell), cell))
    want = {}
    for key, workflow, name, sid, media, _, cell in rows:
        values = cell[0]["value"]
        rule = consensus.RULES[workflow]
        if rule.skip_odd_sizes and not 1 <= len(values) <= consensus.K_MAX:
            continue
        own = want.setdefault((workflow, name, sid, media), {"k": Counter(), "taxa": {}})
        own["k"][str(len(values))] += 1
        for pos, value in enumerate(values):
            taxon = rule.taxa.get(value["choice"], rule.unknown_taxon or value["choice"])
            votes = own["taxa"].setdefault(taxon, [])
            votes.append((key, pos, value["answers"].get("HOWMANY", "")))
    schema = "classification_id string, workflow_id string, workflow_key string, sid bigint, media_id string, annotations string"
    got = consensus.tally(spark.createDataFrame([r[:6] for r in rows], schema).repartition(4)).collect()
    found = {}
    for r in got:
        own = found.setdefault((r.workflow_id, r.workflow_key, r.sid, r.media_id), {"k": Counter(), "taxa": {}})
        if r.kind == "k":
            own["k"][r.value] = r.n
        else:
            own["taxa"][r.value] = (r.n, tuple(r.first_vote), r.individuals)
    for own in want.values():
        for taxon, votes in own["taxa"].items():
            numbers = [int(n) for _, _, n in votes if n.isdigit()]
            middle = -(-(statistics.median_low(numbers) + statistics.median_high(numbers)) // 2) if numbers else None
            own["taxa"][taxon] = (len(votes), min(v[:2] for v in votes), middle)
    assert found.keys() == want.keys()
    for key, own in want.items():
        assert found[key]["k"] == own["k"]
        for taxon in own["taxa"]:
            assert found[key]["taxa"].get(taxon) == own["taxa"][taxon], (key, taxon)
    assert found == want


def test_tally_needs_no_object_aggregation(spark):
    plan = consensus.decisions(classified(spark, CLASSIFICATIONS))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("from_json") <= 4
