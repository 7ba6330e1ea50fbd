"""Hand-worked cases of the scalar functions and filters."""

from datetime import datetime

import pytest
from tests.conftest import listed
from pyspark.sql import functions as F

from fieldlens.functions import dates, filters, naming, parsing
from fieldlens.operators import consensus, sequences


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(text):
    return F.lit(text).cast("string")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("123", [123]),
        ("12, 34", [12, 34]),
        ("['1','2']", [1, 2]),
        ("[7]", [7]),
        ("-5", [-5]),
        ("id 9", [9]),
        ("", []),
        (None, []),
        ("12;34", [12, 34]),
    ],
)
def test_subject_ids(spark, text, expected):
    assert value(spark, parsing.subject_ids(lit(text))) == expected


def test_subject_ids_legacy(spark):
    assert value(spark, parsing.subject_ids(lit("12;34"), legacy=True)) == [1234]


@pytest.mark.parametrize(
    "name, expected",
    [("17_x_dep_x_f.jpg", "17"), ("a/b/17_x_dep_x_f.jpg", "17"), ("R0034-LOC__20250101_7436.JPG", None), (None, None)],
)
def test_labelled_media_id(spark, name, expected):
    assert value(spark, parsing.labelled_media_id(lit(name))) == expected


@pytest.mark.parametrize(
    "make, model, expected",
    [
        ("Reconyx", "Reconyx HP2X", "reconyx hp2x"),
        ("A", "B", "a b"),
        (" A ", None, "a (unknown)"),
        (None, None, "(unknown)"),
    ],
)
def test_camera_model(spark, make, model, expected):
    assert value(spark, parsing.camera_model(lit(make), lit(model))) == expected


def test_camera_model_legacy(spark):
    assert value(spark, parsing.camera_model(lit(None), lit(None), legacy=True)) == "none"


@pytest.mark.parametrize(
    "text, expected",
    [("cafÃ©", "café"), ("café", "café"), ("plain", "plain"), ("日本", "日本"), (None, None)],
)
def test_repaired_text(spark, text, expected):
    assert value(spark, parsing.repaired_text(lit(text))) == expected


@pytest.mark.parametrize(
    "name, expected, unicode",
    [
        ("  Peña Río__ 7! ", "pena-rio__-7", False),
        ("--A  b--", "a-b", False),
        ("Ñandú x", "ñandú-x", True),
    ],
)
def test_slug(spark, name, expected, unicode):
    assert value(spark, naming.slug(lit(name), allow_unicode=unicode)) == expected


def test_slug_of_ascii_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("R0001-A b",)], "n string").select(naming.slug(F.col("n"), ascii_input=True))
    assert "Python" not in df._jdf.queryExecution().toString()
    assert df.first()[0] == "r0001-a-b"


@pytest.mark.parametrize(
    "name, expected",
    [("a.JPG", ".jpg"), ("d.x/a", ""), (".hidden", ""), ("a.tar.gz", ".gz"), ("a..jpg", ".jpg"), ("a.", "")],
)
def test_extension(spark, name, expected):
    assert value(spark, naming.extension(lit(name))) == expected


def test_natural_order(spark):
    paths = [
        "a-", "a1", "a01b", "a2", "a10", "A1", "b", "7", "07x", "10", "a", "a1/2.jpg", "a1/10.jpg",
        "a" + "9" * 20, "a1" + "0" * 20, "a2" + "0" * 20, "a" + "0" * 30 + "3",
    ]
    import re

    def by_number(text):
        parts = re.split(r"(\d+)", text)
        return [(int(p) if i % 2 else p) for i, p in enumerate(parts)]

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r["p"] for r in df.orderBy(naming.natural_key(F.col("p")), "p").collect()]
    assert [by_number(p) for p in got] == sorted(by_number(p) for p in paths)


def test_archive_name(spark):
    taken = F.lit("2024-09-04 10:00:00").cast("timestamp_ntz")
    name = naming.archive_name(lit("r0001-loc"), taken, F.lit(7), lit("IMG.JPG"))
    assert value(spark, name) == "R0001-LOC__20240904_7.JPEG"


def test_package_names(spark):
    fields = naming.package_fields(lit("package_123_20251215002603_R0001_r0001-loc_0001_part001.yaml"))
    row = spark.range(1).select(*[v.alias(k) for k, v in fields.items()]).first()
    assert tuple(row) == ("20251215002603", "R0001_r0001-loc_0001", "001", ".yaml")
    assert value(spark, naming.package_fields(lit("package_part1.zip"))["tail"]) is None


def test_revision_code(spark):
    assert value(spark, naming.revision_code(F.lit(7), lit("loc_a"))) == "R0007-LOC_A"


@pytest.mark.parametrize(
    "day, time, expected",
    [
        ("2024:09:04", "3:10:00", datetime(2024, 9, 4, 3, 10)),
        ("2024:09:04", "13:10:00", datetime(2024, 9, 4, 13, 10)),
        ("2024-09-04", "13:10:00", None),
        ("2024:13:04", "13:10:00", None),
    ],
)
def test_log_time(spark, day, time, expected):
    assert value(spark, dates.log_time(lit(day), lit(time))) == expected


def recorded(spark, text, zone="Europe/Madrid", ignore_dst=False):
    made = dates.recorded_at(lit(text), zone, ignore_dst=ignore_dst)
    row = spark.range(1).select(
        made["instant"].cast("timestamp_ntz").alias("i"), made["wall"].alias("w"), made["offset_seconds"].alias("o")
    ).first()
    return tuple(row)


def test_recorded_at(spark):
    summer = datetime(2024, 7, 1, 12)
    assert recorded(spark, "2024:07:01 12:00:00") == (datetime(2024, 7, 1, 10), summer, 7200)
    assert recorded(spark, "2024:07:01 12:00:00", ignore_dst=True) == (datetime(2024, 7, 1, 11), summer, 3600)
    assert recorded(spark, "2024:01:01 12:00:00", ignore_dst=True)[2] == 3600
    for text in ("2024:07:01 12:00:00+0530", "2024:07:01 12:00:00+05:30"):
        assert recorded(spark, text) == (datetime(2024, 7, 1, 6, 30), summer, 19800)
    assert recorded(spark, "2024:07:01 12:00:00Z") == (summer, summer, 0)
    assert recorded(spark, "yesterday") == (None, None, None)


@pytest.mark.parametrize("zone", ["Europe/Madrid", "Europe/Lisbon", "America/New_York", "Africa/Casablanca", "Asia/Kolkata"])
def test_standard_offsets_follow_the_zone(zone):
    from zoneinfo import ZoneInfo

    steps = dates.standard_offsets(zone)
    for year in range(1971, 2040):
        for month in (1, 4, 7, 10):
            at = datetime(year, month, 15, 12)
            aware = at.replace(tzinfo=ZoneInfo(zone))
            expected = int((aware.utcoffset() - aware.dst()).total_seconds())
            assert [s for start, s in steps if start is None or start <= at][-1] == expected


def test_recorded_text(spark):
    text = dates.recorded_text
    assert value(spark, text(lit("0000:00:00 00:00:00"), lit("c"), lit("m"))) == "c"
    assert value(spark, text(lit(None), lit("0000:00:00 00:00:00"), lit("m"))) == "m"
    assert value(spark, text(lit(""), lit(None))) is None


def test_stamp_text(spark):
    moment = F.lit("2024-07-01 12:00:00").cast("timestamp_ntz")
    assert value(spark, dates.stamp_text(moment, F.lit(-12600))) == "2024-07-01T12:00:00-0330"


def test_filter_expressions(spark):
    entries = spark.createDataFrame(
        [("A01", "33"), ("A02", "31.5"), ("A03", None), ("A04", "full"), (None, "1e3")], "`4_Sitio` string, `10_SD` string"
    )

    def kept(*texts):
        return [r[0] for r in listed(filters.apply_filters(entries, texts), F.col("4_Sitio"))]

    assert kept("4_Sitio==A01") == ["A01"]
    assert kept("4_Sitio==A01 OR A02") == kept("4_Sitio==A01|A02") == ["A01", "A02"]
    assert kept("10_SD>32") == ["A01"]
    assert kept("10_SD>=31.5", "4_Sitio!=A01") == ["A02"]
    assert kept("10_SD!=33") == ["A02", "A03", "A04", None]
    assert kept("other==1") == [] and len(kept("other!=1")) == 5
    assert kept("10_SD==full") == ["A04"]
    with pytest.raises(ValueError):
        kept("nothing")


def test_id_lists():
    assert filters.id_list(" 1, 2 3,,") == [1, 2, 3]
    assert filters.id_list("") is None and filters.id_list(None) is None
    with pytest.raises(ValueError):
        filters.id_list("1,x")
    with pytest.raises(ValueError):
        filters.equalities(["broken"])


@pytest.mark.parametrize(
    "length, n, expected",
    [(7, 5, [0, 2, 3, 4, 6]), (6, 5, [0, 1, 2, 4, 5]), (4, 5, [0, 1, 2, 3]), (9, 1, [0]), (9, 2, [0, 8]), (3, 0, [])],
)
def test_sampling_cases(spark, length, n, expected):
    places = spark.range(length).where(sequences.is_sampled(F.col("id"), F.lit(length), n))
    assert sorted(r["id"] for r in places.collect()) == expected


def test_sampling_against_the_definition(spark):
    pairs = [(length, n) for length in range(1, 60) for n in range(2, 15)]
    for n in range(2, 15):
        df = spark.range(1, 60).selectExpr("id AS length", "explode(sequence(0L, id - 1)) AS pos")
        got = df.where(sequences.is_sampled(F.col("pos"), F.col("length"), n)).groupBy("length").agg(
            F.sort_array(F.collect_list("pos")).alias("kept")
        )
        for row in got.collect():
            length = row["length"]
            step = (length - 1) / (n - 1)
            wanted = list(range(length)) if length <= n else [round(i * step) for i in range(n)]
            assert row["kept"] == wanted, (length, n)
    assert len(pairs) == 767


@pytest.mark.parametrize("votes, expected", [((5, 3), "0.62"), ((1, 1), "0.50"), ((2, 1), "0.67")])
def test_confidence_text(spark, votes, expected):
    assert value(spark, consensus.confidence_text(F.lit(votes[0] / sum(votes)))) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [
        ('[{"task":"T0","value":[{"choice":"A","answers":{"HOWMANY":"2"}}]}]', "A (2)"),
        ('[{"task":"T0","value":[{"choice":"A","answers":{}}]}]', "A"),
        ('[{"task":"T0","value":[{"answers":{}}]}]', "unknown"),
        ('[{"task":"T0","value":[]}]', "invalid"),
        ("junk", "invalid"),
    ],
)
def test_annotation_label(spark, cell, expected):
    assert value(spark, parsing.annotation_label(parsing.annotations(lit(cell)))) == expected


def test_annotation_values_of_every_shape(spark):
    cells = [
        (1, '[{"task":"T0","value":[{"choice":"A","answers":{"HOWMANY":"2"}}]},{"task":"T1","value":"Yes"}]'),
        (2, '[{"task":"T0","value":["x","y"]}]'),
        (3, '[{"task":"T0","value":[{"choice":"A","answers":{}},"plain"]}]'),
        (4, "[{'task':'T0','value':[{'choice':'B','answers':{'HOWMANY':'1'}}]}]"),
        (5, "junk"),
        (6, None),
    ]
    df = spark.createDataFrame(cells, "id int, cell string")
    every = {r["id"]: [v["choice"] for v in r["v"]] for r in parsing.with_values(df, "cell", "v").collect()}
    assert every == {1: ["A"], 2: ["x", "y"], 3: ["A", "plain"], 4: ["B"], 5: [], 6: []}
    labelled = {r["id"]: [v["choice"] for v in r["v"]] for r in parsing.with_choices(df, "cell", "v").collect()}
    assert labelled == {1: ["A"], 2: [], 3: ["A"], 4: ["B"], 5: [], 6: []}


def test_unknown_keys_are_stable(spark):
    keys = [value(spark, parsing.unknown_key("UNKNOWN_SITE", lit("e1"))) for _ in range(2)]
    assert keys[0] == keys[1] and keys[0].startswith("UNKNOWN_SITE_")
    assert value(spark, parsing.unknown_key("UNKNOWN_SITE", lit("e2"))) != keys[0]
