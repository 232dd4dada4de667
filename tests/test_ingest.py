import json

from conftest import rows
from pyspark.sql import functions as F

from pulseline.operators import ips
from pulseline.sources import export, ingest, tables


def values(spark, *messages):
    lines = [(m if isinstance(m, str) or m is None else json.dumps(m),) for m in messages]
    return spark.createDataFrame(lines, "value string")


def test_defaults_types_and_refusals(spark):
    good, bad = ingest.normalize_events(
        values(
            spark,
            {"id": 1, "url": None, "is_bot": None, "timestamp": None},
            {"id": "2", "is_bot": True, "timestamp": 1705248000.9},
            {"id": 3, "is_bot": 0, "extra": {"a": 1}},
            {"id": 4, "is_bot": "0"},
            {},
            {"id": "x"},
            {"id": 5, "timestamp": "soon"},
            "{broken",
            "null",
            "",
            None,
        )
    )
    assert rows(good, "id", "url", "is_bot", "timestamp") == [
        (0, "", 0, 0),
        (1, "", 0, 0),
        (2, "", 1, 1705248000),
        (3, "", 0, 0),
        (4, "", 0, 0),
    ]
    reasons = [r.reason for r in bad.collect()]
    assert sorted(reasons) == ["bad number"] * 2 + ["malformed json"] * 4
    assert good.schema.simpleString() == tables.ACTIVITY_SCHEMA.simpleString()


def test_legacy_defaults(spark):
    good, bad = ingest.normalize_legacy(
        values(spark, {"id": 7, "timestamp": 1705248000}, {"stay_duration": "x"}), as_of=1705300000
    )
    row = good.select("id", F.unix_timestamp("timestamp"), F.unix_timestamp("created_at"), "label_id").first()
    assert tuple(row) == (7, 1705248000, 1705300000, 0)
    assert bad.count() == 1 and len(good.columns) == 17


def test_client_address(spark):
    df = spark.createDataFrame(
        [
            ("1.1.1.1", "2.2.2.2", "3"),
            ("", " 2.2.2.2 , 4.4.4.4", "3"),
            (None, "2.2.2.2", "3"),
            (None, "", "3"),
            (None, None, None),
        ],
        "cf_connecting_ip string, x_forwarded_for string, remote_addr string",
    )
    assert [r.ip_user for r in ingest.resolve_ip(df).collect()] == ["1.1.1.1", "2.2.2.2", "2.2.2.2", "3", ""]


def test_bot_flag_is_agent_or_supplied(spark):
    df = spark.createDataFrame(
        [("GoogleBOT/2.1", 0), ("Chrome", 1), ("Chrome", 0), ("Chrome", None), ("", 0)], "browser string, is_bot int"
    )
    assert [r.is_bot for r in ingest.mark_bots(df).collect()] == [1, 1, 0, 0, 0]


def test_time_fields(spark):
    df = spark.createDataFrame([(1705247999,), (1705248000,)], "received_at bigint")
    got = rows(ingest.enrich_time(df), "id", "timestamp", "date_num", "created_at")
    assert got == [
        (1705247999000, 1705247999, 20240114, 1705247999),
        (1705248000000, 1705248000, 20240115, 1705248000),
    ]


def test_activity_table_is_partitioned_and_pruned(spark, act, tmp_path):
    path = str(tmp_path / "t")
    tables.write_activity(act(dict(), dict(timestamp=1705248000 + 86400)), path)
    tables.write_activity(act(dict(hostname="b")), path)
    df = tables.read_activity(spark, path)
    assert df.count() == 3 and (tmp_path / "t" / "date_num=20240115").exists()
    plan = df.filter("date_num = 20240115")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_num" in plan


def test_csv_export_quotes_and_clips(spark, act, tmp_path):
    ua = act(dict(browser='a "quoted", agent' + "x" * 60, referer=""))
    profile = ips.ip_profile(ua)
    export.export_csv(profile, str(tmp_path / "c"), short=["user_agent", "sample_referer"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back.user_agent == ('a "quoted", agent' + "x" * 60)[:50] + ".."
    assert back.distinct_urls == "1"


def test_json_export_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    export.export_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":1,"b":null}'


def test_messages_are_one_object_with_honest_numbers(spark):
    lines = [
        '{"id": 3, "url": "u"} junk',
        '{"id": 3} {"id": 4}',
        '{"id": 3}, {"id": 4}',
        '[{"id": 3}]',
        '{"id": "1.9"}',
        '{"id": 1.9}',
        '{"id": "7"}',
        "",
        "null",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = ingest.normalize_events(df)
    assert sorted(r.id for r in good.collect()) == [1, 7]
    reasons = {r.value: r.reason for r in bad.collect()}
    assert len(reasons) == 7 and reasons['{"id": "1.9"}'] == "bad number"
    assert {v for k, v in reasons.items() if k != '{"id": "1.9"}'} == {"malformed json"}
