import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.money import cents, has_no_cents
from tallyspark.operators.periods import with_change
from tallyspark.operators.rows import keep_first, profile_columns, unseen
from tallyspark.session import checkpoint_path, scratch_path
from tallyspark.plans import reports
from tallyspark.sources import tables
from tallyspark.sources.tables import checked_csv, read_csv, read_table
from tallyspark.streaming.windows import dropped_as_late, event_windows


def test_keep_first_hot_key_and_null_values(spark):
    rows = [(1, i, f"v{i}") for i in range(500, 0, -1)] + [(2, 7, None), (None, 3, "n"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "id int, at int, note string").repartition(4)
    got = {tuple(r) for r in keep_first(df, ["id"], ["at"]).collect()}
    assert got == {(1, 1, "v1"), (2, 7, None), (None, 2, "m")}


def test_unseen_is_empty_on_second_load(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    old = spark.createDataFrame([(1, "z"), (1, "y")], "id int, x string")
    added = unseen(new, old, ["id"])
    assert [tuple(r) for r in added.collect()] == [(2, "b")]
    assert unseen(new, old.unionByName(added), ["id"]).count() == 0


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    got = {r.column_name: (r.row_count, r.null_count, r.distinct_count) for r in profile_columns(df).collect()}
    assert got == {"a": (3, 0, 2), "b": (3, 2, 1)}


def test_change_is_null_in_first_period(spark):
    df = spark.createDataFrame([("s", "2024-01", 5), ("s", "2024-02", -2)], "k string, m string, v long")
    got = [tuple(r) for r in with_change(df, ["k"], "m", "v").orderBy("m").collect()]
    assert got == [("s", "2024-01", 5, None, None), ("s", "2024-02", -2, 5, -7)]


def test_csv_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,amount\n1,2.5\nx,3.0\n2,oops\n3,\n4,1.0,extra\n5\n")
    good, bad = read_csv(spark, str(tmp_path), {"id": "int", "amount": "double"})
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5), (3, None)]
    assert sorted(r.id for r in good.select("id").collect()) == [1, 3]
    assert good.count() == 2 and bad.count() == 4
    assert sorted(r.id for r in bad.collect()) == ["2", "4", "5", "x"]


def test_scratch_path_raises_on_a_cluster_without_a_shared_folder():
    class Session:
        def __init__(self, master, **values):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, *default: values[key] if key in values else default[0])})

    where = {"spark.sql.warehouse.dir": "file:/here"}
    for master in ("local", "local[4]", "local[*]"):
        assert scratch_path(Session(master, **where), "x").startswith("file:/here/x-")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_path(Session(master, **where), "x")
        assert scratch_path(Session(master, **where, **{"spark.checkpoint.dir": "s3://shared"}), "x").startswith("s3://shared/x-")


def test_checkpoint_path_prefers_the_session():
    class Conf(dict):
        get = dict.get

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    assert checkpoint_path(Session(spark_checkpoint_dir="/shared/"), "x", "/local") == "/shared/x"
    assert checkpoint_path(Session(), "x", "/local") == "/local/x"
    with pytest.raises(ValueError):
        checkpoint_path(Session(), "x")


def test_stream_equals_batch(spark, tmp_path):
    events = read_table(spark, "/root/testdata/sf0.001", "events")
    source = str(tmp_path / "events")
    events.repartitionByRange(3, "ts").write.parquet(source)
    stream = event_windows(spark.readStream.schema(events.schema).parquet(source), late="60 days")
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("hourly")
        .option("checkpointLocation", checkpoint_path(spark, f"hourly-{tmp_path.name}-{uuid.uuid4()}", str(tmp_path)))
        .start()
    )
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table("hourly").collect()}
    finally:
        query.stop()
    want = {tuple(r) for r in event_windows(events, late=None).collect()}
    assert got == want and got


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Append mode, a file per batch: the row from before the watermark goes, and its loss is told."""
    schema = "ts timestamp_ntz, event_type string, value double"
    source = str(tmp_path / "events")
    batches = [["2024-03-31 00:10", "2024-03-31 05:00"], ["2024-03-31 00:20", "2024-03-31 09:00"], ["2024-03-31 12:00"]]
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(source)
    stream = event_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), late="10 minutes")
    query = (
        stream.writeStream.outputMode("append").format("memory").queryName("late_events")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    )
    try:
        for times in batches:
            rows = [(datetime.datetime.fromisoformat(t), "a", 1.0) for t in times]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = {(r.window_start.hour, r.event_count) for r in spark.table("late_events").collect()}
        lost = dropped_as_late(query.recentProgress)
    finally:
        query.stop()
    assert got == {(0, 1), (5, 1), (9, 1)} and lost == 1


def test_windows_do_not_depend_on_the_zone(spark):
    schema = "ts timestamp_ntz, event_type string, value double"
    rows = [(datetime.datetime(2024, 3, 31, h, 30), "a", float("nan") if h == 2 else 0.5) for h in range(5)]
    rows += [(datetime.datetime(2024, 10, 27, h, 59, 59, 999999), "a", 0.5) for h in range(5)]
    events = spark.createDataFrame([*rows, (None, "a", 1.0)], schema)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = sorted(tuple(r) for r in event_windows(events, late="1 hour").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    hour = datetime.timedelta(hours=1)
    spring = [datetime.datetime(2024, 3, 31, h) for h in range(5)]
    autumn = [datetime.datetime(2024, 10, 27, h) for h in range(5)]
    assert got == [(t, t + hour, "a", 1, None if t.hour == 2 else 50, int(t.hour == 2)) for t in spring] + [
        (t, t + hour, "a", 1, 50, 0) for t in autumn
    ]


def test_change_over_a_gap(spark):
    rows = [("s", "2024-01", 5), ("s", "2024-03", 9), ("s", "2024-04", 4), (None, "2024-03", 1), (None, "2024-04", 2)]
    df = spark.createDataFrame(rows, "k string, m string, v long")
    got = {tuple(r) for r in with_change(df, ["k"], "m", "v").collect()}
    assert got == {("s", "2024-01", 5, None, None), ("s", "2024-03", 9, None, None), ("s", "2024-04", 4, 9, -5),
                   (None, "2024-03", 1, None, None), (None, "2024-04", 2, 1, 1)}


def test_no_prior_month_is_skipped_in_the_flagship(spark):
    rows = {(r.segment, r.month): r for r in reports.monthly_segment_sales(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 386
    gaps = 0
    for (segment, month), r in rows.items():
        before = (datetime.date.fromisoformat(f"{month}-01") - datetime.timedelta(days=1)).strftime("%Y-%m")
        prior = rows.get((segment, before))
        gaps += prior is None
        assert r.sales_cents_prior == (prior.sales_cents if prior else None)
    assert gaps > 5


def test_unseen_hot_and_null_keys(spark):
    old = spark.createDataFrame([(1 if k % 3 else k, "z") for k in range(3000)] + [(None, "n")], "id int, x string")
    new = spark.createDataFrame([(5000, "b"), (5000, "a"), (5000, None), (1, "q"), (None, "x"), (3, "r")], "id int, x string")
    added = unseen(new, old, ["id"])
    assert [tuple(r) for r in added.collect()] == [(5000, "a")]
    first = unseen(new, old.limit(0), ["id"])
    assert {tuple(r) for r in first.collect()} == {(5000, "a"), (1, "q"), (None, "x"), (3, "r")}
    assert unseen(new, first, ["id"]).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_raw_row_reaches_the_anti_join(spark):
    plan = _plan(reports.customers_without_orders(spark, "/root/testdata/sf0.01"))
    sides = plan[plan.index("LeftAnti") :].split("Aggregate")
    assert len(sides) == 2 and "o_custkey" in sides[1] and "o_custkey" not in sides[0]  # customers first, orders reduced


def test_exchanges_of_the_reports(spark):
    """Without broadcasts: one exchange per aggregate, two per join; customers alone are not aggregated first."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def exchanges(query):
            return query(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString().count("Exchange ")

        assert exchanges(reports.monthly_segment_sales) == 4  # two of the join, the totals, the window by segment
        assert exchanges(reports.lineitem_first_copy) == 1
        assert exchanges(reports.hourly_events) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nulls_come_last_in_keep_first(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, None), (1, 5, "b"), (2, None, None)], "id int, at int, note string")
    assert {tuple(r) for r in keep_first(df, ["id"], ["at"]).collect()} == {(1, 5, "b"), (2, None, None)}


def test_profile_of_an_empty_table(spark):
    got = {tuple(r) for r in profile_columns(spark.createDataFrame([], "a int, b string")).collect()}
    assert got == {("a", 0, 0, 0), ("b", 0, 0, 0)}


def test_cents_of_no_number(spark):
    rows = [(1.005,), (float("nan"),), (float("inf"),), (1e300,), (None,)]
    df = spark.createDataFrame(rows, "v double").select(cents(F.col("v")), has_no_cents(F.col("v")))
    assert [r[0] for r in df.collect()][1:] == [None] * 4
    assert [r[1] for r in df.collect()] == [False, True, True, True, False]


def test_declared_columns_must_be_there(spark, monkeypatch):
    monkeypatch.setitem(tables.SCHEMAS, "nation", "n_nationkey int, n_nmae string")
    with pytest.raises(ValueError, match="n_nmae"):
        read_table(spark, "/root/testdata/sf0.001", "nation")


def test_csv_header_and_reasons(spark, tmp_path):
    (tmp_path / "in.csv").write_text("line,amount\n1,2.5\nx,oops\n4,1.0,extra\n")
    checked = checked_csv(spark, str(tmp_path), {"line": "int", "amount": "double"})
    got = {(r.line, r.amount, r.reject and (r.reject.reason, r.reject.line, tuple(r.reject.texts))) for r in checked.collect()}
    assert got == {(1, 2.5, None), (None, None, ("type of line, amount", None, ("x", "oops"))),
                   (4, 1.0, ("number of fields", "4,1.0,extra", ("4", "1.0")))}
    assert all(r.reject_file.endswith("in.csv") for r in read_csv(spark, str(tmp_path), {"line": "int", "amount": "double"})[1].collect())
    with pytest.raises(Exception, match="(?i)header"):
        checked_csv(spark, str(tmp_path), {"amount": "double", "line": "int"}).collect()
