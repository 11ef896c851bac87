import datetime as dt
import os
import tempfile

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from wastelens.sources import readers as RD
from wastelens.sources import sinks as SK
from wastelens.sources.tables import ROW_KEY, waste_view
from wastelens.streaming import jobs as J


def test_disjoint_exports_union_to_whole(spark, sf001):
    w = waste_view(spark, sf001, ["timestamp_local", "total_cost"] + ROW_KEY)
    a = SK.export_range(w, "1990-01-01", "1997-12-31")[0]
    b = SK.export_range(w, "1998-01-01", "2030-12-31")[0]
    assert a.count() + b.count() == w.count()
    assert a.join(b, ["timestamp_local", *ROW_KEY]).count() == 0


def test_export_writes_only_when_rows(spark, sf001):
    w = waste_view(spark, sf001, ["timestamp_local", "total_cost"] + ROW_KEY)
    d = tempfile.mkdtemp(prefix="wl-export-")
    _, path = SK.export_range(w, "1980-01-01", "1980-12-31", d + "/none")
    assert path is None and not os.path.exists(d + "/none")
    rows, path = SK.monthly_export(w, "1998-06-17", d + "/month")
    assert path and spark.read.option("header", True).csv(path).count() == rows.count() > 0


def test_round_trip_digests_verify(spark, sf001):
    out = E.queries()["log_round_trip"](spark, sf001)
    assert out.count() > 0 and out.where(~F.col("digest_ok")).count() == 0


def test_missing_files_get_defaults(spark):
    d = tempfile.mkdtemp(prefix="wl-dims-")
    mats = RD.load_materials(spark, d + "/materials", seed_if_missing=True)
    assert mats.count() == 10 and os.path.exists(d + "/materials")
    assert RD.load_materials(spark, d + "/materials").count() == 10
    assert RD.load_sop(spark, d + "/sop").count() == 7
    prices = RD.load_mock_prices(spark, d + "/prices", mats)
    assert dict((r.name, r.mock_price) for r in prices.collect())["Lovo Kit"] == 450.0
    assert RD.load_master(spark, d + "/none").count() == 0


def test_stream_equals_batch_on_closed_days(spark, sf001):
    got = {r.day: (r.day_cost, r.entries) for r in E.queries()["stream_day_totals"](spark, sf001).collect()}
    ev = spark.read.parquet(f"{sf001}/events.parquet")
    mx = ev.agg(F.max("ts")).first()[0]
    closed = (ev.withColumn("day", F.to_date("ts"))
              .where(F.col("day") <= F.lit((mx - dt.timedelta(days=1)).date() - dt.timedelta(days=1)))
              .groupBy("day").agg(F.round(F.sum("value"), 2).alias("c"), F.count("*").alias("n")))
    exp = {r.day: (r.c, r.n) for r in closed.collect()}
    assert got == exp and len(got) > 0


def _days(spark, path, rows):
    spark.createDataFrame([(dt.datetime(2024, 1, d, 12), c) for d, c in rows], "ts timestamp, total_cost double") \
        .coalesce(1).write.mode("append").parquet(path)


def test_late_rows_dropped(spark):
    root = tempfile.mkdtemp(prefix="wl-late-")
    _days(spark, root + "/in", [(d, 10.0) for d in range(1, 6)])
    first = J.run_available_now(J.day_totals(J.file_stream(spark, root + "/in")), root=root + "/q")
    assert {r.day.day: r.day_cost for r in first.collect()} == {1: 10.0, 2: 10.0, 3: 10.0}  # closed at Jan 5 less a day
    # A row of a closed day comes after the watermark and counts no more; one of an open day does.
    _days(spark, root + "/in", [(2, 99.0), (4, 5.0), (9, 1.0)])
    again = J.run_available_now(J.day_totals(J.file_stream(spark, root + "/in")), root=root + "/q")
    assert {r.day.day: r.day_cost for r in again.collect()} == {1: 10.0, 2: 10.0, 3: 10.0, 4: 15.0, 5: 10.0}


def test_update_mode_keeps_days_of_earlier_batches(spark):
    root = tempfile.mkdtemp(prefix="wl-update-")
    _days(spark, root + "/in", [(1, 10.0)])
    _days(spark, root + "/in", [(2, 7.0), (2, 1.0)])

    def run():
        s = J.file_stream(spark, root + "/in", max_files_per_trigger=1)
        out = J.run_available_now(J.day_totals(s), mode="update", root=root + "/q", keys=["day"])
        return {r.day.day: r.day_cost for r in out.collect()}
    assert run() == {1: 10.0, 2: 8.0}
    _days(spark, root + "/in", [(2, 2.0)])
    assert run() == {1: 10.0, 2: 10.0}
    with pytest.raises(ValueError):
        J.run_available_now(J.day_totals(J.file_stream(spark, root + "/in")), mode="update")


def test_csv_log_round_trips_odd_text(spark):
    root = tempfile.mkdtemp(prefix="wl-log-")
    notes = ['said "ok", then left', " leads", "ends ", "a\\b", "line\nbreak\r\n", "\\n", "", '"', "é,\t"]
    rows = [(f"{i:08d}", dt.datetime(2024, 1, 1 + i % 2), n) for i, n in enumerate(notes)]
    df = spark.createDataFrame(rows, "id string, timestamp_local timestamp, notes string").withColumn("material", F.lit(" Lovo Kit"))
    SK.append_log(df, root + "/log", fmt="csv")
    back = RD.load_master(spark, root + "/log", typed=False).collect()
    assert {r.id: r.notes or "" for r in back} == {r[0]: r[2] for r in rows}
    assert {r.material for r in back} == {" Lovo Kit"}


def test_dimensions_keep_one_row_a_name(spark):
    root = tempfile.mkdtemp(prefix="wl-dims-")
    for name, text in (("m", "name,unit,cost_per_unit\nA,ea,1\nA,box,2\nB,ea,bad\n"), ("p", "name,mock_price\nA,5\nA,6\n"),
                       ("s", "reason\nr\nr\n")):
        with open(f"{root}/{name}.csv", "w") as f:
            f.write(text)
    m = RD.load_materials(spark, root + "/m.csv")
    assert {tuple(r) for r in m.select("name", "unit", "cost_per_unit").collect()} == {("A", "ea", 1.0), ("B", "ea", 0.0)}
    p = RD.load_mock_prices(spark, root + "/p.csv", m)
    assert [tuple(r) for r in p.select("name", "mock_price").collect()] == [("A", 6.0)]
    assert RD.load_sop(spark, root + "/s.csv").count() == 1
    seeded = RD.load_mock_prices(spark, root + "/new", m)
    assert seeded.count() == 2 and RD.read_text_csv(spark, root + "/new").count() == 2


def test_parquet_errors_are_not_an_empty_log(spark):
    root = tempfile.mkdtemp(prefix="wl-bad-")
    with open(root + "/x.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        RD.load_master(spark, root, fmt="parquet").count()
    assert RD.load_master(spark, root + "/none", fmt="parquet").count() == 0


def test_stream_chain_links_per_key(spark, sf001):
    out = E.queries()["stream_chain"](spark, sf001)
    per = out.groupBy("chain").agg(F.sum((F.col("prev_hash") == "").cast("int")).alias("g"),
                                   F.count("*").alias("n"))
    assert per.where("g != 1").count() == 0
    known = out.select("chain", F.col("hash").alias("prev_hash"))
    assert out.where("prev_hash != ''").join(known, ["chain", "prev_hash"], "left_anti").count() == 0


def test_chain_links_rows_that_come_out_of_order(spark):
    import hashlib
    root = tempfile.mkdtemp(prefix="wl-chain-")
    t0 = dt.datetime(2024, 1, 1)

    def put(rows):
        spark.createDataFrame([(k, t0 + dt.timedelta(minutes=m), i) for k, m, i in rows], "k string, ts timestamp, id string") \
            .coalesce(1).write.mode("append").parquet(root + "/in")

    def run():
        s = J.file_stream(spark, root + "/in", max_files_per_trigger=1)
        out = J.run_available_now(J.chain_stream(s, "k", "id", "ts", ["id"], watermark="3 hours", step="1 hour"), root=root + "/q")
        return sorted(((r.chain, r.ts, len(r.id), r.id, r.prev_hash, r.hash) for r in out.collect()))

    put([("a", 100, "4"), ("a", 30, "2"), ("b", 20, "1")])
    put([("a", 10, "1"), ("a", 100, "10"), ("a", 70, "3")])  # earlier ones come later
    assert run() == []  # nothing is closed yet
    put([("a", 400, "99")])  # the watermark reaches 220 minutes
    put([("a", 40, "dropped"), ("a", 230, "5")])  # behind the watermark; before it
    put([("b", 900, "98")])
    got = run()
    assert [(r[0], r[3]) for r in got] == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "4"), ("a", "10"), ("a", "5"), ("a", "99"), ("b", "1")]
    prev = {}
    for chain, _, _, i, p, h in got:
        assert p == prev.get(chain, "") and h == hashlib.sha256(f"{i}|{p}".encode()).hexdigest()
        prev[chain] = h


def test_an_update_writes_only_the_days_it_touches(spark):
    root = tempfile.mkdtemp(prefix="wl-touch-")
    _days(spark, root + "/in", [(d, 1.0) for d in range(1, 21)])

    def run():
        s = J.file_stream(spark, root + "/in", max_files_per_trigger=1)
        out = J.run_available_now(J.day_totals(s, watermark="40 days"), mode="update", root=root + "/q", keys=["day"])
        files = {(d, f) for d, _, names in os.walk(root + "/q/out") for f in names if f.startswith("part-")}
        return {r.day.day: (r.day_cost, r.entries) for r in out.collect()}, files
    first, before = run()
    assert first == {d: (1.0, 1) for d in range(1, 21)}
    _days(spark, root + "/in", [(7, 5.0)])
    second, after = run()
    assert second == {**first, 7: (6.0, 2)}
    assert {os.path.basename(d) for d, _ in before ^ after} == {"day=2024-01-07"}
