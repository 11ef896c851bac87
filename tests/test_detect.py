import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from wastelens.operators import duplicates as DU
from wastelens.operators.ordered import global_lag, lag_name
from wastelens.sources.tables import ROW_KEY, flag_dense_view


def _f1(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "ACME, Inc.", 10.00), (2, dt.datetime(2024, 1, 2), "acme inc", 10.001),
            (3, dt.datetime(2024, 1, 3), "Beta", 10.00), (4, dt.datetime(2024, 1, 4), "ACME inc", 10.00),
            (5, dt.datetime(2024, 1, 5), "acme inc", 10.00)]
    return spark.createDataFrame(rows, "k long, date timestamp_ntz, vendor string, cost double") \
        .withColumn("description", F.lit(""))


def test_adjacent_vs_keyed_f1(spark):
    d = _f1(spark)
    a = {r.k: r.dup_candidate for r in DU.adjacent_duplicates(d, ["k"], chunks=3).collect()}
    k = {r.k: r.keyed_dup for r in DU.keyed_duplicates(d, ["k"], chunks=3).collect()}
    assert [a[i] for i in range(1, 6)] == [False, True, False, False, True]
    assert [k[i] for i in range(1, 6)] == [False, True, False, True, True]


def test_three_days_boundary(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "v", 1.0), (2, dt.datetime(2024, 1, 4, 23, 59), "v", 1.0),
            (3, dt.datetime(2024, 1, 9, 0, 0), "v", 1.0)]
    d = spark.createDataFrame(rows, "k long, date timestamp_ntz, vendor string, cost double") \
        .withColumn("description", F.lit(""))
    a = {r.k: r.dup_candidate for r in DU.adjacent_duplicates(d, ["k"]).collect()}
    assert a == {1: False, 2: True, 3: False}


def test_subscription_f2(spark):
    days = ["2024-01-01", "2024-01-31", "2024-03-02", "2024-07-01", "2024-07-05", "2024-07-09"]
    rows = [(i, dt.datetime.fromisoformat(x), "Netflix", 9.99) for i, x in enumerate(days)]
    d = spark.createDataFrame(rows, "k long, date timestamp_ntz, vendor string, cost double") \
        .withColumn("description", F.lit(""))
    out = sorted(DU.subscription_like(d, ["k"], chunks=4).collect(), key=lambda r: r.k)
    assert [r.gap for r in out] == [None, 30, 31, 121, 4, 4]
    assert [r.subscription_like for r in out] == [False, True, True, True, True, False]


def test_flags_keep_rows_f11(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "a", 1.0), (2, dt.datetime(2024, 1, 1), "a", 1.0)]
    d = spark.createDataFrame(rows, "k long, date timestamp_ntz, vendor string, cost double") \
        .withColumn("description", F.lit(""))
    assert DU.flags_in_place(d, ["k"]).count() == 2
    assert {r.legacy_copies for r in DU.flags_fanout(d, ["k"]).collect()} == {2}


def test_global_lag_equals_window(spark, sf001):
    d = flag_dense_view(spark, sf001)
    order = ["date", *ROW_KEY]
    g = global_lag(d, order, ["vendor", "date"], k=2, chunks=5)
    w = Window.orderBy(*order)
    ref = d.select(*order, F.lag("vendor", 1).over(w).alias("v1"), F.lag("vendor", 2).over(w).alias("v2"),
                   F.lag("date", 2).over(w).alias("d2"))
    j = g.join(ref, order)
    bad = j.where(~F.col("v1").eqNullSafe(F.col(lag_name("vendor", 1)))
                  | ~F.col("v2").eqNullSafe(F.col(lag_name("vendor", 2)))
                  | ~F.col("d2").eqNullSafe(F.col(lag_name("date", 2))))
    assert g.count() == d.count()
    assert bad.count() == 0


def test_lags_over_any_number_of_chunks(spark, sf001, monkeypatch):
    from wastelens.operators import ordered as O

    d = flag_dense_view(spark, sf001)
    want = {tuple(r) for r in DU.subscription_like(d, ROW_KEY).collect()}
    near = {tuple(r) for r in DU.adjacent_duplicates(d, ROW_KEY).collect()}
    monkeypatch.setattr(O, "MAX_CHUNKS", 2)
    for size in (2, 97, 2000):
        monkeypatch.setattr(O, "ROWS_A_CHUNK", size)
        assert {tuple(r) for r in DU.subscription_like(d, ROW_KEY).collect()} == want
    assert {tuple(r) for r in DU.adjacent_duplicates(d, ROW_KEY).collect()} == near


def test_lags_over_many_chunks_take_one_exchange_of_the_table(spark, sf001, monkeypatch):
    from wastelens.operators import ordered as O

    d = flag_dense_view(spark, sf001)
    order = ["date", *ROW_KEY]
    w = Window.orderBy(*order)
    ref = {tuple(r) for r in d.select(*order, F.lag("vendor", 1).over(w), F.lag("vendor", 2).over(w)).collect()}
    monkeypatch.setattr(O, "ROWS_A_CHUNK", 10)  # some 600 chunks, which used to be numbered, stored and exchanged again
    monkeypatch.setattr(O, "global_position", None)
    g = global_lag(d, order, ["vendor"], k=2)
    assert {tuple(r) for r in g.select(*order, lag_name("vendor", 1), lag_name("vendor", 2)).collect()} == ref


def test_rows_go_to_the_chunk_of_their_bounds(spark):
    from wastelens.operators.ordered import with_chunk

    rows = [(dt.datetime(2024, 1, d), k) for d in range(1, 8) for k in range(7)]
    d = spark.createDataFrame(rows, "date timestamp_ntz, k long")
    for n in (1, 2, 3, 7, 8, 20):
        bounds = sorted(rows)[::len(rows) // n][:n]
        got = {(r.date, r.k): r._chunk for r in with_chunk(d, ["date", "k"], bounds).collect()}
        assert got == {r: sum(b <= r for b in bounds) for r in rows}


def test_both_flags_equal_the_single_detectors(spark, sf001, monkeypatch):
    from wastelens.operators import ordered as O

    null = F.lit(None)
    d = flag_dense_view(spark, sf001).withColumns({
        "date": F.when(F.col("l_linenumber") == 3, null).otherwise(F.col("date")),
        "cost": F.when(F.col("l_linenumber") == 2, null).otherwise(F.col("cost"))})
    monkeypatch.setattr(O, "ROWS_A_CHUNK", 50)
    both = DU.duplicates_and_subs(d, ROW_KEY)
    cols = both.columns
    want = DU.adjacent_duplicates(DU.flags_in_place(d, ROW_KEY), ROW_KEY).select(*cols)
    assert both.exceptAll(want).count() == want.exceptAll(both).count() == 0
    assert both.where("dup_candidate").count() and both.where("subscription_like").count()
