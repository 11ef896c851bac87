import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wastelens.functions import dates as DT
from wastelens.operators import filters as FL
from wastelens.sources import dims
from wastelens.sources import readers as RD


def read_column(spark, values):
    df = RD.canonicalize(spark.createDataFrame([(v, str(i)) for i, v in enumerate(values)], "date string, qty string"))
    got = {int(r.qty): r.d for r in df.select("qty", F.date_format("date", "yyyy-MM-dd HH:mm").alias("d")).collect()}
    return [got.get(i) for i in range(len(values))]


def test_the_column_votes_for_one_order(spark):
    assert read_column(spark, ["13/01/2024", "02/01/2024"]) == ["2024-01-13 00:00", "2024-01-02 00:00"]
    assert read_column(spark, ["01/13/2024", "02/01/2024"]) == ["2024-01-13 00:00", "2024-02-01 00:00"]
    assert read_column(spark, ["02/01/2024", None, "", "nope"]) == ["2024-02-01 00:00", None, None, None]  # open: month first
    # What only the other order can read keeps that reading; ISO text takes no part in the vote.
    assert read_column(spark, ["13/01/2024", "25/02/2024", "03/04/2024", "04/30/2024", "2024-05-06"]) == \
        ["2024-01-13 00:00", "2024-02-25 00:00", "2024-04-03 00:00", "2024-04-30 00:00", "2024-05-06 00:00"]
    assert read_column(spark, ["31.12.99 7:05", "01.02.03"]) == ["1999-12-31 07:05", "2003-02-01 00:00"]
    assert read_column(spark, []) == []


def test_a_fixed_order_and_other_forms(spark):
    d = spark.createDataFrame([("02/01/2024",)], "date string")
    assert RD.canonicalize(d, day_first=True).first().date == dt.datetime(2024, 1, 2)
    vals = ["2024/1/2 3:04", "Jan 2, 2024", "2 Jan 2024", "02-Jan-2024", "20240102", "January 2, 2024", "12345", "99/99/2024", "2024-13-01", "1.5"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x string")
           .select(F.date_format(DT.parse_timestamp("x"), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-02"] * 6 + [None] * 4


def test_reports_read_dates_by_column_too(spark):
    d = spark.createDataFrame([("13/01/2024", "1"), ("02/01/2024", "2")], "date string, cost string")
    assert sorted(r.date.month for r in FL.report_input(d).collect()) == [1, 1]
    typed = spark.createDataFrame([(dt.date(2024, 1, 2), 1.0)], "date date, cost double")
    assert FL.report_input(typed).count() == 1


BASE = [("a", "ea", 1.0), ("b", "ea", 2.0), ("c", "ea", 3.0), (None, "ea", 4.0)]


def base(spark):
    return spark.createDataFrame(BASE, "name string, unit string, price double")


def changed(spark, rows):
    log = spark.createDataFrame(rows, "name string, unit string, price double, op string, seq long")
    return {r.name: (r.unit, r.price) for r in dims.apply_changes(base(spark), log, "name").collect()}


def play(rows):
    """The same log, one change after the other."""
    state = {n: (u, p) for n, u, p in BASE}
    rank = {"delete": 0, "upsert": 1, "update": 2}
    for n, u, p, op, _ in sorted(rows, key=lambda r: (r[4], rank[r[3]], (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or 0))):
        if op == "delete":
            state.pop(n, None)
        elif op == "upsert":
            state[n] = (u, p)
        elif n in state:
            state[n] = (u if u is not None else state[n][0], p if p is not None else state[n][1])
    return state


def test_changes_apply_in_order(spark):
    rows = [("a", None, 9.0, "update", 1), ("a", None, 10.0, "update", 5), ("b", None, None, "delete", 2), ("b", "box", 7.0, "upsert", 3),
            ("b", None, 8.0, "update", 4), ("c", "bag", 1.0, "upsert", 1), ("c", None, None, "delete", 2), ("c", "x", 1.0, "update", 3),
            ("d", "x", 1.0, "update", 1), ("e", None, 5.0, "upsert", 1), (None, "n", None, "update", 1)]
    assert changed(spark, rows) == play(rows) == {"a": ("ea", 10.0), "b": ("box", 8.0), "e": (None, 5.0), None: ("n", 4.0)}
    assert changed(spark, []) == {n: (u, p) for n, u, p in BASE}


def test_random_change_logs(spark):
    import random
    r = random.Random(4)
    for _ in range(6):
        rows = [(r.choice(["a", "b", "c", "d", None]), r.choice([None, "ea", "box"]), r.choice([None, 1.0, 2.0]),
                 r.choice(["delete", "update", "upsert"]), r.randint(0, 8)) for _ in range(30)]
        assert changed(spark, rows) == play(rows)


def test_unknown_operations_are_errors(spark):
    with pytest.raises(PySparkException):
        changed(spark, [("a", None, None, "drop", 1)])


def test_upsert_keeps_one_row_a_key(spark):
    more = spark.createDataFrame([("a", "x", 5.0, 1), ("a", "y", 4.0, 2), ("z", "z", 1.0, 1), (None, "q", 1.0, 1)],
                                 "name string, unit string, price double, seq long")
    got = {r.name: r.unit for r in dims.upsert(base(spark), more, "name", "seq").collect()}
    assert got == {"a": "y", "b": "ea", "c": "ea", "z": "z", None: "q"}
    assert dims.upsert(base(spark), more, "name").count() == 5
