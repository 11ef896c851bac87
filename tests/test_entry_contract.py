import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["period", "total_cost", "events", "anomalies", "subs", "top_materials", "top_vendors"]


def test_every_query_has_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_some_queries_run_at_sf0001(spark, sf001):
    for name in ["by_day", "report_week", "subscription_like", "stream_day_totals", "row_digest"]:
        assert E.queries()[name](spark, sf001).count() >= 0
