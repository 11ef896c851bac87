import datetime as dt

from wastelens.operators import categorize as C
from wastelens.operators import dashboards as D
from wastelens.operators import entries as EN
from wastelens.sources import readers as RD


def test_prices_f8(spark):
    mats = spark.createDataFrame([("A", "ea", 5.0), ("B", "ea", 2.0)], "name string, unit string, cost_per_unit double")
    ovr = spark.createDataFrame([("A", 0.0)], "name string, mock_price double")
    e = spark.createDataFrame([("A",), ("B",)], "material string")
    got = {r.material: r.cost_per_unit for r in EN.resolve_price(e, mats, ovr, True).collect()}
    assert got == {"A": 0.0, "B": 2.0}
    got = {r.material: r.cost_per_unit for r in EN.resolve_price(e, mats, ovr, False).collect()}
    assert got == {"A": 5.0, "B": 2.0}


def test_day_alert_f14(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1999.99), (dt.datetime(2024, 1, 2), 2000.0)],
                              "timestamp_local timestamp_ntz, total_cost double")
    assert [str(r.day) for r in EN.day_alerts(d, 2000).collect()] == ["2024-01-02"]
    assert EN.day_alerts(d, 0).count() == 0
    assert EN.entry_alerts(d, 2000).count() == 1


def test_rules_f7(spark):
    rows = [("AWS", "cloud bill"), ("City Water", ""), ("50 mL Conical Tubes", "Expired"),
            ("Cups R Us", ""), ("water license", ""), (None, None)]
    d = spark.createDataFrame(rows, "vendor string, description string")
    out = C.categorize_rules(d).collect()
    assert [r.ai_category for r in out] == ["software", "utilities", "supplies", "logistics", "utilities", None]
    assert out[-1].ai_category_source == "unknown" and out[0].ai_category_source == "rule"
    word = C.categorize_rules(d, match="word").collect()
    assert word[3].ai_category is None


def test_grouped_sums_f10(spark):
    d = spark.createDataFrame([("a", None), (None, 1)], "material string, quantity long") \
        .withColumn("total_cost", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("double"))
    out = D.by_material(d).collect()
    assert [(r.material, r.quantity) for r in out] == [("a", 0)]


def test_top_n_ties_f6(spark):
    rows = [("s", "a", 5), ("s", "b", 7), ("s", "c", 7), ("s", "d", 5), ("s", "e", 9)]
    d = spark.createDataFrame(rows, "suite string, material string, quantity long")
    out = D.suite_material_topn(d, 5).orderBy("rank").collect()
    assert [r.material for r in out] == ["e", "b", "c", "a", "d"]


def test_canonicalize_f13(spark):
    rows = [("2024-01-02 10:00:00", "Tubes", "Acme", "3", "1.5", "note"),
            ("x", "Caps", "Beta", "abc", "2", "n2")]
    d = spark.createDataFrame(rows, "Event_TS string, Item string, Supplier string, Quantity string, USD string, Memo string")
    out = RD.canonicalize(d).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.material, r.vendor, r.qty, r.cost, r.description) == ("Tubes", "Acme", 3.0, 1.5, "note")
    assert r.suite is None and r.category is None and r.lot is None
    d2 = spark.createDataFrame([("2024-01-02", "abc")], "date string, qty string")
    assert RD.canonicalize(d2).first().qty is None


def test_no_amount_is_shown_to_operators(spark):
    from wastelens.operators import dashboards as D
    from wastelens.operators import filters as FL

    df = spark.createDataFrame([("A", 2, 10.0), ("B", 1, 99.0)], "material string, quantity long, total_cost double")
    shown = D.overall_material(df, "total_cost", role="Operator")
    assert {r.material: r.value for r in shown.collect()} == {"A": 2, "B": 1}
    assert "value" not in FL.cost_view(D.overall_material(df, "total_cost"), "Operator").columns
    assert "value" in FL.cost_view(shown, "Operator", metric="quantity").columns
    wide = df.selectExpr("material", *[f"total_cost AS {c}" for c in FL.COST_COLUMNS])
    assert FL.cost_view(wide, "Operator").columns == ["material"] and FL.cost_view(wide, "Manager").columns == wide.columns


def test_enrichment_strips_all_white_space(spark):
    e = spark.sql("""select 'x' id, date'2024-01-01' log_date, '10:00:00' log_time, '\tQC\n' suite, 's' shift, ' e\n' employee_id,
                     'A' material, 2L quantity, 'r' reason, '\u00a0L ' batch_lot, 'n\n' notes""")
    m = spark.createDataFrame([("A", "ea", 1.5)], "name string, unit string, cost_per_unit double")
    sop = spark.createDataFrame([("r", "u")], "reason string, sop_url string")
    r = EN.enrich_entries(e, m, None, sop, use_mock=False).first()
    assert (r.suite, r.employee_id, r.batch_lot, r.notes, r.total_cost) == ("QC", "e", "L", "n", 3.0)


def test_totals_come_in_order_with_a_fixed_tie(spark):
    rows = [("s2", "n", "A", "r1", 5, 1.0), ("s1", "d", "B", "r2", 5, 9.0), ("s1", "n", "C", "r1", 7, 2.0), ("s3", "d", "A", "r3", 1, 9.0)]
    d = spark.createDataFrame(rows * 3, "suite string, shift string, material string, reason string, quantity long, total_cost double").repartition(5)
    assert [(r.shift, r.quantity) for r in D.by_shift(d).collect()] == [("n", 36), ("d", 18)]
    assert [(r.material, r.quantity) for r in D.by_material(d).collect()] == [("C", 21), ("A", 18), ("B", 15)]
    assert [r.reason for r in D.by_reason(d).collect()] == ["r1", "r2", "r3"]
    assert [r.suite for r in D.by_suite_cost(d).collect()] == ["s1", "s3", "s2"]
    assert [r.suite for r in D.by_suite_qty(d).collect()] == ["s1", "s2", "s3"]
    assert [r.value for r in D.overall_material(d, "total_cost").collect()] == [30.0, 27.0, 6.0]
