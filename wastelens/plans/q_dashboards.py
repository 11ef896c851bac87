"""Filters, projections and dashboard tables over the waste view."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelens.functions import scalars as S
from wastelens.operators import dashboards as D
from wastelens.operators import filters as P
from wastelens.plans.registry import query
from wastelens.plans.sqlviews import WASTE_CTE, with_
from wastelens.sources.tables import ROW_KEY, table, waste_view

# Dashboard filter used by the registered queries (the feature is the filter).
START, END = "1996-01-01", "1999-12-31"
MATERIALS = ["red plate", "small widget", "hot ring", "blue gear", "cold anvil",
             "large rod", "new bolt", "old gizmo"]
REASONS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
SUITES = [f"NATION_{i}" for i in range(0, 20)]

_IN = lambda xs: "(" + ", ".join("'" + x + "'" for x in xs) + ")"

FILTER_SQL = (f"timestamp_local IS NOT NULL AND CAST(timestamp_local AS DATE) "
              f"BETWEEN DATE '{START}' AND DATE '{END}'")


def _filtered(spark, sf_dir, columns=None):
    w = waste_view(spark, sf_dir, columns)
    return P.filter_log(w, START, END)


@query("filter_log", with_(WASTE_CTE) + f"""
SELECT * FROM waste
WHERE {FILTER_SQL} AND material IN {_IN(MATERIALS)} AND reason IN {_IN(REASONS)}
  AND suite IN {_IN(SUITES)}""")
def q_filter_log(spark, sf_dir):
    w = waste_view(spark, sf_dir)
    return P.filter_log(w, START, END, MATERIALS, REASONS, SUITES)


@query("default_range", with_(WASTE_CTE) + """
SELECT min(CAST(timestamp_local AS DATE)) AS start_date,
       max(CAST(timestamp_local AS DATE)) AS end_date FROM waste""")
def q_default_range(spark, sf_dir):
    return P.default_range(waste_view(spark, sf_dir, ["timestamp_local"]))


@query("analysis_frame", with_(WASTE_CTE) + f"""
SELECT timestamp_local AS date, suite, material, material AS vendor,
       CAST(quantity AS DOUBLE) AS qty, total_cost AS cost, reason AS description
FROM waste WHERE {FILTER_SQL}""")
def q_analysis_frame(spark, sf_dir):
    return P.analysis_frame(_filtered(spark, sf_dir, ["timestamp_local", "suite", "material",
                                                      "quantity", "total_cost", "reason"]))


@query("vendor_norm_bucket", with_(WASTE_CTE) + """
SELECT vendor, total_cost AS cost,
       trim(regexp_replace(lower(coalesce(vendor, '')), '[^a-z0-9 ]', '', 'g')) AS vendor_norm,
       round_even(total_cost, 2) AS amount_bucket,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM waste""")
def q_vendor_norm_bucket(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["vendor", "total_cost"] + ROW_KEY)
    return P.with_vendor_bucket(w.withColumnRenamed("total_cost", "cost")) \
        .select("vendor", "cost", "vendor_norm", "amount_bucket", *ROW_KEY)


@query("slug_and_nonneg", """
SELECT p_partkey,
       regexp_replace(replace(lower(trim(p_name || ' ' || p_brand)), ' ', '_'),
                      '[^a-z0-9_\\-\\.]', '', 'g') AS slug,
       greatest(p_size - 25, 0) AS nonneg_size,
       CAST(0 AS BIGINT) AS nonneg_type
FROM part""")
def q_slug_and_nonneg(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey",
                    S.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"),
                    S.nonneg_int((F.col("p_size") - 25).cast("string")).alias("nonneg_size"),
                    S.nonneg_int("p_type").alias("nonneg_type"))


DOMAIN_SUITES = [f"NATION_{i}" for i in range(0, 12)]
DOMAIN_SHIFTS = ["AF", "NF", "NO", "RF"]
DOMAIN_REASONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("domain_check", with_(WASTE_CTE) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       concat_ws(',',
         CASE WHEN coalesce(suite IN {_IN(DOMAIN_SUITES)}, false) THEN NULL ELSE 'suite' END,
         CASE WHEN coalesce(shift IN {_IN(DOMAIN_SHIFTS)}, false) THEN NULL ELSE 'shift' END,
         CASE WHEN coalesce(reason IN {_IN(DOMAIN_REASONS)}, false) THEN NULL ELSE 'reason' END,
         CASE WHEN coalesce(quantity >= 0, false) THEN NULL ELSE 'quantity' END) AS violations,
       (coalesce(suite IN {_IN(DOMAIN_SUITES)}, false) AND coalesce(shift IN {_IN(DOMAIN_SHIFTS)}, false)
        AND coalesce(reason IN {_IN(DOMAIN_REASONS)}, false) AND coalesce(quantity >= 0, false)) AS accepted
FROM waste""")
def q_domain_check(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["suite", "shift", "reason", "quantity"] + ROW_KEY)
    chk = P.domain_check(w, DOMAIN_SUITES, DOMAIN_SHIFTS, DOMAIN_REASONS)
    return chk.select(*ROW_KEY, F.array_join("violations", ",").alias("violations"),
                      (F.size("violations") == 0).alias("accepted"))


@query("cost_view_operator", with_(WASTE_CTE) + f"""
SELECT material, CAST(sum(quantity) AS BIGINT) AS quantity
FROM waste WHERE {FILTER_SQL} GROUP BY material""")
def q_cost_view(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "material", "quantity", "total_cost"])
    return P.cost_view(D.by_material(f), role="Operator")


def _r2(df, *cols):
    return df.withColumns({c: F.round(c, 2) for c in cols})


@query("by_day", with_(WASTE_CTE) + f"""
SELECT CAST(timestamp_local AS DATE) AS date, CAST(sum(quantity) AS BIGINT) AS quantity,
       round(sum(total_cost), 2) AS total_cost
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_day(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "quantity", "total_cost"])
    return _r2(D.by_day(f), "total_cost")


@query("by_shift", with_(WASTE_CTE) + f"""
SELECT shift, CAST(sum(quantity) AS BIGINT) AS quantity
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_shift(spark, sf_dir):
    return D.by_shift(_filtered(spark, sf_dir, ["timestamp_local", "shift", "quantity"]))


@query("by_material", with_(WASTE_CTE) + f"""
SELECT material, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(total_cost), 2) AS total_cost
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_material(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "material", "quantity", "total_cost"])
    return _r2(D.by_material(f), "total_cost")


@query("by_reason", with_(WASTE_CTE) + f"""
SELECT reason, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(total_cost), 2) AS total_cost
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_reason(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "reason", "quantity", "total_cost"])
    return _r2(D.by_reason(f), "total_cost")


@query("by_suite_cost", with_(WASTE_CTE) + f"""
SELECT suite, round(sum(total_cost), 2) AS total_cost
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_suite_cost(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "suite", "total_cost"])
    return _r2(D.by_suite_cost(f), "total_cost")


@query("by_suite_qty", with_(WASTE_CTE) + f"""
SELECT suite, CAST(sum(quantity) AS BIGINT) AS quantity
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_by_suite_qty(spark, sf_dir):
    return D.by_suite_qty(_filtered(spark, sf_dir, ["timestamp_local", "suite", "quantity"]))


@query("kpis", with_(WASTE_CTE) + f"""
SELECT count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS total_qty,
       round(avg(quantity), 6) AS avg_qty, round(sum(total_cost), 2) AS total_cost
FROM waste WHERE {FILTER_SQL}""")
def q_kpis(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "quantity", "total_cost"])
    return D.kpis(f).withColumns({"avg_qty": F.round("avg_qty", 6),
                                  "total_cost": F.round("total_cost", 2)})


TOP_N = 8


@query("suite_material_topn", with_(WASTE_CTE) + f""",
agg AS (SELECT suite, material, sum(CAST(quantity AS DOUBLE)) AS quantity
        FROM waste WHERE {FILTER_SQL} GROUP BY 1, 2)
SELECT * FROM (
  SELECT suite, material, quantity,
         row_number() OVER (PARTITION BY suite ORDER BY quantity DESC, material) AS rank
  FROM agg) WHERE rank <= {TOP_N}""")
def q_suite_material_topn(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "suite", "material", "quantity"])
    return D.suite_material_topn(f, TOP_N)


@query("material_suite_topn", with_(WASTE_CTE) + f""",
agg AS (SELECT material, suite, sum(CAST(quantity AS DOUBLE)) AS quantity
        FROM waste WHERE {FILTER_SQL} GROUP BY 1, 2),
tops AS (SELECT material FROM agg GROUP BY material
         ORDER BY sum(quantity) DESC, material LIMIT {TOP_N})
SELECT * FROM agg WHERE material IN (SELECT material FROM tops)""")
def q_material_suite_topn(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "suite", "material", "quantity"])
    return D.material_suite_topn(f, TOP_N)


@query("overall_material", with_(WASTE_CTE) + f"""
SELECT material, round(sum(total_cost), 2) AS value
FROM waste WHERE {FILTER_SQL} GROUP BY 1""")
def q_overall_material(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "material", "total_cost"])
    return _r2(D.overall_material(f, "total_cost"), "value")


# SOP links derived from the data: one link per order priority except the lowest.
SOP_SQL = """sop AS (
  SELECT DISTINCT o_orderpriority AS reason,
         'https://sop.example/' || lower(replace(o_orderpriority, ' ', '-')) AS sop_url
  FROM orders WHERE o_orderpriority <> '5-LOW')"""


def sop_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.where(F.col("o_orderpriority") != "5-LOW")
            .select(F.col("o_orderpriority").alias("reason")).distinct()
            .withColumn("sop_url", F.concat(F.lit("https://sop.example/"),
                                            F.lower(F.replace("reason", F.lit(" "), F.lit("-"))))))


@query("sop_coverage", with_(WASTE_CTE, SOP_SQL) + f"""
SELECT r.reason, r.quantity, r.total_cost, s.sop_url FROM (
  SELECT reason, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(total_cost), 2) AS total_cost
  FROM waste WHERE {FILTER_SQL} GROUP BY 1) r LEFT JOIN sop s ON r.reason = s.reason""")
def q_sop_coverage(spark, sf_dir):
    f = _filtered(spark, sf_dir, ["timestamp_local", "reason", "quantity", "total_cost"])
    return _r2(D.sop_coverage(f, sop_links(spark, sf_dir)), "total_cost")
