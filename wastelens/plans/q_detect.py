"""Duplicate and subscription detection over the flag-dense and supplier views."""

from __future__ import annotations

from wastelens.operators import duplicates as DU
from wastelens.plans.registry import query
from wastelens.plans.sqlviews import FLAG_DENSE_CTE, SUPPLIER_QTY_CTE, with_
from wastelens.sources.tables import ROW_KEY, flag_dense_view, supplier_qty_view

KEYS = ", ".join(ROW_KEY)


def _prep_sql(src: str) -> str:
    return f"""p AS (
  SELECT *, trim(regexp_replace(lower(coalesce(vendor, '')), '[^a-z0-9 ]', '', 'g')) AS vendor_norm,
         round_even(cost, 2) AS amount_bucket FROM {src})"""


_DAYS = "floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)"


@query("adjacent_duplicates", with_(FLAG_DENSE_CTE, _prep_sql("flagdense")) + f"""
SELECT date, vendor, cost, description, {KEYS},
  coalesce(vendor_norm = lag(vendor_norm) OVER w AND amount_bucket = lag(amount_bucket) OVER w
           AND abs({_DAYS.format(a='date', b='lag(date) OVER w')}) <= 3, false) AS dup_candidate
FROM p WINDOW w AS (ORDER BY date, {KEYS})""")
def q_adjacent_duplicates(spark, sf_dir):
    d = DU.adjacent_duplicates(flag_dense_view(spark, sf_dir), ROW_KEY)
    return d.select("date", "vendor", "cost", "description", *ROW_KEY, "dup_candidate")


@query("keyed_duplicates", with_(FLAG_DENSE_CTE, _prep_sql("flagdense")) + f"""
SELECT date, vendor, cost, description, {KEYS},
  coalesce(abs({_DAYS.format(a='date', b='lag(date) OVER w')}) <= 3, false) AS keyed_dup
FROM p WINDOW w AS (PARTITION BY vendor_norm, amount_bucket ORDER BY date, {KEYS})""")
def q_keyed_duplicates(spark, sf_dir):
    d = DU.keyed_duplicates(flag_dense_view(spark, sf_dir), ROW_KEY)
    return d.select("date", "vendor", "cost", "description", *ROW_KEY, "keyed_dup")


SUBS_SQL = f"""g AS (
  SELECT *, CAST({_DAYS.format(a='date', b='lag(date) OVER w')} AS BIGINT) AS gap
  FROM p WHERE amount_bucket IS NOT NULL
  WINDOW w AS (PARTITION BY vendor_norm, amount_bucket ORDER BY date, {KEYS})),
s AS (
  SELECT *, coalesce(max(CASE WHEN gap BETWEEN 27 AND 33 THEN 1 ELSE 0 END) OVER (
      PARTITION BY vendor_norm, amount_bucket ORDER BY date, {KEYS}
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1, false) AS subscription_like
  FROM g)"""


@query("subscription_like", with_(SUPPLIER_QTY_CTE, _prep_sql("supqty"), SUBS_SQL) + f"""
SELECT date, vendor, cost, {KEYS}, gap, subscription_like FROM s""")
def q_subscription_like(spark, sf_dir):
    d = DU.subscription_like(supplier_qty_view(spark, sf_dir), ROW_KEY)
    return d.select("date", "vendor", "cost", *ROW_KEY, "gap", "subscription_like")


@query("duplicates_and_subs", with_(SUPPLIER_QTY_CTE, _prep_sql("supqty"), SUBS_SQL) + f"""
SELECT s.date, s.vendor, s.cost, s.description, {", ".join("s." + k for k in ROW_KEY)},
  coalesce(s.vendor_norm = lag(s.vendor_norm) OVER w AND s.amount_bucket = lag(s.amount_bucket) OVER w
           AND abs({_DAYS.format(a='s.date', b='lag(s.date) OVER w')}) <= 3, false) AS dup_candidate,
  s.subscription_like
FROM s WINDOW w AS (ORDER BY s.date, {", ".join("s." + k for k in ROW_KEY)})""")
def q_duplicates_and_subs(spark, sf_dir):
    return DU.duplicates_and_subs(supplier_qty_view(spark, sf_dir), ROW_KEY)


@query("flags_in_place", with_(FLAG_DENSE_CTE, _prep_sql("flagdense"), SUBS_SQL) + f"""
SELECT date, vendor, cost, description, {KEYS}, subscription_like FROM s""")
def q_flags_in_place(spark, sf_dir):
    return DU.flags_in_place(flag_dense_view(spark, sf_dir), ROW_KEY)


@query("flags_fanout", with_(FLAG_DENSE_CTE, _prep_sql("flagdense"), SUBS_SQL) + f"""
SELECT s.date, s.vendor, s.cost, s.description, {", ".join("s." + k for k in ROW_KEY)},
       s.subscription_like, c.legacy_copies
FROM s JOIN (SELECT date, vendor, cost, count(*) AS legacy_copies FROM flagdense GROUP BY ALL) c
  ON s.date IS NOT DISTINCT FROM c.date AND s.vendor IS NOT DISTINCT FROM c.vendor
 AND s.cost IS NOT DISTINCT FROM c.cost""")
def q_flags_fanout(spark, sf_dir):
    return DU.flags_fanout(flag_dense_view(spark, sf_dir), ROW_KEY)
