"""Categories, entry enrichment, alerts and dimension change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelens import schemas
from wastelens.functions import scalars as S
from wastelens.operators import categorize as C
from wastelens.operators import entries as EN
from wastelens.plans.q_dashboards import SOP_SQL, sop_links
from wastelens.plans.registry import query
from wastelens.plans.sqlviews import WASTE_CTE, with_
from wastelens.sources import dims
from wastelens.sources.tables import ROW_KEY, is_few, table, waste_view

KEYS = ", ".join(ROW_KEY)


def _rules_sql(rules, text):
    parts = []
    for cat, keys in rules:
        cond = " OR ".join(f"contains({text}, '{k}')" for k in keys)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(parts) + " END"


DOC_TEXT = "lower(coalesce(source, '') || ' ' || coalesce(text, ''))"


@query("categorize_rules", f"""
SELECT doc_id, rule_cat, rule_cat AS ai_category,
       CASE WHEN rule_cat IS NOT NULL THEN 'rule' ELSE 'unknown' END AS ai_category_source
FROM (SELECT doc_id, {_rules_sql(schemas.DEFAULT_RULES, DOC_TEXT)} AS rule_cat FROM documents)""")
def q_categorize_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("vendor"),
                                                  F.col("text").alias("description"))
    return C.categorize_rules(d).select("doc_id", "rule_cat", "ai_category", "ai_category_source")


PART_RULES = [("tools", ["widget", "gizmo"]), ("hardware", ["bolt", "gear"]),
              ("logistics", ["ups", "freight"])]
PART_TEXT = "lower(coalesce(p_name, '') || ' ' || coalesce(p_type, ''))"


@query("categorize_part_rules", f"""
SELECT p_partkey, rule_cat, rule_cat AS ai_category,
       CASE WHEN rule_cat IS NOT NULL THEN 'rule' ELSE 'unknown' END AS ai_category_source
FROM (SELECT p_partkey, {_rules_sql(PART_RULES, PART_TEXT)} AS rule_cat FROM part)""")
def q_categorize_part_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("vendor"),
                                            F.col("p_type").alias("description"))
    return C.categorize_rules(p, PART_RULES).select("p_partkey", "rule_cat", "ai_category",
                                                    "ai_category_source")


# Two hundred rules of a few word endings each: a later rule counts only where no earlier one does.
LONG_RULES = [(f"rule {k:03d}", [f"{a}{b} " for b in "aeinorst"]) for k, a in enumerate(
    [x + y for x in "zqxjkvbpgwfymcdlhrsntioae" for y in "zxjkvbpg"])]


@query("categorize_long_rules", f"""
SELECT doc_id, {_rules_sql(LONG_RULES, DOC_TEXT)} AS rule_cat FROM documents""")
def q_categorize_long_rules(spark, sf_dir):
    """M2 with 1600 keywords, found by one automaton."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("vendor"), F.col("text").alias("description"))
    return C.categorize_rules(d, LONG_RULES).select("doc_id", "rule_cat")


@query("categorize_model")
def q_categorize_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("vendor"),
                                                     F.col("text").alias("description"))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("category"))
    model = C.train_category_model(docs.join(labels, "doc_id"), "category", num_features=1 << 16)
    return C.categorize_model(docs, model).select("doc_id", "rule_cat", "ai_category",
                                                  "ai_category_source")


# Dimensions derived from part: catalog keeps the first row per name, the
# overrides (parts of size above 25, price less 1) keep the last.
def catalog(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("ea").alias("unit"),
                                            F.col("p_retailprice").alias("cost_per_unit"),
                                            F.col("p_partkey").alias("seq"))
    return dims.first_per_key(p, "name", "seq").drop("seq")


def overrides(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_size") > 25).select(
        F.col("p_name").alias("name"), (F.col("p_retailprice") - 1.0).alias("mock_price"),
        F.col("p_partkey").alias("seq"))
    return dims.last_per_key(p, "name", "seq").drop("seq")


DIMS_SQL = """cat AS (SELECT p_name AS name, 'ea' AS unit, arg_min(p_retailprice, p_partkey) AS cost_per_unit
                FROM part GROUP BY p_name),
ovr AS (SELECT p_name AS name, arg_max(p_retailprice - 1.0, p_partkey) AS mock_price
        FROM part WHERE p_size > 25 GROUP BY p_name)"""


def entry_facts(spark, sf_dir):
    """The rows of the log that entries are made of, as they are."""
    return waste_view(spark, sf_dir, ["timestamp_local", "suite", "shift", "material", "quantity", "reason"] + ROW_KEY, narrow=True)


def entry_columns():
    """Columns of entries (id, log_date, log_time), as expressions over the facts."""
    return {"id": F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in ROW_KEY]), 256),
            "log_date": F.to_date("timestamp_local"),
            "log_time": F.concat(F.lpad((F.col("l_linenumber") + 6).cast("string"), 2, "0"), F.lit(":15:00"))}


def as_entries(facts, keep=()):
    return facts.select(
        *[c.alias(k) for k, c in entry_columns().items()],
        "suite", "shift", F.concat(F.lit("EMP-"), F.col("l_suppkey").cast("string")).alias("employee_id"),
        "material", "quantity", "reason",
        F.concat(F.lit("LOT-"), F.col("l_orderkey").cast("string")).alias("batch_lot"),
        F.lit("").alias("notes"), *ROW_KEY, *keep)


def entries_source(spark, sf_dir):
    return as_entries(entry_facts(spark, sf_dir))


ENTRIES_SQL = """entries AS (
  SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS id,
         CAST(timestamp_local AS DATE) AS log_date,
         lpad(CAST(l_linenumber + 6 AS VARCHAR), 2, '0') || ':15:00' AS log_time,
         suite, shift, 'EMP-' || CAST(l_suppkey AS VARCHAR) AS employee_id, material, quantity, reason,
         'LOT-' || CAST(l_orderkey AS VARCHAR) AS batch_lot, '' AS notes,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM waste)"""


@query("resolve_price", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL) + f"""
SELECT {KEYS}, e.material, e.quantity, c.unit,
       CASE WHEN o.name IS NOT NULL THEN o.mock_price ELSE c.cost_per_unit END AS cost_per_unit
FROM entries e LEFT JOIN cat c ON e.material = c.name LEFT JOIN ovr o ON e.material = o.name""")
def q_resolve_price(spark, sf_dir):
    e = entries_source(spark, sf_dir).select(*ROW_KEY, "material", "quantity")
    return EN.resolve_price(e, catalog(spark, sf_dir), overrides(spark, sf_dir), use_mock=True)


@query("resolve_price_catalog", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL) + f"""
SELECT {KEYS}, e.material, e.quantity, c.unit, c.cost_per_unit
FROM entries e LEFT JOIN cat c ON e.material = c.name""")
def q_resolve_price_catalog(spark, sf_dir):
    e = entries_source(spark, sf_dir).select(*ROW_KEY, "material", "quantity")
    return EN.resolve_price(e, catalog(spark, sf_dir), overrides(spark, sf_dir), use_mock=False)


ENRICHED_SQL = """enriched AS (
  SELECT e.id, strftime(e.log_date, '%Y-%m-%d') || 'T' || e.log_time AS timestamp_local,
         strftime(e.log_date, '%Y-%m-%d') AS date, e.log_time AS time, '' AS site, trim(e.suite) AS suite,
         '' AS line, '' AS room, e.shift, trim(e.employee_id) AS employee_id, e.material, c.unit,
         e.quantity, e.reason, trim(e.batch_lot) AS batch_lot,
         CASE WHEN o.name IS NOT NULL THEN o.mock_price ELSE c.cost_per_unit END AS cost_per_unit,
         round_even(e.quantity * CASE WHEN o.name IS NOT NULL THEN o.mock_price ELSE c.cost_per_unit END, 4)
           AS total_cost,
         trim(e.notes) AS notes, '' AS photo_filename, coalesce(s.sop_url, '') AS sop_url
  FROM entries e LEFT JOIN cat c ON e.material = c.name LEFT JOIN ovr o ON e.material = o.name
  LEFT JOIN sop s ON e.reason = s.reason)"""


def enriched(spark, sf_dir, lay=None):
    """The log's rows. ``lay(rows, at, like)`` deals them out or stores them as the next step wants them, and may add
    columns; ``at`` gives columns of the log by name, as expressions over ``rows``; of ``like``, which takes less work than ``rows`` and
    holds about the same rows, over it too, for id, timestamp_local and shift.

    The facts are laid, as they are narrower than the log's rows, where the dimensions are few enough to be
    broadcast, so that no later join moves a row; else the log's rows are.
    """
    dimensions = [catalog(spark, sf_dir), overrides(spark, sf_dir), sop_links(spark, sf_dir)]
    if lay is None:
        return EN.enrich_entries(entries_source(spark, sf_dir), *dimensions, use_mock=True)
    if not all(is_few(d) for d in dimensions):
        log = EN.enrich_entries(entries_source(spark, sf_dir), *dimensions, use_mock=True)
        return lay(log, {c: F.col(c) for c in log.columns}, log)
    facts = entry_facts(spark, sf_dir)
    like = waste_view(spark, sf_dir, ["timestamp_local", "shift"] + ROW_KEY, narrow=True)
    c = entry_columns()
    date = F.date_format(c["log_date"], "yyyy-MM-dd")
    laid = lay(facts, {"id": c["id"], "timestamp_local": F.concat(date, F.lit("T"), c["log_time"]), "date": date,
                       "suite": S.strip("suite"), "shift": F.col("shift"), "material": F.col("material")}, like)
    new = [n for n in laid.columns if n not in facts.columns]
    return EN.enrich_entries(as_entries(laid, new), *[F.broadcast(d) for d in dimensions], use_mock=True, keep=new)


@query("enrich_entries", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL, SOP_SQL, ENRICHED_SQL)
       + "SELECT * FROM enriched")
def q_enrich_entries(spark, sf_dir):
    return enriched(spark, sf_dir)


ENTRY_THRESHOLD = 95000.0
DAY_THRESHOLD = 1500000.0


@query("entry_alerts", with_(WASTE_CTE) + f"""
SELECT {KEYS}, material, total_cost FROM waste WHERE total_cost >= {ENTRY_THRESHOLD}""")
def q_entry_alerts(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["material", "total_cost"] + ROW_KEY)
    return EN.entry_alerts(w, ENTRY_THRESHOLD).select(*ROW_KEY, "material", "total_cost")


@query("day_alerts", with_(WASTE_CTE) + f"""
SELECT day, round(day_cost, 2) AS day_cost FROM (
  SELECT CAST(timestamp_local AS DATE) AS day, sum(coalesce(total_cost, 0)) AS day_cost
  FROM waste GROUP BY 1) WHERE day_cost >= {DAY_THRESHOLD}""")
def q_day_alerts(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["timestamp_local", "total_cost"])
    return EN.day_alerts(w, DAY_THRESHOLD).withColumn("day_cost", F.round("day_cost", 2))


# Change set from part: small parts get a new unit and price (last row per
# name wins), size-50 parts add new "XL" materials.
def _changes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edits = dims.last_per_key(p.where(F.col("p_size") < 5).select(
        F.col("p_name").alias("name"), F.lit("box").alias("unit"),
        (F.col("p_retailprice") + 10.0).alias("cost_per_unit"), F.col("p_partkey").alias("seq")),
        "name", "seq").drop("seq")
    adds = dims.last_per_key(p.where(F.col("p_size") == 50).select(
        F.concat(F.col("p_name"), F.lit(" XL")).alias("name"), F.lit("ea").alias("unit"),
        F.col("p_retailprice").alias("cost_per_unit"), F.col("p_partkey").alias("seq")),
        "name", "seq").drop("seq")
    return edits.unionByName(adds)


CHANGES_SQL = """chg AS (
  SELECT p_name AS name, 'box' AS unit, arg_max(p_retailprice + 10.0, p_partkey) AS cost_per_unit
  FROM part WHERE p_size < 5 GROUP BY p_name
  UNION ALL
  SELECT p_name || ' XL' AS name, 'ea' AS unit, arg_max(p_retailprice, p_partkey) AS cost_per_unit
  FROM part WHERE p_size = 50 GROUP BY p_name)"""


@query("upsert_dim", with_(DIMS_SQL, CHANGES_SQL) + """
SELECT name, unit, cost_per_unit FROM cat WHERE name NOT IN (SELECT name FROM chg)
UNION ALL SELECT name, unit, cost_per_unit FROM chg""")
def q_upsert_dim(spark, sf_dir):
    return dims.upsert(catalog(spark, sf_dir), _changes(spark, sf_dir), "name")


@query("delete_dim", with_(DIMS_SQL) + """
SELECT name, unit, cost_per_unit FROM cat
WHERE name NOT IN (SELECT p_name FROM part WHERE contains(p_name, 'bolt'))""")
def q_delete_dim(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where(F.col("p_name").contains("bolt")) \
        .select(F.col("p_name").alias("name"))
    return dims.delete(catalog(spark, sf_dir), gone, "name")


# A change log over the catalog, in the order of p_partkey: names repeat, so a name is edited,
# deleted and added again in turn. Updates set the price, or only the unit.
def change_log(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.pmod("p_partkey", F.lit(5))
    return p.select(
        F.when(kind == 4, F.concat("p_name", F.lit(" NEW"))).otherwise(F.col("p_name")).alias("name"),
        F.when(kind.isin(1, 4), F.lit("box")).when(kind == 3, F.lit("bag")).alias("unit"),
        F.when(kind != 3, F.col("p_retailprice") + 10.0).alias("cost_per_unit"),
        F.when(kind == 0, F.lit(dims.DELETE)).when(kind.isin(1, 4), F.lit(dims.UPSERT)).otherwise(F.lit(dims.UPDATE)).alias("op"),
        F.col("p_partkey").alias("seq"))


@query("change_log_dim", "WITH RECURSIVE " + DIMS_SQL + """,
log AS (
  SELECT p_name || CASE WHEN p_partkey % 5 = 4 THEN ' NEW' ELSE '' END AS name,
         CASE p_partkey % 5 WHEN 1 THEN 'box' WHEN 4 THEN 'box' WHEN 3 THEN 'bag' END AS unit,
         CASE WHEN p_partkey % 5 <> 3 THEN p_retailprice + 10.0 END AS cost_per_unit,
         CASE p_partkey % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'upsert' WHEN 4 THEN 'upsert' ELSE 'update' END AS op, p_partkey AS seq
  FROM part),
steps AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS k FROM log),
names AS (SELECT name FROM cat UNION SELECT name FROM log),
state AS (
  SELECT n.name, c.unit, c.cost_per_unit, c.name IS NOT NULL AS here, 0::BIGINT AS k FROM names n LEFT JOIN cat c ON n.name = c.name
  UNION ALL
  SELECT s.name,
         CASE x.op WHEN 'upsert' THEN x.unit WHEN 'update' THEN coalesce(x.unit, s.unit) END,
         CASE x.op WHEN 'upsert' THEN x.cost_per_unit WHEN 'update' THEN coalesce(x.cost_per_unit, s.cost_per_unit) END,
         CASE x.op WHEN 'upsert' THEN true WHEN 'delete' THEN false ELSE s.here END, x.k
  FROM state s JOIN steps x ON x.name = s.name AND x.k = s.k + 1)
SELECT name, unit, cost_per_unit FROM state WHERE here
QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1
  AND k = (SELECT count(*) FROM steps x WHERE x.name = state.name)""")
def q_change_log_dim(spark, sf_dir):
    """The catalog after an ordered log of edits, deletions and additions with repeated names."""
    return dims.apply_changes(catalog(spark, sf_dir), change_log(spark, sf_dir), "name")
