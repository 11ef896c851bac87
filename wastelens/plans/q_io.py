"""Readers, canonicalize, exports and a write / read-back round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wastelens.operators import audit as AU
from wastelens.plans.q_dashboards import SOP_SQL
from wastelens.plans.q_entries import DIMS_SQL, ENRICHED_SQL, ENTRIES_SQL, catalog, change_log, enriched
from wastelens.plans.q_reports import BASE_CTE, grain_sql
from wastelens.plans.registry import ORACLE, query
from wastelens.plans.sqlviews import WASTE_CTE, with_
from wastelens.session import cut_lineage, ensure_checkpoint_dir
from wastelens.sources import dims, versions
from wastelens.sources import readers as RD
from wastelens.sources import sinks as SK
from wastelens.sources.tables import ROW_KEY, table, waste_view


@query("canonicalize_events", """
SELECT ts AS date, CAST(NULL AS VARCHAR) AS suite, event_type AS material,
       CAST(user_id AS VARCHAR) AS vendor, CAST(event_id AS DOUBLE) AS qty,
       TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS category,
       props AS description, CAST(NULL AS VARCHAR) AS lot
FROM events WHERE ts IS NOT NULL""")
def q_canonicalize_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("ts").alias("Event_TS"), F.col("event_type").alias("Item"),
        F.col("user_id").cast("string").alias("Supplier"),
        F.col("event_id").cast("string").alias("Quantity"),
        F.col("value").cast("string").alias("USD"), F.col("props").alias("Memo"))
    return RD.canonicalize(e)


#: Text forms of the same dates, and what the column gives as a whole; the last holds days to the
#: 12th only, so both orders read all of it and the month comes first.
DATE_COLUMNS = {"day first": ("dd/MM/yyyy", "CAST(ts AS DATE)", None),
                "month first": ("M-d-yyyy H:mm", "date_trunc('minute', ts)", None),
                "short year": ("d.M.yy", "CAST(ts AS DATE)", None),
                "open": ("dd/MM/yyyy", "make_date(year(ts), day(ts), month(ts))", "day(ts) <= 12")}


@query("canonicalize_date_orders", " UNION ALL ".join(
    f"""SELECT CAST({value} AS TIMESTAMP) AS date, '{name}' AS material, CAST(event_id AS DOUBLE) AS qty
FROM events WHERE ts IS NOT NULL AND {only or 'true'}""" for name, (_, value, only) in DATE_COLUMNS.items()))
def q_canonicalize_date_orders(spark, sf_dir):
    """Uploaded tables whose date columns are written in different orders of day and month."""
    out = None
    for name, (form, _, only) in DATE_COLUMNS.items():
        e = table(spark, sf_dir, "events").where(only or "true").select(
            F.date_format("ts", form).alias("Timestamp"), F.lit(name).alias("Item"), F.col("event_id").cast("string").alias("Quantity"))
        one = RD.canonicalize(e).select("date", "material", "qty")
        out = one if out is None else out.unionByName(one)
    return out


AS_OF = "1998-06-17"


@query("export_presets", with_(WASTE_CTE) + " UNION ALL ".join(
    f"""SELECT '{name}' AS preset, {', '.join(['timestamp_local', 'material', 'quantity', 'total_cost'] + ROW_KEY)}
FROM waste WHERE CAST(timestamp_local AS DATE) BETWEEN DATE '{s}' AND DATE '{e}'"""
    for name, s, e in (("day", "1998-06-17", "1998-06-17"), ("week", "1998-06-15", "1998-06-21"),
                       ("month", "1998-06-01", "1998-06-30"), ("quarter", "1998-04-01", "1998-06-30"),
                       ("year", "1998-01-01", "1998-12-31"))))
def q_export_presets(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["timestamp_local", "material", "quantity", "total_cost"] + ROW_KEY)
    return SK.export_presets(w, AS_OF)


@query("export_range", with_(WASTE_CTE) + """
SELECT timestamp_local, material, quantity, total_cost, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM waste WHERE CAST(timestamp_local AS DATE) BETWEEN DATE '1997-02-10' AND DATE '1997-05-20'""")
def q_export_range(spark, sf_dir):
    w = waste_view(spark, sf_dir, ["timestamp_local", "material", "quantity", "total_cost"] + ROW_KEY)
    s, e = SK.custom_range("1997-02-10", "1997-05-20")
    return SK.export_range(w, s, e)[0]


@query("log_round_trip", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL, SOP_SQL, ENRICHED_SQL) + """
SELECT id, CAST(timestamp_local AS TIMESTAMP) AS timestamp_local, material,
       CAST(quantity AS DOUBLE) AS quantity, total_cost,
       ' said "' || material || '", then\\left' || chr(10) || 'x ' || id || chr(9) AS notes, true AS digest_ok
FROM enriched""")
def q_log_round_trip(spark, sf_dir):
    """Write the enriched entries, with quotes, commas, backslashes, line breaks and outer
    blanks in the notes, and their digests as a partitioned CSV log in the shared
    checkpoint folder, read it back as text, check every digest."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/log-{uuid.uuid4().hex}"
    odd = F.concat(F.lit(' said "'), "material", F.lit('", then\\left\nx '), "id", F.lit("\t"))
    e = enriched(spark, sf_dir, lambda d, at, like: SK.rebalanced(d, at["date"]))
    SK.append_log(AU.with_digest(e.withColumn("notes", odd)), root, fmt="csv", laid=True)
    text = RD.load_master(spark, root, typed=False)
    ok = AU.digest(text) == F.col("hash")
    typed = RD.type_log(text.withColumn("digest_ok", ok))
    return typed.select("id", "timestamp_local", "material", "quantity", "total_cost", "notes", "digest_ok")


@query("safe_totals", with_(WASTE_CTE) + """
SELECT reason, round(coalesce(sum(coalesce(TRY_CAST(CAST(total_cost AS VARCHAR) AS DOUBLE), 0)), 0), 2) AS total_cost
FROM waste GROUP BY reason""")
def q_safe_totals(spark, sf_dir):
    """Totals over a text-typed cost column (bad values count 0)."""
    from wastelens.functions.scalars import safe_sum
    w = waste_view(spark, sf_dir, ["reason", "total_cost"])
    t = w.withColumn("total_cost", F.col("total_cost").cast("string"))
    return t.groupBy("reason").agg(F.round(safe_sum("total_cost"), 2).alias("total_cost"))


@query("report_text_export", with_(WASTE_CTE, BASE_CTE) + f"""
SELECT unnest(string_split(report_text, chr(10))) AS value FROM ({grain_sql('Monthly', True)})""")
def q_report_text_export(spark, sf_dir):
    """Write the monthly report blocks as text into the shared
    checkpoint folder and read them back (one line per text line)."""
    from wastelens.operators import reports as R
    from wastelens.plans.q_reports import report_source
    t = R.with_text(R.period_table(report_source(spark, sf_dir), "Monthly"), "Monthly")
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/report-{uuid.uuid4().hex}"
    SK.write_text(t.orderBy("period").coalesce(1), root)
    return spark.read.text(root)


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BACK_DATED = "1998-01-01"


@query("append_sequence", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL, SOP_SQL, ENRICHED_SQL) + f"""
SELECT count(*) AS rows, 1::BIGINT AS first_seq, count(*) AS last_seq, count(*) AS sequences,
       (SELECT arg_max(sha256(id), (timestamp_local, id)) FROM enriched WHERE timestamp_local < '{BACK_DATED}') AS last_hash,
       (SELECT arg_max(sha256(id), (timestamp_local, id)) FROM enriched) AS latest_hash FROM enriched""")
def q_append_sequence(spark, sf_dir):
    """Entries dated back and appended last are the log's last rows by its append sequence."""
    root, order = _folder(spark, "log"), ["timestamp_local", "id"]
    e = enriched(spark, sf_dir, lambda d, at, like: cut_lineage(d)).withColumn("hash", F.sha2("id", 256))
    late = F.col("timestamp_local") < BACK_DATED
    for rows in (e.where(~late), e.where(late)):
        SK.append_log(rows, root, fmt="csv", sequence=order, partitioned=False)
    log = RD.load_master(spark, root, typed=False).withColumn("seq", F.col("seq").cast("long"))
    # Beside a distinct count the other sums, with their texts, would be kept and exchanged for each number.
    told = log.agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
                   F.max_by("hash", "seq").alias("last_hash"), F.max_by("hash", F.struct(*order)).alias("latest_hash"))
    return told.crossJoin(log.agg(F.count_distinct("seq").alias("sequences"))).select(
        "rows", "first_seq", "last_seq", "sequences", "last_hash", "latest_hash")


@query("entry_lookup", with_(WASTE_CTE, DIMS_SQL, ENTRIES_SQL, SOP_SQL, ENRICHED_SQL, """picked AS (
  SELECT date, material FROM enriched ORDER BY timestamp_local, id LIMIT 1)""") + """
SELECT e.id, e.timestamp_local, e.material, e.quantity FROM enriched e JOIN picked p ON e.date = p.date AND e.material = p.material""")
def q_entry_lookup(spark, sf_dir):
    """Entries stored by material; those of the first entry's day and material are looked up."""
    root = _folder(spark, "entries")
    e = enriched(spark, sf_dir, lambda d, at, like: SK.rebalanced(d, SK.material_slug(at["material"])))
    SK.append_entries(e, root, laid=True)
    first = e.orderBy("timestamp_local", "id").select("date", "material").first()
    return SK.find_entries(spark, root, first["date"], first["material"]).select("id", "timestamp_local", "material", "quantity")


@query("foreign_log", """
SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp_local, 'C:\\new\\rack ' || event_type AS notes, value AS total_cost
FROM events""")
def q_foreign_log(spark, sf_dir):
    """A log that another tool wrote: nothing in it is an escape."""
    root = _folder(spark, "foreign")
    table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_local"),
        F.concat(F.lit("C:\\new\\rack "), "event_type").alias("notes"), F.col("value").cast("string").alias("total_cost")) \
        .write.options(**RD.CSV).csv(root)
    return RD.load_master(spark, root)


def _dim_csv(spark, sf_dir, folder: str, columns: dict) -> str:
    """A CSV dimension of part's rows, in the order of p_partkey, in files whose names follow it."""
    path = _folder(spark, folder)
    p = table(spark, sf_dir, "part").orderBy("p_partkey")
    p.select(*[v.alias(k) for k, v in columns.items()]).write.options(**RD.CSV).csv(path)
    return path


@query("load_dimensions", """
SELECT 'materials' AS dim, p_name AS name, 'ea' AS unit,
       coalesce(arg_min_null(CASE WHEN p_size <= 40 THEN p_retailprice END, p_partkey), 0) AS price FROM part GROUP BY p_name
UNION ALL
SELECT 'prices', p_name, NULL, arg_max_null(p_retailprice, p_partkey) FROM part GROUP BY p_name
UNION ALL
SELECT 'sop', p_brand, arg_max_null(CASE WHEN p_size > 40 THEN '' ELSE 'https://sop.example/' || p_partkey END, p_partkey), NULL
FROM part GROUP BY p_brand""")
def q_load_dimensions(spark, sf_dir):
    """Dimensions from CSV: names repeat, a column is missing, prices are bad, links are empty."""
    price = F.when(F.col("p_size") > 40, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    m = RD.load_materials(spark, _dim_csv(spark, sf_dir, "materials", {"name": F.col("p_name"), "cost_per_unit": price}))
    p = RD.load_mock_prices(spark, _dim_csv(spark, sf_dir, "prices", {
        "name": F.col("p_name"), "mock_price": F.col("p_retailprice").cast("string")}), m)
    s = RD.load_sop(spark, _dim_csv(spark, sf_dir, "sop", {"reason": F.col("p_brand"), "sop_url": F.when(
        F.col("p_size") <= 40, F.concat(F.lit("https://sop.example/"), F.col("p_partkey").cast("string")))}))
    none = F.lit(None)
    return m.select(F.lit("materials").alias("dim"), "name", "unit", F.col("cost_per_unit").alias("price")) \
        .unionByName(p.select(F.lit("prices").alias("dim"), "name", none.cast("string").alias("unit"), F.col("mock_price").alias("price"))) \
        .unionByName(s.select(F.lit("sop").alias("dim"), F.col("reason").alias("name"), F.col("sop_url").alias("unit"), none.cast("double").alias("price")))


@query("dim_versions", ORACLE["change_log_dim"].replace("SELECT name, unit, cost_per_unit FROM state WHERE here", """, after AS (
SELECT name, unit, cost_per_unit FROM state WHERE here""") + """)
SELECT 'before' AS version, name, unit, cost_per_unit FROM cat UNION ALL SELECT 'after', name, unit, cost_per_unit FROM after""")
def q_dim_versions(spark, sf_dir):
    """A reader of a dimension keeps its version when a new one is written; later readers see that."""
    root = _folder(spark, "dim")
    versions.write(catalog(spark, sf_dir), root)
    before = versions.read(spark, root)
    versions.write(dims.apply_changes(before, change_log(spark, sf_dir), "name"), root)
    after = versions.read(spark, root)
    return before.withColumn("version", F.lit("before")).unionByName(after.withColumn("version", F.lit("after"))) \
        .select("version", "name", "unit", "cost_per_unit")


@query("monthly_export", with_(WASTE_CTE) + """
SELECT timestamp_local, material, quantity, total_cost, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM waste WHERE CAST(timestamp_local AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'""")
def q_monthly_export(spark, sf_dir):
    """The month's rows are written as a CSV hand-out and read back."""
    w = waste_view(spark, sf_dir, ["timestamp_local", "material", "quantity", "total_cost"] + ROW_KEY)
    _, path = SK.monthly_export(w, AS_OF, _folder(spark, "month"))
    return w.where("false") if path is None else spark.read.schema(w.schema).options(**RD.CSV).csv(path)
