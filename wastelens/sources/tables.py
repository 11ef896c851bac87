"""Driver tables and the waste-log view over them.

The view maps TPC-H-like tables onto the waste-log layout (see FIXTURES.md):

    timestamp_local = l_shipdate       suite    = supplier's n_name
    shift  = l_returnflag||l_linestatus material = p_name
    vendor = s_name                    reason   = o_orderpriority
    quantity = l_quantity (bigint)     total_cost = l_extendedprice
    cost_per_unit = p_retailprice

Row key / tiebreak: (timestamp_local, l_orderkey, l_linenumber, l_partkey, l_suppkey).

Only the dimension joins that provide requested columns are planned. They are
left joins on the dimensions' unique keys, so a fact row without its dimension
row stays (with nulls), and which columns are asked for never changes the rows.
Skipping an unneeded one saves a full shuffle of the fact table (lineitem x
orders is the big one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ORDER_KEY = ["timestamp_local"] + ROW_KEY

WASTE_COLUMNS = ["timestamp_local", "suite", "shift", "material", "vendor", "reason",
                 "quantity", "total_cost", "cost_per_unit"] + ROW_KEY

_NEEDS = {"suite": "nation", "vendor": "supplier", "material": "part",
          "cost_per_unit": "part", "reason": "orders"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str, columns) -> DataFrame:
    """Pruned scan of a fact table."""
    return table(spark, sf_dir, name).select(*columns)


#: Rows of a table that may be broadcast.
FEW_ROWS = 500_000


def is_few(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows (one job)."""
    return df.count() <= most


def waste_view(spark: SparkSession, sf_dir: str, columns=None, narrow: bool = False) -> DataFrame:
    """Waste-log view; ``columns`` limits output (and the joins) to those named.

    ``narrow``: for views whose rows are exchanged by several joins. Facts are brought to their final, fewer columns
    before the first join, and up to ``FEW_ROWS`` suppliers are broadcast, which costs a job that counts them.
    """
    columns = list(columns or WASTE_COLUMNS)
    need = {_NEEDS[c] for c in columns if c in _NEEDS}
    if "nation" in need:
        need.add("supplier")
    li_cols = {"l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
               *ROW_KEY}
    li = fact(spark, sf_dir, "lineitem", sorted(li_cols))
    df = li
    if narrow:
        plain = [c for c in columns if c in ("timestamp_local", "shift", "quantity", "total_cost", *ROW_KEY)]
        keys = [k for d, k in (("orders", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")) if d in need and k not in plain]
    exprs = {
        "timestamp_local": F.col("l_shipdate"),
        "shift": F.concat(F.col("l_returnflag"), F.col("l_linestatus")),
        "quantity": F.col("l_quantity").cast("bigint"),
        "total_cost": F.col("l_extendedprice"),
    }
    for k in ROW_KEY:
        exprs[k] = F.col(k)
    if narrow:
        df = li = li.select(*[exprs[c].alias(c) for c in plain], *keys)
        exprs = {c: F.col(c) for c in plain}
    if "orders" in need:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        df = df.join(o, df.l_orderkey == o.o_orderkey, "left")
        exprs["reason"] = F.col("o_orderpriority")
    if "part" in need:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
        df = df.join(p, df.l_partkey == p.p_partkey, "left")
        exprs["material"] = F.col("p_name")
        exprs["cost_per_unit"] = F.col("p_retailprice")
    if "supplier" in need:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        if "nation" in need:
            n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
            s = s.join(n, s.s_nationkey == n.n_nationkey, "left")
            exprs["suite"] = F.col("n_name")
        if narrow and is_few(s):
            s = F.broadcast(s.drop("s_nationkey"))
        df = df.join(s, df.l_suppkey == s.s_suppkey, "left")
        exprs["vendor"] = F.col("s_name")
    return df.select(*[exprs[c].alias(c) for c in columns])


def flag_dense_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor = l_returnflag, cost = l_quantity, date = l_shipdate (adjacent duplicates)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("date"), F.col("l_returnflag").alias("vendor"),
                     F.col("l_quantity").alias("cost"),
                     F.col("l_linestatus").alias("description"), *ROW_KEY)


def supplier_qty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor = l_suppkey as text, cost = l_quantity, date = l_shipdate (subscriptions)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("date"),
                     F.col("l_suppkey").cast("string").alias("vendor"),
                     F.col("l_quantity").alias("cost"),
                     F.col("l_returnflag").alias("description"), *ROW_KEY)
