"""DuckDB text of the driver-table views (same mapping as sources/tables.py)."""

WASTE_CTE = """waste AS (
  SELECT l.l_shipdate AS timestamp_local, n.n_name AS suite,
         l.l_returnflag || l.l_linestatus AS shift, p.p_name AS material,
         s.s_name AS vendor, o.o_orderpriority AS reason,
         CAST(l.l_quantity AS BIGINT) AS quantity, l.l_extendedprice AS total_cost,
         p.p_retailprice AS cost_per_unit,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

FLAG_DENSE_CTE = """flagdense AS (
  SELECT l_shipdate AS date, l_returnflag AS vendor, l_quantity AS cost,
         l_linestatus AS description, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""

SUPPLIER_QTY_CTE = """supqty AS (
  SELECT l_shipdate AS date, CAST(l_suppkey AS VARCHAR) AS vendor, l_quantity AS cost,
         l_returnflag AS description, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
