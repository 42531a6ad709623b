"""Registered relational queries, each a Spark plan with the SQL that it must equal.

Sheets are simulated by partitions of `orders`; before and after snapshots are derived arithmetically.
Ordering is explicit about nulls, sums of money are decimals, and every computed column has a name.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..budget import Budget
from ..compare import reconcile as compare
from ..errors import BudgetError
from ..functions import refs
from ..operators import discovery, profiling, reconcile, relations, search
from ..session import shared_dir
from ..sources import projections, xlsx
from ..sources.export import write_parts
from ..sources.package import Package
from ..workbook import Workbook

MONEY = "decimal(18,2)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a plan under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as four sheets of one workbook; headers of the odd ones are in another order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("Status"), F.col("o_totalprice").cast(MONEY).alias("Amount"))
    out = {}
    for k in range(4):
        columns = ["ID", "Status", "Amount"] if k % 2 == 0 else ["Amount", "ID", "Status"]
        out[f"Partition{k}"] = orders.where(F.col("ID") % 4 == k).select(columns)
    return out


# --- scans, projections, filters ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS price, l_shipdate::DATE AS shipped FROM lineitem WHERE l_quantity > 45")
def scan_project_cast(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_shipdate").cast("date").alias("shipped"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def read_table_filter(spark, d):
    return relations.filtered(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}).drop("o_orderpriority")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL")
def read_table_is_null(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return relations.filtered(rows, ["o_orderkey", "status"], {"status": None})


@query("SELECT o_orderpriority, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DECIMAL(38,2)) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def filter_parametrized(spark, d):
    relation = relations.Relations(spark)
    relation.register("orders", table(spark, d, "orders"))
    return relation.frame("SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders WHERE o_orderstatus = ? GROUP BY 1", ["O"])


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') ")
def find_by_substring(spark, d):
    return discovery.containing(table(spark, d, "nation"), "n_name", "1").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5")
def page_offset(spark, d):
    return discovery.page(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 5, 7)


@query("""SELECT o_orderkey AS "ID", o_orderstatus AS "Status", o_totalprice::DECIMAL(18,2) AS "Amount", 'Partition' || (o_orderkey % 4)::VARCHAR AS _sheet FROM orders""")
def load_sheets_union(spark, d):
    return relations.union_sheets(sheets(spark, d), ["ID", "Status", "Amount"])


@query("""SELECT o_totalprice::DECIMAL(18,2) AS "Amount", o_orderkey AS "ID", 'Partition' || (o_orderkey % 4)::VARCHAR AS origin FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def union_header_reorder(spark, d):
    both = {k: v for k, v in sheets(spark, d).items() if k in ("Partition1", "Partition2")}
    return relations.union_sheets(both, ["Amount", "ID"], "origin")


@query("SELECT g AS row_number, o_orderstatus AS status FROM range(1, 301) AS r(g) LEFT JOIN orders ON o_orderkey = g")
def dense_range_fill(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_orderstatus").alias("status"))
    return discovery.dense_rows(rows, "row_number", 1, 300)


@query("SELECT w.k AS o_orderkey, o_orderstatus FROM (VALUES (3), (999999999), (1), (40)) AS w(k) LEFT JOIN orders ON o_orderkey = w.k")
def sparse_lookup(spark, d):
    wanted = spark.createDataFrame([(3,), (999999999,), (1,), (40,)], "o_orderkey bigint")
    return discovery.lookup(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), wanted, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 101")
def budget_limit(spark, d):
    return relations.bounded(table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), 100)


# --- aggregates --------------------------------------------------------------------------------


@query("SELECT r_name, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_sum(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("decimal(38,2)").alias("total"))


@query("SELECT o_custkey, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1 ORDER BY total DESC NULLS LAST, o_custkey LIMIT 10")
def group_sum_top(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("decimal(38,2)").alias("total"))
    return rows.orderBy(F.desc_nulls_last("total"), "o_custkey").limit(10)


@query("SELECT count(*) AS n, CAST(sum(l_quantity::DECIMAL(18,2)) AS DECIMAL(38,2)) AS quantity, count(DISTINCT l_partkey) AS parts, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast(MONEY)).cast("decimal(38,2)").alias("quantity"), F.count_distinct("l_partkey").alias("parts"), F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY 1")
def agg_filter(spark, d):
    return relations.sql(spark, {"lineitem": table(spark, d, "lineitem")}, "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY 1")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_mktsegment)::INTEGER AS all_segments FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def agg_grouping_sets(spark, d):
    return relations.sql(spark, {"customer": table(spark, d, "customer")}, "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) AS INT) AS all_segments FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def agg_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 6")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS median, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY ALL")
def agg_median(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.5).alias("median"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("""SELECT 'o_orderkey' AS column_name, count(*) AS rows, count(o_orderkey) AS nonnull, count(DISTINCT o_orderkey) AS distinct_values, round(avg(o_orderkey), 6) AS mean FROM orders
UNION ALL SELECT 'status', count(*), count(nullif(o_orderstatus, 'F')), count(DISTINCT nullif(o_orderstatus, 'F')), NULL FROM orders
UNION ALL SELECT 'price', count(*), count(o_totalprice), count(DISTINCT o_totalprice::DECIMAL(18,2)), round(CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) / count(*), 6) FROM orders""")
def profile_table(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.col("o_totalprice").cast(MONEY).alias("price"))
    return profiling.profile(rows).withColumn("mean", F.round("mean", 6))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_keys, count(DISTINCT o_orderkey) AS distinct_keys FROM orders")
def key_audit(spark, d):
    return reconcile.key_audit(table(spark, d, "orders"), ["o_orderkey"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys FROM lineitem")
def key_audit_duplicates(spark, d):
    return reconcile.key_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE k IS NULL OR p IS NULL) AS null_keys, count(DISTINCT (k, p)) AS distinct_keys
FROM (SELECT nullif(o_custkey % 100, 7) AS k, nullif(o_orderpriority, '5-LOW') AS p FROM orders)""")
def key_audit_nulls(spark, d):
    rows = table(spark, d, "orders").select(F.nullif(F.col("o_custkey") % 100, F.lit(7)).alias("k"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    return reconcile.key_audit(rows, ["k", "p"])


# --- reconciliation ----------------------------------------------------------------------------

#: Snapshots of orders: the earlier one by priority, the later one by status, with some orders gone, dearer, of another status or new.
_SNAPSHOTS = """WITH b AS (SELECT 'priority ' || left(o_orderpriority, 1) AS sheet, o_orderkey AS "ID", o_totalprice::DECIMAL(18,2) AS "Amount", nullif(o_orderstatus, 'P') AS "Status" FROM orders),
a AS (SELECT 'status ' || o_orderstatus AS sheet, o_orderkey AS "ID", CASE WHEN o_custkey % 31 = 4 THEN o_totalprice::DECIMAL(18,2) + 12.34 ELSE o_totalprice::DECIMAL(18,2) END AS "Amount",
  CASE WHEN o_custkey % 37 = 3 THEN NULL WHEN o_custkey % 43 = 6 THEN '' ELSE nullif(o_orderstatus, 'P') END AS "Status" FROM orders WHERE o_orderkey % 23 <> 7
  UNION ALL SELECT 'late', -o_orderkey, o_totalprice::DECIMAL(18,2), o_orderstatus FROM orders WHERE o_orderkey % 41 = 5),
j AS (SELECT b.sheet AS before_sheet, a.sheet AS after_sheet, coalesce(b."ID", a."ID") AS k0, b."Amount" AS b0, b."Status" AS b1, a."Amount"::DECIMAL(18,2) AS a0, a."Status" AS a1,
  CASE WHEN b."ID" IS NULL THEN 'added' WHEN a."ID" IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  b."ID" IS NOT NULL AND a."ID" IS NOT NULL AS paired FROM b FULL JOIN a ON b."ID" = a."ID"),
c AS (SELECT kind, before_sheet, after_sheet, k0, b0, b1, a0, a1 FROM j WHERE NOT paired OR b0 IS DISTINCT FROM a0 OR b1 IS DISTINCT FROM a1) """


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    key, customer, price, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast(MONEY), F.nullif(F.col("o_orderstatus"), F.lit("P"))
    before = orders.select(F.concat(F.lit("priority "), F.left("o_orderpriority", F.lit(1))).alias("_sheet"), key.alias("ID"), price.alias("Amount"), status.alias("Status"))
    dearer = F.when(customer % 31 == 4, price + F.lit("12.34").cast(MONEY)).otherwise(price).cast(MONEY)
    other = F.when(customer % 37 == 3, None).when(customer % 43 == 6, "").otherwise(status)
    after = orders.where(key % 23 != 7).select(F.concat(F.lit("status "), "o_orderstatus").alias("_sheet"), key.alias("ID"), dearer.alias("Amount"), other.alias("Status"))
    new = orders.where(key % 41 == 5).select(F.lit("late").alias("_sheet"), (-key).alias("ID"), price.alias("Amount"), F.col("o_orderstatus").alias("Status"))
    return before, after.unionByName(new)


@query(_SNAPSHOTS + "SELECT * FROM c")
def reconcile_changes(spark, d):
    return reconcile.changes(*snapshots(spark, d), ["ID"], ["Amount", "Status"], "_sheet")


@query(_SNAPSHOTS + "SELECT (SELECT count(*) FROM c WHERE kind = 'added') AS added, (SELECT count(*) FROM c WHERE kind = 'removed') AS removed, (SELECT count(*) FROM c WHERE kind = 'changed') AS changed, (SELECT count(*) FROM b) - (SELECT count(*) FROM c WHERE kind <> 'added') AS unchanged")
def reconcile_counts(spark, d):
    before, after = snapshots(spark, d)
    return reconcile.counts(reconcile.changes(before, after, ["ID"], ["Amount", "Status"], "_sheet"), before)


@query(_SNAPSHOTS + """SELECT 'Amount' AS column_name, count(*) FILTER (WHERE kind = 'changed' AND b0 IS DISTINCT FROM a0) AS changed FROM c UNION ALL SELECT 'Status', count(*) FILTER (WHERE kind = 'changed' AND b1 IS DISTINCT FROM a1) FROM c""")
def reconcile_changed_columns(spark, d):
    return reconcile.changed_columns(reconcile.changes(*snapshots(spark, d), ["ID"], ["Amount", "Status"], "_sheet"), ["Amount", "Status"])


@query(_SNAPSHOTS + "SELECT * FROM c ORDER BY k0 LIMIT 20")
def reconcile_sample(spark, d):
    return reconcile.sample(reconcile.changes(*snapshots(spark, d), ["ID"], ["Amount", "Status"], "_sheet"), 1, 20)


@query(_SNAPSHOTS + "SELECT kind, before_sheet, after_sheet, k0 FROM c WHERE kind <> 'changed'")
def reconcile_membership_only(spark, d):
    return reconcile.changes(*snapshots(spark, d), ["ID"], [], "_sheet")


@query("""WITH b AS (SELECT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN upper(role) ELSE role END AS role, text FROM conversations WHERE turn < 4 OR conv_id % 5 <> 0)
SELECT CASE WHEN a.conv_id IS NULL THEN 'removed' ELSE 'changed' END AS kind, 'before' AS before_sheet, CASE WHEN a.conv_id IS NOT NULL THEN 'after' END AS after_sheet, b.conv_id AS k0, b.turn AS k1, b.role AS b0, a.role AS a0 FROM b LEFT JOIN a ON b.conv_id = a.conv_id AND b.turn = a.turn WHERE a.conv_id IS NULL OR a.role <> b.role""")
def reconcile_composite_key(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    after = rows.where("turn < 4 OR conv_id % 5 <> 0").withColumn("role", F.when(F.col("conv_id") % 7 == 0, F.upper("role")).otherwise(F.col("role")))
    return reconcile.changes(rows.withColumn("_sheet", F.lit("before")), after.withColumn("_sheet", F.lit("after")), ["conv_id", "turn"], ["role"], "_sheet")


@query("""WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0 END AS v, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '' END AS t FROM customer), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 0 END AS v, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '' END AS t FROM customer)
SELECT 'changed' AS kind, 's' AS before_sheet, 's' AS after_sheet, b.k AS k0, b.v AS b0, b.t AS b1, a.v AS a0, a.t AS a1 FROM b JOIN a USING (k) WHERE b.v IS DISTINCT FROM a.v OR b.t IS DISTINCT FROM a.t""")
def reconcile_null_transitions(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    make = lambda m, n: rows.select("k", F.when(F.col("k") % m == 0, None).otherwise(F.lit(0)).alias("v"), F.when(F.col("k") % n == 0, None).otherwise(F.lit("")).alias("t"), F.lit("s").alias("_sheet"))
    return reconcile.changes(make(3, 5), make(4, 7), ["k"], ["v", "t"], "_sheet")


@query(_SNAPSHOTS + """SELECT k0, kind, '{"kind":"' || kind || '","key":{"ID":' || k0 || '},"before":' || CASE WHEN before_sheet IS NULL THEN 'null' ELSE '{"sheet":"' || before_sheet || '","values":{"Amount":' || coalesce('"' || b0 || '"', 'null') || ',"Status":' || coalesce('"' || b1 || '"', 'null') || '}}' END
|| ',"after":' || CASE WHEN after_sheet IS NULL THEN 'null' ELSE '{"sheet":"' || after_sheet || '","values":{"Amount":' || coalesce('"' || a0 || '"', 'null') || ',"Status":' || coalesce('"' || a1 || '"', 'null') || '}}' END
|| ',"changed_columns":[' || CASE WHEN kind <> 'changed' THEN '' ELSE concat_ws(',', CASE WHEN b0 IS DISTINCT FROM a0 THEN '"Amount"' END, CASE WHEN b1 IS DISTINCT FROM a1 THEN '"Status"' END) END || ']}' AS record FROM c""")
def reconcile_records(spark, d):
    made = reconcile.changes(*snapshots(spark, d), ["ID"], ["Amount", "Status"], "_sheet")
    return made.select("k0", "kind", reconcile.record(["ID"], ["Amount", "Status"], made).alias("record"))


# --- joins -------------------------------------------------------------------------------------

_CUSTOMER_ORDERS = "customer {} JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"


def _customer_orders(spark, d, how):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), how)


@query("SELECT c_custkey, o_orderkey FROM " + _CUSTOMER_ORDERS.format("INNER"))
def join_inner(spark, d):
    return _customer_orders(spark, d, "inner").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM " + _CUSTOMER_ORDERS.format("LEFT"))
def join_left(spark, d):
    return _customer_orders(spark, d, "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM customer WHERE c_nationkey < 5) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(spark, d):
    return table(spark, d, "customer").where("c_nationkey < 5").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 7")
def join_full(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey") * 7, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, d):
    return _customer_orders(spark, d, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark, d):
    return _customer_orders(spark, d, "left_anti").select("c_custkey")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_using(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT count(*) AS pairs FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey")
def join_self(spark, d):
    s = table(spark, d, "supplier")
    return s.alias("a").join(s.alias("b"), F.col("a.s_nationkey") == F.col("b.s_nationkey")).agg(F.count("*").alias("pairs"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(spark, d):
    s = table(spark, d, "supplier")
    return s.alias("a").join(s.alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))).select(F.col("a.s_suppkey").alias("low"), F.col("b.s_suppkey").alias("high"))


@query("SELECT band, count(*) AS n FROM (VALUES ('low', 0, 50000), ('mid', 50000, 200000), ('high', 200000, 10000000)) AS b(band, lo, hi) JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1")
def join_range(spark, d):
    bands = spark.createDataFrame([("low", 0, 50000), ("mid", 50000, 200000), ("high", 200000, 10000000)], "band string, lo long, hi long")
    return table(spark, d, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT k, s.total AS sales, c.total AS costs, s.total - c.total AS margin FROM (SELECT l_returnflag AS k, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DECIMAL(37,2)) AS total FROM lineitem GROUP BY 1) s JOIN (SELECT l_returnflag AS k, CAST(sum((l_quantity * 100)::DECIMAL(18,2)) AS DECIMAL(37,2)) AS total FROM lineitem GROUP BY 1) c USING (k)""")
def join_aggregated(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    total = lambda c, name: rows.groupBy("k").agg(F.sum(c.cast(MONEY)).cast("decimal(37,2)").alias(name))
    both = total(F.col("l_extendedprice"), "sales").join(total(F.col("l_quantity") * 100, "costs"), "k")
    return both.withColumn("margin", (F.col("sales") - F.col("costs")).cast("decimal(38,2)"))


@query("SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) x")
def join_lateral(spark, d):
    return relations.sql(spark, {"nation": table(spark, d, "nation"), "supplier": table(spark, d, "supplier")}, "SELECT n_name, x.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) x")


@query("SELECT c.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_join(spark, d):
    events = table(spark, d, "events")
    left = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return relations.asof(left, right, ["user_id"], "ts", ["purchase"]).select("event_id", "purchase")


# --- windows -----------------------------------------------------------------------------------


@query("SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (w2) AS rn FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000) DESC NULLS LAST), w2 AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def window_rank(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last(F.round(F.col("s_acctbal") / 1000)))
    w2 = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.row_number().over(w2).cast("bigint").alias("rn"))


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id", 2).over(w).alias("next2"), F.first("event_id").over(w).alias("first_id"))


@query("SELECT o_orderkey, CAST(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running FROM orders")
def window_running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast(MONEY)).over(w).cast("decimal(38,2)").alias("running"))


@query("SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def window_rows_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(w).alias("n"), F.max("o_totalprice").over(w).alias("most"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM orders")
def window_range_frame(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rangeBetween(-10, 10)
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(w).alias("near"))


@query("SELECT c_custkey, ntile(4) OVER w AS quarter, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def window_ntile(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).cast("bigint").alias("quarter"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify_rewrite(spark, d):
    return relations.first_by(table(spark, d, "orders"), ["o_custkey"], [F.desc_nulls_last("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


# --- sorts, limits, sets -----------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10")
def sort_limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("SELECT p_partkey, p_size FROM part ORDER BY nullif(p_size, 1) NULLS LAST, p_partkey LIMIT 15")
def sort_nulls_last(spark, d):
    return table(spark, d, "part").orderBy(F.asc_nulls_last(F.nullif(F.col("p_size"), F.lit(1))), "p_partkey").limit(15).select("p_partkey", "p_size")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect_all(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersectAll(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(table(spark, d, "customer").select("c_custkey"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# --- scalars -----------------------------------------------------------------------------------


@query("SELECT p_partkey, length(p_name) AS n, upper(p_brand) AS u, substring(p_type, 1, 4) AS s, replace(p_name, ' ', '_') AS r, concat_ws('-', p_brand, p_size) AS c, coalesce(nullif(p_size, 1), -1) AS z, greatest(p_size, 10) AS g FROM part")
def scalar_string(spark, d):
    return table(spark, d, "part").select("p_partkey", F.length("p_name").cast("bigint").alias("n"), F.upper("p_brand").alias("u"), F.substring("p_type", 1, 4).alias("s"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("c"), F.coalesce(F.nullif(F.col("p_size"), F.lit(1)), F.lit(-1)).alias("z"), F.greatest("p_size", F.lit(10)).alias("g"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, date_trunc('month', o_orderdate)::DATE AS t, (o_orderdate::DATE + 30) AS due, datediff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders")
def scalar_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.trunc(day, "month").alias("t"), F.date_add(day, 30).alias("due"), F.datediff(day, F.lit("1990-01-01").cast("date")).alias("days"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS c, CAST(s_acctbal AS DECIMAL(18,1)) AS r, s_suppkey % 7 AS m, sign(s_acctbal)::INTEGER AS s FROM supplier")
def scalar_math(spark, d):
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.abs(x).alias("a"), F.floor(x).alias("f"), F.ceil(x).alias("c"), x.cast("decimal(18,1)").alias("r"), (F.col("s_suppkey") % 7).alias("m"), F.signum(x).cast("int").alias("s"))


@query("SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, list_max(embedding)::DOUBLE AS most, list_contains(embedding, embedding[3]) AS has FROM embeddings")
def scalar_array(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), e[0].cast("double").alias("first"), F.array_max(e).cast("double").alias("most"), F.array_contains(e, e[2]).alias("has"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def scalar_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, nullif(c_nationkey, 3) IS DISTINCT FROM nullif(c_nationkey, 4) AS differs, nullif(c_nationkey, 3) IS NOT DISTINCT FROM 5 AS is_five FROM customer")
def null_safe_compare(spark, d):
    a, b = F.nullif(F.col("c_nationkey"), F.lit(3)), F.nullif(F.col("c_nationkey"), F.lit(4))
    return table(spark, d, "customer").select("c_custkey", (~a.eqNullSafe(b)).alias("differs"), a.eqNullSafe(F.lit(5)).alias("is_five"))


@query("SELECT k, CASE WHEN regexp_full_match(k, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(round(k::DECIMAL(38,10)) AS BIGINT) END AS n FROM (SELECT (o_totalprice::DECIMAL(18,2))::VARCHAR AS k FROM orders)")
def cast_bigint_rounds(spark, d):
    from ..functions import casts

    rows = table(spark, d, "orders").select(F.col("o_totalprice").cast(MONEY).cast("string").alias("k"))
    return rows.select("k", casts.from_text(F.col("k"), casts.parse_type("BIGINT")).alias("n"))


# --- discovery ---------------------------------------------------------------------------------

_BM25 = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l)::DOUBLE / (SELECT count(*) FROM documents) AS avglen),
f AS (SELECT doc_id, w, count(*) AS f FROM t WHERE w IN ('thinged', 'the', 'worthless') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM f GROUP BY 1),
x AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avglen))) AS s FROM f JOIN df USING (w) JOIN l USING (doc_id), s GROUP BY 1)
SELECT doc_id, round(-s, 6) AS score FROM x"""


@query(_BM25)
def bm25_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.bm25(search.ascii_tokens(docs, "doc_id", "text"), docs.count(), "doc_id", ["thinged", "the", "worthless"], shared_dir(spark)).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT page_id AS cell, CASE WHEN page_id // 8 + 1 <= 20 THEN 'header' WHEN page_id % 8 + 1 <= 3 THEN 'label' ELSE 'body' END AS kind, substring(url, 1, 2048) AS text FROM pages""")
def label_classify(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("cell"), F.expr("page_id div 8 + 1").alias("row"), (F.col("page_id") % 8 + 1).alias("col"), F.col("url").alias("value_text"))
    return search.labels(rows).select("cell", "kind", "text")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS row, l_linenumber AS col, 'p' || (l_orderkey // 50 % 3) AS pattern FROM lineitem WHERE l_linenumber <= 3),
g AS (SELECT *, row - row_number() OVER (PARTITION BY col, pattern ORDER BY row) AS grp FROM c)
SELECT col, pattern, min(row) AS first_row, max(row) AS last_row, count(*) AS n FROM g GROUP BY col, pattern, grp""")
def pattern_runs(spark, d):
    cells = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.concat(F.lit("p"), F.expr("cast(l_orderkey div 50 % 3 as string)")).alias("pattern")).distinct()
    return discovery.runs(cells, ["col", "pattern"], "row").select("col", "pattern", "first_row", "last_row", "n")


@query("""WITH c AS (SELECT o_orderkey AS row FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT row, row - row_number() OVER (ORDER BY row) AS grp FROM c) SELECT min(row) AS first_row, max(row) AS last_row FROM g GROUP BY grp""")
def hidden_runs(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("row"))
    return discovery.runs(rows, [], "row").select("first_row", "last_row")


@query("SELECT p_size % 7 AS style, count(*) AS cells FROM part GROUP BY 1")
def style_histogram(spark, d):
    return discovery.style_counts(table(spark, d, "part").select((F.col("p_size") % 7).alias("style")))


@query("SELECT l_linenumber AS sheet, count(*) AS nonempty, count(*) FILTER (WHERE l_tax = 0) AS formulas, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row, min(l_partkey) AS first_col, max(l_partkey) AS last_col FROM lineitem GROUP BY 1")
def range_bounds(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.when(F.col("l_tax") == 0, "=A1").alias("formula"))
    return discovery.bounds(cells)


@query("SELECT w.k AS cell, w.v AS expected, o_orderstatus AS actual FROM (VALUES (1, 'O'), (2, 'F'), (3, 'X'), (888888888, 'O')) w(k, v) LEFT JOIN orders ON o_orderkey = w.k WHERE o_orderstatus IS DISTINCT FROM w.v")
def expected_value_check(spark, d):
    wanted = spark.createDataFrame([(1, "O"), (2, "F"), (3, "X"), (888888888, "O")], "cell bigint, expected string")
    actual = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("actual"))
    return discovery.mismatches(actual, wanted, "cell")


# --- workbooks ---------------------------------------------------------------------------------


def _workbook(spark, d):
    """All customers by nation as a workbook in the shared folder, in columns of two orders: (path, ranges)."""
    folder = tempfile.mkdtemp(prefix="book-", dir=shared_dir(spark))
    path = os.path.join(folder, "book.xlsx")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").cast(MONEY).alias("Balance"), F.col("c_mktsegment").alias("Segment"), "c_nationkey")
    nations = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())
    sheets = {f"Nation{k}": rows.where(F.col("c_nationkey") == k).select(*(["ID", "Balance", "Segment"] if k % 2 else ["Segment", "ID", "Balance"])).coalesce(1).sortWithinPartitions("ID") for k in nations}
    ranges = write_parts(path, sheets)
    for s, own in ranges.items():
        if len(own) > 1:
            raise BudgetError(f"sheet {s!r} has more than {refs.MAX_ROW - 1} rows")
    return path, {s: own[s] for s, own in ranges.items()}


@query("""SELECT c_custkey AS "ID", c_acctbal::DECIMAL(18,2) AS "Balance", c_mktsegment AS "Segment", 'Nation' || c_nationkey::VARCHAR AS _sheet FROM customer""")
def workbook_union(spark, d):
    path, ranges = _workbook(spark, d)
    with Package(path) as package:
        strings = projections.Strings(package)
        schema = {"ID": "BIGINT", "Balance": "DECIMAL(18,2)", "Segment": "VARCHAR"}
        plans = {s: projections.plan(package, strings, s, refs.area(r), schema, list(schema), False) for s, r in ranges.items()}
        return relations.union_sheets({s: projections.frame(spark, package, p) for s, p in plans.items()}, list(schema))


@query("""SELECT 'Nation' || n_nationkey::VARCHAR AS sheet, 3 * count(c_custkey) + 3 AS nonempty, 1 AS first_row, count(c_custkey)::INTEGER + 1 AS last_row FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def workbook_cells(spark, d):
    path, ranges = _workbook(spark, d)
    return discovery.bounds(xlsx.cells(spark, path, [(s, None) for s in ranges])).select("sheet", "nonempty", "first_row", "last_row")


_CUSTOMERS = {"ID": "BIGINT", "Balance": "DECIMAL(18,2)", "Segment": "VARCHAR"}


@query("""SELECT 'Nation' || c_nationkey::VARCHAR AS sheet, c_mktsegment AS "Segment", count(*) AS n, sum(c_acctbal::DECIMAL(18,2)) AS total FROM customer GROUP BY ALL""")
def workbook_sql(spark, d):
    """The second workbook object finds the projections that the first one kept."""
    path, ranges = _workbook(spark, d)
    for _ in range(2):
        with Workbook(path, spark, os.path.dirname(path)) as book:
            book.load_sheets("Customers", ranges, _CUSTOMERS, "sheet")
            out = book.frame('SELECT sheet, "Segment", count(*) AS n, CAST(sum("Balance") AS DECIMAL(38,2)) AS total FROM Customers GROUP BY sheet, "Segment"')
            hits = book.metrics.counts["persistent_table_hits"]
    if hits != len(ranges):
        raise AssertionError(f"{hits} of {len(ranges)} kept projections were found")
    return out


@query("""SELECT CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) THEN -c_custkey ELSE c_custkey END AS "ID",
CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 4) THEN NULL ELSE c_acctbal::DECIMAL(18,2) END AS "Balance", c_mktsegment AS "Segment", 'Nation' || c_nationkey::VARCHAR AS sheet FROM customer""")
def workbook_patch(spark, d):
    path, ranges = _workbook(spark, d)
    made = os.path.join(os.path.dirname(path), "patched.xlsx")
    last = refs.area(ranges["Nation4"]).bottom
    with Workbook(path, spark) as book:
        first = book.read_cells("Nation3", ["A2"])[0]["value"]
        ops = [{"operation": "SET_VALUE", "sheet": "Nation3", "cell": "A2", "value": -first, "expected": first}, {"operation": "SET_VALUE", "sheet": "Nation4", "cell": f"C{last}", "value": None}]
        book.patch_cells(ops, made)
    with Workbook(made, spark, os.path.dirname(path)) as book:
        book.load_sheets("Customers", ranges, _CUSTOMERS, "sheet")
        return book.relation("Customers")


@query("""WITH c AS (SELECT * FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 1) SELECT 'A2' AS cell, '-1' AS expected, c_custkey::VARCHAR AS actual FROM c UNION ALL SELECT 'C2', 'NOTHING', c_mktsegment FROM c UNION ALL SELECT 'Z2', 'x', NULL""")
def workbook_validate(spark, d):
    path, _ = _workbook(spark, d)
    with Workbook(path, spark) as book:
        told = book.validate_range("Nation3", "A1:Z2", {"A1": "ID", "A2": -1, "C2": "NOTHING", "Z2": "x"})["mismatches"]
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([(m["cell"], str(m["expected"]), text(m["actual"])) for m in told], "cell string, expected string, actual string")


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS r, * FROM customer WHERE c_nationkey = 3), t AS (SELECT r * 3 AS pos, 'A' || (r + 1)::VARCHAR AS cell, c_custkey::VARCHAR AS value FROM c UNION ALL SELECT r * 3 + 1, 'C' || (r + 1)::VARCHAR, c_mktsegment FROM c UNION ALL SELECT r * 3 + 2, 'E' || (r + 1)::VARCHAR, NULL FROM c)
SELECT row_number() OVER (ORDER BY pos) AS place, cell, value FROM t""")
def workbook_sparse(spark, d):
    path, ranges = _workbook(spark, d)
    rows = spark.range(2, refs.area(ranges["Nation3"]).bottom + 1).select(F.col("id").alias("row"), F.posexplode(F.array(*map(F.lit, "ACE"))).alias("nth", "letter"))
    wanted = rows.select(((F.col("row") - 2) * 3 + F.col("nth") + 1).alias("place"), F.concat("letter", F.col("row").cast("string")).alias("cell"))
    with Workbook(path, spark) as book:
        return book.lookup_cells("Nation3", wanted).select("place", "cell", F.col("value_text").alias("value"))


def _change(numbered: tuple[str, int]) -> tuple:
    """One line of the exported file, with how many lines are before it."""
    x = json.loads(numbered[0])
    sides = [x[s] or {"sheet": None, "values": {}} for s in ("before", "after")]
    return numbered[1] + 1, x["kind"], x["key"]["ID"], *(s["sheet"] for s in sides), *(s["values"].get("Amount") for s in sides), *(s["values"].get("Status") for s in sides)


@query(_SNAPSHOTS + """SELECT row_number() OVER (ORDER BY k0) AS line, kind, k0 AS "ID", before_sheet, after_sheet, b0::VARCHAR AS before_amount, a0::VARCHAR AS after_amount, b1 AS before_status, a1 AS after_status FROM c""")
def workbook_reconcile(spark, d):
    """Both snapshots of all orders as workbooks, compared; the lines of the exported file in their order."""
    folder = tempfile.mkdtemp(prefix="compared-", dir=shared_dir(spark))
    paths, ranges = [], []
    for name, rows in zip(("before", "after"), snapshots(spark, d)):
        sheets = sorted(r[0] for r in rows.select("_sheet").distinct().collect())
        paths.append(os.path.join(folder, f"{name}.xlsx"))
        ranges.append(write_parts(paths[-1], {s: rows.where(F.col("_sheet") == s).select(*(["ID", "Amount", "Status"] if k % 2 else ["Status", "Amount", "ID"])) for k, s in enumerate(sheets)}, 1_000_000))
    out = os.path.join(folder, "changes.jsonl")
    schema = {"ID": "BIGINT", "Amount": "DECIMAL(18,2)", "Status": "VARCHAR"}
    budget = Budget(max_chars=Budget().max_chars + len(json.dumps(ranges)))  # the answer repeats the ranges
    compare(*paths, before_ranges=ranges[0], after_ranges=ranges[1], schema=schema, keys=["ID"], spark=spark, output=out, cache_dir=folder, budget=budget)
    told = spark.sparkContext.textFile(out).zipWithIndex().map(_change)
    return spark.createDataFrame(told, "line long, kind string, ID long, before_sheet string, after_sheet string, before_amount string, after_amount string, before_status string, after_status string")
