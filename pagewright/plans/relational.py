"""Relational and event queries over the accompanying tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.catalog import Tables, query

def revenue_of_line():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c):
    """Sums of doubles depend on their order; cents do not show it."""
    return F.round(c, 2)


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum(revenue_of_line())).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("""
    SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    r = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(money(F.sum(revenue_of_line())).alias("revenue"))
    return r.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
    SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(t: Tables) -> DataFrame:
    places = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))  # 25 rows
    by_customer = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(revenue_of_line()).alias("revenue"))
    c = by_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("r_name", "n_name").agg(money(F.sum("revenue")).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def discount_revenue(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).agg(money(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
    SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def top_orders_by_customer(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def lineitem_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.grouping_id().alias("level"))


@query("SELECT p_brand, p_type, count(*) AS parts, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY ROLLUP (p_brand, p_type)")
def part_rollup(t: Tables) -> DataFrame:
    return t.part.rollup("p_brand", "p_type").agg(F.count("*").alias("parts"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def nations_without_suppliers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).subtract(t.supplier.select("s_nationkey"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS events FROM events GROUP BY ALL")
def event_properties(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("events"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def hourly_events(t: Tables) -> DataFrame:
    from pagewright.streaming.pages import event_windows

    return event_windows(t.events).withColumn("value", F.round("value", 4))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
         s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(t: Tables) -> DataFrame:
    from pagewright.streaming.pages import event_sessions

    return event_sessions(t.events)


@query("""
    SELECT e.event_id, max(p.ts) AS purchase_ts FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id""")
def last_purchase_before_click(t: Tables) -> DataFrame:
    """As-of join by a window over the union: no pair of rows is made."""
    e = t.events.where("event_type in ('click', 'purchase')").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("ts")))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("purchase_ts", F.max("bought").over(w)).where("event_type = 'click' and purchase_ts is not null").select("event_id", "purchase_ts")
