"""Extension: relational queries over the star schema, beyond points, fields and systems."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from krylake.operators.joins import as_of, in_range
from krylake.plans.registry import query
from krylake.plans.tables import table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def orders_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_with_and_without(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    part = lambda how, name: c.join(o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", F.lit(name).alias("kind"))
    return part("left_semi", "with").unionByName(part("left_anti", "without"))


@query("SELECT a.event_id, b.value AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def last_view_before_purchase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bought = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return as_of(bought, e.filter(F.col("event_type") == "view").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


@query("SELECT p_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity >= p_size AND l_quantity < p_size + 5 GROUP BY p_partkey")
def quantity_near_size(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 5.0).alias("hi"))
    return lines.join(parts, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT o_orderkey, o_totalprice AS lo, o_totalprice + 50 AS hi FROM orders WHERE o_orderpriority = '1-URGENT') SELECT r.o_orderkey, count(*) AS n FROM r JOIN orders o ON o.o_totalprice >= r.lo AND o.o_totalprice < r.hi GROUP BY r.o_orderkey")
def similar_prices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ranges = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 50).alias("hi"))
    return in_range(o.select(F.col("o_totalprice").alias("at")), ranges, "at", "lo", "hi", 50.0).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT coalesce(o_orderstatus, '-') AS status, coalesce(o_orderpriority, '-') AS priority, count(*) AS n, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark, sf_dir):
    c = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), (F.grouping("o_orderstatus").cast("long") + 2 * F.grouping("o_orderpriority").cast("long")).alias("level"))
    return c.select(F.coalesce("o_orderstatus", F.lit("-")).alias("status"), F.coalesce("o_orderpriority", F.lit("-")).alias("priority"), "n", "level")


@query("SELECT o_custkey, o_orderkey, rank() OVER w::BIGINT AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def order_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())
    r = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("place"), F.round(F.sum("o_totalprice").over(r), 2).alias("running"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 INTERSECT (SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier)")
def set_operations(spark, sf_dir):
    ids = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("id"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return rich.intersect(ids("orders", "o_custkey").subtract(ids("supplier", "s_suppkey")))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM s GROUP BY user_id, sid")
def user_sessions(spark, sf_dir):
    """Sessions end after twelve quiet hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "12 hours 1 microsecond")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).select("user_id", "first_event", "n")
