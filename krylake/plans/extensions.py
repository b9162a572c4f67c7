"""Extension: what the star schema's queries use beyond joins and windows: quantiles, pivots, laterals, strings, dates, formats, SQL text and UDFs."""

import pandas as pd
from pyspark.sql import functions as F

from krylake.plans.registry import query
from krylake.plans.tables import table, written


@query("SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def price_quantiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"))
    return o.agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("high"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def approximate_parts(spark, sf_dir):
    """A sketch of how many parts are ordered: where it lies within a tenth of the number that is shown, else the sketch."""
    both = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("about"))
    return both.select("flag", F.when(F.abs(F.col("about") - F.col("parts")) <= 0.1 * F.col("parts"), F.col("parts")).otherwise(F.col("about")).alias("parts"))


@query("SELECT l_linenumber, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS a, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 2) AS n, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 2) AS r FROM lineitem GROUP BY l_linenumber")
def quantity_by_flag(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("l_linenumber", *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c.lower()) for c in "ANR"])


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def dearest_orders(spark, sf_dir):
    """The two dearest orders of each customer, as SQL text over views; the group limit drops the others before the shuffle."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("krylake_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("krylake_customer")
    return spark.sql("SELECT c_custkey, o_orderkey, o_totalprice FROM krylake_customer JOIN (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM krylake_orders) ON o_custkey = c_custkey AND r <= 2")


@query("SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, min(o_orderdate::DATE)::VARCHAR AS first_day, date_diff('day', min(o_orderdate), max(o_orderdate))::INTEGER AS days FROM orders GROUP BY 1, 2")
def orders_by_month(spark, sf_dir):
    d = F.col("o_orderdate")
    g = table(spark, sf_dir, "orders").groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
    return g.agg(F.count("*").alias("n"), F.min(d.cast("date")).cast("string").alias("first_day"), F.date_diff(F.max(d), F.min(d)).alias("days"))


@query("SELECT upper(split_part(p_type, ' ', 1)) AS kind, count(*) AS n, sum(length(p_name))::BIGINT AS signs, sum(CASE WHEN regexp_matches(p_name, '[aeiou]{2}') THEN 1 ELSE 0 END)::BIGINT AS vowels, min(replace(p_brand, 'Brand', 'B')) AS brand FROM part GROUP BY 1")
def part_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.upper(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("signs"), F.sum(F.when(F.col("p_name").rlike("[aeiou]{2}"), 1).otherwise(0)).alias("vowels"), F.min(F.replace("p_brand", F.lit("Brand"), F.lit("B"))).alias("brand"))


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def formats_round_trip(spark, sf_dir):
    """A table through CSV, JSON and ORC in the shared folder and back."""
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    for form, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
        d = written(d, form, **options)
    return d


@query("SELECT p_partkey, nfc_normalize(p_name || 'e' || chr(769)) AS name FROM part")
def vectorised_udf(spark, sf_dir):
    """A function that Spark lacks (composed forms of letters and accents), over whole columns in Arrow batches, registered for SQL text too."""

    @F.pandas_udf("string")
    def composed(v: pd.Series) -> pd.Series:
        return v.str.normalize("NFC")

    spark.udf.register("krylake_composed", composed)
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "krylake_composed(concat(p_name, 'e\u0301')) AS name")
