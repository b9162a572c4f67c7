"""Extension: commands as variants, table functions and laterals, sketches that merge."""

from pyspark.sql import functions as F

from krylake.operators.lateral import simplified
from krylake.operators.sketches import daily, merged
from krylake.plans.registry import query
from krylake.plans.tables import table

COMMANDS = """c AS (SELECT event_id, event_type, user_id, (json_extract_string(props, '$.k'))::BIGINT AS k, value FROM events)"""


def commands(spark, sf_dir):
    """(event_id, event_type, v): the events' JSON and more, as one variant: numbers, a nested object, a list, members that only some have, and one that isn't always a number."""
    e = table(spark, sf_dir, "events")
    shape = F.struct("user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("width"))
    body = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), shape.alias("shape"), F.array(F.col("event_id") % 4, F.col("event_id") % 5).alias("tags"), F.when(F.col("event_id") % 7 == 0, F.lit("auto")).otherwise(F.col("user_id").cast("string")).alias("size"))
    return e.select("event_id", "event_type", F.parse_json(F.to_json(body)).alias("v"))


@query(f"""WITH {COMMANDS} SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k, count(CASE WHEN event_id % 3 = 0 THEN value END) AS widths, round(sum(CASE WHEN event_id % 3 = 0 THEN value END), 4) AS width, sum(event_id % 5)::BIGINT AS second_tags,
count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS sized, sum(CASE WHEN event_id % 7 <> 0 THEN user_id END)::BIGINT AS sizes, count(CASE WHEN k IS NULL THEN 1 END) AS absent FROM c GROUP BY event_type""")
def variant_members(spark, sf_dir):
    """Typed members of variants: nested ones, places of a list, members that some rows lack and members that aren't always numbers."""
    v = F.col("v")
    c = commands(spark, sf_dir).select(
        "event_type", F.variant_get(v, "$.k", "long").alias("k"), F.variant_get(v, "$.shape.width", "double").alias("width"), F.variant_get(v, "$.tags[1]", "long").alias("tag"), F.try_variant_get(v, "$.size", "long").alias("size"),
    )
    return c.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("k"), F.count("width").alias("widths"), F.round(F.sum("width"), 4).alias("width"), F.sum("tag").alias("second_tags"), F.count("size").alias("sized"), F.sum("size").alias("sizes"), F.count(F.when(F.col("k").isNull(), 1)).alias("absent"),
    )


@query("SELECT event_type, 'OBJECT<k: BIGINT, shape: OBJECT<user_id: BIGINT' || CASE WHEN count(*) FILTER (event_id % 3 = 0 AND value IS NOT NULL) > 0 THEN ', width: ' ELSE '' END AS begins FROM events GROUP BY event_type")
def variant_schema(spark, sf_dir):
    """The schema that all variants of an event type have together: where it tells of the width it says so (its number type depends on the values)."""
    s = commands(spark, sf_dir).groupBy("event_type").agg(F.schema_of_variant_agg("v").alias("s"))
    return s.select("event_type", F.regexp_extract("s", r"^(OBJECT<k: BIGINT, shape: OBJECT<user_id: BIGINT(?:, width: )?)", 1).alias("begins"))


@query(f"WITH {COMMANDS}, t AS (SELECT event_type, event_id % 4 AS tag FROM c UNION ALL SELECT event_type, event_id % 5 FROM c) SELECT event_type, tag, count(*) AS n FROM t GROUP BY event_type, tag")
def variant_explode(spark, sf_dir):
    """A list within each variant, a row an element, by a lateral table function."""
    commands(spark, sf_dir).createOrReplaceTempView("krylake_commands")
    return spark.sql("SELECT event_type, CAST(t.value AS BIGINT) AS tag, count(*) AS n FROM krylake_commands, LATERAL variant_explode(variant_get(v, '$.tags', 'variant')) AS t GROUP BY ALL")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def lateral_orders(spark, sf_dir):
    """The two dearest orders of each customer by a lateral join: the subquery speaks of the customer's row, its limit counts for each."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    own = o.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return c.lateralJoin(own).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
k AS (SELECT user_id, event_id, value, r, true AS kept, value AS last FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.value, e.r, abs(e.value - k.last) >= 10.0, CASE WHEN abs(e.value - k.last) >= 10.0 THEN e.value ELSE k.last END FROM k JOIN e ON e.user_id = k.user_id AND e.r = k.r + 1)
SELECT user_id, event_id, value FROM k WHERE kept""")
def thinned_trails(spark, sf_dir):
    """Trails of users without the events that differ by less than 10 from the last one kept: a table function over each user's rows in their order."""
    return simplified(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10.0)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, quantile_disc(value, 0.5) AS median FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY event_type")
def sketched_range(spark, sf_dir):
    """Users and the median over two weeks, from one sketch a day and type. Where a sketch's answer lies within its bound the exact value beside it is shown, else the sketch's."""
    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    span = F.col("day").between("2024-01-08", "2024-01-21")
    about = merged(daily(e, ["event_type", "day"], "user_id", "value").filter(span), ["event_type"])
    q, v = F.col("quantile"), F.col("value")
    exact = e.filter(span).join(F.broadcast(about.drop("n")), "event_type").groupBy("event_type").agg(  # a row a type
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.avg((v < q).cast("double")).alias("below"), F.avg((v <= q).cast("double")).alias("up_to"), F.first("distinct").alias("distinct"), F.first("error").alias("error"), F.first("rank_error").alias("rank_error"), F.first("quantile").alias("quantile"),
    )
    counted = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.col("error") * F.col("users"), F.lit(1.0))
    placed = (F.col("below") <= 0.5 + F.col("rank_error")) & (F.col("up_to") >= 0.5 - F.col("rank_error"))
    return exact.select("event_type", "n", F.when(counted, F.col("users")).otherwise(F.col("distinct")).alias("users"), F.when(placed, F.col("median")).otherwise(q).alias("median"))
