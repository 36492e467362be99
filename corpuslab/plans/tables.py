"""Queries over the star schema and the events: the generic relational surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.plans.registry import query
from corpuslab.sources.readers import json_field, table
from corpuslab.streaming import events as stream

def revenue() -> Column:
    """Exact: a sum of doubles would depend on their order."""
    return F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pricing_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.sum(revenue()).cast("double").alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, c_custkey, c_acctbal, CAST(r AS INTEGER) AS rank FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3""")
def nation_topk_customers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rank = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return rows.select("n_name", "c_custkey", "c_acctbal", rank.alias("rank")).where("rank <= 3")


@query("""SELECT r_name, n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY r_name, n_name""")
def regional_revenue(spark: SparkSession, d: str) -> DataFrame:
    dates = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    orders = table(spark, d, "orders").where(dates).select("o_orderkey", "o_custkey")
    # Lines are summed by order before the joins that only add names.
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.sum(revenue()).alias("revenue"))
    rows = lines.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("revenue").cast("double").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


@query("""SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.09 AND l_quantity >= 49)""")
def suppliers_anti(spark: SparkSession, d: str) -> DataFrame:
    steep = table(spark, d, "lineitem").where("l_discount >= 0.09 and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, d, "supplier").join(steep, "s_suppkey", "left_anti").select("s_name", "s_acctbal")


@query("""SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY CUBE (p_brand, p_type)""")
def part_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def order_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.lower()) for c in "FOP"])


@query("""SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.9) AS p90, round(stddev_samp(c_acctbal), 4) AS spread FROM customer GROUP BY c_mktsegment""")
def segment_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.5).alias("median"), F.percentile("c_acctbal", 0.9).alias("p90"), F.round(F.stddev_samp("c_acctbal"), 4).alias("spread"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey EXCEPT SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def customer_set_difference(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return count(orders).subtract(count(orders.where("o_orderstatus = 'F'")))


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_HOURLY)
def events_hourly_window(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query(_HOURLY)
def stream_hourly_window(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream: watermarked windows over the event files, drained."""
    out = stream.drained(stream.hourly(stream.event_stream(spark, d)))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS k, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def events_props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(json_field("props", "k").cast("long")).alias("k"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("interval '6' hour")).cast("long"), F.lit(0))
    rows = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, n, round(n * cost / sum(n * cost) OVER (), 6) AS fraction, round(sum(n * cost) OVER (ORDER BY event_type) / sum(n * cost) OVER (), 6) AS done
 FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 0.003 WHEN 'click' THEN 0.1 ELSE 0.5 END AS cost FROM events GROUP BY event_type)""")
def progress_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Cost-weighted progress over the stages."""
    cost = F.when(F.col("event_type") == "view", 0.003).when(F.col("event_type") == "click", 0.1).otherwise(0.5)
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("work", F.col("n") * cost)
    total = rows.agg(F.sum("work").alias("all_work"))
    rows = rows.join(F.broadcast(total))  # a single row
    upto = F.sum("work").over(Window.orderBy("event_type"))
    return rows.select("event_type", "n", F.round(F.col("work") / F.col("all_work"), 6).alias("fraction"), F.round(upto / F.col("all_work"), 6).alias("done"))
