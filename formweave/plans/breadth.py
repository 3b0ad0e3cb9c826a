"""Beyond the blueprint's own operators: join types, grouping sets, windows, approximate counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from formweave.plans.fixtures import table
from formweave.plans.registry import query


@query("b1_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("b2_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube(spark, sf):
    return table(spark, sf, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("b3_running_window", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM events")
def running(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, sf, "events").select("event_id", F.sum("event_id").over(w).alias("s"))


@query("b4_session_windows", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
def sessions(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("b5_revenue_by_region", "SELECT r_name, count(*) AS n, sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def revenue(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("total"))
