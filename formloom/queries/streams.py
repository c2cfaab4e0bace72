"""Streams drained over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.registry import query, table
from formloom.streaming import arrivals


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, epoch_us(min(ts)) AS began_us, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 40 MINUTE <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark, sf_dir):
    out = arrivals.drained(arrivals.sessions(arrivals.arriving_table(spark, sf_dir, "events")))
    return out.select("user_id", F.unix_micros("began").alias("began_us"), "n", "total")


@query("stream_hours", """SELECT epoch_us(date_trunc('hour', ts)) AS began_us, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING date_trunc('hour', min(ts)) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)""")
def stream_hours(spark, sf_dir):
    out = arrivals.drained(arrivals.windows(arrivals.arriving_table(spark, sf_dir, "events")))
    return out.select(F.unix_micros("began").alias("began_us"), "event_type", "n")


@query("stream_reassembly", """WITH u AS (SELECT user_id, event_id, props, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS unit FROM events),
g AS (SELECT user_id AS key, unit, string_agg(props, '' ORDER BY event_id) AS payload, max(unit) OVER (PARTITION BY user_id) AS last FROM u GROUP BY user_id, unit)
SELECT key, unit::BIGINT AS unit, payload FROM g WHERE unit > 0 AND unit < last""")
def stream_reassembly(spark, sf_dir):
    e = arrivals.arriving_table(spark, sf_dir, "events")
    parts = e.select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("begins"), F.col("props").cast("binary").alias("payload"))
    return arrivals.drained(arrivals.assembled(parts, "user_id")).withColumn("payload", F.col("payload").cast("string"))


@query("batch_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, sum(new)::BIGINT AS n_sessions FROM e GROUP BY user_id""")
def batch_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    new = F.when(F.col("ts") < before + F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    return e.withColumn("new", new).groupBy("user_id").agg(F.sum("new").alias("n_sessions"))
