"""Queries over lineitem as sample tables: a track is an order, a sample a line."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.operators import timeline as op
from formloom.registry import query, table

K = ["track"]


def _samples(spark, sf_dir):
    """Line numbers repeat in these tables, so samples are numbered anew."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.row_number().over(w).alias("sample"), F.col("l_quantity").cast("long").alias("delta"), F.col("l_partkey").alias("size"), (F.col("l_returnflag") == "R").alias("sync"))


_S = "s AS (SELECT l_orderkey AS track, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))::INT AS sample, l_quantity::BIGINT AS delta, l_partkey AS size, l_returnflag = 'R' AS sync FROM lineitem)"
_W = "OVER (PARTITION BY track ORDER BY sample"
_BEFORE = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("media_sample_times", f"WITH {_S} SELECT track, sample, coalesce(sum(delta) {_BEFORE}, 0) / 90000::DOUBLE * 1e6 AS timestamp_us, delta / 90000::DOUBLE * 1e6 AS duration_us FROM s")
def media_sample_times(spark, sf_dir):
    return op.sample_times(_samples(spark, sf_dir), K, "sample", "delta", F.lit(90000)).select("track", "sample", "timestamp_us", "duration_us")


@query("media_frame_counter", f"WITH {_S} SELECT track, sample, track + (row_number() {_W}) - 1) * 1024 * 1e6::DOUBLE / 48000 AS timestamp_us FROM s")
def media_frame_counter(spark, sf_dir):
    return op.frame_counter(_samples(spark, sf_dir), K, "sample", "track", F.lit(48000)).select("track", "sample", "timestamp_us")


@query("media_durations", f"WITH {_S} SELECT track, sample, coalesce(abs(lead(size) {_W}) - size), 1e6::DOUBLE / 30)::DOUBLE AS duration_us FROM s")
def media_durations(spark, sf_dir):
    return op.durations(_samples(spark, sf_dir), K, "sample", "size").select("track", "sample", "duration_us")


@query("media_counter_gaps", f"WITH {_S}, e AS (SELECT track, sample, size % 16 AS cc, (lag(size % 16) {_W}) + 1) % 16 AS expected FROM s) SELECT * FROM e WHERE cc <> expected")
def media_counter_gaps(spark, sf_dir):
    return op.counter_gaps(_samples(spark, sf_dir).select("track", "sample", (F.col("size") % 16).alias("cc")), K, "sample", "cc")


@query("media_sequence_errors", f"WITH {_S}, q AS (SELECT track, sample, sample - 1 + (delta = 7)::INT AS seq FROM s), b AS (SELECT track, seq <> coalesce((lag(seq) {_W})) + 1, 0) AS bad FROM q) SELECT track, CASE WHEN bool_or(bad) THEN 'SEQUENCE_GAP' END AS error_code FROM b GROUP BY track")
def media_sequence_errors(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("seq", F.col("sample") - 1 + (F.col("delta") == 7).cast("int"))
    return op.sequence_error(s, K, "sample", "seq")


@query("media_run_expansion", f"WITH {_S} SELECT track, row_number() OVER (PARTITION BY track ORDER BY sample, i) AS sample, size AS delta FROM (SELECT track, sample, size, unnest(range(delta % 5)) AS i FROM s)")
def media_run_expansion(spark, sf_dir):
    s = _samples(spark, sf_dir).select("track", "sample", (F.col("delta") % 5).alias("count"), F.col("size").alias("delta"))
    return op.expanded_runs(s, K, "sample", "count", "delta")


@query("media_as_of_runs", f"WITH {_S} SELECT a.track, a.sample AS chunk, (SELECT max_by(b.size, b.sample) FROM s b WHERE b.track = a.track AND b.sync AND b.sample <= a.sample) AS size FROM s a")
def media_as_of_runs(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return op.as_of(s.select("track", F.col("sample").alias("chunk")), s.where("sync"), K, "chunk", "sample", ["size"])


@query("media_closed_ranges", f"WITH {_S} SELECT track, sample, coalesce(lead(sample) {_W}), 99) AS until FROM s WHERE sync")
def media_closed_ranges(spark, sf_dir):
    return op.closed_ranges(_samples(spark, sf_dir).where("sync").select("track", "sample"), K, "sample", F.lit(99))


@query("media_sample_table", f"""WITH {_S}, c AS (SELECT track, sample AS chunk, size AS off, 1 + sample // 2 AS spc FROM s),
x AS (SELECT track, chunk, off, i, row_number() OVER (PARTITION BY track ORDER BY chunk, i) AS sample FROM (SELECT track, chunk, off, unnest(range(CASE WHEN chunk < 3 THEN 1 ELSE 2 END)) AS i FROM c)),
z AS (SELECT x.*, s.size, s.sync FROM x JOIN s ON s.track = x.track AND s.sample = x.sample)
SELECT z.track, z.sample, 10 AS delta, size, (off + coalesce(sum(size) OVER (PARTITION BY z.track, chunk ORDER BY z.sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
sync OR NOT any_sync AS is_keyframe FROM z JOIN (SELECT track, bool_or(sync) AS any_sync FROM s GROUP BY track) m ON m.track = z.track""")
def media_sample_table(spark, sf_dir):
    s = _samples(spark, sf_dir)
    stts = s.groupBy("track").agg(F.lit(1).alias("ordinal"), F.count("*").alias("count"), F.lit(10).alias("delta"))
    first = s.select("track").distinct()
    stsc = first.select("track", F.lit(1).alias("first_chunk"), F.lit(1).alias("samples_per_chunk")).unionByName(first.select("track", F.lit(3).alias("first_chunk"), F.lit(2).alias("samples_per_chunk")))
    stco = s.select("track", F.col("sample").alias("chunk"), F.col("size").alias("offset"))
    stsz = s.select("track", F.col("sample").cast("long").alias("sample"), "size")
    return op.sample_table(stts, stsc, stsz, stco, s.where("sync").select("track", F.col("sample").cast("long").alias("sample")), K)


@query("media_keyframes", f"WITH {_S} SELECT track, sample, sync OR NOT bool_or(sync) OVER (PARTITION BY track) AS is_keyframe FROM s")
def media_keyframes(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return op.flagged(s.select("track", "sample"), s.where("sync").select("track", "sample"), K, "sample")


@query("media_default_cascade", f"WITH {_S} SELECT s.track, sample, coalesce(CASE WHEN sample % 2 = 0 THEN delta END, CASE WHEN s.track % 3 = 0 THEN o_custkey END, 7)::BIGINT AS delta FROM s JOIN orders ON o_orderkey = s.track")
def media_default_cascade(spark, sf_dir):
    s = _samples(spark, sf_dir).select("track", "sample", F.when(F.col("sample") % 2 == 0, F.col("delta")).alias("delta"), F.lit(1).alias("file"))
    traf = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("delta"))
    trex = spark.createDataFrame([(1, 7)], "file int, delta long")
    return op.cascade(s, [traf, trex], [K, ["file"]], ["delta"]).select("track", "sample", "delta")


@query("media_edit_list", f"WITH {_S}, t AS (SELECT *, coalesce(sum(delta) {_BEFORE}, 0) AS t FROM s) SELECT track, sample, (t - 20)::BIGINT AS start, row_number() {_W})::INT AS presented FROM t WHERE t + delta > 20 AND t < 80")
def media_edit_list(spark, sf_dir):
    return op.edited(_samples(spark, sf_dir), K, "sample", "delta", F.lit(20), F.lit(60)).select("track", "sample", "start", "presented")


@query("media_last_wins", f"WITH {_S} SELECT track, sync, max_by(size, sample) AS size, min(sample) AS first_at, count(*) AS n_seen FROM s GROUP BY 1, 2")
def media_last_wins(spark, sf_dir):
    return op.last_wins(_samples(spark, sf_dir), ["track", "sync"], "sample", ["size"])


@query("media_duplicates", f"WITH {_S} SELECT track, delta, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def media_duplicates(spark, sf_dir):
    return op.duplicates(_samples(spark, sf_dir), K, "delta")


@query("media_overlaps", f"""WITH {_S}, r AS (SELECT track, delta AS a, delta + sample AS b FROM s), m AS (SELECT *, max(b) OVER (PARTITION BY track ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
SELECT track, a, b FROM m WHERE m > a""")
def media_overlaps(spark, sf_dir):
    return op.overlaps(_samples(spark, sf_dir).select("track", F.col("delta").alias("a"), (F.col("delta") + F.col("sample")).alias("b")), K, "a", "b")


@query("media_over_cap", f"WITH {_S}, t AS (SELECT track, sample, size, sum(size) {_W}) AS total FROM s) SELECT track, min(sample) AS sample, min_by(size, sample) AS size, min(total)::BIGINT AS total FROM t WHERE total > 400 GROUP BY track")
def media_over_cap(spark, sf_dir):
    return op.over_cap(_samples(spark, sf_dir).select("track", "sample", "size"), K, "sample", "size", 400)


@query("media_one_track", f"WITH {_S} SELECT track, sample FROM s WHERE track = (SELECT min(track) FROM s)")
def media_one_track(spark, sf_dir):
    s = _samples(spark, sf_dir)
    first = s.agg(F.min("track").alias("t"))
    return s.join(F.broadcast(first), F.col("track") == F.col("t")).select("track", "sample")


@query("media_reassembly", f"""WITH {_S}, u AS (SELECT *, sum((sample % 3 = 1)::INT) {_W}) AS unit FROM s)
SELECT track, unit::BIGINT AS unit, string_agg(size::VARCHAR, '' ORDER BY sample) AS payload, count(*) AS n_parts FROM u GROUP BY 1, 2""")
def media_reassembly(spark, sf_dir):
    s = _samples(spark, sf_dir).select("track", "sample", (F.col("sample") % 3 == 1).alias("begins"), F.col("size").cast("string").cast("binary").alias("payload"))
    return op.reassembled(s, K, "sample", "begins", "payload").withColumn("payload", F.col("payload").cast("string"))


@query("media_chained_streams", f"WITH {_S} SELECT 0 AS stream, track, sample FROM s WHERE sync UNION ALL SELECT 1, track, sample FROM s WHERE NOT sync")
def media_chained_streams(spark, sf_dir):
    s = _samples(spark, sf_dir).select("track", "sample", "sync")
    return op.chained([s.where("sync").drop("sync"), s.where("NOT sync").drop("sync")])
