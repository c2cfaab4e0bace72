r"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in order of code points (null last) weigh 1, 2, 3, repeating. Together they
get as many words as all documents have; no source gets more than ``CAP`` (3) times its own
size, and what is above is reshared by weight. That fixed point is found in closed form: in
the order of cap / weight the capped sources come first, and the first that its share does
not fill fixes the level for all after it.

Curriculum: each source has a schedule, a piecewise-linear weight over training time 0 to 1
whose integral, scaled to the source's target, is its cumulative demand. A source's documents
stand in the order of an MD5 of their ids, pass after pass (``CAP`` passes), and cover its
demand like a tape. Inverting the cumulative demand at the middle of each occurrence gives its
training position; beyond time 1 the schedule goes on with its last weight. The occurrences
that lie before time 1 are taken, and the mix is these, range-sorted by position.

The tape needs a running sum over each source, and one source may hold a third of all rows.
All rows are therefore range-partitioned by (source, MD5, size, content, row number), the
totals of the partitions are summed up, and rows are summed inside their partition; the row
number makes the key unique, so neither a source nor a repeated or null id is hot. Windows
over a whole table run only over the sources and over the totals of the partitions.

Defined results: null or empty texts have size 0 and are taken 0 words; a null source is a
source of its own, last in order; repeated rows count and stand each for itself, those that
differ in any column in the order of a hash of all columns; an empty table gives an empty one;
reruns and other partitionings agree, as rows stand in the order of their contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import content_hash, n_words, written

CAP = 3
CYCLE = 3
#: Rows of a partition of the tape, on average at most.
PART_ROWS = 250_000
#: Schedules by weight: knots (time, relative weight). Light sources fade, heavy ones grow.
SCHEDULES = {1: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target and begins (words of the sources before it) from sizes (source, size per row); one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("begins", F.coalesce(F.sum("source_size").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1)
    s = s.withColumn("ratio", F.expr(f"{CAP} * cast(source_size AS double) / weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    exact = "decimal(38,0)"
    s = s.withColumn("cap", F.expr(f"cast({CAP} * source_size AS {exact})"))
    s = s.withColumn("rest", F.sum("source_size").over(Window.partitionBy()).cast(exact) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(exact)))
    s = s.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.expr("cap * weights <= weight * rest"))
    level = F.struct("rest", "weights")
    s = s.withColumn("level", F.first(F.when(~F.col("capped"), level), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "weight", "begins", F.expr("CASE WHEN capped THEN cast(cap AS double) ELSE cast(weight * level.rest AS double) / cast(level.weights AS double) END").alias("target"))


def segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(t0, t1, w0, w1, c0, c1) of each piece: times, weights and the normalised cumulative demand at both ends."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, out, c = sum(area), [], 0.0
    for (a, b), part in zip(zip(knots, knots[1:], strict=False), area, strict=True):
        out.append((a[0], b[0], a[1] / total, b[1] / total, c, c + part / total))
        c += part / total
    return out


def position(x: F.Column, weight: F.Column) -> F.Column:
    """Training time at which a source of that weight has used the share x of its demand; over 1 where x is."""
    out = F.lit(None).cast("double")
    for w, knots in SCHEDULES.items():
        # A schedule's last weight goes on beyond its end.
        own = F.lit(float(knots[-1][0])) + (x - 1) / F.lit(segments(knots)[-1][3])
        for t0, t1, w0, w1, c0, c1 in reversed(segments(knots)):
            slope = (w1 - w0) / (t1 - t0)
            rest = x - F.lit(c0)
            # w0 * dt + slope / 2 * dt^2 = rest; this form of the root holds for slope 0 too.
            dt = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest)))
            own = F.when(x < c1, F.lit(t0) + F.least(F.lit(t1 - t0), dt)).otherwise(own)
        out = F.when(weight == w, own).otherwise(out)
    return out


def _rows(docs: DataFrame, keep: list[F.Column]) -> DataFrame:
    """keep, size and the order of rows within their source: h, a hash of the id, th, one of all columns, and the row's number."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(*keep, n_words(F.col("text")).alias("size"), h.alias("h"), content_hash(docs).alias("th"), F.monotonically_increasing_id().alias("rid"))


def _tape(rows: DataFrame) -> DataFrame:
    """rows (written; source, size, h, th, rid, ...) with their source's figures, and the positions of their passes (``at``)."""
    per_source = written(targets(rows), "sources")
    order = [F.col("source").asc_nulls_last(), "h", "size", "th", "rid"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS + 1)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "tape")
    ahead = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.sum("size").alias("in_part")).select("part", ahead.alias("offset"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, "part")
    t = t.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    t = t.withColumn("start", F.col("offset") + F.col("inside") - F.col("begins"))
    middle = lambda p: position((F.col("start") + F.col("size") / 2 + p * F.col("source_size")) / F.col("target"), F.col("weight"))
    return t.withColumn("at", F.transform(F.sequence(F.lit(0), F.lit(CAP - 1)), middle)).drop("_s", "part", "offset", "inside", "begins", "weight", "start")


def _taken() -> F.Column:
    """The positions, of those in ``at``, that lie before the end of training."""
    return F.when(F.col("size") > 0, F.filter("at", lambda t: t < 1)).otherwise(F.array().cast("array<double>"))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and first_position (null where there are no copies), range-sorted by the position of the first pass."""
    t = _tape(written(_rows(docs, [F.col("doc_id"), F.col("source")]), "mix")).withColumn("_in", _taken())
    order = [F.col("at")[0], "h", "size", "th", "rid"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("copies", F.size("_in"))
    first = F.when(F.col("copies") > 0, F.round(F.col("_in")[0], 6))
    return t.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", first.alias("first_position"))


def mixed(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: docs' columns, one row for each time a document is taken, range-sorted by training position.

    Rows are written once with a number; positions are decided on narrow rows, and each text then
    moves to its number's decisions and on to its place.
    """
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = [F.col(f"`{c}`").alias(v) for c, v in aside.items()]
    rows = written(_rows(docs, own), "numbered")
    t = _tape(rows.select(F.col(aside["source"]).alias("source"), "size", "h", "th", "rid"))
    t = t.select("rid", _taken().alias("_at")).where(F.size("_at") > 0)
    out = rows.select(*aside.values(), "rid", "h", "th").join(t, "rid").withColumn("_at", F.explode("_at"))
    order = ["_at", "h", "th", "rid"]
    out = (out.repartitionByRange(shards, *order) if shards else out.repartitionByRange(*order)).sortWithinPartitions(*order)
    return out.select(*[F.col(v).alias(c) for c, v in aside.items()])
