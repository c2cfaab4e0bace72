"""The relational operators that media containers hide in loops, as windows and joins.

Every function works inside groups (keys: file, track, stream), so its shuffle is one exchange
by those keys, and several of them in a row share it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _order(keys: Keys, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def running(rows: DataFrame, keys: Keys, order: str, value: str, out: str = "start") -> DataFrame:
    """The sum of value over all rows before: ticks so far, bytes so far."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def sample_times(samples: DataFrame, keys: Keys, order: str, delta: str, timescale: Column) -> DataFrame:
    """timestamp_us and duration_us (double) from durations in ticks."""
    t = running(samples, keys, order, delta, "_ticks")
    return t.select("*", (F.col("_ticks") / timescale * 1e6).alias("timestamp_us"), (F.col(delta) / timescale * 1e6).alias("duration_us")).drop("_ticks")


def frame_counter(frames: DataFrame, keys: Keys, order: str, base: str, rate: Column, per_frame: int = 1024) -> DataFrame:
    """timestamp_us of the n-th audio frame of its packet: base plus n frames of samples, restarting with each packet."""
    n = F.row_number().over(_order(keys, order)) - 1
    return frames.withColumn("timestamp_us", F.col(base) + n * per_frame * 1e6 / rate)


def durations(rows: DataFrame, keys: Keys, order: str, at: str, last: float = 1e6 / 30) -> DataFrame:
    """duration_us: distance to the next row's time, and a frame of 1/30 second for the last."""
    return rows.withColumn("duration_us", F.coalesce(F.abs(F.lead(at).over(_order(keys, order)) - F.col(at)), F.lit(last)))


def counter_gaps(packets: DataFrame, keys: Keys, order: str, counter: str, modulus: int = 16) -> DataFrame:
    """Packets whose counter does not follow the one before: expected and seen. Gaps warn, they do not fail."""
    expected = (F.lag(counter).over(_order(keys, order)) + 1) % modulus
    return packets.withColumn("expected", expected).where(F.col("expected") != F.col(counter))


def sequence_error(pages: DataFrame, keys: Keys, order: str, seq: str) -> DataFrame:
    """keys and error_code of streams whose sequence does not begin at 0 or does not step by 1."""
    bad = F.col(seq) != F.coalesce(F.lag(seq).over(_order(keys, order)) + 1, F.lit(0))
    return pages.withColumn("_bad", bad).groupBy(*keys).agg(F.when(F.max("_bad"), "SEQUENCE_GAP").alias("error_code"))


def renumbered(rows: DataFrame, keys: Keys, order: str, out: str = "ordinal") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(_order(keys, order)))


def expanded_runs(runs: DataFrame, keys: Keys, order: str, count: str, value: str, out: str = "sample") -> DataFrame:
    """Run lengths to rows: keys, sample (from 1) and value; runs of no rows vanish."""
    r = running(runs, keys, order, count, "_before").where(F.col(count) > 0)
    return r.select(*keys, F.col(value), "_before", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("_i")).select(*keys, (F.col("_before") + F.col("_i")).cast("long").alias(out), value)


def closed_ranges(starts: DataFrame, keys: Keys, start: str, end: Column, out: str = "until") -> DataFrame:
    """Each start lasts to the next start of its group, the last one to end (excluded)."""
    return starts.withColumn(out, F.coalesce(F.lead(start).over(_order(keys, start)), end))


def as_of(rows: DataFrame, starts: DataFrame, keys: Keys, at: str, start: str, values: list[str]) -> DataFrame:
    """rows with the values of the last start at or before their place; null before the first.

    Both sides go into one sorted window instead of a range join, so that a group with many
    starts costs no product.
    """
    typed = {f.name: f.dataType for f in [*rows.schema, *starts.schema]}
    a = rows.select(F.struct(*rows.columns).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(typed[v]).alias(f"_{v}") for v in values])
    b = starts.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_last._{v}").alias(v) for v in values])


def chunk_samples(stsc: DataFrame, stco: DataFrame, keys: Keys) -> DataFrame:
    """keys, chunk, sample (from 1) and chunk_offset from runs (first_chunk, samples_per_chunk) and chunks (chunk, offset)."""
    chunks = as_of(stco, stsc, keys, "chunk", "first_chunk", ["samples_per_chunk"])
    c = running(chunks, keys, "chunk", "samples_per_chunk", "_before").where("samples_per_chunk > 0")
    return c.select(*keys, "chunk", F.col("offset").alias("chunk_offset"), "_before", F.explode(F.sequence(F.lit(1), F.col("samples_per_chunk").cast("int"))).alias("_i")).select(*keys, "chunk", "chunk_offset", (F.col("_before") + F.col("_i")).cast("long").alias("sample"))


def sample_table(stts: DataFrame, stsc: DataFrame, stsz: DataFrame, stco: DataFrame, stss: DataFrame | None, keys: Keys) -> DataFrame:
    """keys, sample, delta, size, offset and is_keyframe, from a track's run-length tables.

    stts (ordinal, count, delta), stsc (first_chunk, samples_per_chunk), stsz (sample, size), stco
    (chunk, offset), stss (sample). Samples beyond the sizes are cut off; a track without any sync
    table has key frames only.
    """
    placed = chunk_samples(stsc, stco, keys).join(stsz, [*keys, "sample"])
    inside = Window.partitionBy(*keys, "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", (F.col("chunk_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).cast("long"))
    out = placed.join(expanded_runs(stts, keys, "ordinal", "count", "delta"), [*keys, "sample"]).select(*keys, "sample", "delta", "size", "offset")
    if stss is None:
        return out.withColumn("is_keyframe", F.lit(True))
    return flagged(out, stss, keys, "sample")


def flagged(rows: DataFrame, marks: DataFrame, keys: Keys, at: str, out: str = "is_keyframe") -> DataFrame:
    """Whether a row's number is marked; groups without marks are marked throughout."""
    some = marks.select(*keys).distinct().withColumn("_some", F.lit(True))
    hit = marks.select(*keys, at).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, [*keys, at], "left").join(some, keys, "left").withColumn(out, F.col("_hit").isNotNull() | F.col("_some").isNull()).drop("_hit", "_some")


def cascade(rows: DataFrame, defaults: list[DataFrame], keys: list[Keys], values: list[str]) -> DataFrame:
    """Values missing in rows from the first default table that has them (run, then fragment, then track)."""
    for i, (d, k) in enumerate(zip(defaults, keys, strict=True)):
        rows = rows.join(d.select(*k, *[F.col(v).alias(f"_{i}_{v}") for v in values]), k, "left")
    names = [f"_{i}_{v}" for i in range(len(defaults)) for v in values]
    return rows.withColumns({v: F.coalesce(v, *[F.col(f"_{i}_{v}") for i in range(len(defaults))]) for v in values}).drop(*names)


def edited(samples: DataFrame, keys: Keys, order: str, delta: str, media_time: Column, length: Column) -> DataFrame:
    """Samples that an edit [media_time, media_time + length) presents, with start shifted and numbers anew."""
    t = running(samples, keys, order, delta, "_t")
    inside = (F.col("_t") + F.col(delta) > media_time) & (F.col("_t") < media_time + length)
    kept = t.where(inside).withColumn("start", F.col("_t") - media_time).drop("_t")
    return renumbered(kept, keys, order, "presented")


def last_wins(rows: DataFrame, keys: Keys, order: str, values: list[str]) -> DataFrame:
    """One row per keys: the last values, the first place and the number of rows."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values], F.min(order).alias("first_at"), F.count("*").alias("n_seen"))


def duplicates(rows: DataFrame, keys: Keys, name: str) -> DataFrame:
    return rows.groupBy(*keys, name).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(ranges: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Ranges that begin before an earlier one of their group has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_before", F.max(end).over(w)).where(F.col("_before") > F.col(start)).drop("_before")


def over_cap(rows: DataFrame, keys: Keys, order: str, value: str, cap: int) -> DataFrame:
    """The first row of each group at which the running total passes cap."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("total", F.sum(value).over(w)).where(F.col("total") > cap)
    return t.withColumn("_n", F.row_number().over(_order(keys, order))).where("_n = 1").drop("_n")


def projected(samples: DataFrame, track: str, wanted: Column) -> DataFrame:
    """A file cut down to one track."""
    return samples.where(F.col(track) == wanted)


def reassembled(parts: DataFrame, keys: Keys, order: str, begins: str, payload: str) -> DataFrame:
    """keys, unit, payload: parts joined in order from each start flag to the next; parts before the first start are dropped."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    p = parts.withColumn("unit", F.sum(F.col(begins).cast("int")).over(w)).where("unit > 0")
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(payload).alias("h"))))
    return p.groupBy(*keys, "unit").agg(F.unhex(F.array_join(F.transform(one, lambda x: x["h"]), "")).alias(payload), F.count("*").alias("n_parts"))


def chained(streams: list[DataFrame]) -> DataFrame:
    """Streams one after the other, each row with the number of its stream."""
    return reduce(DataFrame.unionByName, [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)])
