"""Structured Streaming over arriving files and events: an extension beyond whole-file conversion.

Streams run with what has arrived (``availableNow``) into Parquet with a checkpoint, both in a
folder that driver and executors share, so a restart goes on where the last run ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formloom.session import shared_dir
from formloom.sources.detect import detect_with_hint


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def drained(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Run stream over all that has arrived and read what it wrote."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def arriving_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of path, length, head and ext of the files that arrive in folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "length", F.substring("content", 1, 1024).alias("head"), detect_with_hint(F.col("content"), F.col("path")).alias("ext"))


def arriving_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the table's rows, be it a single file or a folder of part files.

    All that has arrived is one batch: part files come in no order of time, and rows of a later
    batch that lie behind the watermark of an earlier one would be dropped.
    """
    at = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(at).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(at)
    # The source takes folders only: a single file is picked from its own.
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per user and session: its bounds, events and total value; sessions appear once the watermark has passed them."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "total")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by event type."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "event_type", "n")


def assembled(parts: DataFrame, key: str) -> DataFrame:
    """Units put together from parts (key, seq, begins, payload) as they arrive: key, unit and payload.

    The state of a key is its unfinished unit; a unit is given out when the next one begins. Parts
    of a key must arrive in order of seq from one batch to the next, and are sorted within a batch.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, held = state.get if state.exists else (0, None)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.begins:
                if held is not None:
                    out.append((k[0], unit, held))
                unit, held = unit + 1, bytes(r.payload)
            elif held is not None:
                held += bytes(r.payload)
        state.update((unit, held))
        yield pd.DataFrame(out, columns=["key", "unit", "payload"])

    rows = parts.select(F.col(key).alias("key"), "seq", "begins", "payload")
    return rows.groupBy("key").applyInPandasWithState(step, "key long, unit long, payload binary", "unit long, held binary", "append", GroupStateTimeout.NoTimeout)
