"""What the training-data operators share: written intermediate tables, row keys and numbers, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.session import shared_dir, small_batches

#: White space that separates words in the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: This driver's tables lie in a folder of their own, so that jobs that share a folder do not meet.
_JOB = uuid.uuid4().hex
#: Rows of a stretch of consecutive row numbers (see ``numbered``), as a power of two.
STRETCH_BITS = 14
_at: ContextVar[str | None] = ContextVar("formloom_work", default=None)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_at.get() or f'{shared_dir(spark)}/formloom-llm/{_JOB}'}/{tag}-{uuid.uuid4().hex}"


def _reread(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and any executor can reread it."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return _reread(df, path)


def settled(spark: SparkSession, tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a written table; the tables that make writes on its way are deleted."""
    path, work = fresh_path(spark, tag), fresh_path(spark, f"{tag}-work")
    outer = _at.set(work)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _at.reset(outer)
        delete(spark, work)
    return _reread(df, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that this driver wrote in the shared folder; for the end of a job, when its results are read."""
    delete(spark, f"{shared_dir(spark)}/formloom-llm/{_JOB}")


def content_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row, whatever their types, to order rows by content; it never decides that rows are equal."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in df.schema])


def numbered(rows: DataFrame, keys: list[str], rid: str, to: str) -> DataFrame:
    """rows with a gapless number from 0 within keys, in the order of rid.

    rid must be stored and come from monotonically_increasing_id, so that a stretch of
    2 ** ``STRETCH_BITS`` numbers holds no more rows than that: rows are counted by stretch,
    the counts are summed up, and rows are numbered inside their stretch. No key is hot.
    """
    b = rows.withColumn("_stretch", F.shiftright(rid, STRETCH_BITS))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = b.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c")).withColumn("_ahead", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(rid)) - 1
    return b.withColumn("_i", inside).join(ahead, [*keys, "_stretch"]).withColumn(to, (F.col("_ahead") + F.col("_i")).cast("long")).drop("_ahead", "_i", "_stretch")


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's id and text; rows that agree in both are interchangeable."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("~")), F.coalesce(F.md5(text.cast("binary")), F.lit("~"))))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list[bytes]], list[pa.Array]]]) -> DataFrame:
    """Select keep and the columns that make()(texts) gives for each batch.

    make runs once per task; the function it returns takes the batch's texts as UTF-8 bytes
    (null: empty) and gives one Arrow array per field.
    """
    small_batches(df.sparkSession)
    # Columns go under names of their own, so that kept columns of any name do not clash. A text that is kept is moved once.
    own = text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType)
    text = [] if own else [F.col(f"`{text_col}`").cast("string").alias("t")]
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *text)
    n, at = len(keep), keep.index(text_col) if own else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            if b.num_rows:
                texts = [x or b"" for x in b.column(at).cast(pa.large_binary() if pa.types.is_large_string(b.column(at).type) else pa.binary()).to_pylist()]
                made = each(texts)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=[*[f"k{i}" for i in range(n)], *[f"f{i}" for i in range(len(made))]])

    schema = T.StructType([*[T.StructField(f"k{i}", src.schema[i].dataType) for i in range(n)], *[T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)]])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"f{i}").alias(f.name) for i, f in enumerate(fields)])
