"""Rows to canonical line-oriented texts: one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.sinks.subtitle import joined
from formloom.sources.text import FwfColumn, check_fwf

SAFE_ENV = r"^[A-Za-z0-9_./:@,+\-]*$"


def delimited_field(c: Column, delimiter: str = ",") -> Column:
    """Quoted only if it holds the delimiter, a quote, CR or LF."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    odd = F.contains(s, F.lit(delimiter)) | F.contains(s, F.lit('"')) | F.contains(s, F.lit("\r")) | F.contains(s, F.lit("\n"))
    return F.when(odd, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def serialize_delimited(rows: DataFrame, keys: list[str], columns: list[str], order: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """keys and text: CRLF after every row, the last included; a header row first."""
    line = F.array_join(F.array(*[delimited_field(F.col(c), delimiter) for c in columns]), delimiter)
    head = delimiter.join(_quoted(c, delimiter) for c in columns) + "\r\n" if header else ""
    return joined(rows, keys, order, line, "\r\n").select(*keys, F.concat(F.lit(head), F.col("_t"), F.lit("\r\n")).alias("text"))


def _quoted(s: str, delimiter: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(x in s for x in (delimiter, '"', "\r", "\n")) else s


def serialize_jsonl(rows: DataFrame, keys: list[str], value: Column, order: str, trailing_newline: bool = True) -> DataFrame:
    """value is a struct, map or variant column; LF between records."""
    return joined(rows, keys, order, F.to_json(value), "\n").select(*keys, F.concat("_t", F.lit("\n" if trailing_newline else "")).alias("text"))


def fwf_field(c: Column, col: FwfColumn, pad: str) -> Column:
    """Padded to its width; too long a value is an error, as lpad and rpad alone would cut it."""
    s, width = F.coalesce(c.cast("string"), F.lit("")), col.end - col.start
    fill = F.rpad(s, width, pad) if col.align == "left" else F.lpad(s, width, pad)
    return F.when(F.length(s) > width, F.raise_error(F.lit(f"FWF_FIELD_OVERFLOW: {col.name}")).cast("string")).otherwise(fill)


def serialize_fwf(rows: DataFrame, keys: list[str], columns: list[FwfColumn], order: str, pad: str = " ") -> DataFrame:
    """Lines as wide as the last column's end; gaps between columns are padding."""
    check_fwf(columns, pad)
    parts, at = [], 0
    for c in sorted(columns, key=lambda c: c.start):
        parts += [F.lit(pad * (c.start - at)), fwf_field(F.col(c.name), c, pad)]
        at = c.end
    return joined(rows, keys, order, F.concat(*parts), "\n").select(*keys, F.concat("_t", F.lit("\n")).alias("text"))


def serialize_ini(rows: DataFrame, keys: list[str], section: str = "section", key: str = "key", value: str = "value", order: str = "ordinal") -> DataFrame:
    """Sections in the order of their first key, __default__ without a header, a blank line between them."""
    body = joined(rows, [*keys, section], order, F.concat(F.col(key), F.lit("="), F.col(value), F.lit("\n")), "")
    first = rows.groupBy(*keys, section).agg(F.min(order).alias("_o"))
    body = body.join(first, [*keys, section]).withColumn("_o", F.when(F.col(section) == "__default__", F.lit(-1)).otherwise(F.col("_o")))
    line = F.concat(F.when(F.col(section) == "__default__", F.lit("")).otherwise(F.concat(F.lit("["), F.col(section), F.lit("]\n"))), F.col("_t"))
    return joined(body.withColumn("_l", line).drop("_t"), keys, "_o", F.col("_l"), "\n").withColumnRenamed("_t", "text")


def env_field(v: Column) -> Column:
    """Plain if safe, else in double quotes with \\ \" LF and TAB escaped."""
    esc = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    esc = F.replace(F.replace(esc, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(v.rlike(SAFE_ENV), v).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def serialize_env(rows: DataFrame, keys: list[str], key: str = "key", value: str = "value", order: str = "ordinal") -> DataFrame:
    line = F.concat(F.col(key), F.lit("="), env_field(F.coalesce(value, F.lit(""))), F.lit("\n"))
    return joined(rows, keys, order, line, "").withColumnRenamed("_t", "text")
