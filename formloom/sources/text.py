"""Line-oriented text formats to rows, in column expressions.

Each parser takes files as rows (key columns and a text column). mode is ``strict`` (a bad file
fails the query) or ``quarantine`` (a bad file is one row with its error_code). Orders inside a
file are always explicit: line_no counts from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.errors import require
from formloom.functions.timecode import trimmed

#: Caps on a text file.
MAX_BYTES, MAX_RECORD, MAX_LINES = 10_485_760, 1_048_576, 1_000_000
NEWLINE = r"\r\n|\r|\n"


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\ufeff", "")


def input_error(content: Column, kind: str) -> Column:
    """Why a binary input is no text of its kind: too large, or not UTF-8; null if it is."""
    return F.when(F.octet_length(content) > MAX_BYTES, f"{kind}_INPUT_TOO_LARGE").when(~F.is_valid_utf8(content.cast("string")), f"{kind}_INVALID_UTF8")


def decoded(content: Column) -> Column:
    """Text of valid UTF-8 without its byte order mark; null otherwise."""
    return without_bom(F.try_validate_utf8(content.cast("string")))


def _guard(value: Column, bad: Column, code: str, mode: str, kind: str = "string") -> Column:
    return F.when(bad, F.raise_error(F.lit(code)).cast(kind)).otherwise(value) if mode == "strict" else value


def lines(df: DataFrame, keys: list[str], text: str = "text", sep: str = NEWLINE) -> DataFrame:
    """keys, line_no and line; an ending newline gives a last, empty line."""
    return df.select(*keys, F.posexplode(F.split(without_bom(F.col(text)), sep, -1)).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside string literals."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    marks = F.transform(F.filter(F.split(bare, ""), lambda c: F.length(c) > 0), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(marks, zero, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["top"], s["now"] + d).alias("top")), lambda s: s["top"])


def parse_json(df: DataFrame, keys: list[str], text: str = "text", max_depth: int = 256, mode: str = "strict") -> DataFrame:
    """keys, value (variant) and error_code of one document per row."""
    t = without_bom(F.col(text))
    value = F.try_parse_json(t)
    code = F.when(json_depth(t) > max_depth, "JSON_TOO_DEEP").when(value.isNull(), "JSON_PARSE_ERROR")
    out = df.select(*keys, F.when(code.isNull(), value).alias("value"), code.alias("error_code"))
    if mode == "strict":
        out = out.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.raise_error(F.col("error_code")).cast("string")))
    return out


def parse_jsonl(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """keys, line_no, value (variant) and error_code; blank lines are numbered but give no record; only LF and CRLF end lines."""
    rows = lines(df, keys, text, r"\r\n|\n").where(F.length(trimmed(F.col("line"))) > 0)
    value = F.try_parse_json("line")
    code = F.when(F.octet_length("line") > MAX_RECORD, "JSONL_RECORD_TOO_LONG").when(value.isNull(), F.concat(F.lit("JSONL_RECORD_PARSE_ERROR:"), F.col("line_no").cast("string")))
    out = rows.select(*keys, "line_no", value.alias("value"), code.alias("error_code"))
    if mode == "strict":
        out = out.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.raise_error(F.col("error_code")).cast("string")))
    return out


class FwfColumn:
    """name, start (included), end (excluded) and the side that values lean to."""

    def __init__(self, name: str, start: int, end: int, align: str = "left"):
        self.name, self.start, self.end, self.align = name, start, end, align


def check_fwf(columns: list[FwfColumn], pad: str = " ") -> None:
    """Refuse a layout with bad names, bounds or overlaps; columns may come in any order."""
    require(columns, "FWF_NO_COLUMNS")
    require(len(pad) == 1, "FWF_PAD_CHAR")
    require(len({c.name for c in columns}) == len(columns), "FWF_DUPLICATE_COLUMN")
    for c in columns:
        require(c.name and 0 <= c.start < c.end and c.align in ("left", "right"), "FWF_INVALID_COLUMN", c.name)
    order = sorted(columns, key=lambda c: c.start)
    for a, b in zip(order, order[1:], strict=False):
        require(a.end <= b.start, "FWF_OVERLAP", f"{a.name}, {b.name}")


def parse_fwf(df: DataFrame, keys: list[str], columns: list[FwfColumn], text: str = "text", pad: str = " ") -> DataFrame:
    """keys, line_no and a string per column: short lines are filled up, long ones cut, blank ones passed over."""
    check_fwf(columns, pad)
    rows = lines(df, keys, text).where(F.length("line") > 0)
    cut = "\\" + pad if not pad.isalnum() else pad

    def value(c: FwfColumn) -> Column:
        raw = F.coalesce(F.substring("line", c.start + 1, c.end - c.start), F.lit(""))
        # Values lean to one side; padding stands on the other.
        return F.regexp_replace(raw, f"{cut}+$" if c.align == "left" else f"^{cut}+", "").alias(c.name)

    return rows.select(*keys, "line_no", *[value(c) for c in columns])


def parse_ini(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """keys, section, key, value, ordinal (place of the key's first line), n_seen (over 1: duplicates, the last holds) and error_code."""
    rows = lines(df, keys, text).withColumn("t", trimmed(F.col("line"))).where("length(t) > 0 AND NOT t RLIKE '^[;#]'")
    head = F.regexp_extract("t", r"^\[(.+)\]$", 1)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.length(head) > 0, trimmed(head)), ignorenulls=True).over(w), F.lit("__default__"))).where(F.length(head) == 0)
    pair = r"(?s)^([^=:]*)[=:](.*)$"
    code = F.when(~F.col("t").rlike("[=:]"), "INI_SYNTAX_ERROR").when(F.length(trimmed(F.regexp_extract("t", pair, 1))) == 0, "INI_EMPTY_KEY")
    rows = rows.select(*keys, "section", trimmed(F.regexp_extract("t", pair, 1)).alias("key"), trimmed(F.regexp_extract("t", pair, 2)).alias("value"), "line_no", code.alias("code"))
    return _last_wins(rows, keys, ["section", "key"], mode)


def _last_wins(rows: DataFrame, keys: list[str], name: list[str], mode: str) -> DataFrame:
    """One row per name with its last value; files with an error give it once."""
    if mode == "strict":
        rows = rows.withColumn("value", F.when(F.col("code").isNotNull(), F.raise_error(F.col("code")).cast("string")).otherwise(F.col("value")))
        good, bad = rows, None
    else:
        rows = rows.withColumn("file_code", F.first("code", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        good, bad = rows.where("file_code IS NULL"), rows.where("file_code IS NOT NULL").select(*keys, "file_code").distinct()
    out = good.groupBy(*keys, *name).agg(F.max_by("value", "line_no").alias("value"), F.min("line_no").alias("ordinal"), F.count("*").alias("n_seen")).withColumn("error_code", F.lit(None).cast("string"))
    if bad is not None:
        none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in [*name, "value", "ordinal", "n_seen"]]
        out = out.unionByName(bad.select(*keys, *none, F.col("file_code").alias("error_code")))
    return out


def env_value(rest: Column) -> Column:
    """struct(value, code) of what follows a key's equals sign."""
    r = F.regexp_replace(rest, "^[ \t]+", "")
    # Loops over groups are possessive: others recurse, and a long value would overflow the stack.
    single, double = r"(?s)^'([^']*)'\s*(#.*)?$", r'(?s)^"((?:[^"\\]|\\.)*+)"\s*(#.*)?$'
    body = F.regexp_extract(r, double, 1)
    bad_escape = F.regexp_replace(body, r'\\[nt\\"]', "").rlike(r"\\")
    mark = F.lit("\x00")
    plain = F.replace(body, F.lit("\\\\"), mark)
    plain = F.replace(F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    value = F.when(r.startswith("'"), F.regexp_extract(r, single, 1)).when(r.startswith('"'), F.replace(plain, mark, F.lit("\\"))).otherwise(F.regexp_replace(F.regexp_replace(r, "(?s)#.*$", ""), r"\s+$", ""))
    code = F.when(r.startswith("'") & ~r.rlike(single), "ENV_SYNTAX_ERROR").when(r.startswith('"') & ~r.rlike(double), "ENV_SYNTAX_ERROR").when(r.startswith('"') & bad_escape, "ENV_BAD_ESCAPE")
    return F.struct(value.alias("value"), code.alias("code"))


def parse_env(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """keys, key, value, ordinal, n_seen and error_code; the first place and the last value of a key hold."""
    rows = lines(df, keys, text).withColumn("t", F.regexp_replace("line", r"^\s+", "")).where("length(t) > 0 AND NOT t RLIKE '^#'")
    rows = rows.withColumn("t", F.regexp_replace("t", r"^export \s*", ""))
    p = r"(?s)^([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
    v = env_value(F.regexp_extract("t", p, 2))
    rows = rows.select(*keys, F.regexp_extract("t", p, 1).alias("key"), v["value"].alias("value"), "line_no", F.when(~F.col("t").rlike(p), "ENV_SYNTAX_ERROR").otherwise(v["code"]).alias("code"))
    return _last_wins(rows, keys, ["key"], mode)
