"""One entry for all formats: rows of files of a named format."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formloom.errors import FormatError
from formloom.sources import delimited, files, subtitle, text


def parse(df: DataFrame, fmt: str, keys: list[str], column: str = "text", mode: str = "strict", **options) -> DataFrame:
    """Rows of the files in column; fwf needs columns=[FwfColumn, ...]. The format is always named: texts are not told apart by their bytes."""
    if fmt in subtitle.PARSERS:
        return subtitle.parse(df, fmt, keys, column, mode)
    if fmt in ("csv", "tsv"):
        return delimited.parse_delimited(df, keys, column, options.get("delimiter", "\t" if fmt == "tsv" else ","), options.get("header", True), mode)
    if fmt == "fwf":
        return text.parse_fwf(df, keys, options["columns"], column, options.get("pad", " "))
    lines = {"json": text.parse_json, "jsonl": text.parse_jsonl, "ini": text.parse_ini, "env": text.parse_env}
    if fmt in lines:
        return lines[fmt](df, keys, column, mode=mode)
    if fmt in files.FORMATS:
        return files.read(df, fmt, keys, column, mode)
    raise FormatError("UNSUPPORTED_FORMAT", fmt)
