"""Cue tables to subtitle texts: one row per file with its canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import timecode as tc
from formloom.sources.subtitle import DEFAULT_FPS, parse

#: The head of an ASS file, its default style, and its event format.
ASS_INFO = ["[Script Info]", "; Generated by formloom", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.601", "PlayResX: 640", "PlayResY: 480"]
ASS_STYLES = ["Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
              "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1"]
ASS_EVENTS = ["[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]


def by_file(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by file to the session's number of shuffle partitions.

    The grouping that follows needs this exchange anyway; asked for by number it is not coalesced,
    as the work on a file's rows is heavy for their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def joined(rows: DataFrame, keys: list[str], order: str, line: Column, sep: str) -> DataFrame:
    """keys and _t: the lines of each file in order, from one aggregation."""
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return by_file(rows, keys).groupBy(*keys).agg(F.array_join(F.transform(one, lambda x: x["l"]), sep).alias("_t"))


def _id() -> Column:
    return F.coalesce(F.concat(F.col("id"), F.lit("\n")), F.lit(""))


def serialize_srt(cues: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Cues are numbered anew from 1; the numbers come from the position in the sorted array, so no window is needed."""
    line = F.concat(tc.srt_time(F.col("start_ms")), F.lit(" --> "), tc.srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    one = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    text = F.array_join(F.transform(one, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["l"])), "\n\n")
    return by_file(cues, keys).groupBy(*keys).agg(F.concat(text, F.lit("\n")).alias("text"))


def serialize_vtt(cues: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    packed = F.try_variant_get(F.try_parse_json("id"), "$.settings", "map<string,string>")
    name = F.when(packed.isNotNull(), F.try_variant_get(F.try_parse_json("id"), "$.id", "string")).otherwise(F.col("id"))
    setting = F.array_join(F.filter(F.array(*[F.when(packed.isNotNull() & packed[k].isNotNull(), F.concat(F.lit(f" {k}:"), packed[k])) for k in ("vertical", "line", "position", "size", "align")]), lambda s: s.isNotNull()), "")
    line = F.concat(F.coalesce(F.concat(name, F.lit("\n")), F.lit("")), tc.vtt_time(F.col("start_ms")), F.lit(" --> "), tc.vtt_time(F.col("end_ms")), F.coalesce(setting, F.lit("")), F.lit("\n"), F.col("text"))
    return joined(cues, keys, order, line, "\n\n").select(*keys, F.concat(F.lit("WEBVTT\n\n"), F.col("_t"), F.lit("\n")).alias("text"))


def serialize_ass(cues: DataFrame, keys: list[str], order: str = "ordinal", styles: str = "[V4+ Styles]") -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,"), tc.ass_time(F.col("start_ms")), F.lit(","), tc.ass_time(F.col("end_ms")), F.lit(","), F.coalesce("id", F.lit("Default")), F.lit(",,0,0,0,,"), tc.escape_ass(F.col("text")))
    head = "\n".join([*ASS_INFO, "", styles, *ASS_STYLES, "", *ASS_EVENTS]) + "\n"
    return joined(cues, keys, order, line, "\n").select(*keys, F.concat(F.lit(head), F.col("_t"), F.lit("\n")).alias("text"))


def serialize_ssa(cues: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    return serialize_ass(cues, keys, order, "[V4 Styles]").withColumn("text", F.replace("text", F.lit("ScriptType: v4.00+"), F.lit("ScriptType: v4.00")))


def serialize_sub(cues: DataFrame, keys: list[str], order: str = "ordinal", fps: float = DEFAULT_FPS) -> DataFrame:
    rate = F.lit(float(fps))
    frame = lambda c: F.concat(F.lit("{"), tc.ms_frames(F.col(c), rate).cast("string"), F.lit("}"))
    line = F.concat(frame("start_ms"), frame("end_ms"), F.replace("text", F.lit("\n"), F.lit("|")))
    return joined(cues, keys, order, line, "\n").select(*keys, F.concat(F.lit("{0}{0}"), tc.plain_number(rate), F.lit("\n"), F.col("_t"), F.lit("\n")).alias("text"))


def serialize_mpl(cues: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    ds = lambda c: F.concat(F.lit("["), tc.ms_deciseconds(F.col(c)).cast("string"), F.lit("]"))
    line = F.concat(ds("start_ms"), ds("end_ms"), F.replace("text", F.lit("\n"), F.lit("|")))
    return joined(cues, keys, order, line, "\n").select(*keys, F.concat(F.col("_t"), F.lit("\n")).alias("text"))


SERIALIZERS = {"srt": serialize_srt, "vtt": serialize_vtt, "ass": serialize_ass, "ssa": serialize_ssa, "sub": serialize_sub, "mpl": serialize_mpl}


def convert(df: DataFrame, source: str, target: str, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """Any of the six formats into any other: keys and text."""
    cues = parse(df, source, keys, text, mode)
    return SERIALIZERS[target](cues.where("error_code IS NULL"), keys)
