"""Queries over cue tables made of events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.functions import timecode as tc
from formloom.registry import query, table
from formloom.sinks import subtitle as sink
from formloom.sources import subtitle as source

_START = 1704067200000  # 2024-01-01 in UTC
_CUES = f"""c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, epoch_us(ts) // 1000 - {_START} AS start_ms,
epoch_us(ts) // 1000 - {_START} + 1500 AS end_ms, event_type || chr(10) || props AS text FROM events)"""


def clock(ms: str, comma: str) -> str:
    return (f"printf('%02d', {ms} // 3600000) || ':' || printf('%02d', {ms} // 60000 % 60) || ':' || printf('%02d', {ms} // 1000 % 60) || '{comma}' || printf('%03d', {ms} % 1000)")


def event_cues(spark, sf_dir):
    """One file per user: an event is a cue of 1.5 seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp")) - _START
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).alias("ordinal"), F.lit(None).cast("string").alias("id"), start.alias("start_ms"), (start + 1500).alias("end_ms"), F.concat("event_type", F.lit("\n"), "props").alias("text"))


def talk_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 2000 + F.col("conv_id") % 997
    return c.select("conv_id", (F.col("turn") + 1).cast("int").alias("ordinal"), F.col("role").alias("id"), start.alias("start_ms"), (start + 1234).alias("end_ms"), F.regexp_replace("text", r"\s+", " ").alias("text"))


_TALK = "t AS (SELECT conv_id, (turn + 1)::INT AS ordinal, role AS id, turn * 2000 + conv_id % 997 AS start_ms, turn * 2000 + conv_id % 997 + 1234 AS end_ms, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM conversations)"


@query("subtitle_cues", f"WITH {_CUES} SELECT user_id, ordinal, start_ms, end_ms, {clock('start_ms', ',')} AS srt_start, {clock('end_ms', '.')} AS vtt_end FROM c")
def subtitle_cues(spark, sf_dir):
    return event_cues(spark, sf_dir).select("user_id", "ordinal", "start_ms", "end_ms", tc.srt_time(F.col("start_ms")).alias("srt_start"), tc.vtt_time(F.col("end_ms")).alias("vtt_end"))


@query("subtitle_srt_text", f"""WITH {_CUES} SELECT user_id, string_agg(ordinal || chr(10) || {clock('start_ms', ',')} || ' --> ' || {clock('end_ms', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS text FROM c GROUP BY user_id""")
def subtitle_srt_text(spark, sf_dir):
    return sink.serialize_srt(event_cues(spark, sf_dir), ["user_id"])


@query("subtitle_srt_roundtrip", f"WITH {_CUES} SELECT user_id, ordinal, ordinal::VARCHAR AS id, start_ms, end_ms, text FROM c")
def subtitle_srt_roundtrip(spark, sf_dir):
    return source.parse_srt(sink.serialize_srt(event_cues(spark, sf_dir), ["user_id"]), ["user_id"]).drop("error_code")


@query("subtitle_vtt_text", f"""WITH {_TALK} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(id || chr(10) || {clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS text FROM t GROUP BY conv_id""")
def subtitle_vtt_text(spark, sf_dir):
    return sink.serialize_vtt(talk_cues(spark, sf_dir), ["conv_id"])


@query("subtitle_vtt_roundtrip", f"WITH {_TALK} SELECT conv_id, ordinal, id, start_ms, end_ms, trim(text) AS text FROM t")
def subtitle_vtt_roundtrip(spark, sf_dir):
    return source.parse_vtt(sink.serialize_vtt(talk_cues(spark, sf_dir), ["conv_id"]), ["conv_id"]).drop("error_code")


_ASS_HEAD = "\\n".join([*sink.ASS_INFO, "", "[V4+ Styles]", *sink.ASS_STYLES, "", *sink.ASS_EVENTS]) + "\\n"
_CS = lambda c: f"floor({c} / 10 + 0.5)::BIGINT"
_ASS = lambda c: f"({_CS(c)} // 360000) || ':' || printf('%02d', {_CS(c)} // 6000 % 60) || ':' || printf('%02d', {_CS(c)} // 100 % 60) || '.' || printf('%02d', {_CS(c)} % 100)"


@query("subtitle_ass_text", f"""WITH {_TALK} SELECT conv_id, replace('{_ASS_HEAD}', '\\n', chr(10)) || string_agg('Dialogue: 0,' || {_ASS('start_ms')} || ',' || {_ASS('end_ms')} || ',' || id || ',,0,0,0,,' || text, chr(10) ORDER BY ordinal) || chr(10) AS text FROM t GROUP BY conv_id""")
def subtitle_ass_text(spark, sf_dir):
    return sink.serialize_ass(talk_cues(spark, sf_dir), ["conv_id"])


@query("subtitle_ass_roundtrip", f"WITH {_TALK} SELECT conv_id, ordinal, id, 10 * {_CS('start_ms')} AS start_ms, 10 * {_CS('end_ms')} AS end_ms, trim(text) AS text, NULL::VARCHAR AS font_name FROM t")
def subtitle_ass_roundtrip(spark, sf_dir):
    out = source.parse_ass(sink.serialize_ass(talk_cues(spark, sf_dir), ["conv_id"]), ["conv_id"])
    return out.select("conv_id", "ordinal", "id", "start_ms", "end_ms", "text", "font_name")


@query("subtitle_ssa_styles", "SELECT conv_id, count(*) AS n, 'Arial' AS font_name, 20 AS font_size, false AS bold, 2 AS alignment FROM conversations GROUP BY conv_id")
def subtitle_ssa_styles(spark, sf_dir):
    cues = talk_cues(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    out = source.parse_ssa(sink.serialize_ssa(cues, ["conv_id"]), ["conv_id"])
    return out.groupBy("conv_id", "font_name", "font_size", "bold", "alignment").agg(F.count("*").alias("n"))


@query("subtitle_sub_text", f"""WITH {_CUES} SELECT user_id, '{{0}}{{0}}25' || chr(10) || string_agg('{{' || floor(start_ms / 1000 * 25 + 0.5)::BIGINT || '}}{{' || floor(end_ms / 1000 * 25 + 0.5)::BIGINT || '}}' || replace(text, chr(10), '|'), chr(10) ORDER BY ordinal) || chr(10) AS text FROM c GROUP BY user_id""")
def subtitle_sub_text(spark, sf_dir):
    return sink.serialize_sub(event_cues(spark, sf_dir), ["user_id"], fps=25)


@query("subtitle_sub_roundtrip", f"""WITH {_CUES} SELECT user_id, ordinal, floor(floor(start_ms / 1000 * 25 + 0.5) / 25 * 1000 + 0.5)::BIGINT AS start_ms, floor(floor(end_ms / 1000 * 25 + 0.5) / 25 * 1000 + 0.5)::BIGINT AS end_ms, text FROM c""")
def subtitle_sub_roundtrip(spark, sf_dir):
    return source.parse_sub(sink.serialize_sub(event_cues(spark, sf_dir), ["user_id"], fps=25), ["user_id"]).drop("error_code", "id")


@query("subtitle_mpl_roundtrip", f"WITH {_CUES} SELECT user_id, ordinal, 100 * floor(start_ms / 100 + 0.5)::BIGINT AS start_ms, 100 * floor(end_ms / 100 + 0.5)::BIGINT AS end_ms, text FROM c")
def subtitle_mpl_roundtrip(spark, sf_dir):
    return source.parse_mpl(sink.serialize_mpl(event_cues(spark, sf_dir), ["user_id"]), ["user_id"]).drop("error_code", "id")


@query("subtitle_convert_srt_to_vtt", f"""WITH {_CUES} SELECT user_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(ordinal || chr(10) || {clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS text FROM c GROUP BY user_id""")
def subtitle_convert_srt_to_vtt(spark, sf_dir):
    return sink.convert(sink.serialize_srt(event_cues(spark, sf_dir), ["user_id"]), "srt", "vtt", ["user_id"])
