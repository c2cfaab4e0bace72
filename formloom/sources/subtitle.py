"""Subtitle texts to cue tables, in column expressions.

Every parser takes a DataFrame with key columns and a text column, one file per row, and gives
one row per cue: keys, ordinal (from 1), id, start_ms, end_ms, text, and error_code. A file
that its format refuses gives, in quarantine mode, a single row with the error and no cue; in
strict mode the query fails. SRT, VTT and MPL2 are parsed inside their row, so nothing is
shuffled; ASS and MicroDVD carry state from line to line, which is a window over the file's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions import timecode as tc

CUE = "struct<id:string,start_ms:bigint,end_ms:bigint,text:string>"
DEFAULT_FPS = 23.976
EVENT_FORMAT = ["Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text"]


def normalised(text: Column) -> Column:
    """Without a byte order mark, and with LF line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def _blocks(text: Column) -> Column:
    """Runs of lines that are not blank."""
    return F.filter(F.split(text, rf"(?:^|\n)(?:[^\S\n]*\n)++|\n[^\S\n]*$"), lambda b: F.length(tc.trimmed(b)) > 0)


def _let(value: Column, f) -> Column:
    """f of value, evaluated once: a lambda's body has no common subexpressions."""
    return F.transform(F.array(value), f)[0]


def _result(df: DataFrame, keys: list[str], cues: Column, bad: Column, mode: str, code: str = "SUBTITLE_PARSE_ERROR") -> DataFrame:
    """cues (array of CUE) exploded; bad files as mode says."""
    if mode == "strict":
        cues = F.when(bad, F.raise_error(F.lit(code)).cast(f"array<{CUE}>")).otherwise(cues)
        out = df.select(*keys, F.posexplode(cues).alias("p", "c"), F.lit(None).cast("string").alias("error_code"))
    else:
        none = F.array(F.lit(None).cast(CUE))
        out = df.select(*keys, F.posexplode(F.when(bad, none).otherwise(cues)).alias("p", "c"), F.when(bad, code).alias("error_code"))
    return out.select(*keys, (F.col("p") + 1).alias("ordinal"), "c.id", "c.start_ms", "c.end_ms", "c.text", "error_code")


def _first(lines: Column, test) -> Column:
    """Position (from 1) of the first line that passes, or 0."""
    return F.coalesce(F.array_position(F.transform(lines, test), F.lit(True)), F.lit(0)).cast("int")


def _line(lines: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(lines, F.when(i > 0, i).otherwise(F.lit(None).cast("int"))), F.lit(""))


def _rest(lines: Column, i: Column) -> Column:
    return F.array_join(F.slice(lines, i, F.size(lines)), "\n")


def parse_srt(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """Lines before a block's number are passed over; a number without a timing line fails the file."""

    def cue(b: Column) -> Column:
        return _let(F.split(b, "\n"), lambda lines: _let(_first(lines, lambda s: s.rlike(rf"^{tc.BLANK}*\d+{tc.BLANK}*$")), lambda at: _let(tc.trimmed(_line(lines, at + 1)), lambda timing: timed(lines, at, timing))))

    def timed(lines: Column, at: Column, timing: Column) -> Column:
        start = tc.srt_ms(F.regexp_extract(timing, "^(.*?) --> ", 1))
        end = tc.srt_ms(F.regexp_extract(timing, r"^.*? --> (\S*)", 1))
        return F.when(at > 0, F.struct(tc.trimmed(_line(lines, at)).alias("id"), start.alias("start_ms"), end.alias("end_ms"), tc.strip_srt(_rest(lines, at + 2)).alias("text")))

    base = df.select(*keys, _blocks(normalised(F.col(text))).alias("_b"))
    found = base.select(*keys, F.filter(F.transform("_b", cue), lambda c: c.isNotNull()).alias("_c"))
    bad = F.exists("_c", lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    return _result(found, keys, F.col("_c"), bad, mode)


#: Cue settings that are kept, and the values that two of them may have.
_SETTINGS = {"vertical": ["rl", "lr"], "line": None, "position": None, "size": None, "align": ["start", "center", "end", "left", "right"]}


def _json(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def parse_vtt(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """NOTE, STYLE and REGION blocks give no cues; settings are packed with the id as JSON."""
    arrow = " --> "

    def cue(b: Column) -> Column:
        lines = F.split(b, "\n")
        has = lambda i: F.contains(_line(lines, i), F.lit(arrow))
        # Lines are tried in twos: an id and its timing, or a timing at once.
        at = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(lines), F.lit(2)), lambda i: has(i) | has(i + 1)), F.lit(1)), F.lit(0))
        own = F.when(has(at), at).otherwise(at + 1)
        timing = tc.trimmed(_line(lines, own))
        after = F.regexp_extract(timing, r"^.*? --> \S*\s(.*)$", 1)
        tokens = F.transform(F.split(tc.trimmed(after), r"\s+"), lambda t: F.struct(F.regexp_extract(t, "^([^:]*):", 1).alias("k"), F.regexp_extract(t, "^[^:]*:(.*)$", 1).alias("v")))
        fine = lambda t: reduce(lambda x, y: x | y, [(t["k"] == k) & (t["v"].isin(*v) if v else F.lit(True)) for k, v in _SETTINGS.items()])
        kept = F.filter(tokens, fine)
        name = F.when(has(at), F.lit(None).cast("string")).otherwise(tc.trimmed(_line(lines, at)))
        packed = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"id":'), _json(name), F.lit(",")), F.lit("")), F.lit('"settings":{'), F.array_join(F.transform(kept, lambda t: F.concat(_json(t["k"]), F.lit(":"), _json(t["v"]))), ","), F.lit("}}"))
        start, end = tc.vtt_ms(F.regexp_extract(timing, "^(.*?) --> ", 1)), tc.vtt_ms(F.regexp_extract(timing, r"^.*? --> (\S*)", 1))
        skip = tc.trimmed(_line(lines, F.lit(1))).rlike("^(NOTE|STYLE|REGION)")
        return F.when(~skip & (at > 0), F.struct(F.when(F.size(kept) > 0, packed).otherwise(name).alias("id"), start.alias("start_ms"), end.alias("end_ms"), tc.strip_vtt(_rest(lines, own + 1)).alias("text")))

    t = normalised(F.col(text))
    # The first block is the header whatever it holds.
    base = df.select(*keys, t.startswith("WEBVTT").alias("_ok"), _blocks(F.regexp_replace(t, r"^(?:[^\n]*\S[^\n]*(?:\n|$))++", "\n")).alias("_b"))
    found = base.select(*keys, "_ok", F.filter(F.transform("_b", cue), lambda c: c.isNotNull()).alias("_c"))
    bad = ~F.col("_ok") | F.exists("_c", lambda c: c["start_ms"].isNull() | c["end_ms"].isNull())
    return _result(found, keys, F.col("_c"), bad, mode)


def vtt_metadata(text: Column) -> Column:
    """Header lines with a colon as a map; the last of equal keys holds."""
    lines = F.slice(F.split(F.regexp_extract(normalised(text), r"^((?:[^\n]*\S[^\n]*(?:\n|$))*+)", 1), "\n"), 2, 1 << 20)
    pairs = F.transform(F.filter(lines, lambda s: F.contains(s, F.lit(":"))), lambda s: F.struct(tc.trimmed(F.regexp_extract(s, "^([^:]*):", 1)).alias("k"), tc.trimmed(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def parse_mpl(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    """Lines of another shape, comments included, are passed over."""
    p = r"^\[(\d+)\]\[(\d+)\](.*)$"
    lines = F.filter(F.transform(F.split(normalised(F.col(text)), "\n"), tc.trimmed), lambda s: s.rlike(p))
    part = lambda s, i: F.regexp_extract(s, p, i)
    cue = lambda s: F.struct(F.lit(None).cast("string").alias("id"), (part(s, 1).cast("long") * 100).alias("start_ms"), (part(s, 2).cast("long") * 100).alias("end_ms"), tc.strip_mpl(part(s, 3)).alias("text"))
    return _result(df, keys, F.transform(lines, cue), F.lit(False), mode)


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.split(normalised(F.col(text)), "\n")).alias("line_no", "line"))


def _numbered(cues: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("line_no")
    return cues.withColumn("ordinal", F.row_number().over(w))


def parse_sub(df: DataFrame, keys: list[str], text: str = "text", fps: float = DEFAULT_FPS, mode: str = "strict") -> DataFrame:
    """A {0}{0} line sets the frame rate for the lines after it; cues that do not last are passed over."""
    p = r"^\{(\d+)\}\{(\d+)\}(.*)$"
    binary = F.substring(F.col(text), 1, 4) == "\x00\x00\x01\xba"
    if mode == "strict":
        df = df.withColumn(text, F.when(binary, F.raise_error(F.lit("VOBSUB_NOT_SUPPORTED")).cast("string")).otherwise(F.col(text)))
    rows = lines_of(df.where(~binary) if mode != "strict" else df, keys, text).withColumn("line", tc.trimmed(F.col("line"))).where(F.col("line").rlike(p))
    part = lambda i: F.regexp_extract("line", p, i)
    rows = rows.select(*keys, "line_no", part(1).cast("long").alias("a"), part(2).cast("long").alias("b"), part(3).alias("rest"))
    rate = F.expr(r"try_cast(regexp_extract(rest, '^\\s*([0-9]*\\.?[0-9]+)', 1) AS double)")
    set_here = F.when((F.col("a") == 0) & (F.col("b") == 0) & (rate > 0), rate)
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fps", F.coalesce(F.last(set_here, ignorenulls=True).over(w), F.lit(fps))).where("a < b")
    out = _numbered(rows, keys).select(*keys, "ordinal", F.lit(None).cast("string").alias("id"), tc.frames_ms(F.col("a"), F.col("fps")).alias("start_ms"), tc.frames_ms(F.col("b"), F.col("fps")).alias("end_ms"),
                                       F.replace(tc.strip_sub(F.col("rest")), F.lit("|"), F.lit("\n")).alias("text"), F.lit(None).cast("string").alias("error_code"))
    if mode != "strict":
        none = df.where(binary).select(*keys, F.lit(1).alias("ordinal"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("string").alias("text"), F.lit("VOBSUB_NOT_SUPPORTED").alias("error_code"))
        out = out.unionByName(none)
    return out


def parse_ass(df: DataFrame, keys: list[str], text: str = "text", styles: str = "[V4+ Styles]", mode: str = "strict") -> DataFrame:
    """Cues with their style's font_name, font_size, bold, italic and alignment; id is the style's name unless Default."""
    rows = lines_of(df, keys, text).withColumn("line", F.regexp_replace("line", rf"{tc.BLANK}+$", ""))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("line").startswith("["), tc.trimmed(F.col("line"))), ignorenulls=True).over(w))
    rows = rows.where(~F.col("line").rlike(r"^(\[|;|!:)") & F.contains("line", F.lit(":")))
    rows = rows.withColumn("k", tc.trimmed(F.regexp_extract("line", "^([^:]*):", 1))).withColumn("v", tc.trimmed(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))
    cols = F.transform(F.split("v", ","), tc.trimmed)
    rows = rows.where(F.col("section").isin("[Events]", "[V4 Styles]", styles)).withColumn("kind", F.when(F.col("section") == "[Events]", "e").otherwise("s"))
    own = Window.partitionBy(*keys, "kind").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fmt", F.last(F.when(F.col("k") == "Format", cols), ignorenulls=True).over(own))
    at = lambda name: F.array_position("fmt", F.lit(name)).cast("int")
    get = lambda arr, name, default: F.coalesce(F.try_element_at(arr, F.nullif(at(name), F.lit(0))), F.lit(default))
    number = lambda c, default: F.coalesce(F.nullif(F.expr(f"try_cast(regexp_extract({c}, '^([+-]?[0-9]+)', 1) AS int)"), F.lit(0)), F.lit(default))
    on = lambda c: F.col(c).isin("-1", "1")
    st = rows.where("kind = 's' AND k = 'Style' AND fmt IS NOT NULL").withColumn("p", cols)
    st = st.select(*keys, "line_no", get(F.col("p"), "Name", "").alias("style"), get(F.col("p"), "Fontname", "Arial").alias("font_name"), get(F.col("p"), "Fontsize", "20").alias("fs"), get(F.col("p"), "Bold", "0").alias("b"), get(F.col("p"), "Italic", "0").alias("i"), get(F.col("p"), "Alignment", "2").alias("al"))
    st = st.groupBy(*keys, "style").agg(*[F.max_by(c, "line_no").alias(c) for c in ("font_name", "fs", "b", "i", "al")])
    st = st.select(*keys, "style", "font_name", number("fs", 20).alias("font_size"), on("b").alias("bold"), on("i").alias("italic"), F.when(number("al", 2).between(1, 9), number("al", 2)).otherwise(2).alias("alignment"))
    ev = rows.where("kind = 'e' AND k = 'Dialogue'").withColumn("fmt", F.coalesce("fmt", F.array(*map(F.lit, EVENT_FORMAT))))
    ev = ev.withColumn("p", F.transform(F.expr("split(v, ',', size(fmt))"), tc.trimmed))
    ev = ev.select(*keys, "line_no", tc.ass_ms(get(F.col("p"), "Start", "0:00:00.00")).alias("start_ms"), tc.ass_ms(get(F.col("p"), "End", "0:00:00.00")).alias("end_ms"), get(F.col("p"), "Style", "Default").alias("style"), tc.strip_ass(get(F.col("p"), "Text", "")).alias("text"))
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    if mode == "strict":
        ev = ev.withColumn("start_ms", F.when(bad, F.raise_error(F.lit("SUBTITLE_PARSE_ERROR")).cast("long")).otherwise(F.col("start_ms"))).withColumn("error_code", F.lit(None).cast("string"))
    else:
        ev = ev.withColumn("error_code", F.when(F.max(bad).over(Window.partitionBy(*keys)), "SUBTITLE_PARSE_ERROR"))
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))
        ev = ev.withColumn("_n", first).where("error_code IS NULL OR _n = 1").drop("_n")
        for c in ("start_ms", "end_ms", "text", "style"):
            ev = ev.withColumn(c, F.when(F.col("error_code").isNull(), F.col(c)))
    out = _numbered(ev, keys).join(st, [*keys, "style"], "left")
    return out.select(*keys, "ordinal", F.when(F.col("style") != "Default", F.col("style")).alias("id"), "start_ms", "end_ms", "text", "error_code", "font_name", "font_size", "bold", "italic", "alignment")


def parse_ssa(df: DataFrame, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    return parse_ass(df, keys, text, "[V4 Styles]", mode)


PARSERS = {"srt": parse_srt, "vtt": parse_vtt, "ass": parse_ass, "ssa": parse_ssa, "sub": parse_sub, "mpl": parse_mpl}


def parse(df: DataFrame, fmt: str, keys: list[str], text: str = "text", mode: str = "strict") -> DataFrame:
    return PARSERS[fmt](df, keys, text, mode=mode)
