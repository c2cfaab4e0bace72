"""Which converter takes a pair of formats: registry, capability matrix, choice by priority, argv."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.errors import FormatError
from formloom.plans.formats import BY_EXT, BY_MIME, FORMATS, formats

#: Containers between which every conversion is listed, and the audio types they can become.
VIDEO = ["video/mp4", "video/webm", "video/x-matroska", "video/quicktime", "video/x-msvideo", "video/x-flv", "video/3gpp"]
AUDIO = ["audio/mp4", "audio/mpeg", "audio/flac", "audio/ogg", "audio/opus", "audio/wav", "audio/aac"]
TS = "video/mp2t"
#: Further sources and what they become.
OTHER = {
    "video/x-ms-wmv": ["video/mp4", "video/webm", "video/x-matroska", "audio/mpeg", "audio/aac"],
    "video/x-f4v": ["video/mp4", "video/webm", "audio/mpeg", "audio/aac"],
    "audio/x-ms-wma": ["audio/mpeg", "audio/mp4", "audio/flac", "audio/wav", "audio/ogg", "audio/aac"],
    "audio/aiff": ["audio/mpeg", "audio/mp4", "audio/flac", "audio/wav", "audio/ogg", "audio/aac"],
    "audio/wav": ["audio/aiff"], "audio/flac": ["audio/aiff"],
}
#: Types that are only passed through.
SAME_ONLY = ["image/vnd.adobe.photoshop", "image/x-blp", "image/vnd.ms-dds", "application/postscript", "image/jp2"]
FALLBACK_SUBTITLES = ["text/x-subrip", "text/x-ass", "text/vtt"]


def transcoder_pairs(subtitle_fallback: bool = False) -> list[tuple[str, str]]:
    """The transcoder's pairs of MIME types, from the rules above."""
    out = [(a, b) for a in VIDEO for b in VIDEO]
    out += [(a, b) for a in AUDIO for b in AUDIO if (a, b) != ("audio/mpeg", "audio/mpeg")]
    out += [(a, b) for a in [*VIDEO, TS] for b in AUDIO]
    out += [(TS, b) for b in [*VIDEO[:5], TS]] + [(a, TS) for a in VIDEO]
    out += [(a, b) for a, to in OTHER.items() for b in to] + [(a, a) for a in SAME_ONLY]
    if subtitle_fallback:
        out += [(a, b) for a in FALLBACK_SUBTITLES for b in FALLBACK_SUBTITLES]
    return out


def _same(*exts: str) -> list[tuple[str, str]]:
    return [(BY_EXT[e][1], BY_EXT[e][1]) for e in exts]


def _cross(ins: list[str], outs: list[str]) -> list[tuple[str, str]]:
    mime = lambda e: e if "/" in e else BY_EXT[e][1]
    return [(mime(a), mime(b)) for a in ins for b in outs]


_SUBTITLES = ["srt", "vtt", "ass", "ssa", "sub", "mpl"]
_CANVAS = ["png", "jpeg", "webp", "bmp", "ico"]
#: Converters in the order in which they are asked (fixed), each with the pairs that it takes.
BACKENDS: list[tuple[str, list[tuple[str, str]]]] = [
    ("mp3", [("audio/mpeg", f[1]) for f in FORMATS if f[1].startswith("audio/")]),
    ("wav", _same("wav")), ("flac", _same("flac")), ("ogg", _same("ogg")), ("aac", _same("aac")), ("mp4", _same("m4a")), ("webm", _same("webm")), ("mkv", _same("mkv")), ("ts", _same("ts")),
    ("image-canvas", _cross([*_CANVAS, "gif"], _CANVAS)),
    ("image-svg", _cross(["svg"], ["svg", "png", "jpeg", "webp"])),
    ("image-animation", _same("gif", "apng", "webp")),
    ("image-legacy", _same("pbm", "pgm", "ppm", "pfm", "qoi", "tiff", "tga", "xbm", "pcx", "xpm", "icns")),
    ("data-text", _same("json", "csv", "tsv", "ini", "env", "jsonl", "toml", "fwf", "xml", "yaml")),
    ("archive-zip", _same("zip", "tar", "gz", "bz2", "xz")),
    ("subtitle", _cross(_SUBTITLES, _SUBTITLES)),
]


def capabilities(spark: SparkSession, transcoder: bool = False) -> DataFrame:
    """priority, backend, in_mime, out_mime: one row for each pair that a backend takes."""
    listed = [*BACKENDS, *([("transcoder", transcoder_pairs())] if transcoder else [])]
    rows = {(p, name, a, b) for p, (name, pairs) in enumerate(listed) for a, b in pairs}
    return spark.createDataFrame(sorted(rows), "priority int, backend string, in_mime string, out_mime string")


def plan(pairs: DataFrame, in_mime: str = "in_mime", out_mime: str = "out_mime", transcoder: bool = False) -> DataFrame:
    """pairs with the first backend that takes each, or null.

    The choice is made once over the constant matrix (a few hundred rows), so the pairs, however
    many, meet it in one lookup join without a shuffle.
    """
    best = capabilities(pairs.sparkSession, transcoder).groupBy("in_mime", "out_mime").agg(F.min_by("backend", "priority").alias("backend"))
    best = best.withColumnsRenamed({"in_mime": "_in", "out_mime": "_out"})
    return pairs.join(F.broadcast(best), (F.col(in_mime) == F.col("_in")) & (F.col(out_mime) == F.col("_out")), "left").drop("_in", "_out")


def matrix(spark: SparkSession, transcoder: bool = False) -> DataFrame:
    """Every (input, output) of the known formats with the backend that takes it: 50 x 50 rows."""
    f = formats(spark)
    a = f.select(F.col("ext").alias("in_ext"), F.col("mime").alias("in_mime"))
    b = f.select(F.col("ext").alias("out_ext"), F.col("mime").alias("out_mime"))
    return plan(a.crossJoin(b), transcoder=transcoder)


#: Names of encoders that users may give.
CODECS = {"h264": "libx264", "h.264": "libx264", "avc": "libx264", "hevc": "libx265", "h.265": "libx265", "h265": "libx265", "av1": "libaom-av1", "vp9": "libvpx-vp9", "vp8": "libvpx",
          "mpeg2": "mpeg2video", "mpeg-2": "mpeg2video", "mpeg4": "mpeg4", "mpeg-4": "mpeg4", "mp3": "libmp3lame", "aac": "aac", "opus": "libopus", "vorbis": "libvorbis", "flac": "flac", "pcm": "pcm_s16le",
          **{n: n for n in ("libx264", "libx265", "libaom-av1", "libvpx-vp9", "libvpx", "mpeg2video", "libmp3lame", "libopus", "libvorbis", "pcm_s16le")}}
#: Default encoders by output type.
VIDEO_CODEC = {v: "libx264" for v in VIDEO} | {"video/webm": "libvpx-vp9"}
AUDIO_CODEC = {v: "aac" for v in VIDEO} | {"video/webm": "libopus", "video/x-msvideo": "libmp3lame", "audio/mp4": "aac", "audio/mpeg": "libmp3lame", "audio/flac": "flac", "audio/ogg": "libvorbis",
                                           "audio/opus": "libopus", "audio/wav": "pcm_s16le", "audio/aac": "aac"}
#: Ranges of -crf, and kbps for low, medium and high quality.
CRF = {"libx264": (0, 51), "libx265": (0, 51), "libvpx-vp9": (0, 63), "libaom-av1": (0, 63), "mpeg2video": (1, 31), "mpeg4": (1, 31)}
KBPS = {"aac": (64, 192, 320), "libopus": (32, 128, 256)}
VIDEO_ENCODERS = ("libx264", "libx265", "libvpx-vp9", "libvpx", "libaom-av1", "mpeg2video", "mpeg4")


def _pick(key: Column, table: dict, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(found, F.lit(default)) if default else found


def codec_alias(name: Column) -> Column:
    return _pick(F.lower(name), CODECS)


def quality_flags(codec: Column, quality: Column) -> Column:
    """Flags (array of string) that ask codec for a quality of 0 to 1; null means 0.7."""
    q = F.coalesce(quality, F.lit(0.7))
    half_up = lambda x: F.floor(x + 0.5).cast("string")
    low, high = (_pick(codec, {k: float(v[i]) for k, v in CRF.items()}) for i in (0, 1))
    rate = F.lit(None).cast("int")
    for name, (a, b, c) in KBPS.items():
        rate = F.when(codec == name, F.when(q < 0.33, F.lit(a)).when(q < 0.67, F.lit(b)).otherwise(F.lit(c))).otherwise(rate)
    return (F.when(low.isNotNull(), F.array(F.lit("-crf"), half_up(low + (1 - q) * (high - low))))
            .when(codec.isin("libmp3lame", "libvorbis"), F.array(F.lit("-q:a"), half_up((1 - q) * 9)))
            .when(rate.isNotNull(), F.array(F.lit("-b:a"), F.concat(rate.cast("string"), F.lit("k"))))
            .otherwise(F.array().cast("array<string>")))


def argv(source: Column, target: Column, out_mime: Column, out_category: Column, codec: Column, quality: Column) -> Column:
    """The transcoder's argument list for one conversion; null where the codec does not fit."""
    audio = out_category == "audio"
    alias = codec_alias(codec)
    video_codec = F.when(codec.isNull(), _pick(out_mime, VIDEO_CODEC, "libx264")).when(alias.isin(*VIDEO_ENCODERS), alias)
    audio_codec = F.when(codec.isNotNull() & audio, F.when(_pick(out_mime, AUDIO_CODEC).isNotNull(), alias)).otherwise(_pick(out_mime, AUDIO_CODEC))
    none = F.array().cast("array<string>")
    v = F.when(audio, F.array(F.lit("-vn"))).otherwise(F.concat(F.array(F.lit("-c:v"), video_codec), quality_flags(video_codec, quality)))
    a = F.when(audio_codec.isNotNull(), F.concat(F.array(F.lit("-c:a"), audio_codec), quality_flags(audio_codec, quality))).otherwise(none)
    whole = F.concat(F.array(F.lit("-hide_banner"), F.lit("-nostdin"), F.lit("-y"), F.lit("-i"), source), v, a, F.array(target))
    fits = codec.isNull() | F.when(audio, _pick(out_mime, AUDIO_CODEC).isNull() | alias.isNotNull()).otherwise(alias.isin(*VIDEO_ENCODERS))
    return F.when(fits, whole)


def progress_seconds(line: Column, mark: str) -> Column:
    """Seconds after mark ('Duration: ' or 'time=') in a progress line, or null."""
    p = mark + r"\s*(\d+):(\d{2}):(\d{2})\.(\d{2})"
    part = lambda i: F.regexp_extract(line, p, i).cast("int")
    return F.when(line.rlike(p), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 100)


def find_backend(in_name: str, out_name: str, transcoder: bool = False) -> str:
    """The driver-side form: by extension or MIME type; raises when no backend takes the pair."""

    def mime(x: str) -> str:
        if "/" in x:
            return x if x in BY_MIME or transcoder else _missing(x)
        from formloom.plans.formats import ALIASES

        e = x.lower().removeprefix(".")
        e = ALIASES.get(e, e)
        return BY_EXT[e][1] if e in BY_EXT else _missing(x)

    pair = (mime(in_name), mime(out_name))
    for name, pairs in [*BACKENDS, *([("transcoder", transcoder_pairs())] if transcoder else [])]:
        if pair in pairs:
            return name
    raise FormatError("NO_BACKEND", f"{pair[0]} -> {pair[1]}")


def _missing(name: str) -> str:
    raise FormatError("UNSUPPORTED_FORMAT", name)
