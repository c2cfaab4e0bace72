"""Queries over formats, detection, planning and security."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import security
from formloom.plans import formats, planner
from formloom.registry import query, table
from formloom.sources import detect

_VALUES = ", ".join("(%d, '%s', '%s', '%s')" % (i, f[0], f[1], f[2]) for i, f in enumerate(formats.FORMATS))
_FORMATS = f"f(ordinal, ext, mime, category) AS (VALUES {_VALUES})"


@query("formats_by_category", f"WITH {_FORMATS} SELECT category, count(*) AS n, min(ext) AS first_ext, count(DISTINCT mime) AS n_mimes FROM f GROUP BY category")
def formats_by_category(spark, sf_dir):
    return formats.formats(spark).groupBy("category").agg(F.count("*").alias("n"), F.min("ext").alias("first_ext"), F.count_distinct("mime").alias("n_mimes"))


_NAMES = ["png", ".PNG", "jpg", "TGZ", ".yml", "..yml", "text/plain", "Text/VTT", "audio/mp4", "nope", "video/none", "", "fwf"]
_ALIAS = "CASE regexp_replace(lower(x), '^\\.', '') WHEN 'jpg' THEN 'jpeg' WHEN 'tgz' THEN 'gz' WHEN 'yml' THEN 'yaml' ELSE regexp_replace(lower(x), '^\\.', '') END"


@query("formats_resolve", f"""WITH {_FORMATS}, n(x) AS (VALUES {", ".join(f"('{x}')" for x in _NAMES)})
SELECT x AS name, CASE WHEN contains(x, '/') THEN (SELECT max_by(ext, ordinal) FROM f WHERE f.mime = lower(x)) ELSE (SELECT max(ext) FROM f WHERE f.ext = {_ALIAS}) END AS ext FROM n""")
def formats_resolve(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in _NAMES], "name string").withColumn("ext", formats.resolve(F.col("name")))


@query("formats_of_urls", f"""WITH {_FORMATS}, u AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS last FROM pages)
SELECT page_id, last, (SELECT max(ext) FROM f WHERE f.ext = CASE WHEN contains(last, '.') THEN lower(regexp_extract(last, '\\.([^.]*)$', 1)) ELSE lower(last) END) AS ext FROM u""")
def formats_of_urls(spark, sf_dir):
    last = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", last.alias("last"), detect.detect_with_hint(F.lit(b""), last).alias("ext"))


_TEXT_HEADS = [("BM", "bmp"), ("GIF8", "gif"), ("OggS", "ogg"), ("ID3", "mp3"), ("fLaC", "flac"), ("BZh", "bz2"), ("qoif", "qoi"), ("P1", "pbm"), ("P4", "pbm"), ("P2", "pgm"), ("P5", "pgm"), ("P3", "ppm"), ("P6", "ppm"), ("Pf", "pfm"), ("PF", "pfm")]
_TEXT_CASE = "CASE " + " ".join(f"WHEN starts_with(t, '{s}') THEN '{e}'" + (f" WHEN substr(t, 5, 4) = 'ftyp' THEN 'mp4'" if s == "GIF8" else "") for s, e in _TEXT_HEADS) + " WHEN regexp_matches(t, '^\\s*<(svg|SVG)') THEN 'svg' END"


@query("detect_documents", f"SELECT ext, count(*) AS n FROM (SELECT {_TEXT_CASE} AS ext FROM (SELECT text AS t FROM documents)) GROUP BY ext")
def detect_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(detect.detect(F.col("text").cast("binary"), text=True).alias("ext")).groupBy("ext").agg(F.count("*").alias("n"))


@query("detect_pages", "SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*<(svg|SVG)') THEN 'svg' END AS ext FROM pages")
def detect_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", detect.detect(F.col("html").cast("binary"), text=True).alias("ext"))


def _png(*kinds: str) -> bytes:
    return bytes.fromhex("89504E470D0A1A0A") + b"".join((13).to_bytes(4) + k.encode() + bytes(17) for k in kinds)


#: Heads and what each is expected to be.
HEADS: list[tuple[str, bytes, str | None]] = [
    ("png", _png("IHDR", "IDAT"), "png"), ("apng", _png("IHDR", "acTL", "IDAT"), "apng"), ("late acTL", _png("IHDR", "IDAT", "acTL"), "png"), ("jpeg", b"\xff\xd8\xff\xe0", "jpeg"),
    ("webp", b"RIFF\0\0\0\0WEBPVP8 ", "webp"), ("wav", b"RIFF\0\0\0\0WAVEfmt ", "wav"), ("riff", b"RIFF\0\0\0\0AVI LIST", None), ("bmp", b"BM....", "bmp"), ("ico", b"\0\0\1\0\1\0", "ico"),
    ("gif", b"GIF89a", "gif"), ("mp4", b"\0\0\0\x18ftypisom", "mp4"), ("m4a", b"\0\0\0\x18ftypM4A ", "mp4"), ("webm", b"\x1a\x45\xdf\xa3", "webm"), ("ogg", b"OggS\0", "ogg"), ("id3", b"ID3\x04", "mp3"),
    ("flac", b"fLaC", "flac"), ("zip", b"PK\3\4", "zip"), ("gz", b"\x1f\x8b\x08", "gz"), ("bz2", b"BZh9", "bz2"), ("xz", b"\xfd7zXZ\0", "xz"), ("tar", bytes(257) + b"ustar\0" + b"00", "tar"),
    ("gnu tar", bytes(257) + b"ustar  \0", None), ("qoi", b"qoif", "qoi"), ("ts", (b"G" + bytes(187)) * 2, "ts"), ("one packet", b"G" + bytes(187), None), ("pbm", b"P4 1 1", "pbm"), ("pfm", b"PF\n", "pfm"),
    ("svg", b"<svg xmlns='x'>", "svg"), ("svg bom", b"\xef\xbb\xbf<?xml version='1.0'?>\n<!-- a --><!-- b -->\n<svg>", "svg"), ("late svg", b"<!-- a --> x --> <svg>", None), ("html", b"<html><svg>", None),
    ("mp3 sync", b"\xff\xfb\x90", "mp3"), ("aac sync", b"\xff\xf1\x50", "aac"), ("other sync", b"\xff\xf4", None), ("empty", b"", None), ("csv", b"a,b\r\n", None),
]


@query("detect_heads", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {repr(e) if e else 'NULL'})" for n, _, e in HEADS) + ") AS t(name, ext)")
def detect_heads(spark, sf_dir):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in HEADS], "name string, content binary")
    return df.select("name", detect.detect(F.col("content")).alias("ext"))


_CAP = ", ".join(f"({p}, '{n}', '{a}', '{b}')" for p, (n, pairs) in enumerate([*planner.BACKENDS, ("transcoder", planner.transcoder_pairs())]) for a, b in pairs)


@query("plan_matrix", f"""WITH {_FORMATS}, c(priority, backend, i, o) AS (VALUES {_CAP})
SELECT a.ext AS in_ext, b.ext AS out_ext, a.mime AS in_mime, b.mime AS out_mime, (SELECT min_by(backend, priority) FROM c WHERE c.i = a.mime AND c.o = b.mime) AS backend FROM f a, f b""")
def plan_matrix(spark, sf_dir):
    return planner.matrix(spark, transcoder=True)


@query("plan_first_backends", f"""WITH {_FORMATS}, c(priority, backend, i, o) AS (VALUES {_CAP}),
m AS (SELECT a.ext, b.ext AS o, min_by(backend, priority) AS backend FROM f a JOIN c ON c.i = a.mime JOIN f b ON b.mime = c.o GROUP BY a.ext, b.ext)
SELECT backend, count(*) AS n_pairs FROM m GROUP BY backend""")
def plan_first_backends(spark, sf_dir):
    return planner.matrix(spark, transcoder=True).where("backend IS NOT NULL").groupBy("backend").agg(F.count("*").alias("n_pairs"))


#: The pairs spelled out once more, apart from the planner's table.
_PAIRS = """WITH v(m) AS (VALUES ('video/mp4'), ('video/webm'), ('video/x-matroska'), ('video/quicktime'), ('video/x-msvideo'), ('video/x-flv'), ('video/3gpp')),
a(m) AS (VALUES ('audio/mp4'), ('audio/mpeg'), ('audio/flac'), ('audio/ogg'), ('audio/opus'), ('audio/wav'), ('audio/aac')),
s(m) AS (VALUES ('text/x-subrip'), ('text/vtt'), ('text/x-ass')),
p AS (SELECT x.m AS in_mime, y.m AS out_mime FROM v x, v y
UNION ALL SELECT x.m, y.m FROM a x, a y WHERE x.m <> 'audio/mpeg' OR y.m <> 'audio/mpeg'
UNION ALL SELECT x.m, y.m FROM v x, a y UNION ALL SELECT 'video/mp2t', m FROM a UNION ALL SELECT m, 'video/mp2t' FROM v
UNION ALL SELECT 'video/mp2t', m FROM v WHERE m NOT IN ('video/x-flv', 'video/3gpp') UNION ALL SELECT 'video/mp2t', 'video/mp2t'
UNION ALL SELECT 'video/x-ms-wmv', unnest(['video/mp4', 'video/webm', 'video/x-matroska', 'audio/mpeg', 'audio/aac'])
UNION ALL SELECT 'video/x-f4v', unnest(['video/mp4', 'video/webm', 'audio/mpeg', 'audio/aac'])
UNION ALL SELECT unnest(['audio/x-ms-wma', 'audio/aiff']), o FROM (SELECT unnest(['audio/mpeg', 'audio/mp4', 'audio/flac', 'audio/wav', 'audio/ogg', 'audio/aac']) AS o)
UNION ALL SELECT unnest(['audio/wav', 'audio/flac']), 'audio/aiff'
UNION ALL SELECT m, m FROM (VALUES ('image/vnd.adobe.photoshop'), ('image/x-blp'), ('image/vnd.ms-dds'), ('application/postscript'), ('image/jp2')) AS t(m)
UNION ALL SELECT x.m, y.m FROM s x, s y)"""


@query("transcoder_allowlist", f"{_PAIRS} SELECT * FROM p")
def transcoder_allowlist(spark, sf_dir):
    cap = planner.capabilities(spark, True).where("backend = 'transcoder'").select("in_mime", "out_mime")
    more = spark.createDataFrame([(a, b) for a in planner.FALLBACK_SUBTITLES for b in planner.FALLBACK_SUBTITLES], cap.schema)
    return cap.unionByName(more)


_ARGV = [("video/mp4", "video", None, None, "-hide_banner -nostdin -y -i in -c:v libx264 -crf 15 -c:a aac -b:a 320k out"), ("video/webm", "video", "av1", 0.5, "-hide_banner -nostdin -y -i in -c:v libaom-av1 -crf 32 -c:a libopus -b:a 128k out"),
         ("audio/mpeg", "audio", None, 1.0, "-hide_banner -nostdin -y -i in -vn -c:a libmp3lame -q:a 0 out"), ("audio/flac", "audio", None, 0.1, "-hide_banner -nostdin -y -i in -vn -c:a flac out"),
         ("video/mp4", "video", "mp3", 0.5, None), ("audio/aac", "audio", "odd", None, None), ("audio/ogg", "audio", "OPUS", 0.2, "-hide_banner -nostdin -y -i in -vn -c:a libopus -b:a 32k out")]
_SQL_ARGV = ", ".join("('%s', %s, %s, %s)" % (m, f"'{c}'" if c else "NULL", q if q is not None else "NULL", f"'{w}'" if w else "NULL") for m, _, c, q, w in _ARGV)


@query("transcoder_argv", f"SELECT mime, codec, quality::DOUBLE AS quality, argv FROM (VALUES {_SQL_ARGV}) AS t(mime, codec, quality, argv)")
def transcoder_argv(spark, sf_dir):
    df = spark.createDataFrame([a[:4] for a in _ARGV], "mime string, category string, codec string, quality double")
    line = planner.argv(F.lit("in"), F.lit("out"), F.col("mime"), F.col("category"), F.col("codec"), F.col("quality"))
    return df.select("mime", "codec", "quality", F.when(line.isNotNull(), F.array_join(line, " ")).alias("argv"))


@query("security_pages", """SELECT page_id, contains(html, '<!ENTITY') AS has_entity, contains(html, '<!DOCTYPE') AS has_doctype, regexp_matches(html, '(?i)<script') AS has_script,
regexp_matches(html, '(?i)<foreignObject') AS has_foreign_object, regexp_matches(html, '(?:xlink:)?href\\s*=\\s*["'']([^"''#][^"'']*)["'']') AS has_external_href FROM pages""")
def security_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in security.svg_flags(F.col("html")).items()])


@query("security_verdicts", """SELECT coalesce(CASE WHEN contains(html, '<!ENTITY') THEN 'ENTITY' WHEN contains(html, '<!DOCTYPE') THEN 'DOCTYPE' WHEN regexp_matches(html, '(?i)<script') THEN 'SCRIPT' END, 'OK') AS error_code,
count(*) AS n FROM (SELECT replace(html, '<!DOCTYPE', '') AS html FROM pages) GROUP BY 1""")
def security_verdicts(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(F.replace("html", F.lit("<!DOCTYPE"), F.lit("")).alias("html"))
    return t.select(F.coalesce(security.svg_error(F.col("html")), F.lit("OK")).alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))


IMAGE_HEADS: list[tuple[str, bytes, str | None, str | None]] = [
    ("pcx", b"\x0a\x05\x01\x08" + bytes(124), "pcx", None), ("short pcx", b"\x0a\x05\x01", None, None), ("icns", b"icns\0\0\0\x08", "icns", None), ("tiff", b"II*\0", "tiff", None), ("tiff be", b"MM\0*", "tiff", None),
    ("ppm", b"P6 1 1", "ppm", None), ("xpm", b"/* XPM */", "xpm", None), ("xbm", b"#define a_width 1", "xbm", None), ("tga footer", bytes(8) + b"TRUEVISION-XFILE.\0", "tga", None),
    ("tga 2", bytes(40) + b"TRUEVISION-XFILE.\0", "tga", None), ("tga header", bytes([0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0, 4, 0, 24, 0]), "tga", None), ("gif", b"GIF89a" + bytes(9), None, "gif"), ("apng", _png("IHDR", "acTL"), None, "apng"),
    ("png", _png("IHDR", "IDAT"), None, None), ("webp", b"RIFF\0\0\0\0WEBPVP8X" + bytes(4) + b"\x02" + bytes(9), None, "webp"), ("still webp", b"RIFF\0\0\0\0WEBPVP8X" + bytes(14), None, None),
]
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"


@query("detect_images", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_TEXT(i)}, {_TEXT(a)})" for n, _, i, a in IMAGE_HEADS) + ") AS t(name, image, animation)")
def detect_images(spark, sf_dir):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _, _ in IMAGE_HEADS], "name string, content binary")
    return df.select("name", detect.detect_image(F.col("content")).alias("image"), detect.detect_animation(F.col("content")).alias("animation"))


_LINES = [("  Duration: 00:01:40.50, start: 0", 100.5, None), ("frame= 10 time=00:00:50.25 bitrate", None, 50.25), ("time=N/A", None, None), ("noise", None, None)]


@query("transcoder_progress", "SELECT * FROM (VALUES " + ", ".join(f"('{line}', {d if d else 'NULL'}::DOUBLE, {t if t else 'NULL'}::DOUBLE)" for line, d, t in _LINES) + ") AS t(line, duration, reached)")
def transcoder_progress(spark, sf_dir):
    df = spark.createDataFrame([(x[0],) for x in _LINES], "line string")
    return df.select("line", planner.progress_seconds(F.col("line"), "Duration:").alias("duration"), planner.progress_seconds(F.col("line"), "time=").alias("reached"))


_ENTRY_NAMES = {"a/b": None, "../a": "ENTRY_NAME_TRAVERSAL", "a/../b": "ENTRY_NAME_TRAVERSAL", "a..b": None, "/a": "ENTRY_NAME_ABSOLUTE", "c:a": "ENTRY_NAME_DRIVE", "": "ENTRY_NAME_EMPTY", "a/..": "ENTRY_NAME_TRAVERSAL", "..": "ENTRY_NAME_TRAVERSAL"}


@query("security_entry_names", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_TEXT(e)})" for n, e in _ENTRY_NAMES.items()) + ") AS t(name, error_code)")
def security_entry_names(spark, sf_dir):
    df = spark.createDataFrame([(n,) for n in _ENTRY_NAMES], "name string")
    return df.select("name", security.entry_name_error(F.col("name")).alias("error_code"))


@query("codec_functions", """SELECT p_partkey, 'avc1.' || upper(printf('%02x%02x%02x', p_partkey % 256, p_size, 30)) AS avc, p_partkey % 10000 AS vint, 'mp4a.40.' || p_size % 32 AS aac,
make_timestamp(1980 + p_size, 1 + p_partkey % 12, 1 + p_partkey % 28, p_partkey % 24, p_partkey % 60, (p_partkey % 30 * 2)::DOUBLE) AS stamp, p_partkey AS number FROM part""")
def codec_functions(spark, sf_dir):
    from formloom.functions import codecs as c

    k, z = F.col("p_partkey"), F.col("p_size")
    sps = F.unhex(F.format_string("67%02x%02x1e", k % 256, z))
    coded = F.unhex(F.format_string("%06x", (k % 10_000 + (1 << 21))))
    date, time = (z * 512 + (1 + k % 12) * 32 + 1 + k % 28).cast("int"), (k % 24 * 2048 + k % 60 * 32 + k % 30).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", c.avc_string(sps).alias("avc"), c.vint(coded).alias("vint"), c.aac_string(F.unhex(F.format_string("%02x10", z % 32 * 8))).alias("aac"),
                                               c.dos_timestamp(date, time).alias("stamp"), c.octal(F.concat(F.lpad(F.conv(k, 10, 8), 11, "0"), F.lit("\x00"))).alias("number"))


@query("codec_strings_video", """SELECT p_partkey, 'av01.' || p_size % 3 || '.' || lpad((p_size % 24)::VARCHAR, 2, '0') || CASE WHEN p_size % 2 = 1 THEN 'H' ELSE 'M' END || '.' || CASE WHEN p_size % 4 >= 2 THEN '10' ELSE '08' END AS av1,
'vp09.' || lpad((p_size % 4)::VARCHAR, 2, '0') || '.31.08.01.02.02.02.0' || p_size % 2 AS vp9, 'hvc1.' || 1 + p_size % 2 || CASE WHEN p_size % 2 = 0 THEN '.6.L' ELSE '.4.L' END || 90 + p_size || '.b0' AS hevc FROM part""")
def codec_strings_video(spark, sf_dir):
    """Strings of configuration records made of a part's size; the compatibility flags are those of the profiles Main and Main 10."""
    from formloom.functions import codecs as c

    z, byte = F.col("p_size"), lambda c: F.format_string("%02x", c.cast("int"))
    av1 = F.concat(F.lit("81"), byte(z % 3 * 32 + z % 24), byte(z % 2 * 128 + F.floor(z % 4 / 2) * 64), F.lit("00"))
    vp9 = F.concat(byte(z % 4), F.lit("1f"), byte(0x82 + z % 2), F.lit("0202020000"))
    hevc = F.concat(F.lit("01"), byte(1 + z % 2), F.when(z % 2 == 0, "60000000").otherwise("20000000"), F.lit("b00000000000"), byte(90 + z), F.lit("f000"))
    return table(spark, sf_dir, "part").select("p_partkey", c.av1_string(F.unhex(av1)).alias("av1"), c.vp9_config_string(F.unhex(vp9)).alias("vp9"), c.hevc_string(F.unhex(hevc)).alias("hevc"))


_SUBTITLE_HEADS = ["WEBVTT", "[Script Info]\\nScriptType: v4.00+", "[Script Info]\\nScriptType: v4.00", "{1}{2}a", "[1][2]a", "1\\n00:00:01,000 --> 00:00:02,000\\na", "none"]


@query("detect_subtitles", """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'text/vtt' WHEN 1 THEN 'text/x-ass' WHEN 2 THEN 'text/x-ssa' WHEN 3 THEN 'text/x-microdvd' WHEN 4 THEN 'text/x-mpl2' WHEN 5 THEN 'application/x-subrip' END AS mime
FROM documents WHERE doc_id % 7 < 6 OR NOT regexp_matches(text, '(WEBVTT|Script Info|-->)')""")
def detect_subtitles(spark, sf_dir):
    heads = F.array(*[F.expr(f"'{h}'") for h in _SUBTITLE_HEADS])
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.element_at(heads, (F.col("doc_id") % 7 + 1).cast("int")), F.lit("\n"), F.col("text")).alias("t"))
    return d.where("doc_id % 7 < 6 OR NOT text RLIKE '(WEBVTT|Script Info|-->)'").select("doc_id", detect.detect_subtitle(F.col("t")).alias("mime"))
