"""Queries that build files of the tables' rows and read them back: SQL over the tables is what must come out."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.codecs import animation, archive, audio, ebml, image, markup, mp4, ogg, ts
from formloom.operators import timeline
from formloom.registry import query, table
from formloom.sinks import files as sink
from formloom.sinks.subtitle import by_file
from formloom.sources import files as source


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", "text")


#: An archive holds the documents of a bounded range of ids.
_ARCHIVE = ["source", "part"]


def _parted(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("part", F.floor(F.col("doc_id") / 1000))


def _entries(f):
    return [(f"d{i % 7}/{i}.txt", t.encode(), None) for i, t in zip(f["doc_id"], f["text"], strict=True)]


_ENTRY_SQL = "SELECT source, doc_id // 1000 AS part, 'd' || doc_id % 7 || '/' || doc_id || '.txt' AS name, strlen(text)::BIGINT AS size, md5(text) AS data_md5 FROM documents"


def _opened(files, fmt):
    return source.read(files, fmt, _ARCHIVE).select(*_ARCHIVE, "name", "size", F.md5("data").alias("data_md5"))


@query("archive_zip_roundtrip", _ENTRY_SQL)
def archive_zip_roundtrip(spark, sf_dir):
    return _opened(sink.build(_parted(spark, sf_dir), _ARCHIVE, "doc_id", lambda f: archive.build_zip(_entries(f))), "zip")


@query("archive_tar_gz_roundtrip", _ENTRY_SQL)
def archive_tar_gz_roundtrip(spark, sf_dir):
    return _opened(sink.build(_parted(spark, sf_dir), _ARCHIVE, "doc_id", lambda f: archive.gzip(archive.build_tar(_entries(f)))), "archive")


@query("archive_gzip_roundtrip", "SELECT doc_id, md5(text) AS data_md5 FROM documents")
def archive_gzip_roundtrip(spark, sf_dir):
    files = sink.build_each(_docs(spark, sf_dir), ["doc_id"], "text", lambda t: archive.gzip(t.encode()))
    return source.read(files, "gz", ["doc_id"], mode="quarantine").select("doc_id", F.coalesce(F.md5("data"), F.col("error_code")).alias("data_md5"))


def _levels(spark, sf_dir):
    """Pixels and samples: one file per thousand orders, so files stay small however many there are."""
    w = Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    t = table(spark, sf_dir, "lineitem").withColumn("file", F.floor(F.col("l_orderkey") / 1000))
    return t.select("file", F.row_number().over(w).alias("i"), (F.col("l_partkey") % 256).alias("v"), F.col("l_quantity").cast("int").alias("q"))


_LEVELS = """v AS (SELECT l_orderkey // 1000 AS file, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i, l_partkey % 256 AS v FROM lineitem)"""


@query("audio_wav_roundtrip", f"WITH {_LEVELS} SELECT file, 8000 AS sample_rate, count(*) AS n_frames, sum(v - 128)::BIGINT AS total FROM v GROUP BY file")
def audio_wav_roundtrip(spark, sf_dir):
    files = sink.build(_levels(spark, sf_dir), ["file"], "i", lambda f: audio.build_wav((f["v"].to_numpy() - 128).astype("<i2").tobytes(), 8000, 1, 16))

    @F.pandas_udf("long")
    def total(s: pd.Series) -> pd.Series:
        return s.map(lambda b: int(np.frombuffer(b, "<i2").sum()))

    return source.read(files, "wav", ["file"]).select("file", "sample_rate", "n_frames", total("samples").alias("total"))


@query("audio_wav_chunks", "SELECT p_partkey, 'note' AS id, md5(p_name) AS payload_md5, 4::BIGINT AS n_frames FROM part")
def audio_wav_chunks(spark, sf_dir):
    """A chunk that no reader knows outlives a pass through the format."""
    from formloom.plans.convert import canonical

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    files = sink.build(p, ["p_partkey"], "name", lambda f: audio.build_wav(bytes(8), 8000, 1, 16, extras=[("note", f["name"].iloc[0].encode())]))
    kept = canonical(files, "wav", ["p_partkey"]).drop("error_code")
    notes = source.read(kept, "wav_chunks", ["p_partkey"]).where("id = 'note'").select("p_partkey", "id", F.md5("payload").alias("payload_md5"))
    return notes.join(source.read(kept, "wav", ["p_partkey"]).select("p_partkey", "n_frames"), "p_partkey")


@query("svg_sizes", "SELECT p_partkey, (p_size + 1)::DOUBLE AS width, p_partkey::DOUBLE AS height, '0 0 ' || p_size || ' 9' AS view_box, NULL::VARCHAR AS error_code FROM part WHERE p_size % 5 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'SVG_SCRIPT' FROM part WHERE p_size % 5 = 0")
def svg_sizes(spark, sf_dir):
    """Every fifth size brings a script, which refuses the file."""
    text = """format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%dpx" height="%d" viewBox="0 0 %d 9">%s</svg>', p_size + 1, p_partkey, p_size, if(p_size % 5 = 0, '<script/>', '<g/>'))"""
    # Dealt while rows are short: a small table is read by one task, and its files would be parsed there.
    parts = by_file(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    files = parts.select("p_partkey", F.expr(text).cast("binary").alias("content"))
    return source.read(files, "svg", ["p_partkey"], mode="quarantine").select("p_partkey", "width", "height", "view_box", "error_code")


@query("audio_frames_canonical", "SELECT conv_id, count(*) AS n_frames FROM conversations GROUP BY conv_id")
def audio_frames_canonical(spark, sf_dir):
    """Junk before, between and after frames goes when a file is written anew; the frames stay."""
    from formloom.plans.convert import canonical

    def make(f):
        one = audio.build_mp3([b"x"])
        return b"ID3\4\0\0\0\0\0\3abc" + b"".join(b"junk" + one for _ in range(len(f))) + b"tail"

    files = canonical(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make), "mp3", ["conv_id"]).drop("error_code")
    size = len(audio.build_mp3([b"x"]))
    return files.select("conv_id", ((F.octet_length("content") - 13) / size).cast("long").alias("n_frames")).where(F.col("n_frames") > 0)


_WIDE = 64


def _images(fmt: str, channels: int, depth: int = 8):
    """All values of a file as an image of 64 columns; the last row is filled up with zeros."""

    def make(f):
        v = f["v"].to_numpy().astype(np.int64)
        v = np.pad(v, (0, -len(v) % (_WIDE * channels)))
        if depth == 1:
            v = v & 1
        if fmt == "xpm":  # its pixels are opaque or not there at all
            v = v.reshape(-1, 4)
            v[: -(-len(f) // 4), 3] = 255
        raw = v.astype(">f4" if depth == 32 else ">u2" if depth == 16 else np.uint8).tobytes()
        return image.BUILD[fmt](image.Image(_WIDE, v.size // (_WIDE * channels), channels, depth, raw))

    return make


#: Format, channels and depth of each image that the query builds.
_IMAGE_KINDS = [("pbm", 1, 1), ("pgm", 1, 8), ("pgm", 1, 16), ("ppm", 3, 8), ("pfm", 1, 32), ("qoi", 3, 8), ("qoi", 4, 8), ("bmp", 3, 8), ("tga", 3, 8), ("pcx", 3, 8), ("tiff", 1, 8), ("tiff", 3, 8), ("xbm", 1, 1), ("xpm", 4, 8)]


def _image_sql() -> str:
    own = {1: "v & 1", 8: "v", 16: "v", 32: "v"}
    own |= {"xpm": "v"}
    own = {(k, d): own.get(k, own[d]) for k, _, d in _IMAGE_KINDS}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS kind, file, {c} AS channels, {d} AS bit_depth, sum({own[k, d]})::DOUBLE AS total, sum(({own[k, d]}) * i)::DOUBLE AS placed FROM {'x' if k == 'xpm' else 'v'} GROUP BY file" for k, c, d in _IMAGE_KINDS)
    # Alpha values are 255, of the last pixel too if it was begun.
    alpha = "x AS (SELECT file, i, CASE WHEN i % 4 = 0 THEN 255 ELSE v END AS v FROM v UNION ALL SELECT file, (4 * ceil(max(i) / 4))::BIGINT, 255 FROM v GROUP BY file HAVING max(i) % 4 <> 0)"
    return f"WITH {_LEVELS}, {alpha} {rows}"


@query("image_roundtrips", _image_sql())
def image_roundtrips(spark, sf_dir):
    v = _levels(spark, sf_dir)

    @F.pandas_udf("array<double>")
    def sums(px: pd.Series, depth: pd.Series) -> pd.Series:
        def one(b, d):
            x = np.frombuffer(b, ">f4" if d == 32 else ">u2" if d == 16 else np.uint8).astype(np.float64)
            return [float(x.sum()), float((x * np.arange(1, len(x) + 1)).sum())]

        return px.combine(depth, one)

    out = None
    for k, c, d in _IMAGE_KINDS:
        make = _images(k, c, d)
        got = source.read(sink.build(v, ["file"], "i", make), k, ["file"]).withColumn("s", sums("pixels", "bit_depth"))
        got = got.select(F.lit(k).alias("kind"), "file", "channels", "bit_depth", F.col("s")[0].alias("total"), F.col("s")[1].alias("placed"))
        out = got if out is None else out.unionByName(got)
    return out


def _talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("body"), F.char_length("text").alias("n"))


@query("audio_ogg_roundtrip", "SELECT conv_id, (turn + 2)::INT AS ordinal, 'opus' AS codec, md5(text) AS body_md5 FROM conversations")
def audio_ogg_roundtrip(spark, sf_dir):
    files = sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", lambda f: ogg.build([ogg.opus_head(), *map(bytes, f["body"])], serial=int(f["conv_id"].iloc[0]) + 1))
    return source.read(files, "ogg", ["conv_id"]).where("ordinal > 1").select("conv_id", "ordinal", "codec", F.md5("packet").alias("body_md5"))


@query("video_mkv_roundtrip", "SELECT conv_id, (turn + 1)::INT AS ordinal, (1 + turn % 2)::INT AS track, turn * 20000000 AS timestamp_us, turn % 2 = 0 AS is_keyframe, md5(text) AS body_md5 FROM conversations")
def video_mkv_roundtrip(spark, sf_dir):
    make = lambda f: ebml.build([(1 + t % 2, t * 20_000, t % 2 == 0, bytes(b)) for t, b in zip(f["turn"], f["body"], strict=True)], [(1, "video", "V_VP9"), (2, "audio", "A_OPUS")])
    got = source.read(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make), "mkv", ["conv_id"])
    return got.select("conv_id", "ordinal", "track", "timestamp_us", "is_keyframe", F.md5("payload").alias("body_md5"))


@query("video_mkv_tracks", "SELECT DISTINCT conv_id, t.number, t.kind, t.codec FROM conversations, (VALUES (1, 'video', 'V_VP9'), (2, 'audio', 'A_OPUS')) AS t(number, kind, codec)")
def video_mkv_tracks(spark, sf_dir):
    make = lambda f: ebml.build([(1 + int(t) % 2, int(t), True, bytes(b)) for t, b in zip(f["turn"], f["body"], strict=True)], [(1, "video", "V_VP9"), (2, "audio", "A_OPUS")], "webm")
    return source.read(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make), "mkv_tracks", ["conv_id"]).drop("error_code")


@query("video_ts_roundtrip", "SELECT conv_id, 257 AS pid, (turn + 1)::INT AS ordinal, turn * 3600 AS pts, md5(text) AS body_md5 FROM conversations")
def video_ts_roundtrip(spark, sf_dir):
    make = lambda f: ts.build([(257, int(t) * 3600, bytes(b)) for t, b in zip(f["turn"], f["body"], strict=True)], {257: ts.H264})
    got = source.read(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make), "ts", ["conv_id"])
    return got.select("conv_id", "pid", "ordinal", "pts", F.md5("payload").alias("body_md5"))


@query("video_ts_counters", "SELECT conv_id, 0 AS n_gaps FROM conversations GROUP BY conv_id")
def video_ts_counters(spark, sf_dir):
    make = lambda f: ts.build([(257, 0, bytes(b)) for b in f["body"]], {257: ts.H264})
    p = source.read(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make), "ts_packets", ["conv_id"])
    gaps = timeline.counter_gaps(p.where("length(payload) > 0"), ["conv_id", "pid"], "ordinal", "counter")
    return p.select("conv_id").distinct().join(gaps.groupBy("conv_id").agg(F.count("*").alias("g")), "conv_id", "left").select("conv_id", F.coalesce("g", F.lit(0)).cast("int").alias("n_gaps"))


_PIECE = 400


def _pieces(f) -> list[bytes]:
    whole = b"".join(map(bytes, f["body"]))
    return [whole[i : i + _PIECE] for i in range(0, len(whole), _PIECE)]


@query("audio_frames_roundtrip", """SELECT k.kind, conv_id, ceil(sum(strlen(text)) / 400)::BIGINT AS n_frames, md5(string_agg(text, '' ORDER BY turn)) AS body_md5 FROM conversations, (VALUES ('aac'), ('flac'), ('mp3')) AS k(kind) GROUP BY 1, 2""")
def audio_frames_roundtrip(spark, sf_dir):
    """A talk's whole text dealt to frames, and put together again from them."""
    t = _talk(spark, sf_dir)
    make = {"aac": lambda f: audio.build_adts(_pieces(f)), "flac": lambda f: audio.build_flac(_pieces(f)), "mp3": lambda f: audio.build_mp3([len(p).to_bytes(2) + p for p in _pieces(f)])}
    body = {"aac": "payload", "flac": "substring(payload, cast(length(payload) - 2 - (length(payload) - 8 - CASE WHEN number < 128 THEN 0 WHEN number < 2048 THEN 1 ELSE 2 END) + 1 AS int), length(payload) - 8 - CASE WHEN number < 128 THEN 0 WHEN number < 2048 THEN 1 ELSE 2 END)",
            "mp3": "substring(payload, 7, cast(conv(hex(substring(payload, 5, 2)), 16, 10) AS int))"}
    out = None
    for k, m in make.items():
        got = source.read(sink.build(t, ["conv_id"], "turn", m), k, ["conv_id"]).select("conv_id", "ordinal", F.lit(k).alias("kind"), (F.col("ordinal") == 1).alias("begins"), F.expr(body[k]).alias("payload"))
        got = timeline.reassembled(got, ["kind", "conv_id"], "ordinal", "begins", "payload")
        got = got.select("kind", "conv_id", F.col("n_parts").alias("n_frames"), F.md5("payload").alias("body_md5"))
        out = got if out is None else out.unionByName(got)
    return out


@query("video_mp4_samples", """WITH c AS (SELECT conv_id, turn, text, strlen(text) AS size, coalesce(sum(1000 + turn % 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM conversations)
SELECT conv_id, turn + 1 AS sample, 'video' AS kind, size::BIGINT AS size, t / 90000 * 1e6::DOUBLE AS timestamp_us, turn % 2 = 0 AS is_keyframe, md5(text) AS body_md5 FROM c""")
def video_mp4_samples(spark, sf_dir):
    """The run-length tables become samples by windows; payloads are cut out of the file at the end."""

    def make(f):
        return mp4.build([{"id": 1, "kind": "video", "codec": "avc1", "timescale": 90_000, "samples": [*map(bytes, f["body"])], "deltas": [1000 + int(t) % 3 for t in f["turn"]], "sync": [int(t) + 1 for t in f["turn"] if t % 2 == 0]}])

    files = sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make)
    rows, k = source.read(files, "mp4", ["conv_id"]), ["conv_id", "track"]
    part = lambda name, **cols: rows.where(F.col("table") == name).select(*k, *[F.col(v).alias(c) for c, v in cols.items()])
    s = timeline.sample_table(part("stts", ordinal="ordinal", count="a", delta="b"), part("stsc", first_chunk="a", samples_per_chunk="b"), rows.where("table = 'stsz'").select(*k, F.col("ordinal").cast("long").alias("sample"), F.col("a").alias("size")),
                              part("stco", chunk="ordinal", offset="a"), part("stss", sample="a"), k)
    info = rows.select(*k, "kind", "timescale").distinct()
    s = timeline.sample_times(s.join(info, k), k, "sample", "delta", F.col("timescale")).join(files, "conv_id")
    return s.select("conv_id", "sample", "kind", "size", "timestamp_us", "is_keyframe", F.md5(F.expr("substring(content, cast(offset + 1 AS int), cast(size AS int))")).alias("body_md5"))


@query("video_mp4_fragments", "SELECT conv_id, (1 + turn // 2)::INT AS fragment, (1 + turn % 2)::INT AS ordinal, CASE WHEN turn % 4 < 2 THEN 20 + turn % 2 ELSE 1024 END AS duration, strlen(text)::BIGINT AS size FROM conversations")
def video_mp4_fragments(spark, sf_dir):
    def make(f):
        runs = {}
        for t, b in zip(f["turn"], f["body"], strict=True):
            runs.setdefault(int(t) // 2, []).append((20 + int(t) % 2 if t % 4 < 2 else None, bytes(b)))
        return mp4.build_fragmented(1, 48_000, 1024, list(runs.values()))

    files = sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", make)
    runs, d = source.read(files, "mp4_fragments", ["conv_id"]), source.read(files, "mp4_defaults", ["conv_id"])
    out = timeline.cascade(runs, [d.where("level = 'traf'"), d.where("level = 'trex'")], [["conv_id", "track", "fragment"], ["conv_id", "track"]], ["duration"])
    return out.select("conv_id", "fragment", "ordinal", "duration", "size")


def _frames(f) -> tuple[int, list]:
    """A talk's canvas height and frames: a turn's text as rows of 64 bytes, filled up with spaces."""
    out = []
    for t, b in zip(f["turn"], f["body"], strict=True):
        px = bytes(b) or b" "
        px += b" " * (-len(px) % 64)
        out.append((0, 0, 64, len(px) // 64, 10 * (int(t) + 1), 0, 0, px))
    return max(r[3] for r in out), out


@query("animation_roundtrips", """SELECT k.kind, conv_id, (turn + 1)::INT AS ordinal, (10 * (turn + 1))::INT AS duration_ms, 64 AS width, md5(text || repeat(' ', CASE WHEN text = '' THEN 64 ELSE (64 - strlen(text) % 64) % 64 END)) AS pixels_md5
FROM conversations, (VALUES ('gif'), ('apng'), ('webp')) AS k(kind)""")
def animation_roundtrips(spark, sf_dir):
    grey = bytes(x for i in range(256) for x in (i, i, i))

    def gif(f):
        high, frames = _frames(f)
        return animation.build_gif(64, high, grey, [(x, y, w, h, ms, d, px) for x, y, w, h, ms, d, _, px in frames])

    def other(build):
        return lambda f: build(64, *_frames(f))

    out = None
    for kind, m in {"gif": gif, "apng": other(animation.build_apng), "webp": other(animation.build_webp)}.items():
        got = source.read(sink.build(_talk(spark, sf_dir), ["conv_id"], "turn", m), kind, ["conv_id"])
        got = got.select(F.lit(kind).alias("kind"), "conv_id", "ordinal", "duration_ms", "width", F.md5("payload").alias("pixels_md5"))
        out = got if out is None else out.unionByName(got)
    return out


@query("image_ico_icns", "SELECT conv_id, (turn + 1)::INT AS ordinal, md5(text) AS body_md5, k.kind FROM conversations, (VALUES ('ico'), ('icns')) AS k(kind)")
def image_ico_icns(spark, sf_dir):
    t = _talk(spark, sf_dir)
    ico = source.read(sink.build(t, ["conv_id"], "turn", lambda f: image.build_ico([(16, 16, bytes(b)) for b in f["body"]])), "ico", ["conv_id"])
    icns = source.read(sink.build(t, ["conv_id"], "turn", lambda f: image.build_icns([("ic07", bytes(b)) for b in f["body"]])), "icns", ["conv_id"])
    pick = lambda d, k: d.select("conv_id", "ordinal", F.md5("payload").alias("body_md5"), F.lit(k).alias("kind"))
    return pick(ico, "ico").unionByName(pick(icns, "icns"))


@query("tree_toml_yaml", """SELECT k.kind, o_custkey, '$.' || CASE WHEN k.kind = 'yaml' THEN 'o' ELSE 'o' END || o_orderkey || '.' || f.name AS path, f.value, f.type FROM orders, (VALUES ('toml'), ('yaml')) AS k(kind),
LATERAL (VALUES ('priority', o_orderpriority, 'string'), ('n', o_orderkey::VARCHAR, 'integer'), ('open', (o_orderstatus = 'O')::VARCHAR, 'boolean')) AS f(name, value, type)""")
def tree_toml_yaml(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    tree = lambda f: {f"o{k}": {"priority": p, "n": int(k), "open": s == "O"} for k, p, s in zip(f["o_orderkey"], f["o_orderpriority"], f["o_orderstatus"], strict=True)}
    toml = source.read(sink.build(o, ["o_custkey"], "o_orderkey", lambda f: markup.build_toml(tree(f)).encode()), "toml", ["o_custkey"])
    yaml = source.read(sink.build(o, ["o_custkey"], "o_orderkey", lambda f: markup.build_yaml(tree(f)).encode()), "yaml", ["o_custkey"])
    pick = lambda d, k: d.select(F.lit(k).alias("kind"), "o_custkey", "path", "value", "type")
    return pick(toml, "toml").unionByName(pick(yaml, "yaml"))


@query("tree_xml", "SELECT conv_id, (turn + 2)::INT AS node_id, 1 AS parent_id, 'turn' AS name, text, role FROM conversations")
def tree_xml(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    make = lambda f: markup.build_xml([(1, 0, "talk", "", {}), *[(int(t) + 2, 1, "turn", x, {"role": r, "id": str(t)}) for t, r, x in zip(f["turn"], f["role"], f["text"], strict=True)]]).encode()
    return source.read(sink.build(c, ["conv_id"], "turn", make), "xml", ["conv_id"]).where("node_id > 1").select("conv_id", "node_id", "parent_id", "name", "text", F.col("attributes")["role"].alias("role"))


@query("xml_pages_refused", "SELECT page_id, 'XML_DOCTYPE' AS error_code FROM pages")
def xml_pages_refused(spark, sf_dir):
    return source.read(table(spark, sf_dir, "pages"), "xml", ["page_id"], "html", "quarantine").select("page_id", "error_code")


@query("quarantine_documents", "SELECT doc_id, 'ZIP_NO_EOCD' AS error_code FROM documents")
def quarantine_documents(spark, sf_dir):
    return source.read(_docs(spark, sf_dir), "zip", ["doc_id"], "text", "quarantine").select("doc_id", "error_code")




@query("checksums", "SELECT * FROM (VALUES ('crc8', 244), ('crc16', 65256), ('crc32', 3421780262), ('ogg', 2309065087), ('psi', 58124007)) AS t(name, value)")
def checksums(spark, sf_dir):
    """Check values of the digits 1 to 9; the table's are the published ones."""
    from formloom.codecs import checksums as c

    fs = {"crc8": c.crc8, "crc16": c.crc16, "ogg": c.crc32_ogg, "psi": c.crc32_psi}

    @F.pandas_udf("long")
    def other(name: pd.Series) -> pd.Series:
        return name.map(lambda n: fs[n](b"123456789") if n in fs else None)

    df = spark.createDataFrame([(n,) for n in ("crc8", "crc16", "crc32", "ogg", "psi")], "name string")
    return df.select("name", F.when(F.col("name") == "crc32", F.crc32(F.lit("123456789").cast("binary"))).otherwise(other("name")).alias("value"))
