"""Byte formats: round trips, hostile inputs, and no exception but typed ones for cut or altered files."""

import hashlib
import io
import random
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formloom.codecs import animation, archive, audio, ebml, image, mp4, ogg, ts
from formloom.codecs import checksums as crc
from formloom.errors import FormatError
from formloom.sources.files import FORMATS, read

RNG = random.Random(5)
BODIES = [bytes(RNG.randrange(256) for _ in range(n)) for n in (0, 1, 254, 255, 256, 700, 3000)]


def fails(code, f):
    with pytest.raises(FormatError) as e:
        f()
    assert e.value.code == code


def test_zip_against_the_standard_library():
    data = archive.build_zip([("a/b.txt", b"hello" * 50, None), ("c", b"", None), ("d/", b"", None)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"hello" * 50
    assert [(e[0], e[1], e[6]) for e in archive.zip_entries(data)] == [("a/b.txt", False, b"hello" * 50), ("c", False, b""), ("d/", True, None)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"y" * 100)
    assert next(archive.zip_entries(buf.getvalue()))[6] == b"y" * 100


def test_zip_refuses():
    bad = bytearray(archive.build_zip([("a", b"hello", None)], deflate=False))
    bad[35] ^= 1
    fails("ZIP_CRC_MISMATCH", lambda: list(archive.zip_entries(bytes(bad))))
    assert len(list(archive.zip_entries(bytes(bad), with_data=False))) == 1  # checksums count only where data is read
    fails("ZIP_NO_EOCD", lambda: list(archive.zip_entries(b"nothing")))
    fails("ZIP_BOMB", lambda: list(archive.zip_entries(archive.build_zip([("a", bytes(10_000_000), None)]))))
    for name, code in (("../x", "ENTRY_NAME_TRAVERSAL"), ("/x", "ENTRY_NAME_ABSOLUTE"), ("c:x", "ENTRY_NAME_DRIVE"), ("a\0", "ENTRY_NAME_NUL"), ("a\\..\\b", "ENTRY_NAME_TRAVERSAL"), ("", "ENTRY_NAME_EMPTY")):
        fails(code, lambda name=name: archive.safe_name(name))


def test_tar_against_the_standard_library():
    long = "d" * 90 + "/" + "n" * 90
    data = archive.build_tar([("a", b"x" * 600, None), (long, b"y", None), ("e/", b"", None)])
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert t.getnames() == ["a", long, "e"] and t.extractfile("a").read() == b"x" * 600
    assert [e[0] for e in archive.archive_entries(archive.gzip(data))] == ["a", long, "e/"]
    bad = bytearray(data)
    bad[0] ^= 1
    fails("TAR_CHECKSUM", lambda: list(archive.tar_entries(bytes(bad))))
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.GNU_FORMAT) as t:
        t.addfile(tarfile.TarInfo("x"))
    fails("TAR_NOT_USTAR", lambda: list(archive.tar_entries(buf.getvalue())))


def test_gzip_members():
    fails("GZIP_MULTI_MEMBER", lambda: archive.gunzip(archive.gzip(b"a") + archive.gzip(b"b")))
    fails("BZIP2_NOT_SUPPORTED", lambda: list(archive.archive_entries(b"BZh9")))
    fails("SIZE_CAP", lambda: archive.gunzip(archive.gzip(bytes(1000)), 999))


def test_gzip_magic_within_a_stream_is_no_member():
    magic = b"\x1f\x8b\x08"
    tar = archive.build_tar([("a", b"x" + magic + b"y", None)])
    packed = archive.gzip(tar, level=0)  # stored, so the magic is in the file as it is
    assert magic in packed[10:] and [(e[0], e[6]) for e in archive.archive_entries(packed)] == [("a", b"x" + magic + b"y")]
    assert archive.gunzip(archive.gzip(magic * 3, level=0)) == (None, magic * 3)
    fails("GZIP_MULTI_MEMBER", lambda: archive.gunzip(packed + archive.gzip(b"b")))


def test_gzip_query_on_a_chance_magic_and_shared_ids(spark, tmp_path):
    from formloom import catalog

    # With zlib at level 6 the file of this text has the magic among its compressed bytes.
    text = "".join(hashlib.sha256(b"%d" % (42_437 * 16 + i)).hexdigest() for i in range(16))
    docs = [(1, text), (1, "same id"), (2, "same id"), (3, "")]
    spark.createDataFrame([("s", i, t) for i, t in docs], "source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["archive_gzip_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, hashlib.md5(t.encode()).hexdigest()) for i, t in docs)


def test_checksums():
    d = b"123456789"
    assert (crc.crc8(d), crc.crc16(d), crc.crc32_ogg(d), crc.crc32_psi(d)) == (0xF4, 0xFEE8, 0x89A1897F, 0x0376E6E7)


def test_wav():
    data = audio.build_wav(b"\1\2\3", 8000, 1, 8)
    assert audio.parse_wav(data) == (8000, 1, 8, "pcm", 3, b"\1\2\3") and len(data) % 2 == 0
    fails("WAV_NO_DATA", lambda: audio.parse_wav(data[:36]))
    fails("WAV_RF64", lambda: audio.parse_wav(b"RF64" + data[4:]))


def test_frames():
    own = [b for b in BODIES if len(b) < 400]
    assert [f[-1] for f in audio.adts_frames(audio.build_adts(own) + bytes(100))] == own
    assert [f[7][4 : 4 + len(p)] for f, p in zip(audio.mp3_frames(b"ID3\4\0\0\0\0\0\2xx" + audio.build_mp3(own) + b"TAG" + bytes(125)), own, strict=True)] == own
    made = audio.build_flac([*BODIES, b"\xff\xf8\xc9\x08" * 5])
    got = list(audio.flac_frames(made))
    assert [f[-1][6:-2] for f in got] == [*BODIES, b"\xff\xf8\xc9\x08" * 5] and audio.flac_info(made)[2] == 44100
    for v in (0, 127, 128, 2047, 2048, 70_000, 2**31, 2**36 - 1):
        assert audio._varint(audio.to_varint(v), 0) == (v, len(audio.to_varint(v)))
    fails("MP3_LAYER", lambda: list(audio.mp3_frames(b"\xff\xfd\x90\x00" + bytes(500))))
    fails("ADTS_MULTI_BLOCK", lambda: list(audio.adts_frames(b"\xff\xf1\x50\x80\x01\x1f\xfd" + bytes(100))))


def test_ogg_packets_cross_pages():
    big = bytes(200_000)
    data = ogg.build([ogg.opus_head(), *BODIES, big], serial=9)
    assert [p[-1] for p in ogg.packets(data)][1:] == [*BODIES, big]
    chained = data + ogg.build([ogg.opus_head(1), b"z"], serial=10)
    assert {p[0] for p in ogg.packets(chained)} == {0, 1}
    bad = bytearray(data)
    bad[-1] ^= 1
    fails("OGG_CRC", lambda: list(ogg.packets(bytes(bad))))
    one = list(ogg.pages(data))
    fails("OGG_SEQUENCE_GAP", lambda: list(ogg.packets(data[: one[1][0]] + data[one[2][0] :])))


def test_ebml_lacing():
    frames = [b"a" * 300, b"bb", b"c" * 10]
    xiph = bytes([2, 255, 45, 2]) + b"".join(frames)
    assert ebml._laced(xiph, 2) == frames
    size = ebml.to_vint(300, 2) + ebml.to_vint(2 - 300 + (1 << 13) - 1, 2)
    assert ebml._laced(bytes([2]) + size + b"".join(frames), 6) == frames
    assert ebml._laced(bytes([1]) + b"xxyy", 4) == [b"xx", b"yy"]
    assert ebml.vint(b"\xff", 0) == (-1, 1) and ebml.vint(b"\x40\x7f", 0) == (127, 2)
    data = ebml.build([(1, t * 1000, True, b) for t, b in enumerate(BODIES * 12)], [(1, "video", "V_VP9")], "webm")
    assert ebml.doc_type(data) == "webm" and [f[-1] for f in ebml.frames(data)] == BODIES * 12 and len(list(ebml.cue_points(data))) == 3


def test_ts_units_and_resync():
    units = [(257, 9000 * i, b) for i, b in enumerate(BODIES)]
    data = ts.build(units, {257: ts.H264})
    assert [(p[3], p[5]) for p in ts.pes(data)] == [(t, b) for _, t, b in units]
    assert len(list(ts.packets(b"junk" + data))) == len(data) // 188
    nal = b"\0\0\0\1\x67\x42\0\x1e\0\0\1\x68\xce"
    assert ts.to_annexb(ts.to_avcc(nal)) == b"\0\0\0\1\x67\x42\0\x1e\0\0\0\1\x68\xce" and ts.avc_codec_string(b"\x67\x42\0\x1e") == "avc1.42001E"
    assert ts.without_emulation(b"\0\0\3\1") == b"\0\0\1"


def test_mp4_boxes_and_tables():
    data = mp4.build([{"id": 7, "kind": "audio", "timescale": 1000, "samples": BODIES, "deltas": [5, 5, 5, 1, 1, 2, 2], "edits": [(10, -1), (20, 3)]}])
    t = mp4.tracks(data)[0]
    assert (t["id"], t["stts"], t["stss"], t["elst"]) == (7, [(3, 5), (2, 1), (2, 2)], None, [(10, -1), (20, 3)])
    assert [data[o : o + s] for o, s in zip(t["stco"], t["stsz"], strict=True)] == BODIES
    assert max(b[2] for b in mp4.boxes(data)) == 5
    fails("MP4_BOX_SIZE", lambda: list(mp4.boxes(b"\0\0\0\4ftyp")))
    deep = b""
    for _ in range(12):
        deep = mp4.box("moov", deep)
    fails("MP4_TOO_DEEP", lambda: list(mp4.boxes(deep)))


@pytest.mark.parametrize("fmt, c, depth", [("pbm", 1, 1), ("pgm", 1, 8), ("pgm", 1, 16), ("ppm", 3, 8), ("pfm", 3, 32), ("qoi", 3, 8), ("qoi", 4, 8), ("bmp", 3, 8), ("bmp", 4, 8), ("tga", 1, 8), ("tga", 3, 8), ("tga", 4, 8), ("pcx", 1, 8), ("pcx", 3, 8), ("tiff", 3, 8), ("tiff", 1, 16), ("xbm", 1, 1)])
@pytest.mark.parametrize("w, h", [(1, 1), (7, 5), (33, 4)])
def test_images_round_trip(fmt, c, depth, w, h):
    v = np.random.default_rng(w).integers(0, 2 if depth == 1 else 4, w * h * c) * (1 if depth == 1 else 60)
    px = v.astype(">f4" if depth == 32 else ">u2" if depth == 16 else np.uint8).tobytes()
    got = image.PARSE[fmt](image.BUILD[fmt](image.Image(w, h, c, depth, px)))
    assert (got.width, got.height, got.channels, got.bit_depth, got.pixels) == (w, h, c, depth, px)


def test_images_by_hand():
    assert image.parse_netpbm(b"P1\n# c\n3 2\n1 0 1\n010").pixels == bytes([1, 0, 1, 0, 1, 0])
    assert image.parse_netpbm(b"P3 1 1 15 1 2 15").pixels == bytes([1, 2, 15])
    fails("NETPBM_SAMPLE_RANGE", lambda: image.parse_netpbm(b"P2 1 1 7 8"))
    fails("NETPBM_SAMPLE_COUNT", lambda: image.parse_netpbm(b"P2 2 1 7 1"))
    im = image.Image(5, 3, 3, 8, bytes(range(45)))
    assert image.parse_tga(image.build_tga(im, rle=True)).pixels == im.pixels
    for packing in (1, 8, 32773):
        assert image.parse_tiff(image.build_tiff(im, packing)).pixels == im.pixels
    for d in (b"", b"aaaabc", bytes(range(200)), b"ab" * 100, b"x" * 300):
        assert image.unpack_bits(image.pack_bits(d), len(d)) == d
    x = image.parse_xpm(b'/* XPM */\nstatic char *a[] = {"2 1 2 1", "a c #f00", "b c None", "ab"};')
    assert x.pixels == bytes([255, 0, 0, 255, 0, 0, 0, 0])
    fails("IMAGE_SIZE", lambda: image.parse_netpbm(b"P5 99999 99999 255 "))
    assert [e[1:] for e in image.icns_elements(image.build_icns([("ic07", b"xyz")]))] == [("ic07", b"xyz")]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(2, 8))
def test_gif_codes(px, size):
    px = bytes(b & (1 << size) - 1 for b in px)
    assert animation.gif_lzw(animation.gif_lzw_encode(px, size), size, len(px)) == px


def test_gif_codes_fill_the_book():
    px = bytes(RNG.randrange(256) for _ in range(40_000))
    assert animation.gif_lzw(animation.gif_lzw_encode(px, 8), 8, len(px)) == px


def test_animations():
    frames = [(0, 0, 4, 4, 50, 0, 0, zlib.compress(bytes(20))), (2, 2, 2, 2, 70, 1, 1, zlib.compress(bytes(6)))]
    assert [f[1:] for f in animation.apng_frames(animation.build_apng(4, 4, frames))] == frames
    assert [f[1:] for f in animation.webp_frames(animation.build_webp(4, 4, frames))] == frames
    fails("APNG_FRAME_BOUNDS", lambda: list(animation.apng_frames(animation.build_apng(3, 3, frames))))
    fails("WEBP_NOT_ANIMATED", lambda: list(animation.webp_frames(b"RIFF\x04\0\0\0WEBP")))


def samples():
    yield "zip", archive.build_zip([("a", b"hello" * 9, None)])
    yield "tar", archive.build_tar([("a", b"hello", None)])
    yield "gz", archive.gzip(b"hello" * 9)
    yield "wav", audio.build_wav(bytes(64), 8000, 1, 16)
    yield "mp3", audio.build_mp3([b"x"] * 2)
    yield "aac", audio.build_adts([b"x" * 30] * 2)
    yield "flac", audio.build_flac([b"x" * 30] * 2)
    yield "ogg", ogg.build([ogg.opus_head(), b"x" * 300])
    yield "mkv", ebml.build([(1, 0, True, b"xyz")], [(1, "video", "V_VP9")])
    yield "ts", ts.build([(257, 0, b"xyz")], {257: ts.H264})
    yield "mp4", mp4.build([{"id": 1, "kind": "audio", "timescale": 1, "samples": [b"x"], "deltas": [1]}])
    yield "mp4_fragments", mp4.build_fragmented(1, 1, 1, [[(None, b"x")]])
    im = image.Image(4, 3, 3, 8, bytes(36))
    for k in ("ppm", "qoi", "bmp", "tga", "pcx", "tiff"):
        yield k, image.BUILD[k](im)
    yield "gif", animation.build_gif(2, 2, bytes(12), [(0, 0, 2, 2, 0, 0, bytes(4))])
    yield "apng", animation.build_apng(2, 2, [(0, 0, 2, 2, 0, 0, 0, b"x")])
    yield "webp", animation.build_webp(2, 2, [(0, 0, 2, 2, 0, 0, 0, b"x")])


@pytest.mark.parametrize("fmt, data", list(samples()), ids=lambda x: x if isinstance(x, str) else "")
def test_cut_and_altered_files_give_typed_errors_only(fmt, data):
    """What the reader turns into an error code; anything else would end the query."""
    rows, rng = FORMATS[fmt][1], random.Random(1)
    list(rows(data))
    broken = [data[:n] for n in range(0, len(data), max(1, len(data) // 60))]
    for _ in range(150):
        b = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append(bytes(b))
    for b in broken:
        try:
            list(rows(b))
        except (FormatError, struct.error, IndexError, UnicodeDecodeError):
            pass


def test_reader_modes(spark):
    good = archive.build_zip([("a", b"x", None)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "file int, content binary")
    got = sorted((r.file, r.name or "", r.error_code or "") for r in read(df, "zip", ["file"], mode="quarantine").collect())
    assert got == [(1, "a", ""), (2, "", "ZIP_NO_EOCD"), (3, "", "ZIP_NO_EOCD")]
    with pytest.raises(Exception, match="ZIP_NO_EOCD"):
        read(df, "zip", ["file"]).collect()


def test_rows_of_many_small_files_share_frames(spark, monkeypatch):
    import pandas as pd

    df = spark.createDataFrame([(1, bytearray(b""))], "file int, content binary")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: run)
    run = read(df, "zip", ["file"], mode="quarantine")
    files = [archive.build_zip([("a", b"x", None), ("b", b"y", None)]), b"not a zip", archive.build_zip([])] * 700
    frames = list(run(iter([pd.DataFrame({"file": range(at, at + 300), "_content": files[at : at + 300]}) for at in range(0, 2100, 300)])))
    assert [len(f) for f in frames] == [1000, 1000, 100]
    got = [(k, n, e) for f in frames for k, n, e in zip(f["file"], f["name"], f["error_code"], strict=True)]
    assert got == [r for k in range(0, 2100, 3) for r in ((k, "a", None), (k, "b", None), (k + 1, None, "ZIP_NO_EOCD"))]
    big = archive.build_zip([(n, RNG.randbytes(6 << 20), None) for n in "abcd"], deflate=False)
    assert [len(f) for f in run(iter([pd.DataFrame({"file": [1, 2], "_content": [big, big]})]))] == [3, 3, 2]


def test_svg_sizes_parses_in_all_tasks(spark, tmp_path):
    from formloom import catalog

    spark.range(100).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    svg = catalog.queries()["svg_sizes"](spark, str(tmp_path))
    assert svg.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert svg.count() == 100


def test_head_source_and_conversion(spark, tmp_path):
    from pyspark.sql import functions as F

    from formloom.plans.convert import convert, routed
    from formloom.sinks.files import save
    from formloom.sources.detect import detect
    from formloom.sources.files import scan
    from formloom.sources.heads import HeadSource

    made = spark.createDataFrame([("a.zip", bytearray(archive.build_zip([("a", b"x", None)]))), ("b.bin", bytearray(b"GIF89a" + bytes(5000))), ("c.csv", bytearray(b'a,b\n1,"2"\n'))], "name string, content binary")
    assert save(made, str(tmp_path / "f")).agg(F.sum("written")).first()[0] > 5000
    spark.dataSource.register(HeadSource)
    heads = spark.read.format("heads").option("path", str(tmp_path / "f")).load()
    assert sorted((r.path.rpartition("/")[2], r.ext, r.n) for r in heads.select("path", detect(F.col("head")).alias("ext"), F.length("head").alias("n")).collect())[1] == ("b.bin", "gif", 1024)
    files = routed(scan(spark, str(tmp_path / "f")))
    assert sorted(r.ext for r in files.select("ext").collect()) == ["csv", "gif", "zip"]
    out = convert(files.where("ext = 'csv'"), "csv", "csv", ["path"]).first()
    assert bytes(out.content) == b"a,b\r\n1,2\r\n"
    fails("NO_BACKEND", lambda: convert(files, "csv", "json", ["path"]))
    fails("UNSUPPORTED_FORMAT", lambda: convert(files, "csv", "nope", ["path"]))


def test_command_line(spark, tmp_path, capsys):
    from formloom.cli import main

    src, dst = tmp_path / "x.dat", tmp_path / "y.vtt"
    src.write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    assert main([str(src), str(dst), "--from", "srt"]) == 0
    assert dst.read_text() == "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nhi\n"
    assert main([str(src), str(dst)]) == 1 and main(["--list-formats"]) == 0
    with pytest.raises(SystemExit):
        main(["one"])


def test_the_transcoder_takes_just_its_pairs():
    from formloom.plans.planner import FALLBACK_SUBTITLES, transcoder_pairs

    pairs = transcoder_pairs()
    assert len(pairs) == len(set(pairs)) == 194
    assert ("video/mp4", "video/webm") in pairs and ("video/mp2t", "audio/aac") in pairs and ("audio/aiff", "audio/flac") in pairs
    assert ("audio/mpeg", "audio/mpeg") not in pairs and ("video/mp2t", "video/3gpp") not in pairs and ("image/png", "image/png") not in pairs
    assert len(transcoder_pairs(True)) == 194 + len(FALLBACK_SUBTITLES) ** 2


def test_wav_keeps_chunks_that_it_does_not_know():
    from formloom.plans.convert import CANONICAL

    extras = [("LIST", b"abc"), ("note", b"")]
    data = audio.build_wav(b"\1\2\3", 8000, 1, 8, extras=extras)
    again = CANONICAL["wav"](data)
    assert again == data and audio.wav_extras(again) == extras and audio.parse_wav(again)[-1] == b"\1\2\3"


def test_mp3_and_aac_are_written_anew():
    from formloom.plans.convert import CANONICAL

    tag, end = b"ID3\4\0\0\0\0\0\2xy", b"TAG" + bytes(125)
    one = audio.build_mp3([b"a"])
    info = one[:4] + b"Info" + one[8:]
    assert CANONICAL["mp3"](tag + b"junk" + info + one + b"junk" + one + b"t" + end) == tag + info + one + one + end
    assert CANONICAL["mp3"](one + one) == one + one
    adts = audio.build_adts([b"abc", b"de"])
    assert CANONICAL["aac"](adts + b"junk") == adts


def test_json_with_indent():
    from formloom.plans.convert import _json

    assert _json(b'{"a":[1,{"b":null}],"c":[]}') == b'{"a":[1,{"b":null}],"c":[]}'
    assert _json(b'{"a":[1]}', 2) == b'{\n  "a": [\n    1\n  ]\n}'


def test_xml_keeps_carriage_returns(spark):
    from formloom.codecs import markup

    text = markup.build_xml([(1, 0, "a", "one\rtwo\r\nthree", {"k": "x\ry"})])
    node = next(markup.xml_nodes(text))
    assert node[5] == "one\rtwo\r\nthree" and node[6]["k"] == "x\ry"
