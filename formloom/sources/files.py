"""Whole files to rows: one reader for all byte formats.

A format is a schema and a generator over one file's bytes; ``read`` runs it on executors, file
by file, and yields rows in small batches, so memory follows the largest file and not the number
of files. A file that its format refuses is one row with error_code in ``quarantine`` mode, and
fails the query in ``strict`` mode; rows of a file that fails late are withheld, as a file is
accepted as a whole or not at all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.codecs import animation, archive, audio, ebml, image, markup, mp4, ogg, ts
from formloom.errors import FormatError
from formloom.session import BATCH_BYTES, small_batches

ENTRY = "name string, is_directory boolean, size long, method string, crc32 long, modified timestamp_ntz, data binary"
IMAGE = "width int, height int, channels int, bit_depth int, pixels binary, note string"
FRAME = "ordinal int, x int, y int, width int, height int, duration_ms int, disposal int, blend int, payload binary"
LEAF = "path string, type string, value string"


def _image(parse: Callable) -> Callable:
    def rows(data: bytes) -> Iterator[tuple]:
        i = parse(data)
        yield i.width, i.height, i.channels, i.bit_depth, i.pixels, i.note

    return rows


def _one(f: Callable) -> Callable:
    return lambda data: iter([f(data)])


def _text(f: Callable) -> Callable:
    def rows(data: bytes):
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            raise FormatError("INVALID_UTF8") from None
        return f(text)

    return rows


FORMATS: dict[str, tuple[str, Callable[[bytes], Iterator[tuple]]]] = {
    "archive": (ENTRY, archive.archive_entries), "zip": (ENTRY, archive.zip_entries), "tar": (ENTRY, archive.tar_entries), "gz": ("name string, data binary", _one(archive.gunzip)),
    "wav": ("sample_rate int, channels int, bits int, format string, n_frames long, samples binary", _one(audio.parse_wav)), "wav_chunks": ("id string, offset long, payload binary", audio.wav_chunks),
    "mp3": ("ordinal int, offset long, version int, kbps int, sample_rate int, size int, samples int, payload binary", audio.mp3_frames),
    "aac": ("ordinal int, offset long, profile int, sample_rate int, channels int, size int, payload binary", audio.adts_frames),
    "flac_info": ("min_block int, max_block int, sample_rate int, channels int, bits int, total_samples long, frames_at long", _one(audio.flac_info)),
    "flac": ("ordinal int, offset long, block_size int, number long, sample_rate int, size int, payload binary", audio.flac_frames),
    "ogg_pages": ("offset long, flags int, granule long, serial long, sequence long, lacing array<int>, payload binary", ogg.pages),
    "ogg": ("stream int, serial long, codec string, channels int, sample_rate int, ordinal int, granule long, packet binary", ogg.packets),
    "ebml": ("id long, depth int, offset long, payload_offset long, size long", ebml.elements), "mkv_tracks": ("number int, kind string, codec string", ebml.tracks),
    "mkv": ("ordinal int, track int, timestamp_us long, is_keyframe boolean, payload binary", ebml.frames), "mkv_cues": ("time long, track int, cluster_position long", ebml.cue_points),
    "ts_packets": ("ordinal int, pid int, unit_start boolean, counter int, payload binary", ts.packets), "ts": ("pid int, stream_type int, ordinal int, pts long, dts long, payload binary", ts.pes),
    "mp4_boxes": ("path string, type string, depth int, offset long, payload_offset long, size long", mp4.boxes),
    "mp4": ("track int, kind string, codec string, timescale long, table string, ordinal int, a long, b long, c long", mp4.tables),
    "mp4_fragments": ("track int, fragment int, run int, ordinal int, duration long, size long, flags long, base_time long", mp4.fragments),
    "mp4_defaults": ("level string, track int, fragment int, duration long, size long, flags long", mp4.fragment_defaults),
    **{k: (IMAGE, _image(f)) for k, f in image.PARSE.items()},
    "ico": ("ordinal int, width int, height int, payload binary", image.ico_images), "icns": ("ordinal int, type string, payload binary", image.icns_elements),
    "gif": (FRAME, animation.gif_frames), "apng": (FRAME, animation.apng_frames), "webp": (FRAME, animation.webp_frames), "png_chunks": ("type string, payload binary", animation.png_chunks),
    "toml": (LEAF, _text(lambda t: markup.flat(markup.parse_toml(t)))), "yaml": (LEAF, _text(lambda t: markup.flat(markup.parse_yaml(t)))),
    "xml": ("node_id int, parent_id int, depth int, ordinal int, name string, text string, attributes map<string,string>", _text(markup.xml_nodes)),
    "svg": ("width double, height double, view_box string, xmlns string", _text(lambda t: iter([markup.parse_svg(t)]))),
}
FORMATS["webm"], FORMATS["m4a"] = FORMATS["mkv"], FORMATS["mp4"]

#: Fixed value: bytes of a file that is refused unread.
MAX_BYTES = 209_715_200


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under path: path, modificationTime, length and content; content is only read where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def read(df: DataFrame, fmt: str, keys: list[str], content: str = "content", mode: str = "strict", batch: int = 1_000) -> DataFrame:
    """keys, the format's columns and error_code."""
    ddl, rows = FORMATS[fmt]
    small_batches(df.sparkSession)
    src = df.select(*keys, F.col(content).cast("binary").alias("_content"))
    own = T.StructType.fromDDL(ddl)
    schema = T.StructType([*[src.schema[k] for k in keys], *own.fields, T.StructField("error_code", T.StringType())])

    def framed(held: list[list]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=schema.names, dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0  # of any number of files, as a frame costs more than a small file's rows
        for f in frames:
            for *key, data in f.itertuples(index=False, name=None):
                code = None
                try:
                    if len(data or b"") > MAX_BYTES:
                        raise FormatError("INPUT_TOO_LARGE")
                    made = list(rows(bytes(data or b"")))
                except (FormatError, struct.error, IndexError, UnicodeDecodeError) as e:
                    if mode == "strict":
                        raise
                    code = e.code if isinstance(e, FormatError) else f"{fmt.upper()}_MALFORMED"
                    made = [[None] * len(own)]
                for r in made:
                    held.append([*key, *r, code])
                    size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
                    if len(held) >= batch or size >= BATCH_BYTES:
                        yield framed(held)
                        held, size = [], 0
        if held:
            yield framed(held)

    return src.mapInPandas(run, schema)
