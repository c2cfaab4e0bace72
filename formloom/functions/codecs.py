"""Codec strings and small binary codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(b: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("int")


def avc_string(sps: Column) -> Column:
    """avc1.PPCCLL of a sequence parameter set that begins with its unit header."""
    return F.concat(F.lit("avc1."), F.hex(F.substring(sps, 2, 3)))


def aac_string(config: Column) -> Column:
    """mp4a.40.N of an AudioSpecificConfig."""
    return F.concat(F.lit("mp4a.40."), F.shiftright(_byte(config, 0), 3).cast("string"))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def vp9_string(profile: Column, level: Column, depth: Column) -> Column:
    return F.concat(F.lit("vp09."), _two(profile), F.lit("."), _two(level), F.lit("."), _two(depth))


def vp9_config_string(config: Column) -> Column:
    """The long form, of a VPCodecConfigurationRecord without its box version: profile, level, depth and chroma, then colour."""
    third = _byte(config, 2)
    parts = [_byte(config, 0), _byte(config, 1), F.shiftright(third, 4), F.shiftright(third, 1).bitwiseAND(7), _byte(config, 3), _byte(config, 4), _byte(config, 5), third.bitwiseAND(1)]
    return F.concat_ws(".", F.lit("vp09"), *map(_two, parts))


def av1_string(config: Column) -> Column:
    """av01.P.LLT.DD of an AV1CodecConfigurationRecord."""
    second, third = _byte(config, 1), _byte(config, 2)
    depth = F.when(third.bitwiseAND(0x20) > 0, "12").when(third.bitwiseAND(0x40) > 0, "10").otherwise("08")
    return F.concat(F.lit("av01."), F.shiftright(second, 5).cast("string"), F.lit("."), _two(second.bitwiseAND(31)), F.when(third >= 128, "H").otherwise("M"), F.lit("."), depth)


def hevc_string(config: Column, fourcc: str = "hvc1") -> Column:
    """Profile, reversed compatibility flags, tier and level, and the constraint bytes up to the last that is not zero, of an HEVCDecoderConfigurationRecord."""
    first = _byte(config, 1)
    space = F.element_at(F.array(*map(F.lit, ["", "A", "B", "C"])), F.shiftright(first, 6) + 1)
    flags = F.reverse(F.lpad(F.conv(F.hex(F.substring(config, 3, 4)), 16, 2), 32, "0"))
    tier = F.when(first.bitwiseAND(0x20) > 0, "H").otherwise("L")
    ends = F.regexp_replace(F.regexp_replace(F.hex(F.substring(config, 7, 6)), "(00)+$", ""), "(..)", ".$1")
    return F.concat(F.lit(f"{fourcc}."), space, first.bitwiseAND(31).cast("string"), F.lit("."), F.lower(F.conv(flags, 2, 16)), F.lit("."), tier, _byte(config, 12).cast("string"), F.lower(ends))


def dos_timestamp(date: Column, time: Column) -> Column:
    """The local time that a ZIP entry's two fields stand for, or null for an impossible one; seconds count in twos."""
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2)
    return text.try_cast("timestamp_ntz")


def octal(field: Column) -> Column:
    """A TAR number; null where it is none."""
    t = F.regexp_replace(field, "^ +|[ \\x00]+$", "")
    return F.when(t.rlike("^[0-7]+$"), F.conv(t, 8, 10).cast("long"))


def vint(b: Column) -> Column:
    """The value of the EBML variable-length number at the start of b; null where it is unknown, broken or over seven bytes."""
    first = _byte(b, 0)
    n = F.when(first > 0, 8 - F.floor(F.log2(first.cast("double"))).cast("int"))
    raw = F.conv(F.hex(F.substr(b, F.lit(1), n)), 16, 10).cast("long")
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), 7 * n) - 1
    v = raw.bitwiseAND(ones)
    return F.when((n <= 7) & (F.octet_length(b) >= n) & (v != ones), v)
