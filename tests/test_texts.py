"""Text formats: strictness, quirks and round trips, row by row."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formloom.codecs import markup
from formloom.errors import FormatError
from formloom.functions import timecode as tc
from formloom.sinks import subtitle as sub_out
from formloom.sinks import text as text_out
from formloom.sources import delimited, subtitle, text


def one(spark, s):
    return spark.createDataFrame([(1, s)], "file int, text string")


def fails(code, f):
    with pytest.raises(FormatError) as e:
        f()
    assert e.value.code == code


# CSV -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("s, want", [
    ('a,b\r\n1,"x, ""y""\r\nz"\r\n', (["a", "b"], [["1", 'x, "y"\r\nz']])), ("a\rb\n\n\nc", (["a"], [["b"], ["c"]])), ("a,b\n1\n", (["a", "b"], [["1", ""]])), ("﻿a\n", (["a"], [])),
    ("", ([], [])), ("a,b\n1,", (["a", "b"], [["1", ""]])), ('a\n""\n', (["a"], [[""]])), (" a , b \n", ([" a ", " b "], [])),
])
def test_csv_accepts(s, want):
    assert delimited.parse(s) == want


@pytest.mark.parametrize("s, code", [('a\np"q', "CSV_BARE_QUOTE"), ('a\n"x"y', "CSV_CHAR_AFTER_QUOTE"), ('a\n"x', "CSV_UNTERMINATED_QUOTE"), ("a,a\n", "CSV_DUPLICATE_HEADER"), ("a\n1,2\n", "CSV_ROW_TOO_LONG"), (",".join("c%d" % i for i in range(1025)), "CSV_TOO_MANY_COLUMNS")])
def test_csv_refuses(s, code):
    fails(code, lambda: delimited.parse(s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text("a\",\r\n é\t", max_size=4), min_size=2, max_size=2), min_size=1, max_size=4))
def test_csv_round_trip(rows):
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in '",\r\n') else s
    assert delimited.parse("".join(",".join(map(quote, r)) + "\r\n" for r in rows), header=False) == (None, rows)


def test_csv_quarantine(spark):
    df = spark.createDataFrame([(1, "a\n1\n2\n"), (2, 'a\n"'), (3, None)], "file int, text string")
    got = delimited.parse_delimited(df, ["file"], mode="quarantine").collect()
    assert sorted((r.file, r.row_no or 0, r.error_code or "") for r in got) == [(1, 1, ""), (1, 2, ""), (2, 0, "CSV_UNTERMINATED_QUOTE")]


# JSON ----------------------------------------------------------------------------------------


def test_json_depth_ignores_strings(spark):
    rows = [("[]", 1), ('{"a":[1,{"b":2}]}', 3), ('"[[["', 0), (r'["\"[", {}]', 2), ("1", 0), ("[" * 300 + "]" * 300, 300)]
    got = spark.createDataFrame(rows, "s string, n int").select("n", text.json_depth(F.col("s")).alias("d")).collect()
    assert all(r.n == r.d for r in got)


def test_jsonl_lines(spark):
    got = text.parse_jsonl(one(spark, '﻿1\r\n\n{"a": 2}\nnope\n"x\ry"'), ["file"], mode="quarantine").select("line_no", F.variant_get("value", "$", "string").alias("v"), "error_code").orderBy("line_no").collect()
    assert [(r.line_no, r.error_code) for r in got] == [(1, None), (3, None), (4, "JSONL_RECORD_PARSE_ERROR:4"), (5, "JSONL_RECORD_PARSE_ERROR:5")]
    with pytest.raises(Exception, match="JSONL_RECORD_PARSE_ERROR:2"):
        text.parse_jsonl(one(spark, "1\nx"), ["file"]).collect()


def test_json_too_deep(spark):
    got = text.parse_json(spark.createDataFrame([(1, "[" * 256 + "]" * 256), (2, "[" * 257 + "]" * 257), (3, "{")], "file int, text string"), ["file"], mode="quarantine").orderBy("file").collect()
    assert [r.error_code for r in got] == [None, "JSON_TOO_DEEP", "JSON_PARSE_ERROR"]


# FWF, INI, ENV -------------------------------------------------------------------------------


def test_fwf(spark):
    cols = [text.FwfColumn("b", 6, 9, "right"), text.FwfColumn("a", 0, 5)]
    got = text.parse_fwf(one(spark, "abc     42\n\nlong!x  9 and more\r\nx"), ["file"], cols).orderBy("line_no").collect()
    assert [(r.line_no, r.a, r.b) for r in got] == [(1, "abc", "4"), (3, "long!", "9"), (4, "x", "")]
    out = text_out.serialize_fwf(spark.createDataFrame([(1, 1, "abc", "42")], "file int, o int, a string, b string"), ["file"], cols, "o")
    assert out.first().text == "abc    42\n"
    with pytest.raises(Exception, match="FWF_FIELD_OVERFLOW"):
        text_out.serialize_fwf(spark.createDataFrame([(1, 1, "toolong", "42")], "file int, o int, a string, b string"), ["file"], cols, "o").collect()


@pytest.mark.parametrize("cols, code", [([], "FWF_NO_COLUMNS"), ([("a", 0, 3), ("a", 3, 4)], "FWF_DUPLICATE_COLUMN"), ([("a", 0, 3), ("b", 2, 4)], "FWF_OVERLAP"), ([("a", 3, 3)], "FWF_INVALID_COLUMN")])
def test_fwf_layouts(cols, code):
    fails(code, lambda: text.check_fwf([text.FwfColumn(*c) for c in cols]))
    fails("FWF_PAD_CHAR", lambda: text.check_fwf([text.FwfColumn("a", 0, 1)], ""))
    text.check_fwf([text.FwfColumn("b", 3, 4), text.FwfColumn("a", 0, 3)])


def test_ini(spark):
    s = "top = 1\n; note\n[one]\na = 1\nb: 2 = 3\n[__proto__]\nx=y\n# more\n[one]\na=9\n[a [b]]\nk=\n"
    got = {(r.section, r.key): (r.value, r.n_seen) for r in text.parse_ini(one(spark, s), ["file"]).collect()}
    assert got == {("__default__", "top"): ("1", 1), ("one", "a"): ("9", 2), ("one", "b"): ("2 = 3", 1), ("__proto__", "x"): ("y", 1), ("a [b]", "k"): ("", 1)}
    bad = spark.createDataFrame([(1, "a=1\nnothing"), (2, "=x"), (3, "a=1")], "file int, text string")
    assert sorted((r.file, r.error_code or "") for r in text.parse_ini(bad, ["file"], mode="quarantine").collect()) == [(1, "INI_SYNTAX_ERROR"), (2, "INI_EMPTY_KEY"), (3, "")]


def test_env(spark):
    s = "export A=1\nB='x # y' # note\nC=\"a\\n\\t\\\\\\\"b\"\nD=foo#bar\nE=\n  F = spaced  \nA=2\n"
    got = {r.key: (r.value, r.ordinal, r.n_seen) for r in text.parse_env(one(spark, s), ["file"]).collect()}
    assert got == {"A": ("2", 1, 2), "B": ("x # y", 2, 1), "C": ('a\n\t\\"b', 3, 1), "D": ("foo", 4, 1), "E": ("", 5, 1), "F": ("spaced", 6, 1)}
    bad = spark.createDataFrame([(1, "1A=2"), (2, 'A="\\x"'), (3, "A='x"), (4, 'A="x" y')], "file int, text string")
    assert sorted((r.file, r.error_code) for r in text.parse_env(bad, ["file"], mode="quarantine").collect()) == [(1, "ENV_SYNTAX_ERROR"), (2, "ENV_BAD_ESCAPE"), (3, "ENV_SYNTAX_ERROR"), (4, "ENV_SYNTAX_ERROR")]


# Subtitles -----------------------------------------------------------------------------------


def cues(df):
    return [(r.id, r.start_ms, r.end_ms, r.text) for r in df.orderBy("ordinal").collect()]


def test_srt(spark):
    s = "﻿noise\r\n1\r\n00:00:01,000 --> 00:00:02.500 X1:1\r\n<i>Hi</i> <font color=red>you</font>\r\ntwo\r\n\r\n \r\n7\r\n100:00:00,001 --> 100:00:00,002\r\n\r\n"
    assert cues(subtitle.parse_srt(one(spark, s), ["file"])) == [("1", 1000, 2500, "Hi you\ntwo"), ("7", 360000001, 360000002, "")]
    with pytest.raises(Exception, match="SUBTITLE_PARSE_ERROR"):
        subtitle.parse_srt(one(spark, "1\nno timing\n"), ["file"]).collect()
    got = subtitle.parse_srt(one(spark, "1\nno timing\n"), ["file"], mode="quarantine").collect()
    assert [(r.id, r.error_code) for r in got] == [(None, "SUBTITLE_PARSE_ERROR")]


def test_vtt(spark):
    s = "WEBVTT - x\nKind: captions\n\nNOTE a\nb\n\nSTYLE\n::cue {}\n\nintro\n00:01.000 --> 00:02.000 align:start line:0 bad:1\n<v Bob>Hi</v> <00:00:01.500>there\n\n01:00:00.000 --> 01:00:01.000\nplain\n"
    got = cues(subtitle.parse_vtt(one(spark, s), ["file"]))
    assert got == [('{"id":"intro","settings":{"align":"start","line":"0"}}', 1000, 2000, "Hi there"), (None, 3600000, 3601000, "plain")]
    back = sub_out.serialize_vtt(subtitle.parse_vtt(one(spark, s), ["file"]), ["file"]).first().text
    assert back == "WEBVTT\n\nintro\n00:00:01.000 --> 00:00:02.000 line:0 align:start\nHi there\n\n01:00:00.000 --> 01:00:01.000\nplain\n"
    assert one(spark, s).select(subtitle.vtt_metadata(F.col("text")).alias("m")).first().m == {"Kind": "captions"}
    with pytest.raises(Exception, match="SUBTITLE_PARSE_ERROR"):
        subtitle.parse_vtt(one(spark, "00:01.000 --> 00:02.000\nx"), ["file"]).collect()


def test_ass_styles_join(spark):
    s = ("[Script Info]\nTitle: x\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, Bold, Alignment\nStyle: Big,Verdana,40,-1,8\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
         "Dialogue: 0,0:00:01.00,0:00:02.50,Big,{\\b1}Hello,\\Nworld\\h!\nComment: 0,0:00:01.00,0:00:02.50,Big,no\nDialogue: 0,0:00:03.00,0:00:04.00,Default,plain\n")
    got = subtitle.parse_ass(one(spark, s), ["file"]).orderBy("ordinal").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text, r.font_name, r.font_size, r.bold, r.alignment) for r in got] == [("Big", 1000, 2500, "Hello,\nworld !", "Verdana", 40, True, 8), (None, 3000, 4000, "plain", None, None, None, None)]


def test_sub_frame_rate_changes(spark):
    s = "{0}{0}25\n{25}{50}a|{Y:i}b\n{9}{9}none\n{0}{0}50\n{50}{100}c\nnoise"
    assert cues(subtitle.parse_sub(one(spark, s), ["file"])) == [(None, 1000, 2000, "a\nb"), (None, 1000, 2000, "c")]
    assert cues(subtitle.parse_sub(one(spark, "{24}{48}x"), ["file"])) == [(None, 1001, 2002, "x")]


def test_mpl(spark):
    assert cues(subtitle.parse_mpl(one(spark, "# note\n[10][25]/a|b\nnoise"), ["file"])) == [(None, 1000, 2500, "a\nb")]


def test_every_pair_of_subtitle_formats(spark):
    src = one(spark, "1\n00:00:01,000 --> 00:00:02,000\na\nb\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n")
    made = {"srt": src} | {t: sub_out.convert(src, "srt", t, ["file"]) for t in sub_out.SERIALIZERS if t != "srt"}
    for a, df in made.items():
        for b in sub_out.SERIALIZERS:
            out = sub_out.convert(df, a, b, ["file"])
            got = cues(subtitle.parse(out, b, ["file"]))
            assert [(x[3], abs(x[1] - w) < 30) for x, w in zip(got, (1000, 3000), strict=True)] == [("a\nb", True), ("c", True)], (a, b)


def test_time_codes(spark):
    df = spark.createDataFrame([(0,), (359999999,), (360000000,), (61001,)], "ms long")
    got = df.select(tc.srt_time(F.col("ms")).alias("s"), tc.srt_ms(tc.srt_time(F.col("ms"))).alias("b"), "ms", tc.ass_time(F.col("ms")).alias("a")).collect()
    assert [r.s for r in got] == ["00:00:00,000", "99:59:59,999", "100:00:00,000", "00:01:01,001"] and all(r.b == r.ms for r in got)
    assert got[1].a == "100:00:00.00"


# TOML, YAML, XML -----------------------------------------------------------------------------


@pytest.mark.parametrize("s, want", [
    ("a: yes\nb: 0x1\nc: 012\nd: true\ne: 1_0\nf: '1'\ng: ~\nh: .inf\ni: 1e3\nj: -0\nk: 0.5", {"a": "yes", "b": "0x1", "c": "012", "d": True, "e": "1_0", "f": "1", "g": None, "h": float("inf"), "i": 1000.0, "j": 0, "k": 0.5}),
    ("- |\n  x\n  y\n- >\n  a\n  b\n- [1, {b: 2}]", ["x\ny\n", "a b\n", [1, {"b": 2}]]), ("a: &x [1]\nb: *x", {"a": [1], "b": [1]}), ("", None), ("!!str 1", "1"), ("!!bool maybe", "maybe"), ("a: !!int 7", {"a": 7}),
])
def test_yaml(s, want):
    assert markup.parse_yaml(s) == want


@pytest.mark.parametrize("s, code", [("a: 1\na: 2", "YAML_DUPLICATE_KEY"), ("<<: {a: 1}", "YAML_MERGE_KEY"), ("? [1]\n: 2", "YAML_COMPLEX_KEY"), ("a\n---\nb", "YAML_MULTI_DOCUMENT"), ("!x 1", "YAML_TAG"), ("!!int x", "YAML_TAG_VALUE"), ("a: [", "YAML_PARSE_ERROR"),
                                     ("a: &a [x,x,x,x,x,x,x,x,x,x]\n" + "".join(f"{c}: &{c} [" + ",".join([f"*{p}"] * 10) + "]\n" for p, c in zip("abcdef", "bcdefg", strict=True)), "YAML_ALIAS_BOMB"), ("[" * 70 + "]" * 70, "YAML_TOO_DEEP")])
def test_yaml_refuses(s, code):
    fails(code, lambda: markup.parse_yaml(s))


trees = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(10**20), 10**20), st.floats(allow_nan=False), st.text("aZ0 :#-'\"\n\\é~", max_size=6)), lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.text("abk y", min_size=1, max_size=3), c, max_size=3)), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(trees)
def test_yaml_round_trip(v):
    assert markup.parse_yaml(markup.build_yaml(v)) == v


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab.\" é", min_size=1, max_size=3), st.recursive(st.one_of(st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.text("a\"\\\n\té\x7f", max_size=5)), lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from(["x", "y z"]), c, max_size=2)), max_leaves=6), max_size=4))
def test_toml_round_trip(v):
    assert markup.parse_toml(markup.build_toml(v)) == v


@pytest.mark.parametrize("s, code", [("a = 9223372036854775808", "TOML_INTEGER_RANGE"), ("a = 01", "TOML_PARSE_ERROR"), ("a = 1\na = 2", "TOML_PARSE_ERROR")])
def test_toml_refuses(s, code):
    fails(code, lambda: markup.parse_toml(s))


def test_xml():
    got = list(markup.xml_nodes('<?xml version="1.0"?><r b="2" a="1">x<!-- no --><k><![CDATA[<&]]></k>y</r>'))
    assert got == [(1, 0, 0, 1, "r", "xy", {"a": "1", "b": "2"}), (2, 1, 1, 1, "k", "<&", {})]
    assert markup.build_xml([(1, 0, "r", "t", {"b": '"', "a": "&"}), (2, 1, "k", "", {})]) == '<r a="&amp;" b="&quot;">\n  t\n  <k/>\n</r>\n'


@pytest.mark.parametrize("s, code", [("<!DOCTYPE a><a/>", "XML_DOCTYPE"), ("<?php x?><a/>", "XML_PROCESSING_INSTRUCTION"), ("<a><b></a>", "XML_PARSE_ERROR"), ("<a>" * 65 + "</a>" * 65, "XML_TOO_DEEP"), ("", "XML_PARSE_ERROR")])
def test_xml_refuses(s, code):
    fails(code, lambda: list(markup.xml_nodes(s)))


def test_svg():
    assert markup.parse_svg('<svg xmlns="http://www.w3.org/2000/svg" width="10px" viewBox="0 0 1 1"/>')[:3] == (10.0, None, "0 0 1 1")
    fails("SVG_SCRIPT", lambda: markup.parse_svg("<svg><SCRIPT/></svg>"))
    fails("SVG_EXTERNAL_HREF", lambda: markup.parse_svg("<svg><a href='http://x'/></svg>"))


def test_dispatch(spark):
    from formloom.sources.dispatch import parse

    texts = {"csv": "a\n1\n", "tsv": "a\tb\n1\t2\n", "json": "[1]", "jsonl": "1\n2\n", "ini": "a=1", "env": "A=1", "toml": "a = 1", "yaml": "a: 1", "xml": "<a/>", "srt": "1\n00:00:01,000 --> 00:00:02,000\nx\n", "mpl": "[1][2]x"}
    for fmt, s in texts.items():
        assert parse(one(spark, s), fmt, ["file"]).count() == (2 if fmt == "jsonl" else 1), fmt
    assert parse(one(spark, "ab\n"), "fwf", ["file"], columns=[text.FwfColumn("a", 0, 1)]).first().a == "a"
    fails("UNSUPPORTED_FORMAT", lambda: parse(one(spark, ""), "nope", ["file"]))


def test_texts_are_not_taken_for_packets(spark):
    from formloom.sources.detect import detect

    heads = ["G" + "o" * 187 + "Good", "G\x00" + "o" * 186 + "Good", "RIFF1234WAVE", "PK\x03\x04", "GIF89a", "P1 2 2", " <svg>"]
    df = spark.createDataFrame(list(enumerate(heads)), "i int, t string").withColumn("b", F.col("t").cast("binary"))
    got = df.orderBy("i").select(detect(F.col("b"), text=True).alias("text"), detect(F.col("b")).alias("bytes")).collect()
    assert [r.text for r in got] == [None, None, None, None, "gif", "pbm", "svg"]
    assert [r.bytes for r in got] == ["ts", "ts", "wav", "zip", "gif", "pbm", "svg"]


def test_detect_documents_equals_its_sql_on_two_letters_at_a_packets_distance(spark, tmp_path):
    import duckdb

    from formloom import catalog

    texts = ["G" + "o" * 187 + "Good", "Good", "GIF89a", "BM", "\t<svg>", None]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["detect_documents"]).fetchall()
    assert sorted(map(repr, map(tuple, catalog.queries()["detect_documents"](spark, str(tmp_path)).collect()))) == sorted(map(repr, want))
