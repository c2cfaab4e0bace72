"""Queries over line-oriented texts made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.registry import query, table
from formloom.sinks import text as sink
from formloom.sources import delimited
from formloom.sources import text as source
from formloom.sources.text import FwfColumn


@query("text_lines", "SELECT doc_id, len(string_split_regex(text, '\\r\\n|\\r|\\n')) AS n_lines, sum(0) AS zero FROM documents GROUP BY doc_id, text")
def text_lines(spark, sf_dir):
    return source.lines(table(spark, sf_dir, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.lit(0).alias("zero"))


@query("text_line_rows", "SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents))")
def text_line_rows(spark, sf_dir):
    return source.lines(table(spark, sf_dir, "documents"), ["doc_id"])


@query("jsonl_events", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def jsonl_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = sink.serialize_jsonl(e.withColumn("f", F.col("user_id")), ["f"], F.struct("event_id", F.from_json("props", "k bigint").alias("p")), "event_id")
    rows = source.parse_jsonl(files, ["f"])
    return rows.select(F.variant_get("value", "$.event_id", "bigint").alias("event_id"), F.variant_get("value", "$.p.k", "bigint").alias("k"))


@query("json_depth", "SELECT event_id, 1 AS depth, (props->>'k')::BIGINT AS k FROM events")
def json_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return source.parse_json(e.select("event_id", "props"), ["event_id"], "props").join(e.select("event_id", source.json_depth(F.col("props")).alias("depth")), "event_id").select("event_id", "depth", F.variant_get("value", "$.k", "bigint").alias("k"))


_Q = lambda c: f"""CASE WHEN contains({c}, ',') OR contains({c}, '"') OR contains({c}, chr(10)) OR contains({c}, chr(13)) THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


#: A file holds the rows of a bounded range of ids, so files stay small however many rows there are.
_FILE_ROWS = 1_000


def _part(c):
    return F.floor(F.col(c) / _FILE_ROWS)


@query("csv_text", f"SELECT source, doc_id // {_FILE_ROWS} AS part, 'doc_id,lang,text' || chr(13) || chr(10) || string_agg(doc_id || ',' || {_Q('lang')} || ',' || {_Q('text')}, chr(13) || chr(10) ORDER BY doc_id) || chr(13) || chr(10) AS text FROM documents GROUP BY 1, 2")
def csv_text(spark, sf_dir):
    return sink.serialize_delimited(table(spark, sf_dir, "documents").withColumn("part", _part("doc_id")), ["source", "part"], ["doc_id", "lang", "text"], "doc_id")


@query("csv_roundtrip", f"SELECT source, doc_id // {_FILE_ROWS} AS part, row_number() OVER (PARTITION BY source, doc_id // {_FILE_ROWS} ORDER BY doc_id)::INT AS row_no, doc_id::VARCHAR AS doc_id, lang, text FROM documents")
def csv_roundtrip(spark, sf_dir):
    return delimited.columns(delimited.parse_delimited(csv_text(spark, sf_dir), ["source", "part"]), ["source", "part"], ["doc_id", "lang", "text"])


@query("tsv_roundtrip", f"SELECT o_orderstatus, o_orderkey // {_FILE_ROWS} AS part, o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, o_totalprice FROM orders")
def tsv_roundtrip(spark, sf_dir):
    o, keys = table(spark, sf_dir, "orders").withColumn("part", _part("o_orderkey")), ["o_orderstatus", "part"]
    files = sink.serialize_delimited(o, keys, ["o_orderkey", "o_orderpriority", "o_totalprice"], "o_orderkey", "\t")
    rows = delimited.columns(delimited.parse_delimited(files, keys, delimiter="\t"), keys, ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return rows.select("o_orderstatus", "part", "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))


_FWF = [FwfColumn("n_name", 6, 26), FwfColumn("n_nationkey", 0, 5, "right"), FwfColumn("n_regionkey", 26, 30, "right")]


@query("fwf_text", "SELECT 1 AS file, string_agg(lpad(n_nationkey::VARCHAR, 5, ' ') || ' ' || rpad(n_name, 20, ' ') || lpad(n_regionkey::VARCHAR, 4, ' '), chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation")
def fwf_text(spark, sf_dir):
    return sink.serialize_fwf(table(spark, sf_dir, "nation").withColumn("file", F.lit(1)), ["file"], _FWF, "n_nationkey")


@query("fwf_roundtrip", "SELECT 1 AS file, row_number() OVER (ORDER BY n_nationkey)::INT AS line_no, n_name, n_nationkey::VARCHAR AS n_nationkey, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def fwf_roundtrip(spark, sf_dir):
    return source.parse_fwf(fwf_text(spark, sf_dir), ["file"], _FWF)


def _ini_rows(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit(1).alias("file"), F.col("r_name").alias("section"), F.col("n_name").alias("key"), F.concat(F.lit("id "), F.col("n_nationkey").cast("string")).alias("value"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("ordinal"))


@query("ini_text", """SELECT 1 AS file, string_agg('[' || r_name || ']' || chr(10) || body, chr(10) ORDER BY r_regionkey) AS text FROM (
SELECT r_regionkey, r_name, string_agg(n_name || '=id ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)""")
def ini_text(spark, sf_dir):
    return sink.serialize_ini(_ini_rows(spark, sf_dir), ["file"])


@query("ini_roundtrip", "SELECT 1 AS file, r_name AS section, n_name AS key, 'id ' || n_nationkey AS value, 1 AS n_seen FROM nation JOIN region ON n_regionkey = r_regionkey")
def ini_roundtrip(spark, sf_dir):
    return source.parse_ini(ini_text(spark, sf_dir), ["file"]).drop("ordinal", "error_code")


@query("ini_last_wins", "SELECT o_custkey AS file, o_orderpriority AS key, max_by(o_orderkey, o_orderkey)::VARCHAR AS value, count(*) AS n_seen FROM orders GROUP BY 1, 2")
def ini_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.concat(F.col("o_orderpriority"), F.lit(" : "), F.col("o_orderkey").cast("string")).alias("l"), F.col("o_orderkey").alias("ordinal"))
    return source.parse_ini(sink.joined(o, ["file"], "ordinal", F.col("l"), "\n").withColumnRenamed("_t", "text"), ["file"]).select("file", "key", "value", "n_seen")


@query("env_roundtrip", f"SELECT lang, doc_id // {_FILE_ROWS} AS part, 'DOC_' || doc_id || '_' || i AS key, l[i] AS value, doc_id AS first FROM (SELECT lang, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT lang, doc_id, string_split(text, chr(13)) AS l FROM documents))")
def env_roundtrip(spark, sf_dir):
    """No value of the format holds a carriage return, so a text has a key for each part between them."""
    d = table(spark, sf_dir, "documents").select("lang", _part("doc_id").alias("part"), "doc_id", F.posexplode(F.split("text", "\r")).alias("i", "value"))
    d = d.select("lang", "part", F.concat(F.lit("DOC_"), F.col("doc_id"), F.lit("_"), F.col("i") + 1).alias("key"), "value", F.struct("doc_id", "i").alias("ordinal"))
    out = source.parse_env(sink.serialize_env(d, ["lang", "part"]), ["lang", "part"])
    return out.select("lang", "part", "key", "value", F.regexp_extract("key", r"^DOC_(\d+)_", 1).cast("long").alias("first"))
