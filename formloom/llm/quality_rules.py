r"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Signals are exact counts over whole texts. For each (lang, source) group a sketch of each
signal is a histogram over integer buckets with six significant bits (relative error under
1/32): sketches merge by adding counts, so the order of merging never matters, and a group's
sketch never exceeds some 2,000 cells however many documents it has. Groups of fewer than
``min_group`` documents take the sketch of their language, and languages of fewer take that
of the corpus; both are merges of the groups' sketches. The thresholds are then joined back.

A document is rejected when base_failed holds or when a signal lies above its group's fence
``q50 + reach * max(q75 - q25, least)``; ``least`` (per signal) keeps a group of nearly equal
values from rejecting ordinary documents.

Defined results: null text counts as empty (no words: base_failed); null lang or source is a
group of its own; repeated rows each get their own row; an empty table gives an empty table;
columns of any other name pass through ``rate`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import map_texts, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]

#: Signal: (integer expression, reach of the fence, least spread). All per 1,000 words, but
#: word_len, which is the mean word length in hundredths of a character.
SIGNALS = {
    "symbols": ("1000 * n_symbols div n_words", 6, 25),
    "word_len": ("100 * word_chars div n_words", 6, 20),
    "dup_lines": ("1000 * n_dup_lines div n_words", 6, 5),
}
MIN_GROUP = 200


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = h[:n].copy()
    for k in range(1, WINDOW):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += h[k : n + k]
    order = np.argsort(acc, kind="stable")
    a = acc[order]
    same = a[1:] == a[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[1:] = same
    hit[:-1] |= same
    # Equal hashes are only candidates: the windows themselves decide.
    where: dict[tuple, list[int]] = {}
    for i in order[hit].tolist():
        where.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    starts = np.array([i for at in where.values() if len(at) > 1 for i in at], dtype=np.int64)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The five base counts of a text given as UTF-8."""
    words = text.split()  # bytes.split() separates at exactly \x20 and \x09-\x0D
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(b"".join(words).decode(errors="replace")), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words)


def _make():
    def each(texts: list[bytes]) -> list[pa.Array]:
        rows = [counts(t) for t in texts]
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]

    return each


def signals(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, the five counts and base_failed, from one scan of the texts."""
    out = map_texts(df, text_col, keep, FIELDS, _make)
    return out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def _bucket(v: str) -> str:
    """The lower end of v's bucket: its six leading bits."""
    return f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) END"


def sketches(signal_rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Cells (lang, source, signal, bucket, n) over documents that have words."""
    pairs = ", ".join(f"'{k}', {e}" for k, (e, _, _) in SIGNALS.items())
    long = signal_rows.where("n_words > 0").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.expr(f"stack({len(SIGNALS)}, {pairs}) AS (signal, v)"))
    return long.withColumn("bucket", F.expr(_bucket("v"))).groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))


def fences(cells: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """For each (lang, source) a row with the fence of each signal."""
    groups = cells.groupBy("lang", "source").agg(F.sum(F.when(F.col("signal") == "symbols", F.col("n"))).alias("n_docs"))
    by_lang = cells.groupBy("lang").agg(F.sum(F.when(F.col("signal") == "symbols", F.col("n"))).alias("n_lang"))
    level = groups.join(by_lang, groups.lang.eqNullSafe(by_lang.lang)).select(
        groups.lang, groups.source, F.expr(f"CASE WHEN n_docs >= {min_group} THEN 'group' WHEN n_lang >= {min_group} THEN 'lang' ELSE 'all' END").alias("level"))

    def quantiles(keys: list[str]) -> DataFrame:
        merged = cells.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
        over = ", ".join([*keys, "signal"])
        ranked = merged.selectExpr("*", f"sum(n) OVER (PARTITION BY {over} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {over}) AS total")
        q = ", ".join(f"min(bucket) FILTER (WHERE 4 * upto >= {k} * total) AS q{25 * k}" for k in (1, 2, 3))
        qs = ranked.groupBy(*keys, "signal").agg(*[F.expr(x) for x in q.split(", ")])
        pick = [F.max(F.expr(f"CASE WHEN signal = '{s}' THEN q50 + {reach} * greatest(q75 - q25, {least}) END")).alias(f"fence_{s}") for s, (_, reach, least) in SIGNALS.items()]
        return qs.groupBy(*keys).agg(*pick) if keys else qs.agg(*pick)

    cols = [f"fence_{s}" for s in SIGNALS]
    g, la, al = quantiles(["lang", "source"]), quantiles(["lang"]), quantiles([])
    a = level.where("level = 'group'").join(g.withColumnsRenamed({"lang": "gl", "source": "gs"}), F.expr("lang <=> gl AND source <=> gs")).select("lang", "source", *cols)
    b = level.where("level = 'lang'").join(la.withColumnsRenamed({"lang": "gl"}), F.expr("lang <=> gl")).select("lang", "source", *cols)
    c = level.where("level = 'all'").join(al.withColumn("one", F.lit("all")), F.expr("level = one")).select("lang", "source", *cols)
    return a.unionByName(b).unionByName(c)


def judged(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """rows with kept: whether base rules and all fences are met."""
    f = limits.withColumnsRenamed({"lang": "_fl", "source": "_fs"})
    within = " AND ".join(f"({e}) <= coalesce(fence_{s}, {e})" for s, (e, _, _) in SIGNALS.items())
    out = rows.join(f, F.col(lang).eqNullSafe(F.col("_fl")) & F.col(source).eqNullSafe(F.col("_fs")), "left")
    return out.withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false ELSE {within} END")).drop("_fl", "_fs", *[f"fence_{s}" for s in SIGNALS])


def rate(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, counts, base_failed and kept for each document; texts are scanned once."""
    rows = written(signals(docs, ["doc_id", "lang", "source"]), "rules")
    return judged(rows, fences(written(sketches(rows), "sketch"), min_group))


def filtered(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    The texts are scanned twice, for the sketches and for the verdicts, so that only narrow
    rows are shuffled.
    """
    limits = written(fences(written(sketches(signals(docs, ["lang", "source"])), "sketch"), min_group), "fences")
    # Columns of the input that share a name with a signal are put aside and come back at the end.
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    rows = signals(docs.withColumnsRenamed(aside), list(aside.values()), aside["text"])
    out = judged(rows, limits, aside["lang"], aside["source"]).where("kept")
    return out.select(*[F.col(v).alias(c) for c, v in aside.items()])
