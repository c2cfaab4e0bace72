r"""License scans by diagonal voting, in DataFrame operations only.

A text's words (ASCII digits, letters and any other non-ASCII characters; A-Z lower-cased)
give all rolling word pairs. Their hashes are joined with the pairs of the templates, a fixed
table of phrases; a hit at word i of the text and j of a template votes for the diagonal
i - j. Votes are aggregated by (document, template, diagonal); diagonals no more than ``GAP``
apart are merged, so that an inserted or missing word does not break a match; a merged span is
verified by the share of the template's pairs that it really holds (``COVER`` at least). The
words themselves are compared in the join, so equal hashes never decide.

Base phrases count at every place where all their words stand on one diagonal. Other
templates add labels of their own.

One scan of the texts gives everything: the last pair of each text, which has no second word,
matches a mark in the template table and brings the number of words along. Only hits are
shuffled, once, by document; a document's hits are in one group, no more than its own words.

Defined results: null and empty texts have no words, no places and score 0; first_word and
last_word are null without places; repeated rows each get their row; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP, COVER = 2, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Openings of well-known licence notices, and this method's labels for them.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
#: Characters outside ASCII whose lower case lies inside.
_ODD = "[İK]"


def templates() -> list[tuple[int, int, str, str, int, str, bool]]:
    """(template, position, first word, second word, pairs in all, label, base) of every pair."""
    out = []
    for t, (label, phrase) in enumerate([*BASE, *NOTICES]):
        words = phrase.split()
        out += [(t, j, a, b, len(words) - 1, label, t < len(BASE)) for j, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return out


def lowered(text: Column) -> Column:
    """A-Z in lower case; lower() does no more to ASCII unless a character of _ODD is there."""
    return F.when(text.rlike(_ODD), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _pairs(spark: SparkSession) -> DataFrame:
    rows = templates()
    t = spark.createDataFrame(rows, "t int, j int, a string, b string, n_pairs int, label string, base boolean").withColumn("h", F.xxhash64("a", "b"))
    # The mark that each text's last word meets: no second word.
    return t.unionByName(spark.createDataFrame([(-1, 0, None, None, 1, None, False, 0)], "t int, j int, a string, b string, n_pairs int, label string, base boolean, h long"))


def votes(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, _rid and one row per hit: template t, its figures, pos in the text, j in the template."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(*keep, F.monotonically_increasing_id().alias("_rid"), F.array_remove(F.split(lowered(text), SEPARATORS), "").alias("_w"))
    # arrays_zip fills the shorter side up: the last word stands alone.
    zipped = words.select(*keep, "_rid", F.posexplode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))).alias("pos", "p"))
    zipped = zipped.select(*keep, "_rid", "pos", F.col("p.a").alias("_a"), F.col("p.b").alias("_b"))
    h = F.when(F.col("_b").isNull(), F.lit(0)).otherwise(F.xxhash64("_a", "_b"))
    t = _pairs(docs.sparkSession)
    # The templates are a constant of this module.
    hit = zipped.withColumn("_h", h).join(F.broadcast(t), (F.col("_h") == t.h) & ((F.col("_b").isNull() & (t.t < 0)) | ((F.col("_a") == t.a) & (F.col("_b") == t.b))))
    return hit.select(*keep, "_rid", "pos", "t", "j", "n_pairs", "label", "base")


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """keep (doc_id), n_words, n_base, first_word, last_word, base_labels, labels and score of each row's whole text."""
    keep = keep or ["doc_id"]
    hits = votes(docs, keep, text_col).repartition("_rid")
    last = F.col("t") < 0
    diag = F.when(last, F.coalesce(F.col("pos") + 1, F.lit(0))).otherwise(F.col("pos") - F.col("j"))
    by = hits.withColumn("diag", diag).groupBy("_rid", "t", "diag").agg(
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"), *[F.first(c).alias(c) for c in ("n_pairs", "label", "base", *keep)])
    own = Window.partitionBy("_rid", "t").orderBy("diag")
    by = by.withColumn("far", (F.col("diag") - F.lag("diag").over(own) > GAP).cast("int"))
    by = by.withColumn("span", F.sum(F.coalesce("far", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = F.bit_or("mask").over(Window.partitionBy("_rid", "t", "span"))
    by = by.withColumn("cover", F.bit_count(merged) / F.col("n_pairs"))
    notice = ~last
    place = notice & F.col("base") & (F.bit_count("mask") == F.col("n_pairs"))
    found = place | (notice & ~F.col("base") & (F.col("cover") >= COVER))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = by.groupBy("_rid").agg(
        *[F.first(c).alias(c) for c in keep], F.max(F.when(last, F.col("diag"))).cast("long").alias("n_words"), F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("diag"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("diag"))).cast("long").alias("last_word"),
        names(place).alias("base_labels"), names(found).alias("labels"),
        F.coalesce(F.max(F.when(place, F.lit(1.0)).when(found, F.col("cover"))), F.lit(0.0)).alias("score"))
    return out.drop("_rid")
