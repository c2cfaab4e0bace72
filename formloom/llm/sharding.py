r"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group that is placed as a whole. Groups are placed one after the other,
largest first, each into the shard whose residual capacity has the highest dot product with
the group's (bytes, tokens, rows), all in shares of a shard's fair part; a shard that has
room for the bytes goes before one that has not, as the law that holds is ``bytes``: the
shards' sizes are near equal, and tokens and rows are as balanced as the groups allow.

Groups over 1/``HEAVY`` of a shard in some dimension come first, on the driver: there are at
most 3 * shards * ``HEAVY`` of them in any corpus. One that fits into no shard's residual and is
over 1/``CUT`` of a shard is cut into pieces of 1/``PIECES`` of a shard that are placed like groups;
smaller ones stay whole even so. All lighter groups are then
placed whole and one by one on executors, in lanes of some ``LANE`` groups dealt by a hash of
the text: each lane has its share of every shard's residual capacity, so that lanes do not wait
for one another and their shards add up. With one lane this is the plain greedy over all
groups; more groups only make more lanes.

Slots number a shard's documents from 0 without gaps, counted by stretches of row numbers.

Defined results: null and empty texts are one group of size 1 per row (crc32 0); repeated rows
each get a slot; null ids are placed like others; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import fresh_path, n_words, numbered, written

SHARDS = 8
#: Share of a shard above which a group is placed before all lanes, as a divisor; groups of a lane.
HEAVY, LANE = 200, 16_384
#: Shares of a shard, as divisors: above which a group that fits nowhere is cut, and of the pieces.
CUT, PIECES = 4, 16
DIMS = ("bytes", "tokens", "rows")


def _best(left: np.ndarray, share: np.ndarray) -> tuple[int, bool]:
    """The shard for a load, and whether it has room for its bytes."""
    room = left[:, 0] >= share[0] - 1e-12
    if room.any():
        return int(np.where(room, left @ share, -np.inf).argmax()), True
    return int(left[:, 0].argmax()), False


def _order(shares: np.ndarray) -> np.ndarray:
    return np.argsort(-shares.max(axis=1, initial=0.0), kind="stable")


def placed(loads: np.ndarray, fair: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Shard of each load (bytes, tokens, rows); fair is a shard's part and left the shards' residual capacity, in shares of fair."""
    shares, left = loads / np.maximum(fair, 1e-9), left.copy()
    out = np.zeros(len(loads), np.int64)
    for i in _order(shares):
        out[i], _ = _best(left, shares[i])
        left[out[i]] -= shares[i]
    return out


def cut(loads: np.ndarray, fair: np.ndarray, shards: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """Like placed, but what fits nowhere is cut: (shard, rows) of each load, and the shards' residual capacity."""
    shares, left = loads / np.maximum(fair, 1e-9), np.ones((shards, loads.shape[1]))
    out: list[list[tuple[int, int]]] = [[] for _ in loads]
    for i in _order(shares):
        rows, row = int(loads[i, -1]), shares[i] / loads[i, -1]
        fits = shares[i, 0] <= 1 / CUT or _best(left, shares[i])[1]
        # All rows of a group are alike, so a piece is a number of rows.
        step = rows if fits else max(1, int(1 / (PIECES * row[0])))
        put = np.zeros(shards, np.int64)
        for n in [step] * (rows // step) + [rows % step] * bool(rows % step):
            best, _ = _best(left, row * n)
            left[best] -= row * n
            put[best] += n
        out[i] = [(int(s), int(put[s])) for s in np.flatnonzero(put)]
    return out, left


def _rows(docs: DataFrame, keep: list[F.Column] | None = None) -> DataFrame:
    raw = F.col("text").cast("string")
    text = F.coalesce(raw, F.lit("")).cast("binary")
    return docs.select(
        *(keep or []), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), n_words(raw).alias("tokens"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("g"), F.monotonically_increasing_id().alias("rid"))


def assigned(rows: DataFrame, shards: int = SHARDS, lane: int = LANE) -> DataFrame:
    """rows (written, as _rows gives them) with their shard."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    total = groups.agg(*[F.sum(d) for d in DIMS], F.count("*")).first()
    if not total[3]:
        return rows.withColumn("shard", F.lit(0)).drop("g")
    fair = np.array([(v or 0) / shards for v in total[:3]], np.float64)
    over = F.greatest(*[F.col(d) / float(max(f, 1e-9)) for d, f in zip(DIMS, fair, strict=True)]) > 1 / HEAVY
    # At most len(DIMS) * shards * HEAVY groups are that heavy.
    heavy = groups.where(over).orderBy("g").collect()
    loads = np.array([[r[d] for d in DIMS] for r in heavy], np.float64).reshape(len(heavy), len(DIMS))
    pieces, left = cut(loads, fair, shards)
    light = fair * shards - loads.sum(axis=0)
    lanes = max(1, -(-(total[3] - len(heavy)) // lane))

    def place(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("g", ignore_index=True)
        own = f[list(DIMS)].to_numpy(np.float64)
        # The lane's part of a shard, so that its loads are in shares of what it may fill.
        mine = fair * np.where(light > 0, own.sum(axis=0) / np.maximum(light, 1e-9), 0.0)
        return pd.DataFrame({"g": f["g"], "shard": placed(own, mine, left).astype(np.int32)})

    put = groups.where(~over).withColumn("lane", F.pmod(F.xxhash64("g", F.lit(11)), F.lit(lanes))).groupBy("lane").applyInPandas(place, "g binary, shard int")
    # Tables of the heavy groups, bounded like them.
    whole = [(bytes(r.g), p[0][0] if len(p) == 1 else -1) for r, p in zip(heavy, pieces, strict=True)]
    known = rows.join(F.broadcast(spark.createDataFrame(whole, "g binary, shard int")), "g", "left")
    parts = [known.where("shard >= 0"), known.where("shard IS NULL").drop("shard").join(put, "g")]
    torn = [(bytes(r.g), s, int(at), int(at + n)) for r, p in zip(heavy, pieces, strict=True) if len(p) > 1 for (s, n), at in zip(p, np.cumsum([0, *(n for _, n in p)]), strict=False)]
    if torn:
        table = F.broadcast(spark.createDataFrame(torn, "_g binary, shard int, low long, high long"))
        some = numbered(known.where("shard = -1").drop("shard"), ["g"], "rid", "_n")
        parts.append(some.join(table, (F.col("g") == F.col("_g")) & (F.col("_n") >= F.col("low")) & (F.col("_n") < F.col("high"))).drop("_g", "low", "high", "_n"))
    cols = [c for c in rows.columns if c != "g"] + ["shard"]
    return reduce(DataFrame.unionByName, [p.select(cols) for p in parts])


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and tokens of each document."""
    out = numbered(written(assigned(written(_rows(docs), "sizes"), shards), "assigned"), ["shard"], "rid", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS) -> str:
    """Write docs into one folder per shard (shard=0, ...) and return the path.

    A column of docs called shard (in any case) is written as _shard, with further underscores
    if that is there too. Rows are written once with a number and meet their shard by it, and
    tasks write what they hold, so no task gathers a whole shard.
    """
    path = path or fresh_path(docs.sparkSession, "shards")
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = [F.col(f"`{c}`").alias(v) for c, v in aside.items()]
    base = written(_rows(docs, own), "numbered")
    plan = assigned(base.select("doc_id", "size", "tokens", "text_crc32", "g", "rid"), shards).select("rid", "shard")
    taken = {c.lower() for c in docs.columns}
    name = "_shard"
    while name in taken:
        name = "_" + name
    put = base.select(*aside.values(), "rid").join(plan, "rid").select(*[F.col(v).alias(name if c.lower() == "shard" else c) for c, v in aside.items()], "shard")
    put.write.partitionBy("shard").parquet(path)
    return path
