r"""Exact top-k inner products by multi-resolution segment statistics.

Each component x becomes the integer floor(1024 * x). Vectors are rotated by an orthogonal
matrix, fitted on a bounded sample (``PILOT``) so that the leading coordinates carry the most;
products stay the same, and it only serves the bounds. A resolution cuts the coordinates into
segments: the leading share (``LEVELS``, coarse to fine) one by one, the rest in ``TAIL``
pieces. A segment's statistics are its mean and its deviation (the norm of what is left without
the mean). Over segments of length L

    <q, x>  <=  sum over segments of  L * mean(q) * mean(x) + dev(q) * dev(x)

as Cauchy-Schwarz bounds the centred parts, which is the lower bound
L * ((mean(q) - mean(x))^2) + (dev(q) - dev(x))^2 on squared distances seen through
|q - x|^2 = |q|^2 + |x|^2 - 2 <q, x>. Vectors whose bound stays under a query's k-th best
score so far drop out, coarse to fine; the exact integer product decides among the survivors.

All vectors are packed into blocks (a row with the ids and a matrix). The queries, a stated
subset, are dealt into groups of bounded bytes (``GROUP_BYTES``), and one group after the other
is broadcast to a pass over the blocks, so vectors are never shuffled and queries are not
copied through one. A pass goes in waves, each some eight times the last: a wave's tasks keep
their k best for each query, tightening the threshold from block to block, and the k-th best
of all waves so far is the next wave's first threshold. A query thus sends on a few times k
rows a wave, however many blocks there are.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; empty vectors score 0; repeated vec_ids are
rows of their own, and only the query's own row is left out; ties go to the smaller vec_id;
null vec_ids are candidates, last among ties, but no queries. Sums are exact whatever the
components; components and scores beyond a long saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import fresh_path, small_batches, written

SCALE = 1024
#: Share of the coordinates that stand alone at each resolution, coarse to fine, and segments of the rest.
LEVELS, TAIL = (0.5, 0.75, 0.875), 4
#: Vectors that fit the rotation and give the first thresholds.
PILOT = 4_096
BLOCK_ROWS, GROUP_BYTES = 8_192, 32 << 20
#: Rows of a group that are compared with a block at a time, pairs that are compared one by one at a time.
TILE, PAIRS = 512, 1 << 16
#: All bounds of a tile are taken at once while more than one pair in so many is alive.
DENSE = 16
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_SHAPE = "n int, dim int, width int, uids binary, ids binary, nulls binary, data binary"


def _usable(c):
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class Block:
    """Vectors with their row numbers and ids, as arrays."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, null: np.ndarray, x: np.ndarray):
        self.uid, self.ids, self.null, self.x = uid, ids, null, x

    @staticmethod
    def of(r, at: str = "") -> Block:
        """From a row's columns, whose names begin with at."""
        get = lambda c: getattr(r, at + c)
        x = np.frombuffer(get("data"), f"<i{get('width')}").reshape(get("n"), get("dim"))
        return Block(np.frombuffer(get("uids"), np.int64), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("nulls"), np.uint8).astype(bool), x.astype(np.int64))

    def columns(self) -> dict[str, list]:
        """The columns of _SHAPE, components in as few bytes as hold them all."""
        top = max(int(self.x.max(initial=0)), -int(self.x.min(initial=0)) - 1)
        width = next(w for w in (2, 4, 8) if top < 1 << (8 * w - 1))
        return {"n": [len(self.x)], "dim": [self.x.shape[1]], "width": [width], "uids": [self.uid.tobytes()], "ids": [self.ids.tobytes()],
                "nulls": [self.null.astype(np.uint8).tobytes()], "data": [self.x.astype(f"<i{width}").tobytes()]}


def _block(held: list[tuple[int, int | None, np.ndarray]]) -> Block:
    x = np.zeros((len(held), max(1, *(len(v) for *_, v in held), 1)), np.int64)
    for i, (*_, v) in enumerate(held):
        x[i, : len(v)] = v
    return Block(np.array([h[0] for h in held], np.int64), np.array([h[1] or 0 for h in held], np.int64), np.array([h[1] is None for h in held], bool), x)


def packed(df: DataFrame, id_col: str, vec_col: str, rows: int, uid: str) -> DataFrame:
    """Blocks (columns of _SHAPE) of at most rows vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, np.ndarray]] = []
        types = [pa.int32()] * 3 + [pa.binary()] * 4
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(_block(held).columns().values(), types, strict=True)], names=[c.split()[0] for c in _SHAPE.split(", ")])
        for b in batches:
            lists = b.column(2)
            flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
            flat = np.clip(flat, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            ends = np.cumsum([0, *(len(v) for v in lists)])
            for i, (u, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held.append((u, k, flat[ends[i] : ends[i + 1]]))
                if len(held) >= rows:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    narrow = df.select(uid, F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
    return narrow.mapInArrow(pack, _SHAPE)


def _level(y: np.ndarray, share: float) -> np.ndarray:
    """Rows whose products bound inner products from above: single coordinates, then sqrt(L) * mean and deviation of each segment."""
    alone = int(np.ceil(share * y.shape[1]))
    cuts = np.unique(np.linspace(alone, y.shape[1], TAIL + 1).astype(int))
    out = [y[:, :alone]]
    for a, b in zip(cuts, cuts[1:], strict=False):
        mean = y[:, a:b].mean(axis=1, keepdims=True)
        out += [mean * np.sqrt(b - a), np.linalg.norm(y[:, a:b] - mean, axis=1, keepdims=True)]
    return np.hstack(out)


def _beyond(q: np.ndarray, x: np.ndarray) -> float:
    """A bound on all products' sizes."""
    return max(1, q.shape[1]) * np.abs(q.astype(np.float64)).max(initial=0.0) * np.abs(x.astype(np.float64)).max(initial=0.0)


def _whole(q: np.ndarray, x: np.ndarray) -> int:
    return min(_HIGH, max(_LOW, sum(int(a) * int(b) for a, b in zip(q, x, strict=True))))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q with all rows of x; what no long holds saturates."""
    most = _beyond(q, x)
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    out = q @ x.T
    if most >= 2**63:
        # Only pairs that might not fit are summed in Python's integers.
        qm, xm = (np.abs(v.astype(np.float64)).max(axis=1, initial=0.0) for v in (q, x))
        for i, j in np.argwhere(max(1, q.shape[1]) * qm[:, None] * xm[None, :] >= 2**63):
            out[i, j] = _whole(q[i], x[j])
    return out


def _exact_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of row i of q with row i of x."""
    most = _beyond(q, x)
    if most < 2**53:
        return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    out = np.einsum("ij,ij->i", q, x)
    if most >= 2**63:
        qm, xm = (np.abs(v.astype(np.float64)).max(axis=1, initial=0.0) for v in (q, x))
        for i in np.flatnonzero(max(1, q.shape[1]) * qm * xm >= 2**63):
            out[i] = _whole(q[i], x[i])
    return out


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def rotation(pilot: np.ndarray) -> np.ndarray:
    """Orthogonal columns, those that carry most of the pilot's squares first."""
    f = pilot.astype(np.float64)
    top = np.abs(f).max(initial=1.0) or 1.0
    return np.linalg.eigh((f / top).T @ (f / top))[1][:, ::-1]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest score, or the least number there is."""
    if scores.shape[1] < k:
        return np.full(len(scores), _LOW)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def thresholds(q: Block, x: Block, dim: int, k: int) -> np.ndarray:
    """Each query's k-th best score within x, its own row left out."""
    out = [np.zeros(0, np.int64)]
    wide = _wide(x.x, dim)
    for t in range(0, len(q.x), TILE):
        s = _exact(_wide(q.x[t : t + TILE], dim), wide)
        s[q.uid[t : t + TILE, None] == x.uid[None, :]] = _LOW
        out.append(_kth(s, k))
    return np.concatenate(out)


class Group:
    """A group of queries: their rotated vectors and statistics at every resolution."""

    def __init__(self, block: Block, turn: np.ndarray):
        self.block, self.turn, self.q = block, turn, _wide(block.x, len(turn))
        y = self.q @ turn
        self.norm, self.levels = np.linalg.norm(y, axis=1), [_level(y, s) for s in LEVELS]


def search_block(g: Group, xb: Block, least: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all vectors of xb that reach a query's threshold; seen gets the pairs alive after each resolution."""
    x = _wide(xb.x, len(g.turn))
    y = x @ g.turn
    norm, levels = np.linalg.norm(y, axis=1), [_level(y, s) for s in LEVELS]
    alive, out = [0] * (len(LEVELS) + 1), []
    for t in range(0, len(g.q), TILE):
        rows = slice(t, t + TILE)
        # Slack for the rounding of doubles, so that a bound is never under the exact product.
        need = least[rows].astype(np.float64)[:, None] - 1 - 1e-9 * g.norm[rows, None] * norm[None, :]
        keep = g.block.uid[rows, None] != xb.uid[None, :]
        counts = [keep.size]
        for lq, lx in zip(g.levels, levels, strict=True):
            # While many pairs are alive, all bounds at once cost less than picking pairs out.
            if len(counts) > 1 and counts[-1] * DENSE < keep.size:
                break
            keep &= lq[rows] @ lx.T >= need
            counts.append(np.count_nonzero(keep))
        left = len(counts) - 1
        i, j = np.nonzero(keep)
        counts += [0] * (len(levels) - left)
        for a in range(0, len(i), PAIRS):
            pi, pj = i[a : a + PAIRS], j[a : a + PAIRS]
            for n, (lq, lx) in enumerate(zip(g.levels[left:], levels[left:], strict=True), left + 1):
                ok = np.einsum("ij,ij->i", lq[t + pi], lx[pj]) >= need[pi, pj]
                pi, pj = pi[ok], pj[ok]
                counts[n] += len(pi)
            score = _exact_pairs(g.q[t + pi], x[pj])
            ok = score >= least[t + pi]
            out.append((t + pi[ok], pj[ok], score[ok]))
        alive = [a + c for a, c in zip(alive, counts, strict=True)]
    if seen is not None:
        seen[:] = [a + b for a, b in zip(seen or [0] * len(alive), alive, strict=True)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Best:
    """The k best rows of each query so far, ties to smaller ids and nulls last."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.rows = least.copy(), k, (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        i, score, ids, null = (np.concatenate(c) for c in zip(self.rows, (i, score, ids, null), strict=True))
        order = np.lexsort((ids, null, ~score, i))  # ~score falls as score grows, without overflow
        i, score, ids, null = i[order], score[order], ids[order], null[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        last = place == self.k - 1
        self.least[i[last]] = np.maximum(self.least[i[last]], score[last])
        self.rows = tuple(c[place < self.k] for c in (i, score, ids, null))


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, block_rows: int) -> DataFrame:
    """All usable vectors in blocks; wave is geometric in a hash of the block's number."""
    rows = vectors.where(_usable(vec_col)).withColumn("_uid", F.monotonically_increasing_id())
    blocks = packed(rows, id_col, vec_col, block_rows, "_uid").withColumn("_h", F.xxhash64(F.monotonically_increasing_id()).bitwiseOR(F.lit(1 << 24)))
    blocks = blocks.withColumn("wave", F.expr("cast((length(bin(_h & -_h)) - 1) div 3 AS int)")).drop("_h")
    path = fresh_path(vectors.sparkSession, "vectors")
    blocks.write.partitionBy("wave").parquet(path)
    return vectors.sparkSession.read.schema(blocks.schema).parquet(path)


def _picked(blocks: DataFrame, keep, most: int) -> DataFrame:
    """Blocks' vectors that keep(block) marks, as blocks again, of at most most vectors."""

    def pick(frames):
        for f in frames:
            for r in f.itertuples():
                b = Block.of(r)
                at = np.flatnonzero(keep(b))
                for s in range(0, len(at), most):
                    i = at[s : s + most]
                    yield pd.DataFrame(Block(b.uid[i], b.ids[i], b.null[i], b.x[i]).columns())

    return blocks.drop("wave").mapInPandas(pick, _SHAPE)


def _together(rows: list, dim: int) -> Block:
    made = [Block.of(r) for r in rows]
    cat = lambda c: np.concatenate([getattr(b, c) for b in made])
    return Block(cat("uid"), cat("ids"), cat("null"), np.concatenate([_wide(b.x, dim) for b in made]))


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", modulus: int = 100, block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for every row whose id is divisible by modulus, against all rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    found, result = "uid long, query_id long, vec_id long, score long", "query_id long, rank int, vec_id long, score long"
    blocks = _blocks(vectors, id_col, vec_col, block_rows)
    waves = {r["wave"]: (r["dim"], r["n"]) for r in blocks.groupBy("wave").agg(F.max("dim").alias("dim"), F.sum("n").alias("n")).collect()}  # nine at most
    if not waves:
        return spark.createDataFrame([], result)
    dim, n = max(d for d, _ in waves.values()), sum(c for _, c in waves.values())
    # A sample by the row number's multiplicative hash, which spreads evenly: some PILOT vectors whatever n is.
    part = _picked(blocks, lambda b: (b.uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) < (1 << 40) * min(1.0, PILOT / n), block_rows)
    sampled = part.collect()
    pilot = _together(sampled, dim) if sampled else None
    turn = rotation(pilot.x if pilot else np.zeros((1, dim), np.int64))
    # Queries in groups of bounded bytes. Blocks of queries are numbered by their running size, which is narrow.
    rows = max(1, group_bytes // (16 * dim))
    asked = written(_picked(blocks, lambda b: ~b.null & (b.ids % modulus == 0), rows).withColumn("b", F.monotonically_increasing_id()), "asked")
    ahead = F.sum("n").over(Window.orderBy("b")) - F.col("n")
    dealt = written(asked.select("b", "n").select("b", F.floor(ahead / rows).cast("int").alias("g")), "groups")
    at = fresh_path(spark, "queries")
    asked.join(dealt, "b").drop("b").write.partitionBy("g").parquet(at)
    queries = spark.read.schema(f"{_SHAPE}, g int").parquet(at)
    last = dealt.agg(F.max("g")).first()[0]
    n_groups = 0 if last is None else last + 1
    best, w = fresh_path(spark, "best"), Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    for g in range(n_groups):
        mine = queries.where(F.col("g") == g).collect()  # less than group_bytes
        if not mine:
            continue
        asks = _together(mine, dim)
        least = thresholds(asks, pilot, dim, k) if pilot else np.full(len(asks.x), _LOW)
        order, top = np.argsort(asks.uid), None
        for wave in sorted(waves, reverse=True):
            sent = spark.sparkContext.broadcast((asks.uid, asks.ids, asks.null, asks.x, turn, least))

            def search(frames, sent=sent):
                uid, ids, null, x, turn, least = sent.value
                group, kept = Group(Block(uid, ids, null, x), turn), Best(least, k)
                for f in frames:
                    for r in f.itertuples():
                        xb = Block.of(r)
                        i, j, s = search_block(group, xb, kept.least)
                        kept.add(i, s, xb.ids[j], xb.null[j])
                i, s, v, none = kept.rows
                for at in range(0, len(i), PAIRS):
                    p = slice(at, at + PAIRS)
                    yield pd.DataFrame({"uid": uid[i[p]], "query_id": ids[i[p]], "vec_id": pd.arrays.IntegerArray(v[p], none[p]), "score": s[p]})

            new = blocks.where(F.col("wave") == wave).drop("wave").mapInPandas(search, found)
            ranked = (new if top is None else new.unionByName(top)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            if wave == min(waves):
                ranked.write.mode("append").parquet(best)
            else:
                top = written(ranked.drop("rank"), "top")
                # One number a query of this group.
                for r in top.groupBy("uid").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k).collect():
                    at = order[np.searchsorted(asks.uid, r["uid"], sorter=order)]
                    least[at] = max(least[at], r["s"])
            sent.destroy()
    if not n_groups:
        return spark.createDataFrame([], result)
    return spark.read.schema(f"{found}, rank int").parquet(best).select("query_id", "rank", "vec_id", "score")
