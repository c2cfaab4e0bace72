r"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 bits over word shingles hashed with XXH64. Two of them link at ``RADIUS``
(3) or fewer differing bits. Such a pair differs in one bit at most in one of its two 32-bit
halves, so each half gets a vantage-point tree of its own that is searched at radius 1, where
the triangle bound prunes far better than radius 3 does on 64 bits.

A tree node holds a vantage point v and a distance mu. A half x with d(x, v) <= mu belongs
inside; by the triangle inequality a partner of it has d <= mu + 1, so halves at exactly mu + 1
overlap the boundary and go to both sides. Every linking pair thus meets in some leaf. The
trees' upper levels are fitted on a bounded sample of the fingerprints (``SAMPLE``) and sent
to the executors; all distinct fingerprints are dealt to the leaves (shards). In a shard the
tree goes on over the shard's own fingerprints until leaves are small, where all 64 bits are
compared exactly. A shard gives a spanning forest of its links, never all pairs, and the
forests are joined into components by alternating large and small stars, each round a written
table.

The near-duplicates stage (``deduplicated``) searches by the same trees: fingerprints of 64 blocks
of 16 bits, a tree of radius 1 for each block, and exact similarities of what they bring together.

Defined results: null and empty texts have fingerprint zero, linked like any other; texts of
one or two words are a single shingle; null ids never become a component's id while another
id is there; repeated rows share a component; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import content_hash, map_texts, row_key, written
from formloom.session import small_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints, at most, that the driver sees to fit the trees' upper levels.
SAMPLE = 100_000
#: Fingerprints a shard should hold, and those compared pairwise in a leaf.
SHARD, LEAF = 8_192, 2_048
_HALF = np.uint64(0xFFFFFFFF)
#: The near-duplicates stage: words of a shingle, and 16-bit blocks of a wide fingerprint, a tree each.
WORDS, BLOCKS = 5, 64
#: Bits, at most, that a pair to be compared differs in: in one block at least, in the first 192, in all 1,024.
CLOSE, CHECK, FAR = 1, 64, 240
#: Wide fingerprints, at most about, that the driver sees; those a shard of a block should hold; those compared pairwise in a leaf.
WIDE_SAMPLE, WIDE_SHARD, WIDE_LEAF = 32_768, 32_768, 512
#: Wide fingerprints that a task deals to the shards at a time.
DEAL = 16_384
#: Members of a bucket in a tile, and bytes of their sets, on average at most.
TILE, TILE_BYTES = 4_096, 32 << 20
#: What names two tiles of a bucket whose members are compared.
PAIR = ["bucket", "low", "high"]
#: A multiplier that mixes the hashes of a shingle's words.
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What a shard gets of a wide fingerprint: its node and size, the shard's block, and the first 192 bits.
_ENTRY = np.dtype([("node", "<i8"), ("size", "<i4"), ("block", "<u2"), ("check", "<u8", 3)])
#: Bits, as a power of two, of the filter of keys in front of a join: 8 MB that are broadcast, however many keys there are.
FILTER_BITS = 26


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and exactly the contract's white space
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n < 1:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _make():
    def each(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return each


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and fp (the fingerprint as a signed long) of each row's whole text."""
    return map_texts(df, text_col, keep, [T.StructField("fp", T.LongType())], _make)


class VpTree:
    """Upper levels over half fingerprints: arrays of nodes; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf: int, radius: int, tries: int = 8):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.root = self._grow(points, leaf, tries)

    def _grow(self, x: np.ndarray, leaf: int, tries: int) -> int:
        """Index of the node for x, or -1 - leaf."""
        best = self._split(x, tries) if len(x) > leaf else None
        if best is None:
            self.leaves += 1
            return -self.leaves
        v, mu = best
        at = len(self.nodes)
        self.nodes.append(None)
        d = np.bitwise_count(x ^ v)
        self.nodes[at] = (v, mu, self._grow(x[d <= mu + self.radius], leaf, tries), self._grow(x[d > mu], leaf, tries))
        return at

    def _split(self, x: np.ndarray, tries: int) -> tuple[np.uint64, int] | None:
        """The vantage point and distance whose larger side is smallest, so that overlap and imbalance both count."""
        found = None
        for v in x[:: max(1, len(x) // tries)][:tries]:
            upto = np.cumsum(np.bincount(np.bitwise_count(x ^ v), minlength=65))
            larger = np.maximum(upto[np.minimum(np.arange(65) + self.radius, 64)], len(x) - upto)
            mu = int(larger.argmin())
            if found is None or larger[mu] < found[0]:
                found = (int(larger[mu]), v, mu)
        return None if found is None or found[0] > 0.9 * len(x) else found[1:]

    def dealt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x and the leaves they go to; boundary points go to several."""
        idx, leaf, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            at, i = todo.pop()
            if not len(i):
                continue
            if at < 0:
                idx.append(i)
                leaf.append(np.full(len(i), -1 - at, np.int64))
                continue
            v, mu, inside, outside = self.nodes[at]
            d = np.bitwise_count(x[i] ^ v)
            todo += [(inside, i[d <= mu + self.radius]), (outside, i[d > mu])]
        if not idx:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(idx), np.concatenate(leaf)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each point's root) after linking a with b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label = up


def spanning(x: np.ndarray, radius: int = RADIUS, most: int = LEAF, also=None) -> np.ndarray:
    """For each fingerprint of a shard the position of its component's first one, over exact distances.

    Leaves hold ``most`` fingerprints; also(a, b) tells which of the pairs within radius link, all where it is None.
    """
    label = np.arange(len(x))
    todo = [np.arange(len(x))]
    while todo:
        i = todo.pop()
        tree = VpTree(x[i], most, radius) if len(i) > most else None
        if tree is not None and tree.leaves > 1:
            pos, leaf = tree.dealt(x[i])
            order = np.argsort(leaf, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                label = _pairs(x, i[pos[part]], label, radius, also)
        else:
            label = _pairs(x, i, label, radius, also)
    return label


def _pairs(x: np.ndarray, i: np.ndarray, label: np.ndarray, radius: int, also=None) -> np.ndarray:
    """label after comparing all of i among themselves, block by block."""
    y = x[i]
    step = max(1, (1 << 20) // max(1, len(y)))
    for s in range(0, len(y), step):
        near = np.bitwise_count(y[s : s + step, None] ^ y[None, s:]) <= radius
        a, b = np.divmod(np.flatnonzero(near), near.shape[1])
        up = b > a
        a, b = i[s + a[up]], i[s + b[up]]
        if also is not None:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            good = also(a, b)
            a, b = a[good], b[good]
        if len(a):
            label = _merge(label, a, b)
    return label


def _halves(x: np.ndarray) -> list[np.ndarray]:
    return [x & _HALF, x >> np.uint64(32)]


def links(nodes: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in nodes.fp that connect just what is linked."""
    n = nodes.count()
    share = min(1.0, sample / max(1, n))
    # A sample by hash: the same fingerprints whatever the partitions.
    part = nodes.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp")
    seen = np.sort(np.array([r[0] for r in part.limit(2 * sample).collect()], np.int64)).view(np.uint64)
    trees = [VpTree(h, max(16, int(shard * share)), 1) for h in _halves(seen)]

    def deal(frames):
        for f in frames:
            x = f["fp"].to_numpy(np.int64).view(np.uint64)
            base = 0
            for tree, half in zip(trees, _halves(x), strict=True):
                i, leaf = tree.dealt(half)
                yield pd.DataFrame({"shard": leaf + base, "fp": x[i].view(np.int64)})
                base += tree.leaves

    def search(f: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(f["fp"].to_numpy(np.int64)).view(np.uint64)
        root = spanning(x)
        far = root != np.arange(len(x))
        return pd.DataFrame({"a": x[root[far]].view(np.int64), "b": x[far].view(np.int64)})

    shards = nodes.select("fp").mapInPandas(deal, "shard long, fp long")
    return shards.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in edges, root being the least node it reaches.

    Large and small stars in turn until nothing changes; each round is a written table.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def mark(e: DataFrame):
        # xor is the same in any order and overflows nowhere
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = (both.where("v > u") if large else both).join(least, "u")
        new = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            new = new.unionByName(least.select("u", F.col("m").alias("v")))
        return new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    before = mark(e)
    while before[0]:
        e = written(star(star(e, True), False), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (a written table with fp) with root, the fingerprint that stands for the row's component, and component_id."""
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("first"))
    comp = components(links(written(nodes.select("fp"), "nodes"))).withColumnRenamed("node", "fp")
    labelled = nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of each document."""
    rows = written(fingerprints(docs, ["doc_id"]), "simhash")
    return grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes) -> np.ndarray:
    """The set of a UTF-8 text's shingles of ``WORDS`` words, as sorted hashes; each is made of its words' hashes."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    long = min(WORDS, len(words))
    n = len(words) - long + 1
    h = each[:n]
    for k in range(1, long):
        h = (h ^ (h >> np.uint64(29))) * _ODD + each[k : n + k]
    h = np.sort(h ^ (h >> np.uint64(32)))
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is 0.8 or more, in whole numbers."""
    if min(len(x), len(y)) * 5 < max(len(x), len(y)) * 4:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _wide():
    """Per text a number of its set of shingles, the set's wide fingerprint, and its size."""
    rng = np.random.default_rng(SEED)
    flip, odd = rng.integers(0, 1 << 63, (2, BLOCKS // 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def simhash(h: np.ndarray) -> bytes:
        ones = np.zeros(16 * BLOCKS, np.int64)
        for at in range(0, len(h), 255):  # so that a byte holds the counts
            x = (h[at : at + 255, None] ^ flip) * odd
            x = (x ^ (x >> np.uint64(32))) * _ODD
            x ^= x >> np.uint64(29)
            ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        return np.packbits(2 * ones > len(h), bitorder="little").tobytes()

    def each(texts: list[bytes]) -> list[pa.Array]:
        from xxhash import xxh3_64_intdigest

        sets = [shingles(t) for t in texts]
        node = np.array([xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        return [pa.array(node), pa.array([simhash(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64())]

    return each


def _blocks(sigs) -> np.ndarray:
    """Wide fingerprints as rows of 16-bit blocks."""
    return np.frombuffer(b"".join(sigs), "<u2").reshape(-1, BLOCKS)


def _met(nodes: DataFrame) -> DataFrame:
    """(node, band, bucket, b, n, words): the groups of wide fingerprints that a vantage-point tree brings together.

    Each block has a tree of radius ``CLOSE`` of its own, its upper levels fitted on a bounded
    sample; every fingerprint is dealt to its shards in all trees, at a boundary to both sides.
    In a shard the tree goes on to small leaves, whose pairs are compared exactly. Pairs within
    ``CLOSE`` bits in the block and ``CHECK`` in the first 192, of sizes that allow 0.8, chain
    to a group (bucket): b is its least node, n its members, words the sum of their sizes.
    """
    count = nodes.count()
    share = min(1.0, WIDE_SAMPLE / max(1, count))
    part = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).select("sig")
    seen = _blocks(sorted(bytes(r[0]) for r in part.limit(2 * WIDE_SAMPLE).collect()))
    trees = [VpTree(x, max(16, int(WIDE_SHARD * share)), CLOSE) for x in seen.T]
    most = WIDE_LEAF

    def packed(batches):
        t = pa.Table.from_batches(batches)
        node, size, block = t["node"].to_numpy(), t["size"].to_numpy(), _blocks(t["sig"].to_pylist())
        check, base = np.ascontiguousarray(block[:, :12]).view("<u8"), 0
        for band, tree in enumerate(trees):
            i, leaf = tree.dealt(block[:, band])
            order = np.argsort(leaf, kind="stable")
            i, leaf = i[order], leaf[order]
            entries = np.empty(len(i), _ENTRY)
            entries["node"], entries["size"], entries["block"], entries["check"] = node[i], size[i], block[i, band], check[i]
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1), len(i)]
            made = [pa.array(np.full(len(cuts) - 1, band, np.int32)), pa.array(base + leaf[cuts[:-1]]), pa.array([entries[s:e].tobytes() for s, e in pairwise(cuts)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["band", "shard", "entries"])
            base += tree.leaves

    def deal(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= DEAL:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    def search(f: pd.DataFrame) -> pd.DataFrame:
        e = np.frombuffer(b"".join(f["entries"]), _ENTRY)
        e = e[np.argsort(e["node"])]
        node, size, check = (np.ascontiguousarray(e[c]) for c in ("node", "size", "check"))

        def also(a, b):
            good = np.flatnonzero(5 * np.minimum(size[a], size[b]).astype(np.int64) >= 4 * np.maximum(size[a], size[b]).astype(np.int64))
            return good[np.bitwise_count(check[a[good]] ^ check[b[good]]).sum(axis=1, dtype=np.int64) <= CHECK]

        label = spanning(np.ascontiguousarray(e["block"]), CLOSE, most, also)
        n, words = np.bincount(label, minlength=len(e)), np.bincount(label, size, minlength=len(e)).astype(np.int64)
        of = label[n[label] > 1]
        columns = {"node": node[n[label] > 1], "band": f["band"].iloc[0], "shard": f["shard"].iloc[0], "b": node[of], "n": n[of], "words": words[of]}
        return pd.DataFrame(columns)

    small_batches(nodes.sparkSession)
    shards = nodes.select("node", "size", "sig").mapInArrow(deal, "band int, shard long, entries binary")
    met = shards.groupBy("shard").applyInPandas(search, "node long, band int, shard long, b long, n long, words long")
    return met.select("node", "band", F.xxhash64("shard", "b").alias("bucket"), "b", "n", "words")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike, compared shingle by shingle."""

    def check(batches):
        last = None, None
        for batch in batches:
            kept = []
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            for i in range(len(a)):
                if last[0] != b[i]:
                    last = b[i], shingles(tb[i] or b"")
                kept.append(alike(shingles(ta[i] or b""), last[1]))
            yield pa.RecordBatch.from_arrays(list(batch.select([0, 1]).filter(pa.array(kept, pa.bool_())).columns), names=["a", "b"])

    t = texts.withColumn("text", F.col("text").cast("binary"))
    both = pairs.join(t.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key has the hash of one of keys', by a bitmap of 2 ** ``FILTER_BITS`` bits.

    It only spares a shuffle of rows that the exact join after it would drop: the more keys
    there are, the fewer rows it drops, and the join's rows stay the same.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(h).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bits"))
    at = rows.withColumns({"_part": F.bitmap_bucket_number(h), "_bit": F.bitmap_bit_position(h)}).join(F.broadcast(bits), "_part")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return at.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).select(*rows.columns)


def _near(f: pd.DataFrame, label: np.ndarray):
    """(i, positions after i) of a tile pair's rows that lie in different groups by label, whose wide fingerprints are near and that are close in no earlier block."""
    block = _blocks(f["sig"])
    whole = block.view("<u8")
    band, tile = int(f["band"].iloc[0]), f["tile"].to_numpy()
    apart = tile.min(initial=0) != tile.max(initial=0)
    for i in range(len(f) - 1):
        far = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if apart:
            far = far[tile[far] != tile[i]]
        far = far[np.bitwise_count(block[far, band] ^ block[i, band]) <= CLOSE]
        far = far[np.bitwise_count(whole[far] ^ whole[i]).sum(axis=1, dtype=np.int64) <= FAR]
        far = far[(np.bitwise_count(block[far, :band] ^ block[i, :band]) > CLOSE).all(axis=1)]
        if len(far):
            yield i, far


def _tile_pairs(frames):
    """The rows of each tile pair, from frames sorted by it; many small pairs share a frame, a large one takes several."""
    held, last = [], None
    for f in frames:
        if not len(f):
            continue
        key = f[PAIR].to_numpy()
        cuts = np.flatnonzero(np.append(last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1)))
        last = key[-1]
        if not len(cuts):
            held.append(f)
            continue
        if held:
            yield pd.concat([*held, f.iloc[: cuts[0]]])
        for start, end in pairwise(cuts):
            yield f.iloc[start:end]
        held = [f.iloc[cuts[-1] :]]
    if held:
        yield pd.concat(held)


def _each_tile_pair(rows: DataFrame, make, schema) -> DataFrame:
    """make's frames over the tile pairs of rows; a task takes many pairs in one pass, one pair at a time in memory."""

    def run(frames):
        out, n = [], 0
        for f in _tile_pairs(frames):
            made = make(f)
            if len(made):
                out, n = [*out, made], n + len(made)
            if n >= TILE or len(out) >= 256:
                yield pd.concat(out)
                out, n = [], 0
        if out:
            yield pd.concat(out)

    small_batches(rows.sparkSession)
    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInPandas(run, schema)


def _wanted(f: pd.DataFrame) -> pd.DataFrame:
    """The rows of a tile pair that any pair is to be compared of."""
    hit = np.zeros(len(f), bool)
    for i, far in _near(f, f["root"].to_numpy()):
        hit[i] = True
        hit[far] = True
    return f[hit]


def _linked(f: pd.DataFrame) -> pd.DataFrame:
    """Links that join a tile pair's groups, over exact similarities; pairs that lie in one group by then are passed over."""
    label = np.unique(f["root"].to_numpy(), return_inverse=True)[1]
    sets, node, out = [np.frombuffer(x, np.uint64) for x in f["set"]], f["node"].to_numpy(), []
    size = np.array([len(x) for x in sets])
    for i, far in _near(f, label.copy()):
        far = far[(label[far] != label[i]) & (5 * np.minimum(size[far], size[i]) >= 4 * np.maximum(size[far], size[i]))]
        if not len(far) or not size[i]:
            continue
        flat = np.concatenate([sets[j] for j in far])
        at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        both = np.add.reduceat(sets[i][at] == flat, np.cumsum(size[far]) - size[far], dtype=np.int64)
        for j in far[5 * both >= 4 * (size[far] + size[i] - both)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((max(node[i], node[j]), min(node[i], node[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _with_sets(rows: DataFrame) -> DataFrame:
    """rows with the set of shingles of each one's text in its place."""

    def make():
        def each(texts):
            of = {t: shingles(t).tobytes() for t in set(texts)}
            return [pa.array([of[t] for t in texts], pa.large_binary())]

        return each

    return map_texts(rows, "text", [c for c in rows.columns if c != "text"], [T.StructField("set", T.BinaryType())], make)


def alike_groups(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the sets of shingles that have another at ``alike`` distance, over chains of such pairs.

    rows: _k and text; nodes: a written table of node, _k, sig and size, a row per set.
    Buckets are the groups that the vantage-point trees of the wide fingerprints bring together
    (``_met``). Each bucket's members are first compared with its least one; what then lies in one
    group needs no more comparison. Of a band's buckets with the same members, met in several shards,
    one stands for all. All other pairs of a bucket are compared inside tasks, tile by tile
    (``TILE`` members, ``TILE_BYTES`` of sets), each pair in the first block it is close in;
    only links that join groups leave a task. Sets are moved only to tiles that need them.
    """
    shared = written(_met(nodes), "buckets")
    first = written(shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    wanted = written(shared.select("node").distinct().join(nodes.select("node", "_k"), "node"), "wanted")
    texts = written(_likely(rows, wanted, "_k").join(wanted, "_k").groupBy("node").agg(F.first("text").alias("text")), "texts")
    sure = written(_verified(first, texts), "alike")
    found = components(sure).withColumnsRenamed({"node": "member", "root": "top"})
    placed = written(shared.join(found, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("top", "node")).drop("member", "top", "b"), "placed")
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    kinds = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("band").alias("at"), F.first("n").alias("n"), *same).where("lo <> hi")
    mixed = kinds.groupBy("x", "y", "n", "at").agg(F.min("bucket").alias("bucket")).select("bucket")
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(8 * F.col("words") / TILE_BYTES)).cast("int")
    left = placed.join(mixed, "bucket", "left_semi").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    left = left.select(*PAIR, "band", "tile", "node", "root").join(nodes.select("node", "sig"), "node").select(*PAIR, "band", "tile", "node", "root", "sig")
    wants = written(_each_tile_pair(left, _wanted, left.schema), "wants")
    more = _each_tile_pair(_with_sets(wants.join(texts, "node")), _linked, "a long, b long")
    return components(sure.unionByName(written(more, "links")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id, with the columns docs came with.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more, and chains of such texts. Candidates come from SimHash fingerprints of 16 * ``BLOCKS``
    bits through vantage-point trees over each block of 16 (``_met``); their exact similarity
    decides. A bit differs with a chance of 0.152 at a similarity of 0.8, so such a pair is close in no
    block with one of 9 in 10^10 (7 in 10^6 for sets of 4 and 5 shingles, whose bits differ most). Texts of fewer words
    are a single shingle; null and empty texts are one group. Of rows with the same doc_id the
    one with the least key over all columns stays, whatever the partitions.
    """
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.withColumnsRenamed(aside)
    doc_id, text = F.col(aside["doc_id"]), F.col(aside["text"])
    # Rows of one key agree in every column that can be hashed, so it does not matter which of them stays.
    own = own.withColumn("_k", F.concat_ws(":", row_key(doc_id, text), content_hash(own).cast("string")))
    keyed = own.select("_k", doc_id.alias("doc_id"), text.alias("text"))
    fields = [T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())]
    sketched = map_texts(keyed, "text", ["_k", "doc_id"], fields, _wide)
    # Nulls come last, so that a null id stays only where the group has no other.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k")).alias("best")
    nodes = written(sketched.groupBy("node").agg(best, F.first("sig").alias("sig"), F.first("size").alias("size")).withColumn("_k", F.col("best._k")), "sketches")
    groups = alike_groups(keyed.select("_k", "text"), nodes)
    first = nodes.select("node", "best").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("top")).agg(F.min("best")["_k"].alias("_k"))
    once = F.row_number().over(Window.partitionBy("_k").orderBy("_k"))
    return own.join(first.select("_k"), "_k", "left_semi").withColumn("_n", once).where("_n = 1").select(*[F.col(v).alias(c) for c, v in aside.items()])
