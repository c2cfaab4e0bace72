r"""Quality classifier: a factorisation machine over hashed words, structure and length.

A document's features are its words hashed to ``BUCKETS`` (log counts, unit length together)
and one-hot bins of structure statistics and of metadata of the text itself (its length). With
weights w and rank-``RANK`` vectors v the score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose second part, the sum-of-squares identity, gives all pairwise interactions in time linear
in the features. Whole texts are read, in training and in scoring.

Training reads labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``TRAIN_ROWS``
of them (those with the smallest hashes of their ids: the same rows whatever the partitions);
the model is fitted on the driver from their features and sent to the executors, its size
fixed by the parameters. Labels, lang, source and doc_id are no features.

Defined results: null texts count as empty and are scored like any text; a null doc_id counts
as the empty string in the crc32; labels that are null are passed over and of repeated labels
the largest holds; without any label every score is 0.5; repeated rows each get their row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import map_texts
from formloom.llm.quality_rules import SYMBOLS, repeat_words

BUCKETS, RANK, BINS = 1 << 14, 8, 10
TRAIN_ROWS = 8_000
#: Passes over the sample, and the steps that a small sample is given at least.
EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 400, 128, 0.05, 1e-5
THRESHOLD = 0.3
#: Documents' words kept with their buckets by each worker.
CACHE = 500_000
STATS = ("symbols", "pipes", "bangs", "upper", "digits", "stops", "word_bytes", "unique", "repeated", "dup_lines", "line_words", "log_words", "log_bytes")
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = zlib.crc32(word) % BUCKETS
        return out


def structure(text: bytes, words: list[bytes]) -> list[float]:
    """The values of STATS."""
    n, size = max(1, len(words)), max(1, len(text))
    cut = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    many = max(1, len(lines))
    return [cut(SYMBOLS) / n, text.count(b"|") / n, text.count(b"!") / n, cut(_UPPER) / size, cut(_DIGITS) / size, text.count(b".") / n, sum(map(len, words)) / n,
            len(set(words)) / n, repeat_words(words) / n, 1 - len(set(lines)) / many, n / many, float(np.log1p(len(words))), float(np.log1p(len(text)))]


def features(text: bytes, bucket: _Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values and the structure statistics of a text."""
    words = text.split()
    low = text.lower().split()
    ids, counts = np.unique(np.fromiter(map(bucket.__getitem__, low), np.int32, len(low)), return_counts=True)
    x = np.log1p(counts).astype(np.float32)
    return ids, x / max(1e-9, float(np.sqrt((x * x).sum()))), structure(text, words)


class Fm:
    """Weights and their use; cuts are the bins' inner edges for each statistic."""

    def __init__(self, cuts: np.ndarray, seed: int = 5):
        size = BUCKETS + len(STATS) * BINS
        self.cuts, self.w0 = cuts, 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK))

    def whole(self, ids: np.ndarray, x: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """All feature numbers and values: words, then a bin of each statistic."""
        bins = [BUCKETS + i * BINS + int(np.searchsorted(c, s, side="right")) for i, (c, s) in enumerate(zip(self.cuts, stats, strict=True))]
        return np.concatenate([ids, bins]).astype(np.int64), np.concatenate([x, np.full(len(bins), 0.5)])

    def raw(self, i: np.ndarray, x: np.ndarray) -> float:
        xv = self.v[i] * x[:, None]
        s = xv.sum(axis=0)
        return float(self.w0 + self.w[i] @ x + 0.5 * ((s * s).sum() - (xv * xv).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Fm:
        """Adagrad over mini-batches; the rarer label weighs as much as the commoner one in sum."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
        g0, gw, gv = 1e-3, np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                i = np.concatenate([rows[k][0] for k in own])
                x = np.concatenate([rows[k][1] for k in own])
                ends = np.cumsum([0, *(len(rows[k][0]) for k in own)])
                xv = self.v[i] * x[:, None]
                s = np.add.reduceat(xv, ends[:-1])
                z = self.w0 + np.add.reduceat(self.w[i] * x, ends[:-1]) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), ends[:-1]))
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
                each = np.repeat(d, np.diff(ends))
                at_doc = np.repeat(np.arange(len(own)), np.diff(ends))
                used, slot = np.unique(i, return_inverse=True)
                dw = np.bincount(slot, each * x, len(used)) + DECAY * self.w[used]
                part = (each * x)[:, None] * (s[at_doc] - xv)
                dv = np.stack([np.bincount(slot, part[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                d0 = d.sum()
                g0 += d0 * d0
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w0 -= RATE * d0 / np.sqrt(g0)
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
        return self


def _crc(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Fm | None:
    """The model of the labelled rows outside the held-out fifth; None without any."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(_crc(F.col("doc_id")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most rows ids and labels, so the broadcast is bounded by the parameter.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def make():
        bucket = _Buckets()

        def each(texts):
            got = [features(t, bucket) for t in texts]
            return [pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), pa.array([np.array(g[2]).tobytes() for g in got], pa.binary())]

        return each

    fields = [T.StructField(c, T.BinaryType()) for c in ("ids", "x", "stats")]
    got = map_texts(sample, "text", ["doc_id", "quality"], fields, make).orderBy("doc_id").limit(2 * rows).toPandas()
    if got.empty:
        return None
    stats = np.array([np.frombuffer(s, np.float64) for s in got["stats"]])
    model = Fm(np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T)
    data = [model.whole(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), s) for i, x, s in zip(got["ids"], got["x"], stats, strict=True)]
    return model.fit(data, got["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Fm | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and score (0 to 1) of each row's whole text."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fm, bucket = sent.value, _Buckets()

        def each(texts):
            if len(bucket) > CACHE:
                bucket.clear()
            z = np.array([fm.raw(*fm.whole(*features(t, bucket))) for t in texts])
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

        return each

    return map_texts(docs, text_col, keep, [T.StructField("score", T.DoubleType())], make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
