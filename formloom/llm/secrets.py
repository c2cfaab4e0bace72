r"""Secret scans with corpus-wide ownership frequency.

Each whole text is scanned once for the base kinds (assign, access, hex) and for the kinds
that this method adds (``ADDED``). Every candidate's value is hashed; the hashes are
aggregated over the corpus by distinct repositories and distinct owners. A value is a widely
copied example when ``EXAMPLE_OWNERS`` owners carry it, or when ``FEW_OWNERS`` do in
``EXAMPLE_REPOS`` repositories; a value that one owner repeats in any number of repositories
stays that owner's. Any other value that looks random is owner-specific and live-looking. Base
spans stay whatever their class; an added span counts only while its value is owner-specific.

Only candidates (hash, owner, repository) are shuffled, pre-aggregated to distinct triples
before a value's owners meet, so a value that a third of all documents carry stays cheap.

Defined results: null texts count as empty; positions are code points, end exclusive; spans
that coincide are all listed; repeated rows each get their row; a null owner is one owner of
its own, apart from an empty name, and likewise a null repository; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import map_texts, written

_ASCII = re.ASCII
#: The base kinds in the order listed: name, pattern, group of the value, least length of that group.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+", _ASCII), 0, 16),
    # A run of fewer than 32 is dropped anyway, and a run's matches start where it starts.
    ("hex", re.compile(r"[0-9a-f]{32,}", _ASCII), 0, 32),
]
#: Kinds added by this method, after the base kinds in order.
ADDED = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", _ASCII), 0, 40),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _ASCII), 0, 30),
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}", _ASCII), 0, 40),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", _ASCII), 0, 15),
    ("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}", _ASCII), 0, 39),
    ("pay", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}", _ASCII), 0, 24),
    ("url", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@", _ASCII), 1, 6),
]
KINDS = [k for k, *_ in (*BASE, *ADDED)]
#: Owners that must carry a value before it counts as a copied example; or fewer, but in so many repositories.
EXAMPLE_OWNERS = 5
FEW_OWNERS, EXAMPLE_REPOS = 3, 10
#: Bits per character above which a value looks random.
LIVE_BITS = 2.5
_CAND = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
                                  T.StructField("vs", T.IntegerType()), T.StructField("ve", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("random", T.BooleanType())]))
FIELDS = [*[T.StructField(f"n_{k}", T.LongType()) for k, *_ in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("cands", _CAND)]


def bits(value: str) -> float:
    """Shannon entropy per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))


def candidates(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(kind, start, end, value start, value end, value), by start, then kind as listed."""
    out = []
    for k, (_, pattern, group, least) in enumerate((*BASE, *ADDED)):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((k, m.start(), m.end(), m.start(group), m.end(group), m.group(group)))
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _make():
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("vs", pa.int32()), ("ve", pa.int32()), ("hash", pa.binary()), ("random", pa.bool_())]))

    def each(texts: list[bytes]) -> list[pa.Array]:
        counts, shas, cands = [[] for _ in BASE], [], []
        for t in texts:
            found = candidates(t.decode(errors="replace"))
            for k, into in enumerate(counts):
                into.append(sum(c[0] == k for c in found))
            base = listed(c[:3] for c in found if c[0] < len(BASE))
            shas.append(hashlib.sha256(base.encode()).hexdigest())
            cands.append([(k, s, e, vs, ve, hashlib.sha256(v.encode()).digest(), bits(v) > LIVE_BITS) for k, s, e, vs, ve, v in found])
        return [*[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()),
                pa.array([[dict(zip(("kind", "s", "e", "vs", "ve", "hash", "random"), c, strict=True)) for c in x] for x in cands], arrow)]

    return each


def scanned(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, the base counts, base_sha256 and all candidates of each row, from one scan."""
    return map_texts(df, text_col, keep, FIELDS, _make)


def ownership(cands: DataFrame, owner: str, repo: str) -> DataFrame:
    """For each value's hash: n_owners and n_repos that carry it; nulls count as one more of each."""
    own = cands.select("hash", F.col(owner).alias("o"), F.col(repo).alias("r")).distinct()
    owners = own.groupBy("hash", "o").agg(F.count("*")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = own.select("hash", "r").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def classed(rows: DataFrame, key: str, owner: str, repo: str) -> DataFrame:
    """One row per candidate: key, kind, s, e, vs, ve, n_owners, n_repos and class (example, live or weak)."""
    c = rows.select(key, owner, repo, F.explode("cands").alias("c")).select(key, owner, repo, "c.*")
    c = c.join(ownership(c, owner, repo), "hash")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") >= FEW_OWNERS) & (F.col("n_repos") >= EXAMPLE_REPOS))
    return c.withColumn("class", F.when(copied, "example").when(F.col("random"), "live").otherwise("weak"))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """doc_id, base counts, base_sha256, spans, the numbers of live and example spans, and the most owners and repositories of a span's value.

    Where documents name no repository, each is one.
    """
    named = docs.select(F.col("doc_id"), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"), F.monotonically_increasing_id().alias("_rid"), F.col("text"))
    rows = written(scanned(named, ["doc_id", "_owner", "_repo", "_rid"]), "secrets")
    c = classed(rows.where(F.size("cands") > 0), "_rid", "_owner", "_repo")
    c = c.where((F.col("kind") < len(BASE)) | (F.col("class") == "live"))
    got = F.sort_array(F.collect_list(F.struct("s", "kind", "e")))
    per = c.groupBy("_rid").agg(got.alias("all"), F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "example").alias("n_example"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    figures = ["n_live", "n_example", "max_owners", "max_repos"]
    out = rows.join(per.select("_rid", text.alias("spans"), *figures), "_rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[f"n_{k}" for k, *_ in BASE], "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *map(zero, figures))


def _cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, owner: str = "source", repo: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """docs with each value that is not a widely copied example replaced by mark; n_chars follows where it is a column.

    Texts are scanned once, and written with their candidates and a row number; rows without
    candidates then pass straight through, and only the few others meet their classes.
    """
    aside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.withColumnsRenamed(aside).withColumn("_rid", F.monotonically_increasing_id())
    text = F.col(aside["text"])
    rows = written(scanned(own, [*aside.values(), "_rid"], aside["text"]).drop("base_sha256", *[f"n_{k}" for k, *_ in BASE]), "secrets")
    some = rows.where(F.size("cands") > 0)
    c = classed(some.select("_rid", F.col(aside[owner]).alias("_owner"), F.col(aside[repo]).alias("_repo"), "cands"), "_rid", "_owner", "_repo").where("class <> 'example'")
    cuts = c.groupBy("_rid").agg(F.collect_set(F.struct("vs", "ve")).alias("_cuts"))

    @F.pandas_udf(T.StringType())
    def cut(t: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([_cut(x, [(c["vs"], c["ve"]) for c in s], mark) for x, s in zip(t, cuts, strict=True)], dtype=object)

    met = some.drop("cands").join(cuts, "_rid", "left")
    clean = met.where("_cuts IS NULL").drop("_cuts")
    mended = met.where("_cuts IS NOT NULL").withColumn(aside["text"], cut(text.cast("string"), F.col("_cuts"))).drop("_cuts")
    if "n_chars" in aside:
        mended = mended.withColumn(aside["n_chars"], F.char_length(text).cast(rows.schema[aside["n_chars"]].dataType))
    out = rows.where(F.size("cands") == 0).drop("cands").unionByName(clean).unionByName(mended)
    return out.select(*[F.col(v).alias(c) for c, v in aside.items()])
