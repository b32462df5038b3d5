"""Near-duplicate texts by SetSketch registers (Ertl, 2021).

A text's set of word shingles fills M registers.  Register i keeps the smallest of exponential
values that hash function i gives the shingles, as a truncated exponent of a base B a little above
1; so registers of unions are maxima of registers, and equal registers tell of similar sets.  Bands
of registers find candidates, a joint likelihood over the registers drops the hopeless ones, and
the full sets of the others decide.

Texts with the same set form a class; only a class's first text is compared.  A bucket of equal
bands does not give all its pairs: its members are first held against its smallest member only.
Where the links so found leave a small bucket in several components, members of different
components are compared too.  Texts that share large buckets (groups of copies, boilerplate) form
clusters; a cluster is cut into blocks, and each pair of blocks is compared at once on full sets,
giving no more links than join its components.  So no component is missed, and no group's pairs
are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.components import components
from chronoweave.llm.storage import drop, light, written
from chronoweave.llm.workers import FEW_ROWS, give_back

WORDS = 5  # in a shingle
SIMILAR = (75, 100)  # intersection / union, at least
M, ROWS = 128, 4  # registers; registers in a band
#: Unrelated sets then share a register in 1 of 400 cases, so that false candidates stay rare at scale.
BASE = 1.01
RATE, TOP = 20.0, 65_535
_SPLIT = "[ \t-\r]+"
_ODD = (np.random.default_rng(2021).integers(1 << 62, size=M, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(2022).integers(1 << 62, size=M, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; a shorter text is one shingle, one without words has none."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower: A-Z only
    words = low.split()  # bytes.split: space and \t to \r only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.array([one(w) for w in words], np.uint64)
    mixed = np.zeros(len(h) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        mixed = (mixed ^ h[i : len(h) - WORDS + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16[M]: floor(1 - log_BASE(least exponential value)), truncated to 0..TOP."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 4096):
        h = hashes[a : a + 4096, None] * _ODD[None, :] + _ADD[None, :]
        least = np.minimum(least, h.min(0))
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            s = shingles(text)
            mark = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            rows.append((key, len(s), mark, registers(s).tobytes() if len(s) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "mark", "sketch"])
    give_back()


_ETA = np.arange(0.0, 1.0001, 0.01)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of sketches (rows of a and b) of sets of na and nb elements.

    Maximises the joint likelihood of the numbers of registers that are larger in a, larger in b
    and equal, over a grid of similarities.
    """
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = M - up - down
    share = (na / (na + nb))[:, None]
    j = _ETA[None, :]
    most = np.minimum(share / (1 - share), (1 - share) / share)
    ln = np.log(BASE)
    # P(register of a larger) = -log_B(1 - (u - v j)(B - 1) / B) for the shares u of a, v of b
    only_a = np.clip(share - (1 - share) * j, 1e-9, None)
    only_b = np.clip((1 - share) - share * j, 1e-9, None)
    pa = -np.log1p(-only_a * (BASE - 1) / BASE) / ln
    pb = -np.log1p(-only_b * (BASE - 1) / BASE) / ln
    same_p = np.clip(1 - pa - pb, 1e-9, 1)
    like = up * np.log(np.clip(pa, 1e-9, 1)) + down * np.log(np.clip(pb, 1e-9, 1)) + same * np.log(same_p)
    like = np.where(j <= most + 1e-9, like, -np.inf)
    return _ETA[like.argmax(1)]


#: A candidate is dropped when its likely similarity is below this: some 5 standard errors under SIMILAR.
HOPELESS = 0.55


def _array(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(-1, M)


def _hopeful(na, sa, nb, sb) -> np.ndarray:
    na, nb = na.to_numpy(np.float64), nb.to_numpy(np.float64)
    fits = SIMILAR[1] * np.minimum(na, nb) >= SIMILAR[0] * np.maximum(na, nb)
    out = np.zeros(len(na), bool)
    if fits.any():
        out[fits] = estimate(_array(sa[fits]), _array(sb[fits]), na[fits], nb[fits]) >= HOPELESS
    return out


@F.pandas_udf(T.BooleanType())
def _may_link(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
    return pd.Series(_hopeful(na, sa, nb, sb))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(col: pd.Series) -> pd.Series:
    """One 64-bit key for each band of ROWS registers, different for different bands."""
    a = _array(col).reshape(len(col), M // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(M // ROWS, dtype=np.uint64), a.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ a[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return pd.Series(list(key.astype(np.int64)))


@F.pandas_udf(T.BinaryType())
def _sets(col: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in col])


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


#: A larger bucket is compared in blocks of at most about BLOCK texts, two at a time.
SMALL, BLOCK = 64, 512


def _joining(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different ``part`` that join parts, by exact Jaccard of all pairs."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
    n = np.array([len(x) for x in sets])
    ids, part = pdf["rep"].to_numpy(), pdf["part"].to_numpy().copy()
    if len(np.unique(part)) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    owner = np.repeat(np.arange(len(sets)), n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[at] > 1
    owner, at = owner[again], np.unique(at[again], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
        own = slice(*np.searchsorted(at, [a, a + 8192]))
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[own], at[own] - a] = 1
        both += x @ x.T
    link = SIMILAR[1] * both >= SIMILAR[0] * (n[:, None] + n[None, :] - both)
    out = []
    while True:
        across = link & (part[:, None] != part[None, :])
        rows = np.flatnonzero(across.any(1))
        if not len(rows):
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        for i in rows:
            j = int(across[i].argmax())
            if part[i] != part[j]:
                out.append((ids[i], ids[j]))
                part[part == part[i]] = part[j]


def _verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Those of ``a, b`` whose full sets are similar enough.  Only texts of candidates are read into sets."""
    pairs = written(pairs, name + "-candidates")
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), name + "-ids")
    full = written(docs.join(light(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", _sets("text").alias("s")), name + "-sets", "lz4", conf=FEW_ROWS)
    left = full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    out = written(pairs.join(left, "a").join(right, "b").where(_linked("sa", "sb")).select("a", "b"), name, conf=FEW_ROWS)
    drop(pairs, ids, full)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (columns doc_id, text).

    Two documents are linked when 100 * intersection >= 75 * union of their shingle sets;
    component_id is the smallest doc_id reachable.  Texts that are null, empty or without words are
    linked with nothing.  Rows that repeat a doc_id are one document; if their texts differ, copies
    are found for each, other links for one of them.  Rows without a doc_id come back with a null component_id, kept.
    Other columns are not looked at; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    # ids go as text: beside nulls pandas would make them floats
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long").cast("string"))
    sketched = own.mapInPandas(_sketched, "doc_id string, n_shingles long, mark binary, sketch binary")
    sketched = written(sketched.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches", conf=FEW_ROWS)
    real = sketched.where("doc_id is not null and mark is not null")
    classes = written(real.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    # Copies: same set, or one doc_id with several texts.
    member = real.join(classes.select("mark", "rep"), "mark").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    banded = written(classes.select("rep", F.explode(_bands("sketch")).alias("band")), "bands", "lz4")
    leader = banded.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1")
    star = banded.join(leader, "band").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    info = classes.select("rep", "n", "sketch").dropDuplicates(["rep"])
    first = _verified(_hopefuls(star, info), docs, "links-first")

    part = written(components(first).select(F.col("node").alias("rep"), "component"), "parts")

    # Small buckets that these links leave in several components: compare across components.
    shared = banded.join(leader.where(F.col("size") <= SMALL).select("band"), "band", "left_semi")
    placed = shared.join(part, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min("rep").alias("lead")).where("least < most")
    open_ = written(placed.join(split, "band").select("band", "rep", "c", "least", "lead"), "open")
    outside = open_.where("c <> least").select("band", F.col("rep").alias("x"), F.col("c").alias("cx"), "lead")
    cross = outside.join(open_.select("band", F.col("rep").alias("y"), F.col("c").alias("cy")), "band").where("cx <> cy and (cy < cx) and y <> lead")
    pairs = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = _verified(_hopefuls(pairs, info), docs, "links-second")

    # Large buckets: clusters of texts that share some, in blocks.
    large = banded.join(leader.where(F.col("size") > SMALL), "band").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    cluster = written(components(large).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")
    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    sets = docs.join(light(cluster).select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), _sets("text").alias("s"))
    there = cluster.join(blocks, "cluster").withColumn("own", own).join(part, "rep", "left").withColumn("part", F.coalesce("component", "rep")).join(sets, "rep")
    there = there.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    there = there.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "part", "s")
    third = written(there.groupBy("cluster", "i", "j").applyInPandas(_joining, "a long, b long"), "links-third")

    found = components(member.unionByName(first).unionByName(second).unionByName(third))
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    drop(banded, open_, cluster)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _hopefuls(pairs: DataFrame, info: DataFrame) -> DataFrame:
    left = info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = info.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(f"{SIMILAR[1]} * least(na, nb) >= {SIMILAR[0]} * greatest(na, nb)")
    return near.where(_may_link("na", "sa", "nb", "sb")).select("a", "b")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with their own columns."""
    gone = written(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return docs.join(light(gone), "doc_id", "left_anti").select(*docs.columns)
