"""MinHash near-duplicates with tensored banding.

Each document has two small collections of sub-keys, each sub-key the hash of a few
minhashes.  A table's key pairs a sub-key of the first collection with one of the second:
HALVES x HALVES tables are made of 2 x HALVES sub-keys, so that minhash work is about a
square root of the tables.  Equal sets are joined first.  In every table key the document
that shares most keys with others is the hub, and candidates are the pairs with it.  What a
key's main component does not take in is settled in blocks: the documents outside of a main
component against one another and against all of its members in such keys.  A block counts
common shingles by matrix products and returns links only, so no row for each pair is made.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed, long_binary, mix64, runs, slices, table, words_of
from .components import components

SHINGLE = 5
#: Sub-keys in each collection, and minhashes in a sub-key.  At similarity 0.8 a pair shares
#: no table with probability 2 * (1 - 0.8**3)**14 < 0.0001.
HALVES, ROWS = 14, 3
#: Documents and shingles of each side of a block; shingles compared at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4096
#: Keys of documents that are broadcast at most.
BROADCAST_KEYS = 500_000
#: Bytes of text whose shingles are made at once.
TEXT_BYTES = 2_000_000
#: Rows of a document's hashes times minhashes handled at once.
CELLS = 4_000_000
U64 = np.uint64
_seed = np.random.default_rng(20240607)
_MUL = _seed.integers(1, 2**63, size=2 * HALVES * ROWS, dtype=np.uint64) | U64(1)
_ADD = _seed.integers(0, 2**63, size=2 * HALVES * ROWS, dtype=np.uint64)
_WEIGHT = _seed.integers(1, 2**63, size=64, dtype=np.uint64) | U64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width``: one shingle of all."""
    flat, counts = words_of(texts, lower=True)
    enc = flat.dictionary_encode()
    w = hashed(enc.dictionary.to_pylist())[enc.indices.to_numpy()] if len(flat) else np.zeros(0, U64)
    rolled = np.zeros(max(len(w) - width + 1, 0), U64)
    for i in range(width):
        rolled += mix64(w[i : len(w) - width + 1 + i]) * _WEIGHT[i] if len(rolled) else rolled
    rolled = mix64(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            own = mix64(w[at : at + n]) * _WEIGHT[: n]
            out.append(mix64(np.array([own.sum() + U64(n) * _WEIGHT[63]], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_MUL), np.iinfo(U64).max, U64)
    step = max(1, CELLS // len(_MUL))
    for i in range(0, len(s), step):
        x = s[i : i + step, None] * _MUL + _ADD
        np.minimum(low, (x ^ (x >> U64(29))).min(axis=0), out=low)
    return low


def _sub_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(-1, ROWS)
    key = np.arange(len(parts), dtype=U64)
    for i in range(ROWS):
        key = mix64(key * _WEIGHT[40] + parts[:, i])
    return key.view(np.int64)


def _described(width: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                sets = shingle_sets(b.column(1), width)
                keys = [_sub_keys(_signature(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    long_binary([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]),
                    pa.array([k if k is None else k[:HALVES] for k in keys], pa.list_(pa.int64())),
                    pa.array([k if k is None else k[HALVES:] for k in keys], pa.list_(pa.int64())),
                ], ["doc", "n_shingles", "print", "a", "b"])

    return run


def _set_rows(width: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                sets = shingle_sets(b.column(1), width)
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc", "hashes"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    every, flat = zip(*((np.repeat(np.arange(len(side)), [len(s) for s in side]), np.concatenate(side)) for side in (left, right)))
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if len(both):
        at = [np.minimum(np.searchsorted(both, f), len(both) - 1) for f in flat]
        on = [np.flatnonzero(both[a] == f) for a, f in zip(at, flat)]
        for c in range(0, len(both), COLUMNS):
            dense = []
            for side, rows, a, o in zip((left, right), every, at, on):
                own = o[(a[o] >= c) & (a[o] < c + COLUMNS)]
                x = np.zeros((len(side), min(COLUMNS, len(both) - c)), np.float32)
                x[rows[own], a[own] - c] = 1
                dense.append(x)
            out += dense[0] @ dense[1].T
    return out


def _settled(percent: int):
    """Of each block, one link for each two components that a pair of documents links."""
    def run(batches):
        for g in runs(batches, 3):
            side, doc, part = (g.column(i).to_numpy() for i in (3, 4, 5))
            sets = [s.values.to_numpy() for s in g.column(6)]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            common = common_counts([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets], np.float64)
            hit = (100 + percent) * common.astype(np.float64) >= percent * (size[left][:, None] + size[right])
            i, j = np.nonzero(hit & (part[left][:, None] != part[right]))
            if len(i):
                i, j = left[i], right[j]
                _, one = np.unique(np.stack([np.minimum(part[i], part[j]), np.maximum(part[i], part[j])]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc[i[one]]), pa.array(doc[j[one]])], ["x", "y"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (x, y) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc").alias("x"), F.col("hashes").alias("hx")), "x").join(sets.select(F.col("doc").alias("y"), F.col("hashes").alias("hy")), "y")
    n, m = F.size("hx"), F.size("hy")
    enough = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.size(F.array_intersect("hx", "hy")) >= percent * (n + m))
    return cut(both.where(enough).select("x", "y").distinct())


def _members(reps: DataFrame) -> DataFrame:
    """(k, doc): the documents of each table key that two or more share; of keys that hold the same documents one."""
    first = reps.select("doc", F.posexplode("a").alias("i", "s"))
    first = first.select("doc", F.xxhash64("i", "s").alias("k"))
    shared = first.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    met = cut(first.join(shared, "k", "left_semi"))
    tables = met.join(reps.select("doc", "b"), "doc").select("doc", "k", F.posexplode("b").alias("j", "s"))
    tables = tables.select("doc", F.xxhash64("k", "j", "s").alias("k"))
    keys = tables.groupBy("k").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("same")).where("n > 1")
    keys = cut(keys.groupBy("low", "n", "same").agg(F.min("k").alias("k")).select("k"))
    return cut(tables.join(keys, "k", "left_semi"))


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, doc, part): the documents of keys that hold two or more components, by the main component g of the key."""
    named = members.join(parts, F.col("doc") == F.col("node"), "left").select("k", "doc", F.coalesce("component", "doc").alias("part"))
    main = named.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count(F.lit(1)).alias("parts"))
    return cut(named.join(main.where("parts > 1").select("k", "main"), "k").select(F.col("main").alias("g"), "doc", "part").distinct())


def _in_blocks(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between components of a key, from comparisons in blocks: for each main component the
    documents outside of it (side 0) against these and its own (side 1)."""
    sides = F.when(F.col("part") == F.col("g"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = cut(apart.select("g", F.explode(sides).alias("side"), "doc", "part").join(sets.select("doc", F.size("hashes").alias("size")), "doc"))
    pieces = lambda side: F.greatest(F.ceil(F.sum(F.when(F.col("side") == side, 1)) / BLOCK), F.ceil(F.sum(F.when(F.col("side") == side, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    dealt = rows.join(rows.groupBy("g").agg(pieces(0).alias("p"), pieces(1).alias("q")), "g")
    first = F.col("side") == 0
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc"), F.when(first, F.col("p")).otherwise(F.col("q"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("q")).otherwise(F.col("p")) - 1)))
    dealt = dealt.select("g", F.when(first, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("b"), "side", "doc", "part")
    dealt = dealt.join(sets, "doc").select("g", "a", "b", "side", "doc", "part", "hashes").repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return cut(dealt.mapInArrow(_settled(percent), "x long, y long"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``; other columns play no part.

    Texts without words, or null, have n_shingles 0 and are their own component.  Rows with
    a null key are linked with nothing: component_id is null and kept true.  Repeated rows
    get the same result.  Rows of one key with different texts get each the component of
    their own text.  Texts of any length are taken whole.
    """
    d = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    seen = cut(d.mapInArrow(_described(width), "doc long, n_shingles long, print binary, a array<long>, b array<long>"))
    classes = seen.where("print is not null and doc is not null").groupBy("print")
    reps = cut(classes.agg(F.min(F.struct("doc", "a", "b")).alias("r")).select("print", F.col("r.doc").alias("doc"), "r.a", "r.b"))
    members = _members(reps)
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    weight = members.join(sizes, "k").groupBy("doc").agg(F.sum("n").alias("w"))
    hubs = members.join(weight, "doc").groupBy("k").agg(F.max_by("doc", F.struct("w", -F.col("doc"))).alias("hub"))
    tried = cut(members.join(hubs, "k").where("doc <> hub").select(F.greatest("doc", "hub").alias("x"), F.least("doc", "hub").alias("y")).distinct())
    # Sets are made of the documents that share a key only, once for each text of a document.
    wanted = cut(members.select("doc").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = d.join(wanted, "doc", "left_semi").groupBy("doc", F.xxhash64("text")).agg(F.any_value("text").alias("text")).select("doc", "text")
    sets = cut(texts.mapInArrow(_set_rows(width), "doc long, hashes array<long>"))
    parts = components(_links(tried, sets, percent), "x", "y")
    apart = _apart(members, parts)
    if not apart.isEmpty():
        more = _in_blocks(apart, sets, percent)
        if not more.isEmpty():
            parts = components(parts.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more), "x", "y")
    member = reps.select("print", F.col("doc").alias("rep")).join(parts, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("c"))
    out = seen.select("doc", "n_shingles", "print").join(cut(member), "print", "left")
    c = F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("c", "doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc") == c, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that stay: the smallest of each component, one row for each key."""
    stays = near_duplicates(docs, key=key, **options).where("kept").select(key)
    known = docs.where(F.col(key).isNotNull()).join(stays.where(F.col(key).isNotNull()).distinct(), key, "left_semi").dropDuplicates([key])
    return known.unionByName(docs.where(F.col(key).isNull())).select(*docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
