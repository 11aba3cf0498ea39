"""Embedding near-duplicates by NN-descent.

Equal vectors are one class.  A first neighbour graph comes from buckets of random
hyperplane signs; the number of tables follows the bits, so that a pair at the threshold
meets in some bucket with probability FOUND at every size.  Each round then joins every
node's neighbours, forward and reverse, with one another, and keeps the best of each list; a
list that is saturated (all its neighbours pass the threshold) doubles.  Buckets and lists
are compared in full: large ones in pairs of parts.  Of all pairs that pass in a comparison a
spanning forest is kept besides the bounded lists, so no link that was seen is lost to the
components.  An audit holds the links of a bounded sample against brute force over all
vectors, in blocks: the mean recall of a query vector, and that of query vectors outside the
largest components.  Below the wanted recall further tables and rounds follow; if it stays
below LEAST_RECALL the run fails.

Links exist only inside components of the graph, so the number of links is counted there,
exactly and in blocks: long lists need no expansion into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, long_binary, mix64, runs, table
from .components import components

#: Hyperplane tables at least, at most, and dealt out together; the wanted probability that a pair at the threshold shares a bucket.
TABLES, MOST_TABLES, FOUND = 16, 256, 0.99
#: Mean rows of a bucket, and rows of a part of a large bucket: parts are compared in pairs.
BUCKET_ROWS, PART = 16, 1024
#: Neighbours in a list at first; neighbours below FLOOR are not kept.
NEIGHBOURS, FLOOR = 10, 0.5
ROUNDS, RETRIES = 3, 2
AUDIT_ROWS, RECALL, LEAST_RECALL = 512, 0.98, 0.9
#: Components without which the audit's recall is also taken; sums of products differ by up to CLOSE between blocks.
LARGEST, CLOSE = 3, 1e-9
#: In place of the similarity of a pair: the pair belongs to a spanning forest of passing pairs.
TREE = 2.0
#: Vectors of a component compared with one another in one block.
BLOCK = 1024
BROADCAST_KEYS = 100_000


def _unit(raws, dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype).reshape(len(raws), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(dtype):
    def run(batches):
        for b in batches:
            raw = []
            for v in b.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, dtype)
                good = x is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x.astype(np.float64)) > 0
                raw.append((x + dtype(0)).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), long_binary(raw)], ["id", "v"])

    return run


def _bucketed(dtype, tables: int, bits: int, seed: int | tuple):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raws, ids = b.column(1).to_pylist(), b.column(0)
            size = np.array([len(r) for r in raws])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                x = _unit([raws[i] for i in own], dtype)
                if n not in planes:
                    planes[n] = np.random.default_rng([*np.atleast_1d(seed), n]).standard_normal((x.shape[1], tables * bits))
                on = (x @ planes[n] > 0).reshape(len(own), tables, bits)
                key = (on * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
                key = mix64(key * np.uint64(2 * tables) + np.arange(tables, dtype=np.uint64) + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
                own_ids, own_raw = ids.take(pa.array(own)), b.column(1).take(pa.array(own))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, t].view(np.int64)), own_ids, own_raw], ["key", "id", "v"])

    return run


def _signs(total: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET_ROWS, and tables enough for FOUND at the threshold."""
    same = min(max(1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi, 0.01), 1 - 1e-9)
    most = np.log(1 - (1 - FOUND) ** (1 / MOST_TABLES)) / np.log(same)
    bits = int(np.clip(round(np.log2(max(total, 1) / BUCKET_ROWS)), 1, max(min(most, 40), 1)))
    return bits, int(np.clip(np.ceil(np.log(1 - FOUND) / np.log1p(-(same**bits))), TABLES, MOST_TABLES))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of ``n`` members reaches by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _top(sims: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the best ``keep`` of each row."""
    return np.argpartition(-sims, keep, axis=1)[:, :keep] if sims.shape[1] > keep else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _compared(dtype, keep: int, floor: float, threshold: float):
    """Of each group (key, a, b, side, id, v): every member's best neighbours on the other
    side (a = b: in the group), and a forest of the pairs that pass the threshold."""
    def run(batches):
        us, vs, ss = [], [], []

        def add(u, v, s):
            us.append(u)
            vs.append(v)
            ss.append(s)

        for g in runs(batches, 3):
            if g.num_rows < 2:
                continue
            ids, x, side = g.column(4).to_numpy(), _unit(g.column(5).to_pylist(), dtype), g.column(3).to_numpy()
            own = g.column(1)[0].as_py() == g.column(2)[0].as_py()
            left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(left) or not len(right):
                continue
            sims = x[left] @ x[right].T
            sims[ids[left][:, None] == ids[right]] = -2
            for p, q, m in ((left, right, sims),) if own else ((left, right, sims), (right, left, sims.T)):
                best = _top(m, keep)
                s = np.take_along_axis(m, best, 1)
                i, j = np.nonzero(s >= floor)
                add(ids[p[i]], ids[q[best[i, j]]], s[i, j])
            i, j = np.nonzero(sims >= threshold)
            if len(i):
                low = _forest(len(ids), left[i], right[j])
                at = np.flatnonzero(low != np.arange(len(ids)))
                add(ids[at], ids[low[at]], np.full(len(at), TREE))
            if sum(map(len, us)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (us, vs, ss)], ["u", "v", "s"])
                us, vs, ss = [], [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (us, vs, ss)], ["u", "v", "s"])

    return run


EDGES = "u long, v long, s double"


def _parted(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` (key, id, v) as (key, a, b, side, id, v): members of a large group are dealt
    into parts by hash, and every pair of parts (a, b), a <= b, is a group."""
    hot = cut(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    parts = F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)).cast("long")
    dealt = rows.join(hot, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v")


def _grouped(rows: DataFrame, dtype, keep: int, threshold: float) -> DataFrame:
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_compared(dtype, keep, FLOOR, threshold), EDGES)


def _best(edges: DataFrame, limit: int, threshold: float) -> DataFrame:
    """The best NEIGHBOURS of each list, up to ``limit`` of those that pass the threshold, and all pairs of forests."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("u", "tree").orderBy(F.desc("s"), "v"))
    e = edges.groupBy("u", "v", (F.col("s") == TREE).alias("tree")).agg(F.max("s").alias("s")).withColumn("r", rank)
    return e.where(F.col("tree") | (F.col("r") <= NEIGHBOURS) | ((F.col("r") <= limit) & (F.col("s") >= threshold))).select("u", "v", "s")


def _audited(queries: list[tuple[int, bytes]], dtype, threshold: float):
    def run(batches):
        by_size: dict[int, list] = {}
        for i, raw in queries:
            by_size.setdefault(len(raw), []).append((i, raw))
        q = {n: (np.array([i for i, _ in v]), _unit([r for _, r in v], dtype)) for n, v in by_size.items()}
        for b in batches:
            raws, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
            size = np.array([len(r) for r in raws])
            for n in set(size.tolist()) & set(q):
                own = np.flatnonzero(size == n)
                i, j = np.nonzero(q[n][1] @ _unit([raws[k] for k in own], dtype).T >= threshold + CLOSE)
                a, z = q[n][0][i], ids[own[j]]
                yield pa.RecordBatch.from_arrays([pa.array(a[a != z]), pa.array(z[a != z])], ["u", "v"])

    return run


def _counted(dtype, threshold: float):
    """Of each (component, block pair): every first member's links among the second members."""
    def run(batches):
        for g in runs(batches, 3):
            side = g.column(6).to_numpy()
            ids, size, raws = g.column(3).to_numpy(), g.column(4).to_numpy(), g.column(5).to_pylist()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            y, n = _unit([raws[i] for i in right], dtype), size[right].astype(np.float64)
            for at in range(0, len(left), BLOCK):
                own = left[at : at + BLOCK]
                hit = (_unit([raws[i] for i in own], dtype) @ y.T >= threshold) & (ids[own][:, None] != ids[right])
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array((hit @ n).astype(np.int64))], ["u", "n"])

    return run


def _recall(truth: DataFrame, named: DataFrame) -> dict:
    """Mean over query vectors with links of the share of links inside the vector's component; also outside the LARGEST components."""
    a, z = named.select(F.col("id").alias("u"), F.col("comp").alias("cu")), named.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    each = truth.join(a, "u").join(z, "v").groupBy("u", "cu").agg(F.avg((F.col("cu") == F.col("cv")).cast("double")).alias("r")).collect()
    large = {r.comp for r in named.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").orderBy(F.desc("m"), "comp").limit(LARGEST).collect()}
    outside = [r.r for r in each if r.cu not in large]
    return {"recall": float(np.mean([r.r for r in each])), "audited": len(each), "recall_outside": float(np.mean(outside)) if outside else 1.0, "audited_outside": len(outside)}


def near_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, report: dict | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold null or non-finite values, and rows with a
    null key, link with nothing; a null key has a null component and is kept.  Vectors of
    different length do not link.  Repeated rows of a key count as one vector.  The audit's
    mean recall of a query vector with links, that outside the LARGEST components, their
    numbers of query vectors, and the tables are put into ``report``.  Raises RuntimeError
    if a recall stays below LEAST_RECALL.
    """
    dtype = np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64
    rows = cut(df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(_valid(dtype), "id long, v binary"))
    once = rows.where("id is not null and v is not null").groupBy("v", "id").agg(F.count(F.lit(1)).alias("c"))
    reps = cut(once.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")))
    total = reps.count()
    bits, tables = _signs(total, threshold)
    vecs = reps.select("id", "v")
    sample = vecs.orderBy(F.xxhash64("id"), "id").limit(AUDIT_ROWS).collect()
    truth = cut(vecs.mapInArrow(_audited([(r.id, bytes(r.v)) for r in sample], dtype, threshold), "u long, v long")) if sample else None
    wanted = truth.count() if sample else 0
    edges, limit = None, NEIGHBOURS
    links = (F.col("s") >= threshold) & (F.col("s") != TREE)
    for attempt in range(RETRIES + 1):
        for at in range(0, tables, TABLES):
            dealt = vecs.mapInArrow(_bucketed(dtype, min(TABLES, tables - at), bits, (7919 * (attempt + 1), at)), "key long, id long, v binary")
            found = _grouped(_parted(dealt, dealt.select("key", "id")), dtype, NEIGHBOURS, threshold)
            edges = cut(_best(found if edges is None else found.unionByName(edges), limit, threshold))
        passed = edges.where(links).count()
        for _ in range(ROUNDS):
            limit *= 2
            real = edges.where(F.col("s") != TREE)
            both = real.select("u", "v").union(real.select("v", "u")).distinct()
            lists = both.select(F.col("u").alias("key"), F.col("v").alias("id")).union(both.select("u", "u").distinct())
            near = _grouped(_parted(lists.join(vecs, "id").select("key", "id", "v"), lists), dtype, limit, threshold)
            edges = cut(_best(near.unionByName(edges), limit, threshold))
            now = edges.where(links).count()
            if now <= passed:
                break
            passed = now
        parts = components(edges.where(F.col("s") >= threshold), "u", "v")
        named = vecs.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("comp"))
        named = cut(named)
        audit = _recall(truth, named) if wanted else {"recall": 1.0, "audited": 0, "recall_outside": 1.0, "audited_outside": 0}
        if report is not None:
            report.update(audit, attempts=attempt + 1, tables=tables * (attempt + 1))
        recall = min(audit["recall"], audit["recall_outside"])
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"near vectors: recall {audit} below {LEAST_RECALL} after {tables * (attempt + 1)} tables")
    big = named.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = named.join(big, "comp").join(reps, "id")
    members = cut(members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("long")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    deal = lambda side, a, b: members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("comp", F.col(a).alias("a"), F.col(b).alias("b"), "id", "size", "v", F.lit(side).alias("side"))
    pairs = deal(0, "own", "other").unionByName(deal(1, "other", "own")).repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b")
    counted = pairs.mapInArrow(_counted(dtype, threshold), "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    of_class = named.join(counted, F.col("id") == F.col("u"), "left").join(reps.select("id", "size"), "id").select("id", "comp", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"))
    of_class = cut(of_class.join(reps.select("id", "v"), "id").select("v", "comp", "n"))
    out = rows.join(of_class, "v", "left")
    known = F.col("id").isNotNull()
    comp = F.when(known, F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(key), F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_near_vectors": op6_near_vectors}
