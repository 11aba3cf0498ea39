"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="tallyrack-")
    return f"file://{_own}"


_own: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add: its own columns win."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def hash_bits(c: Column, bits: int) -> Column:
    """The first ``bits`` (up to 32) bits of the md5 of a string, as a number."""
    return F.shiftright(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of a key written as text, modulo ``m`` (a null key counts as empty)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


# --- inside tasks -----------------------------------------------------------------------


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in one array, and the number of words of each text (null: none)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    parent = parent.filter(real).to_numpy()
    return flat.filter(real), np.bincount(parent, minlength=len(texts)).astype(np.int64)


def hashed(strings: list[str]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False) if strings else np.zeros(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000):
    """Pieces of a batch whose texts hold about ``limit`` bytes each (one text at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
    released()


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task.

    Workers live on and serve the tasks of other operators: what those kept is dropped here,
    and its memory goes back.
    """
    others = [k for k, v in _kept.items() if k != owner and v]
    for k in others:
        _kept[k].clear()
    if others:
        released()
    return _kept.setdefault(owner, {})


def released() -> None:
    """Memory that a worker has freed goes back to the system: workers live on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def runs(batches, keys: int):
    """Complete groups of a stream sorted by its first ``keys`` columns."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        if rest and any(rest[-1].column(i)[0].as_py() != b.column(i)[0].as_py() for i in range(keys)):
            yield joined(rest)
            rest = []
        breaks = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *breaks.tolist()]
        for a, z in zip(edges, edges[1:]):
            yield joined([*rest, b.slice(a, z - a)])
            rest = []
        rest.append(b.slice(edges[-1]))
    if rest:
        yield joined(rest)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def long_binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
