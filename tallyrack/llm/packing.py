"""Mixture-controlled packing by deficit round-robin.

The token stream of every source is a queue.  Target shares say how many tokens of each
queue the first t tokens of the output should hold: a curve that is straight until a source
is used up, and goes on with the shares of the others (sources without a share come last).
Block j of B holds what the curves pass between j/B and (j+1)/B of all tokens, so that
blocks are packed side by side and yet each begins where the one before it ends; the part
of a token by which a source falls short at a block's edge is its deficit, with which it
enters the block.  In a block every window of ``window`` tokens gives each source credit
along its curve; a queue is served once its credit reaches ``min_piece`` tokens, and what a
window still lacks comes from the queues with the most credit, so that all windows but a
block's last are full.  Deficits pass from window to window.  A block's last sequence is as
long as the next power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, long_binary, slices, table
from .tokens import encode, tokenizer_path

WINDOW = 1024
#: Tokens of a block, handled by one task at a time.
BLOCK_TOKENS = 1 << 19
MIN_PIECE = 256
#: Bytes of text encoded at once: behind other stages an executor's heap has grown, and workers have less room.
TEXT_BYTES = 1_500_000
#: Offsets are broadcast up to so many (partition, source) pairs; beyond it they are joined.
BROADCAST_ROWS = 200_000


TOKENS = "part long, sk string, doc long, n long, start long, ids binary"


def _tokenised(path: str, end_id: int, special_as_text: bool):
    def run(batches):
        from pyspark import TaskContext

        part, used = TaskContext.get().partitionId(), {}
        for whole in batches:
            for b in slices(whole, 2, TEXT_BYTES):
                ids, counts = encode(b.column(2), path, special_as_text)
                at, rows = 0, []
                for n, sk in zip(counts.tolist(), b.column(1).to_pylist()):
                    own = np.append(ids[at : at + n], np.uint32(end_id))
                    rows.append((len(own), used.get(sk, 0), own.astype("<u4" if own.max() > 65535 else "<u2").tobytes()))
                    used[sk] = used.get(sk, 0) + len(own)
                    at += n
                n, start, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), b.column(1), b.column(0), pa.array(n, pa.int64()), pa.array(start, pa.int64()), long_binary(data)], ["part", "sk", "doc", "n", "start", "ids"])

    return run


class Curves:
    """Tokens of each source among the first t of the output: straight between ``starts``."""

    def __init__(self, totals: dict[str, int], total: int, shares: dict[str, float] | None):
        self.total, self.starts, self.named = float(max(total, 1)), [], {}
        left = {s: float(totals.get(s, 0)) for s, v in (shares or {}).items() if v > 0 and totals.get(s, 0)}
        t, rates, before = 0.0, {s: [] for s in left}, {s: [] for s in left}
        active = set(left)
        while active:
            weight = sum(shares[s] for s in active)
            step = min(left[s] * weight / shares[s] for s in active)
            self.starts.append(t)
            for s in left:
                rates[s].append(shares[s] / weight if s in active else 0.0)
                before[s].append(totals[s] - left[s])
            for s in active:
                left[s] = max(left[s] - step * shares[s] / weight, 0.0)
            active = {s for s in active if left[s] > 1e-9 * totals[s]}
            t += step
        self.starts.append(t)  # here the sources without a share begin, in proportion to their tokens
        self.named = {s: (rates[s] + [0.0], before[s] + [float(totals[s])]) for s in rates}
        self.ends = [*self.starts[1:], self.total]
        self.rest = max(self.total - t, 1.0)

    def columns(self, places: DataFrame) -> DataFrame:
        """``places`` with the rate and the tokens before of each straight part."""
        last = len(self.starts) - 1
        own = lambda i: [F.when(F.col("sk") == s, F.array(*map(F.lit, v[i]))) for s, v in self.named.items()]
        rest = F.array(*[F.lit(0.0)] * last, F.col("all") / self.rest)
        return places.withColumns({"rates": F.coalesce(*own(0), rest), "passed": F.coalesce(*own(1), F.array(*[F.lit(0.0)] * (last + 1)))})

    def given(self, t: Column) -> Column:
        """Tokens of the row's source among the first ``t``."""
        at = [F.col("rates")[i] * F.greatest(F.least(t, F.lit(z)) - a, F.lit(0.0)) for i, (a, z) in enumerate(zip(self.starts, self.ends))]
        return sum(at[1:], at[0])

    def when(self, q: Column) -> Column:
        """The output's tokens when the row's source has given ``q``."""
        at = []
        for i, (a, z) in enumerate(zip(self.starts, self.ends)):
            over, rate = q - F.col("passed")[i], F.col("rates")[i]
            at.append(F.when(over <= 0, 0.0).when(rate <= 0, z - a).otherwise(F.least(over / rate, F.lit(z - a))))
        return sum(at[1:], at[0])

    def steps(self, rates: np.ndarray, at: float, end: float) -> np.ndarray:
        """Credit of each queue (rows of ``rates``) between two places of the output."""
        a, z = np.array(self.starts), np.array(self.ends)
        return rates @ np.clip(np.minimum(z, end) - np.maximum(a, at), 0, None)


def rounds(sizes: np.ndarray, credit: np.ndarray, window: int, min_piece: int, due):
    """Tokens taken from each queue for each window; ``credit`` is carried on and changed.

    ``due(a, b)`` is the credit of each queue for tokens a to b of the block.
    """
    left, done = sizes.astype(np.int64).copy(), 0
    while (total := int(left.sum())) > 0:
        room = min(window, total)
        credit += due(done, done + room)
        done += room
        take = np.where(credit >= min_piece, np.floor(credit).astype(np.int64), 0).clip(0, left)
        over = int(take.sum()) - room
        for s in np.argsort(credit - take, kind="stable") if over > 0 else ():  # the least owed give way
            back = min(over, int(take[s]))
            take[s] -= back
            over -= back
        lack = room - int(take.sum())
        for s in np.argsort(-(credit - take), kind="stable") if lack > 0 else ():
            more = min(lack, int(left[s] - take[s]))
            take[s] += more
            lack -= more
            if not lack:
                break
        credit -= take
        left -= take
        yield take


def _packed(window: int, min_piece: int, curves: Curves, blocks: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sk", "queue_start"], kind="stable").reset_index(drop=True)
        names, queue = np.unique(frame["sk"].to_numpy(dtype=str), return_inverse=True)
        size = frame["piece"].to_numpy(np.int64)
        sizes = np.bincount(queue, weights=size, minlength=len(names)).astype(np.int64)
        credit = np.zeros(len(names))
        credit[queue] = frame["carry"].to_numpy()
        head = np.searchsorted(queue, np.arange(len(names)))  # next row of each queue, and what it has given
        rates = np.stack([np.asarray(frame["rates"].iloc[i], float) for i in head])
        given = np.zeros(len(names), np.int64)
        start, doc, null, n = (frame[c].to_numpy() for c in ("piece_start", "doc", "no_doc", "n"))
        data = frame["ids"].to_list()
        base, at = int(key[0]) << 32, curves.total * (int(key[0]) / blocks)
        due = lambda a, b: curves.steps(rates, at + a, at + b)
        out = []
        for w, take in enumerate(rounds(sizes, credit, window, min_piece, due)):
            offset = 0
            for s in np.flatnonzero(take):
                want = int(take[s])
                while want:
                    r = head[s]
                    own = min(want, int(size[r] - given[s]))
                    width = len(data[r]) // int(size[r])
                    ids = np.frombuffer(data[r], "<u2" if width == 2 else "<u4")[given[s] : given[s] + own]
                    out.append((r, start[r] + given[s], own, zlib.crc32(ids.astype("<u4").tobytes()), n[r], base + w, offset))
                    offset += own
                    want -= own
                    given[s] += own
                    if given[s] == size[r]:
                        head[s], given[s] = r + 1, 0
        cols = [np.array(c, np.int64) for c in zip(*out)]
        res = pd.DataFrame(dict(zip(["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], cols[1:])))
        res.insert(0, "doc_id", pd.arrays.IntegerArray(doc[cols[0]].astype(np.int64), null[cols[0]].astype(bool)))
        last = res["sequence_id"].max()
        fill = int(res.loc[res["sequence_id"] == last, "length"].sum())
        res["padded_length"] = np.where(res["sequence_id"] == last, min(window, 1 << (fill - 1).bit_length()), window)
        return res

    return run


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def packed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, end_id: int = 0, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, min_piece: int = MIN_PIECE, shares: dict[str | None, float] | None = None, special_as_text: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence.

    A null text is empty (it still has its end id), a null source is a source of its own;
    equal rows are packed one by one, a null key stays null.  Other columns, whatever their
    names, play no part.  Texts of any length are tokenised whole and cut at windows.
    ``shares`` sets target token proportions (source to share); they hold in every window
    until a source is used up, then among the others; sources without one come last.  By
    default they are the queues' own.  sequence_id is block * 2**32 + window.  An empty
    table gives no rows.
    """
    path = path or tokenizer_path()
    sk = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    src = docs.select(F.col(key).cast("long").alias("doc"), sk.alias("sk"), F.col(text).alias("text"))
    tokens = cut(src.mapInArrow(_tokenised(path, end_id, special_as_text), TOKENS))
    sums = cut(tokens.groupBy("part", "sk").agg(F.sum("n").alias("n")))
    before = F.sum("n").over(Window.partitionBy("sk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = sums.select("part", "sk", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("sk")).alias("all"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_tokens))
    want = None if shares is None else {"null" if s is None else f"s{s}": float(v) for s, v in shares.items()}
    named = {} if want is None else {r.sk: r.n for r in sums.where(F.col("sk").isin(list(want))).groupBy("sk").agg(F.sum("n").alias("n")).collect()}
    curves = Curves(named, total, want)
    places = cut(curves.columns(places))
    small = places.count() <= BROADCAST_ROWS
    t = tokens.join(F.broadcast(places) if small else places, ["part", "sk"]).withColumn("q", F.col("before") + F.col("start"))
    exact = lambda j: curves.given(j.cast("double") / blocks * curves.total)
    edge = lambda j: F.when(j >= blocks, F.col("all")).otherwise(F.least(F.floor(exact(j) + 1e-6), F.col("all")))
    near = lambda q: F.floor(curves.when(q) / curves.total * blocks)
    lo, hi = (lambda j: F.greatest(F.col("q"), edge(j))), (lambda j: F.least(F.col("q") + F.col("n"), edge(j + 1)))
    touched = F.sequence(F.greatest(near(F.col("q")) - 1, F.lit(0)), F.greatest(F.least(near(F.col("q") + F.col("n")) + 1, F.lit(blocks - 1)), F.greatest(near(F.col("q")) - 1, F.lit(0))))
    t = t.withColumn("block", F.explode(F.filter(touched, lambda j: hi(j) > lo(j))))
    t = t.withColumns({"lo": lo(F.col("block")), "piece": hi(F.col("block")) - lo(F.col("block"))})
    width = (F.octet_length("ids") / F.col("n")).cast("int")
    piece_start = F.col("lo") - F.col("q")
    t = t.select(
        "block", "sk", F.col("lo").alias("queue_start"), F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("no_doc"), "n", piece_start.alias("piece_start"), "piece", "rates",
        (exact(F.col("block")) - edge(F.col("block"))).alias("carry"),
        F.substring("ids", (piece_start * width + 1).cast("int"), (F.col("piece") * width).cast("int")).alias("ids"),
    )
    return t.groupBy("block").applyInPandas(_packed(window, min_piece, curves, blocks), PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
