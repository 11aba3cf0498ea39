"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The model predicts an outcome from the two words before it: the sum of two context vectors,
times the outcome's vector, plus a bias, normalised over all outcomes.  Outcomes are the
end, the most frequent words, as many as the square root of the training tokens (model size,
at most MAX_OUTCOMES), and for other words the class of their last two characters; inside a
class a word has its smoothed share of the class.  Contexts are the CONTEXT_WORDS most
frequent words, classes of the others, and the edge of the text.  There are so few that
matrix products give the normaliser of every pair of contexts once; the rest of a score is
gathered from the vectors.

A bounded warm-up gives a common start, from which every partition of a fixed deal (by hash
of key and text) trains on all its training documents; the results are averaged, each row
weighted by how often a partition met it.  Word counts cover all training words.  Counts of
frequent words (a bounded table) are broadcast; the words below it are joined by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, hashed, mix64, slices, table, words_of

#: Outcomes at most; context words; classes of other words; width of a vector.
MAX_OUTCOMES, CONTEXT_WORDS, CLASSES, WIDTH = 50_000, 500, 256, 24
#: Noise samples shared by a batch, targets in a batch, step of the gradient.
NOISE, BATCH, STEP = 64, 1024, 0.2
#: Words whose counts are broadcast at most.
BROADCAST_WORDS = 400_000
#: Training documents (by hash) from which one task makes the common start; all of them teach after it.
WARM_UP = 3000
#: The warm-up repeats its documents until it has taken so many tokens.
WARM_TOKENS = 6_000_000
#: Training documents of one partition of the deal.
DEALT = 8192
#: Tokens scored, and contexts normalised, at once.
TOKENS_AT_ONCE, CONTEXTS_AT_ONCE = 1 << 16, 64
END = "\n"  # no word holds a line feed


def _read(texts: pa.Array):
    """Hash, class and place of the words of a batch: distinct hashes, classes, word number at each place, words of each text."""
    flat, counts = words_of(texts, lower=True)
    enc = flat.dictionary_encode()
    names = enc.dictionary.to_pylist()
    tails = hashed([w[-2:] for w in names])
    return hashed(names).view(np.int64), (mix64(tails) % np.uint64(CLASSES)).astype(np.int64), enc.indices.to_numpy(), counts


def _counted(batches):
    for whole in batches:
        for b in slices(whole, 0):
            h, cls, at, _ = _read(b.column(0))
            n = np.bincount(at, minlength=len(h))
            end = hashed([END]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, end)), pa.array(np.append(cls, 0)), pa.array(np.append(n, len(b)))], ["h", "cls", "c"])


class Vocabulary:
    """Bounded tables of the training words, sent to the tasks."""

    def __init__(self, outcomes, known, classes, tokens: int, types: int, floor: int):
        order = np.argsort(outcomes)
        self.top, self.top_id = outcomes[order], order  # ids by descending count, the end first
        self.h, self.c = known
        self.share = classes  # tokens, types of each class
        self.tokens, self.types, self.floor = tokens, types, floor
        self.words = min(CONTEXT_WORDS, len(outcomes))

    def outcome(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.top, h), max(len(self.top) - 1, 0))
        return np.where(self.top[at] == h, self.top_id[at], len(self.top) + cls) if len(self.top) else cls

    def context(self, outcome: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.where(outcome < self.words, outcome, self.words + cls)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Training count, or -1 where only the join knows it."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.c[at], -1)

    @property
    def outcomes(self) -> int:
        return len(self.top) + CLASSES

    @property
    def contexts(self) -> int:
        """The last one is the edge of a text."""
        return self.words + CLASSES + 1


def vocabulary(counts: DataFrame) -> Vocabulary:
    end = int(hashed([END]).view(np.int64)[0])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size = min(MAX_OUTCOMES, max(int(np.sqrt(total[0])), 1))
    top = counts.orderBy((F.col("h") == end).desc(), F.desc("c"), "h").limit(size).toPandas()
    levels = {r[0]: r[1] for r in counts.groupBy(F.length(F.bin("c")).alias("bits")).count().collect()}
    floor, held = 1, 0
    for bits in sorted(levels, reverse=True):
        held += levels[bits]
        if held > BROADCAST_WORDS:
            floor = 1 << bits
            break
    known = counts.where(F.col("c") >= floor).select("h", "c").toPandas().sort_values("h")
    first = counts.sparkSession.createDataFrame([(int(h),) for h in top["h"]], "h long")
    rest = counts.join(F.broadcast(first), "h", "left_anti").groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    share = np.zeros((CLASSES, 2))
    for r in rest:
        share[r.cls] = r.n, r.v
    return Vocabulary(top["h"].to_numpy(np.int64), (known["h"].to_numpy(np.int64), known["c"].to_numpy(np.int64)), share, total[0], total[1], floor)


def _sequence(outcome: np.ndarray, context: np.ndarray, counts: np.ndarray, end: int, edge: int):
    """Outcomes of all texts, each closed by the end, and the contexts of the two words before each."""
    ends = np.cumsum(counts)
    w, c = np.insert(outcome, ends, end), np.insert(context, ends, edge)
    first = np.cumsum(counts + 1) - counts - 1
    c1 = np.concatenate([[edge], c[:-1]])
    c2 = np.concatenate([[edge, edge], c[:-2]])[: len(c)]
    c1[first] = edge
    c2[first] = edge
    return w, c1, c2


class Weights:
    """Vectors of first contexts, second contexts and outcomes; an outcome's last number is its bias."""

    def __init__(self, q: np.ndarray, contexts: int):
        x = np.random.default_rng(11).standard_normal((2 * contexts + len(q), WIDTH + 1)).astype(np.float32) * 0.1
        x[:, -1] = 0
        x[2 * contexts :, -1] = np.log(q)
        self.x, self.scale, self.contexts = x, np.ones_like(x), contexts

    def parts(self):
        k = self.contexts
        return self.x[:k, :-1], self.x[k : 2 * k, :-1], self.x[2 * k :]


class Trainer:
    """Noise-contrastive gradient steps (with per-element scaling) on batches of outcomes."""

    def __init__(self, weights: Weights, q: np.ndarray):
        self.k = weights.contexts
        self.x, self.scale = weights.x.copy(), weights.scale.copy()
        self.met = np.zeros(len(self.x))  # uses of each row
        self.logq = np.log(NOISE * q).astype(np.float32)
        self.cum = np.cumsum(q)
        self.rng = np.random.default_rng(5)
        self.tokens = 0

    def train(self, w, c1, c2) -> None:
        for i in range(0, len(w), BATCH):
            self._step(w[i : i + BATCH], c1[i : i + BATCH], c2[i : i + BATCH])
        self.tokens += len(w)

    def _step(self, w, c1, c2) -> None:
        k, x = self.k, self.x
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        q = x[c1, :-1] + x[k + c2, :-1]
        own, other = x[2 * k + w], x[2 * k + noise]
        good = (q * own[:, :-1]).sum(axis=1) + own[:, -1] - self.logq[w]
        bad = q @ other[:, :-1].T + (other[:, -1] - self.logq[noise])
        gg = (1 / (1 + np.exp(-good)) - 1).astype(np.float32)
        gb = 1 / (1 + np.exp(-bad))
        g = np.zeros((3 * len(w) + NOISE, WIDTH + 1), np.float32)
        g[: len(w), :-1] = gg[:, None] * own[:, :-1] + gb @ other[:, :-1]
        g[len(w) : 2 * len(w)] = g[: len(w)]
        g[2 * len(w) : 3 * len(w), :-1] = gg[:, None] * q
        g[2 * len(w) : 3 * len(w), -1] = gg
        g[3 * len(w) :, :-1] = gb.T @ q
        g[3 * len(w) :, -1] = gb.sum(axis=0)
        at = np.concatenate([c1, k + c2, 2 * k + w, 2 * k + noise])
        order = np.argsort(at, kind="stable")
        rows = at[order]
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, g = rows[cuts], np.add.reduceat(g[order], cuts, axis=0)
        self.met[rows] += np.diff(np.append(cuts, len(at)))
        scale = self.scale[rows] + g * g
        self.scale[rows] = scale
        x[rows] -= STEP * g / np.sqrt(scale)


def _columns(with_scale: bool) -> list[str]:
    return [f"{k}{i}" for k in "ds"[: 1 + with_scale] for i in range(WIDTH + 1)]


def _trained(shared, q, least: int = 0):
    def run(batches):
        voc, weights = shared.value
        t, kept = Trainer(weights, q), []
        for whole in batches:
            for b in slices(whole, 0):
                h, cls, at, counts = _read(b.column(0))
                out = voc.outcome(h, cls)
                seq = _sequence(out[at], voc.context(out, cls)[at], counts, voc.end, voc.contexts - 1)
                t.train(*seq)
                if least:
                    kept.append(seq)
        while kept and t.tokens < least:
            for seq in kept:
                t.train(*seq)
        if t.tokens:
            both = np.hstack([t.x, t.scale]) if least else t.x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(t.met + 1e-3), *map(pa.array, both.T.copy())], ["row", "n", *_columns(least > 0)])

    return run


def warm_up(texts: DataFrame, docs: int) -> DataFrame:
    """The texts of about WARM_UP of ``docs`` documents (h, text) in one partition: drawn in parallel by the hash
    of key and text, equal rows once, so that neither a hot key nor a hot row comes in whole."""
    share = min(1.0, WARM_UP / max(docs, 1))
    pick = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h", "t"])
    return pick.repartition(1).sortWithinPartitions("h", "t").select("t")


def fit(texts: DataFrame, voc: Vocabulary, q: np.ndarray, warm_tokens: int) -> Weights:
    """Averaged weights of ``texts`` (h, t): one mean a weight, so what the driver gets does not grow with the documents."""
    sc, weights = texts.sparkSession.sparkContext, Weights(q, voc.contexts)
    docs = texts.select(F.lit(1)).count()
    dealt = texts.repartition(max(1, -(-docs // DEALT)), "h").sortWithinPartitions("h", "t").select("t")
    for part, least in ((warm_up(texts, docs), max(warm_tokens, 1)), (dealt, 0)):
        shared, names = sc.broadcast((voc, weights)), _columns(least > 0)
        mean = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).cast("float").alias(c) for c in names]
        rows = part.mapInArrow(_trained(shared, q, least), "row long, n double, " + ", ".join(f"{c} float" for c in names))
        got = rows.groupBy("row").agg(*mean).toPandas()
        if len(got):
            both = got.sort_values("row").drop(columns="row").to_numpy(np.float32)
            weights.x = both[:, : WIDTH + 1].copy()
            if least:
                weights.scale = both[:, WIDTH + 1 :].copy()
    return weights


def log_normalisers(weights: Weights, first: int) -> np.ndarray:
    """log of the sum over all outcomes, for context ``first`` beside every second context."""
    a, b, out = weights.parts()
    z = np.empty(len(b), np.float32)
    for i in range(0, len(b), CONTEXTS_AT_ONCE):
        s = (a[first] + b[i : i + CONTEXTS_AT_ONCE]) @ out[:, :-1].T + out[:, -1]
        top = s.max(axis=1)
        z[i : i + CONTEXTS_AT_ONCE] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return z


def _normalised(shared):
    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([log_normalisers(shared.value[1], i).astype("<f4").tobytes()], pa.binary())], ["i", "z"])

    return run


def _log10_p(weights: Weights, z: np.ndarray, w, c1, c2) -> np.ndarray:
    a, b, out = weights.parts()
    lp = np.empty(len(w))
    for i in range(0, len(w), TOKENS_AT_ONCE):
        s = slice(i, i + TOKENS_AT_ONCE)
        own = out[w[s]]
        lp[s] = np.einsum("ij,ij->i", a[c1[s]] + b[c2[s]], own[:, :-1]) + own[:, -1] - z[c1[s], c2[s]]
    return lp / np.log(10.0)


def _scored(shared):
    def run(batches):
        from pyspark import TaskContext

        voc, weights, z = shared.value
        part, row = TaskContext.get().partitionId() << 36, 0
        low = np.log10(voc.tokens + voc.types + 1.0)
        inside = np.log10(voc.share.sum(axis=1) + 1.0)
        for whole in batches:
            for b in slices(whole, 2):
                h, cls, at, counts = _read(b.column(2))
                out, c = voc.outcome(h, cls), voc.count(h)
                lp = _log10_p(weights, z, *_sequence(out[at], voc.context(out, cls)[at], counts, voc.end, voc.contexts - 1))
                # The share of a word in its class, but for the count that a join must add.
                rare = c < 0
                log_c = np.where(rare, 0.0, np.log10(np.maximum(c, 0) + 1.0))
                in_class = np.where(out >= len(voc.top), log_c - inside[cls], 0.0)
                text = np.repeat(np.arange(len(b)), counts)
                n = counts + 1
                total = np.bincount(np.repeat(np.arange(len(b)), n), weights=lp, minlength=len(b)) + np.bincount(text, weights=in_class[at], minlength=len(b))
                end_c = np.log10(voc.end_count + 1.0)
                base = np.bincount(text, weights=log_c[at], minlength=len(b)) + end_c - n * low
                known = np.bincount(text, weights=(c > 0)[at], minlength=len(b)).astype(np.int64) + (voc.end_count > 0)
                rid = part + row + np.arange(len(b))
                row += len(b)
                on = rare[at]
                pair, times = np.unique(text[on] * max(len(h), 1) + at[on], return_counts=True)
                t, k = pair // max(len(h), 1), pair % max(len(h), 1)
                gone = pa.nulls(len(t))
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(mix64(rid.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(len(b), np.int64)), b.column(0), b.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(total)], NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(rid[t]), pa.array(h[k]), pa.array(times.astype(np.int64)), *[gone.cast(x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], NAMES)

    return run


NAMES = ["rid", "h", "times", "doc", "held", "n", "known", "base", "total"]
SCORES = "rid long, h long, times long, doc long, held boolean, n long, known long, base double, total double"


def scored(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: int = 2, folds: int = 7, warm_tokens: int = WARM_TOKENS) -> DataFrame:
    """One row for each row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the key (a null key: empty text) modulo ``folds`` is ``held_out``
    teach nothing.  A null text is empty: it has the end as its one token.  Texts of any
    length are read whole; repeated rows teach, and are scored, one by one; other columns,
    whatever their names, play no part.  Without training rows every score is that of an
    even choice over the outcomes.
    """
    held = crc_mod(F.col(key), folds) == held_out
    taught = docs.where(~held).select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))
    counts = taught.select("t").mapInArrow(_counted, "h long, cls long, c long").groupBy("h").agg(F.any_value("cls").alias("cls"), F.sum("c").alias("c"))
    counts = cut(counts)
    voc = vocabulary(counts)
    end = int(hashed([END]).view(np.int64)[0])
    voc.end = int(voc.outcome(np.array([end]), np.zeros(1, np.int64))[0])
    voc.end_count = max(int(voc.count(np.array([end]))[0]), 0)
    mass = np.concatenate([np.zeros(len(voc.top)), voc.share[:, 0]])
    mass[voc.top_id] = np.maximum(voc.count(voc.top), 0)
    q = (mass + 0.5) / (mass + 0.5).sum()
    weights = fit(taught, voc, q, warm_tokens)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((voc, weights))
    rows = spark.range(voc.contexts).repartition(24).mapInArrow(_normalised(shared), "i long, z binary").toPandas().sort_values("i")
    z = np.stack([np.frombuffer(r, "<f4") for r in rows["z"]])
    shared = spark.sparkContext.broadcast((voc, weights, z))
    src = docs.select(F.col(key).cast("long").alias("doc"), held.alias("held"), text)
    parts = src.mapInArrow(_scored(shared), SCORES)
    low = counts.where(F.col("c") < voc.floor).select("h", "c")
    log_c = F.coalesce(F.col("times") * F.log10(F.col("c") + 1.0), F.lit(0.0))
    joined = parts.join(low, "h", "left").groupBy("rid").agg(
        F.max("doc").alias(key), F.max("held").alias("held_out"), F.max("n").alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(log_c)).alias("base_score"), (F.sum(F.coalesce("total", F.lit(0.0))) + F.sum(log_c)).alias("score"),
    )
    return joined.select(key, "held_out", "n_tokens", "n_known", F.lit(voc.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op2_lm_scores": op2_lm_scores}
