"""Collocations: phrases of a language that stand together more often than their parts.

Counts of phrases are made order by order; a phrase is counted only where both phrases that
are one word shorter may be frequent, which a bit filter of bounded size tells (it may let
too many through, never too few), so the counts are exact.  The frequent phrases of all
orders are then kept as sorted streams, once in prefix order and once in suffix order, dealt
out by ranges.  In such a stream a phrase comes right behind its beginnings, so one pass
merges the orders in lockstep: the count of each beginning is that of the last row of its
order, and the largest count of a phrase one word longer is folded back into its beginning.
Prefix order gives the left parts and right extensions, suffix order the right parts and left
extensions; no table of counts is held or looked up.

A null text is empty, a null language is ``und``; a language without frequent phrases has no
rows.  Equal rows count each; texts of any length are read whole, keys and other columns,
whatever their names, not at all.  Ties of a score go to the smaller cut, ties of rank to the
larger count, then the phrase in byte order.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hashed, mix64, slices, table

#: Fixed values of the contract: least count of a phrase, longest phrase, rows of a language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if one that holds it has this share of its count, in percent.
HELD_PERCENT = 80
#: Bytes of text counted at once.
SLICE_BYTES = 4_000_000
#: Bits of a filter: 24 for each phrase, up to this power of two (32 MB); with more phrases it lets more through.
FILTER_BITS, BITS_EACH = 28, 24
#: Rows of a part of a sorted stream, and most parts.
PART_ROWS, MOST_PARTS = 100_000, 4096
#: Rows that are ranked in one group before the groups of a language are ranked together.
RANK_ROWS = 200_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_and_pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in running text, piece of each)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # begin and end of each word, by turns
    n = len(edges) // 2
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2)[edges[::2]]
    tiles = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    words = tiles.take(pa.array(np.arange(0, 2 * n - 1, 2))).dictionary_encode()
    return words.dictionary.cast(pa.binary()).cast(pa.string()), words.indices.to_numpy().astype(np.int64), piece


# --- bit filters ------------------------------------------------------------------------


def folded(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of phrases from those of their words."""
    return reduce(lambda h, w: mix64(h * np.uint64(0x9E3779B97F4A7C15) + w), hashes, np.zeros(len(hashes[0]), np.uint64))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]


class Filter:
    """Tells of a phrase that it may be in a set; never denies one that is."""

    def __init__(self, bits: int, blocks: np.ndarray):
        self.bits, self.blocks = bits, blocks

    def holds(self, h: np.ndarray) -> np.ndarray:
        first, second = probes(h, self.bits)
        get = lambda at: (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        out = get(first)
        out[out] = get(second[out])
        return out


def made_filter(phrases: DataFrame, n: int) -> Filter:
    """A filter of ``n`` (lang, phrase) rows; its words of 64 bits are put together by Spark."""
    bits = min(max((n * BITS_EACH - 1).bit_length(), 10), FILTER_BITS)

    def run(batches):
        for b in batches:
            h = _phrase_hashes(b.column(0), b.column(1))
            at = np.concatenate(probes(h, bits))
            block, where = np.unique(at >> 6, return_inverse=True)
            words = np.zeros(len(block), np.uint64)
            np.bitwise_or.at(words, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(words.view(np.int64))], ["block", "word"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "block long, word long").groupBy("block").agg(F.bit_or("word").alias("word")).toPandas()
    blocks = np.zeros(1 << (bits - 6), np.uint64)
    blocks[got["block"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return Filter(bits, blocks)


def _phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Of phrases of one order (as all of a filter are)."""
    if not len(phrases):
        return np.zeros(0, np.uint64)
    lists = pc.split_pattern(phrases, " ")
    words = lists.flatten().dictionary_encode()
    own = hashed(words.dictionary.to_pylist())[words.indices.to_numpy()].reshape(len(phrases), -1)
    lang = langs.dictionary_encode()
    return folded([hashed(lang.dictionary.to_pylist())[lang.indices.to_numpy()], *own.T])


# --- counts -----------------------------------------------------------------------------


def _counted(order: int, known):
    """Counts of the phrases of an order in each slice of a batch: (lang, phrase, n); a null phrase has a language's words."""

    def run(batches):
        may = known.value if known else None
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                langs = pc.fill_null(batch.column(0), "und")
                for lang in pc.unique(langs).to_pylist():
                    texts = pc.fill_null(batch.column(1).filter(pc.equal(langs, lang)), "").cast(pa.binary()).to_pylist()
                    names, word, piece = words_and_pieces(texts)
                    if len(names):
                        phrases, n = of_order(order, lang, names, word, piece, may)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return run


def of_order(order: int, lang: str, names: pa.Array, word: np.ndarray, piece: np.ndarray, may: Filter | None):
    """(phrases, counts) of an order in running text, without those that cannot be frequent."""
    if order == 1:
        n = np.bincount(word, minlength=len(names))
        return pa.concat_arrays([names, pa.nulls(1, pa.string())]), np.append(n, len(word))
    hashes = hashed(names.to_pylist())
    first = hashed([lang])
    shorter = order - 1
    if shorter == 1:
        fine = may.holds(folded([np.repeat(first, len(hashes)), hashes]))[word]
    else:
        fine = np.zeros(len(word), bool)
        at = np.flatnonzero(piece[: len(piece) - shorter + 1] == piece[shorter - 1 :])
        fine[at] = may.holds(folded([np.repeat(first, len(at)), *[hashes[word[at + j]] for j in range(shorter)]]))
    last = len(word) - order + 1
    at = np.flatnonzero(fine[: max(last, 0)] & fine[1 : max(last, 0) + 1] & (piece[: max(last, 0)] == piece[order - 1 :])) if last > 0 else np.zeros(0, np.int64)
    code, ids = word[at], [word[at]]
    for j in range(1, order):
        ids.append(word[at + j])
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(names) + ids[-1]
    _, sample, n = np.unique(code, return_index=True, return_counts=True)
    return pc.binary_join_element_wise(*[names.take(pa.array(i[sample])) for i in ids], " ") if len(sample) else pa.array([], pa.string()), n


def phrase_counts(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, int]:
    """((lang, phrase, f) of all phrases of up to ``longest`` words found ``least`` times, (lang, n) of all words, number of phrases)."""
    src = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    spark, known, orders, total = docs.sparkSession, None, [], 0
    totals = None
    for order in range(1, longest + 1):
        sums = src.mapInArrow(_counted(order, known), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        sums = cut(sums.where((F.col("f") >= least) | F.col("phrase").isNull()))
        if totals is None:
            totals = sums.where("phrase is null").select("lang", F.col("f").alias("n"))
        sums = sums.where("phrase is not null")
        orders.append(sums)
        n = sums.count()
        total += n
        if not n:
            break
        if order < longest:
            known = spark.sparkContext.broadcast(made_filter(sums, n))
    return reduce(DataFrame.unionByName, orders), totals, total


# --- sorted streams ---------------------------------------------------------------------


def _parts(rows: DataFrame, n: int) -> list[tuple]:
    """Keys at which the parts of a stream begin, from a sample of bounded size."""
    parts = min(max(1, n // PART_ROWS), MOST_PARTS)
    if parts == 1:
        return []
    each = 64
    step = max(1, n // (parts * each))
    sample = rows.where(F.pmod(F.xxhash64("lang", "key"), F.lit(step)) == 0).limit(4 * parts * each).collect()
    keys = sorted(_order_key(r.lang, r.key) for r in sample)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _order_key(lang: str, key: list[str]) -> tuple:
    return (lang.encode(), *[w.encode() for w in key])


def _dealt(begins: list[tuple]):
    """Rows with the number of their part; a phrase goes to each part that longer ones beginning with it may be in."""

    def run(batches):
        for b in batches:
            langs, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            part, row = [], []
            for i, own in enumerate(map(_order_key, langs, keys)):
                a = bisect_right(begins, own)
                z = bisect_right(begins, (*own, b"\xff"))  # behind all that goes on from here
                part.extend(range(a, z + 1))
                row.extend([i] * (z - a + 1))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[c.take(pa.array(row, pa.int64())) for c in b.columns]], ["part", "lang", "key", "f"])

    return run


def _in_lockstep(longest: int):
    """Of each phrase in a sorted stream the counts of its beginnings and the largest of those that go one word on."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.Table.from_batches([*([held] if held else []), b]).combine_chunks().to_batches()[0]
            order = pc.list_value_length(b.column(2)).to_numpy().astype(np.int64)
            f, at = b.column(3).to_numpy(), np.arange(len(order))
            last = [None] + [np.maximum.accumulate(np.where(order == k, at, -1)) for k in range(1, longest)]
            counts = [pa.array(f[np.maximum(last[k], 0)], mask=(order <= k) | (last[k] < 0)) for k in range(1, longest)]
            longer = np.zeros(len(order), np.int64)
            for k in range(1, longest):
                rows = np.flatnonzero(order == k + 1)
                np.maximum.at(longer, last[k][rows], f[rows])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), *counts, pa.array(longer)], ["lang", "key", "f", *[f"c{k}" for k in range(1, longest)], "longer"])
            held = b.take(pa.array([int(last[k][-1]) for k in range(1, longest) if k <= order[-1] and last[k][-1] >= 0], pa.int64()))

    return run


def stream(phrases: DataFrame, n: int, longest: int, *, suffix: bool) -> DataFrame:
    """(lang, words, f, c1.., longer) from one sorted stream: counts of the first (of the last, if ``suffix``) 1, 2.. words."""
    words = F.split("phrase", " ", -1)
    rows = phrases.select("lang", (F.reverse(words) if suffix else words).alias("key"), "f")
    begins = _parts(rows, n)
    dealt = rows.mapInArrow(_dealt(begins), "part int, lang string, key array<string>, f long")
    dealt = dealt.repartitionById(len(begins) + 1, F.col("part")).sortWithinPartitions("part", "lang", "key")
    fields = "".join(f", c{k} long" for k in range(1, longest))
    out = dealt.mapInArrow(_in_lockstep(longest), f"lang string, key array<string>, f long{fields}, longer long")
    return out.where(F.size("key") > 1).withColumn("words", F.reverse("key") if suffix else F.col("key")).drop("key")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language."""
    phrases, totals, n = phrase_counts(docs, lang=lang, text=text, least=least, longest=longest)
    cuts = range(1, longest)
    left = stream(phrases, n, longest, suffix=False).withColumnsRenamed({f"c{k}": f"l{k}" for k in cuts})
    right = stream(phrases, n, longest, suffix=True).withColumnsRenamed({f"c{k}": f"r{k}" for k in cuts})
    both = left.unionByName(right, allowMissingColumns=True).groupBy("lang", "words").agg(F.max("f").alias("a"), F.max("longer").alias("longer"), *[F.max(f"{s}{k}").alias(f"{s}{k}") for s in "lr" for k in cuts])
    whole = lambda c: c.cast("decimal(20,0)")
    both = both.where(100 * whole(F.col("longer")) < HELD_PERCENT * whole(F.col("a")))
    size = F.size("words")
    options = []
    for k in cuts:
        rest = reduce(lambda c, m: c.when(size == m, F.col(f"r{m - k}")), range(k + 1, longest + 1), F)
        options.append(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), rest.alias("r")))
    scored = both.withColumn("o", F.explode(F.slice(F.array(*options), F.lit(1), size - 1))).select("lang", "words", "a", "o.k", "o.l", "o.r")
    scored = scored.withColumn("score", F.expr("2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "words", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("b"))
    best = cut(best.select("lang", F.concat_ws(" ", "words").alias("phrase"), "a", "b.l", "b.r", "b.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(1, n // RANK_ROWS)
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + m - 1] AS ph FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS o(m) WHERE len(w) >= m)),
c AS MATERIALIZED (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= 30),
inner_phrases AS (SELECT lang, ph[i:j] AS ph, max(f) AS longer FROM (SELECT lang, ph, f, i, unnest(range(i + 1, len(ph) + 1)) AS j FROM (SELECT lang, ph, f, unnest(range(1, len(ph))) AS i FROM c WHERE len(ph) > 2)) WHERE j - i + 1 < len(ph) GROUP BY 1, 2),
k AS (SELECT lang, ph, f, unnest(range(1, len(ph))) AS k FROM c ANTI JOIN (SELECT * FROM c JOIN inner_phrases USING (lang, ph) WHERE 100 * longer >= 80 * f) x USING (lang, ph) WHERE len(ph) > 1),
s AS (SELECT k.lang, k.ph, k.k, k.f AS a, l.f AS l, r.f AS r, CAST((2000000 * k.f::HUGEINT) // (l.f + r.f) AS BIGINT) AS score FROM k JOIN c l ON l.lang = k.lang AND l.ph = k.ph[1:k.k] JOIN c r ON r.lang = k.lang AND r.ph = k.ph[k.k + 1:]),
b AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": SQL}
