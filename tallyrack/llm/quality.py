"""Quality rules with adaptive thresholds (DataFrame functions only).

Four ratios of every document are held against thresholds taken from its own (lang,
source) group.  The group's values are summarised by a mergeable quantile sketch: counts
of values rounded to six leading bits, so that a quantile is exact up to 1/32 of its value
and sketches merge by adding counts.  A fixed rule on length and repetition comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table, without

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Sketch: leading bits of a value that are kept.
LEADING_BITS = 6
#: Per mille ratio: the least slack between a group's 90 % quantile and its limit.
SLACK = {"symbols": 150, "dup_lines": 250, "repeats": 200, "word_chars": 4000}
#: A limit lies this many times the distance from the median to the 90 % quantile above the latter.
REACH = 3
#: Thresholds are broadcast up to so many groups; beyond it they are joined by salted keys.
BROADCAST_GROUPS = 100_000
SALTS = 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INNER = ("_text", "_w", "_h", "_lines", "_s", "_p", "_g", "_salt", "_row")


def _pairs(a: Column, f) -> Column:
    """f over the neighbours of an array that has two elements at least, else an empty array."""
    return F.when(F.size(a) > 1, F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words.

    A null text has no words.  n_repeat_words counts the words that lie in a window of
    three words found at least twice in the text, its first place included.
    """
    docs = without(docs, *STATS, "n_lines", *INNER)
    kept = docs.columns
    d = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    chars = lambda drop: F.length(F.translate("_text", drop, ""))
    has_word = lambda x: x.rlike(WORD)
    d = d.withColumns({
        "_w": F.transform(F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1), lambda x: F.xxhash64(x)),
        "word_chars": chars(" \t\n\x0b\f\r").cast("long"),
        "n_symbols": (F.length("_text") - chars(SYMBOLS)).cast("long"),
        "_lines": F.filter(F.split("_text", "\n"), has_word),
    })
    d = d.withColumns({"n_words": F.size("_w").cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    n = F.size("_w") - 2
    part = lambda k: F.slice("_w", F.lit(k), n)
    two = F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("_h", F.when(n > 1, F.zip_with(two, part(3), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window: they skip the sort.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    at = F.zip_with("_h", F.sequence(F.lit(1), F.size("_h")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_s", F.when(repeats, F.sort_array(at)))
    same = _pairs(F.col("_s"), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(same))))
    gain = _pairs(F.col("_p"), lambda a, b: F.least(F.lit(3), b - a))
    total = F.aggregate(gain, F.lit(0).cast("long"), lambda s, x: s + x) + 3
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).select(*kept, *STATS, "n_lines")


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_chars": per("word_chars", "n_words")}


def _bin(v: Column) -> Column:
    drop = F.greatest(F.length(F.bin(v)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of rounded ratios: (lang, source, metric, bin, n).  Sketches of parts merge by sum."""
    entry = lambda m, v: F.struct(F.lit(m).alias("metric"), _bin(v).alias("bin"))
    rows = stats.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*[entry(m, v) for m, v in _ratios().items()])).alias("e"))
    return rows.groupBy("lang", "source", "e.metric", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): the highest accepted value of each ratio."""
    g = Window.partitionBy("lang", "source", "metric")
    s = sketch.withColumns({"below": F.sum("n").over(g.orderBy("bin")), "all": F.sum("n").over(g)})
    q = lambda p: F.min(F.when(F.col("below") * 10 >= F.col("all") * p, F.col("bin")))
    s = s.groupBy("lang", "source", "metric").agg(q(5).alias("mid"), q(9).alias("high"))
    slack = reduce(lambda c, kv: c.when(F.col("metric") == kv[0], kv[1]), SLACK.items(), F)
    limit = F.col("high") + F.greatest(slack.cast("long"), REACH * (F.col("high") - F.col("mid")))
    return s.withColumn("limit", limit).groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"max_{m}") for m in SLACK])


def judged(stats: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` with base_failed and kept.  A null lang or source is a group of its own."""
    key = lambda a, b: F.concat(F.coalesce(F.concat(F.lit("l"), a), F.lit("null")), F.lit("\n"), F.coalesce(F.concat(F.lit("s"), b), F.lit("null")))
    kept = [c for c in stats.columns if c not in ("base_failed", "kept")]
    names = [f"max_{m}" for m in SLACK]
    limits = cut(limits.select(key(F.col("lang"), F.col("source")).alias("_g"), *names))
    d = without(stats, "base_failed", "kept", *names).withColumn("_g", key(F.col(lang), F.col(source)))
    if limits.count() <= BROADCAST_GROUPS:
        d = d.join(F.broadcast(limits), "_g", "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in STATS]), F.lit(SALTS)).cast("int")).join(salted, ["_g", "_salt"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = reduce(lambda a, b: a & b, [F.coalesce(v <= F.col(f"max_{m}"), F.lit(True)) for m, v in _ratios().items()])
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits).select(*kept, "base_failed", "kept")


def quality_filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``; texts are never shuffled.

    A null or empty text has fewer than MIN_WORDS words and goes; equal rows stay or go
    together; other columns, whatever their names, are passed on.  Long texts are read whole.
    """
    if {c.lower() for c in docs.columns} - {"doc_id", "text", "lang", "source", "n_chars"}:
        return quality_filtered(docs.select("lang", "source", "text", F.struct(*docs.columns).alias("doc_id"))).select("doc_id.*")
    # A column that is not deterministic keeps the filter, and with it the statistics, from being
    # copied below the join and computed again for each of its terms.
    stats = with_stats(docs).withColumn("_row", F.monotonically_increasing_id())
    limits = thresholds(sketches(stats))
    return judged(stats, limits).where(F.col("kept") & (F.col("_row") >= 0)).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = cut(with_stats(docs).drop("text"))
    return judged(stats, thresholds(sketches(stats))).select("doc_id", *STATS, "base_failed", "kept")


_RATIO_SQL = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_chars": ("word_chars", "n_words")}
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
q AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM p),
g AS (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS g FROM q WHERE n > 1),
rep AS (SELECT rid, sum(g) AS n FROM g GROUP BY rid),
s AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
r AS (SELECT *, {", ".join(f"CAST(CASE WHEN {b} > 0 THEN floor(CAST(1000 * {a} AS DOUBLE) / {b}) ELSE 0 END AS BIGINT) AS r_{m}" for m, (a, b) in _RATIO_SQL.items())} FROM s),
e AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, r_{m} AS v FROM r" for m in _RATIO_SQL)}),
k AS (SELECT lang, source, metric, (v >> CAST(greatest(length(bin(v)) - 6, 0) AS INT)) << CAST(greatest(length(bin(v)) - 6, 0) AS INT) AS bin, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS below, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM k),
z AS (SELECT lang, source, metric, min(bin) FILTER (below * 10 >= total * 5) AS mid, min(bin) FILTER (below * 10 >= total * 9) AS high FROM c GROUP BY ALL),
l AS (SELECT lang, source, metric, high + greatest(CASE metric WHEN 'symbols' THEN 150 WHEN 'dup_lines' THEN 250 WHEN 'repeats' THEN 200 ELSE 4000 END, 3 * (high - mid)) AS lim FROM z),
t AS (SELECT lang, source, {", ".join(f"max(lim) FILTER (metric = '{m}') AS max_{m}" for m in _RATIO_SQL)} FROM l GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(f"r_{m} <= max_{m}" for m in _RATIO_SQL)} AS kept
FROM r JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""
QUERIES = {"op9_quality": op9_quality}
ORACLES = {"op9_quality": SQL}
