"""Chat formatting into a prefix tree (DataFrame functions, but for the token ids).

Conversations that share their first turns share nodes.  A node is named by a chained hash
of its turns; sorting the distinct conversations by their chains is the depth-first order,
so a conversation emits the nodes after the common beginning with its predecessor.  Each
emitted segment has its place in the stream, the position of its first token in its own
conversation, and the intervals of the stream that its ancestors take, to which attention
is allowed.  Shared tokens are thus in the stream once.

A turn reads ``<|role|>`` line feed, text, ``</s>`` line feed.  Control strings inside
roles and texts get a backslash after their first character; a string that already has
backslashes there gets one more, so reading back is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, long_binary, table
from .tokens import encode, tokenizer_path

#: What follows the first character of a control string, by that character (fixed formats).
REST = {"<": r"(?:\||/?s>)", r"\|": ">", r"\[": r"/?INST\]"}
_HEADS = [(c, rest) for c, rest in REST.items()]
ESCAPE = "(" + "|".join(rf"{c}(?=\\*{rest})" for c, rest in _HEADS) + ")"
UNESCAPE = "|".join(rf"(?<={c})\\(?=\\*{rest})" for c, rest in _HEADS)

#: Conversations of a part of the stream: the parts grow in number with the table.
PART_CONVERSATIONS = 50_000


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(ESCAPE), F.lit(r"$1\\"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(UNESCAPE), F.lit(""))


def _with_ids(path: str):
    def run(batches):
        for b in batches:
            ids, counts = encode(b.column(b.schema.get_field_index("formatted")), path)
            ends = np.cumsum(counts)
            own = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts), long_binary(own)], [*b.schema.names, "n_tokens", "ids"])

    return run


def formatted(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, segments) of rows (conv_id, turn, role, text).

    conversations: conv_id, leaf, path (its nodes).  segments, one for each node: node,
    role, formatted, loss_start and loss_length (code points of ``formatted`` that are
    learned: an assistant's text), ids, n_tokens, start (in the stream), position,
    attends (intervals of the stream).  Rows with equal conv_id and turn follow each other
    by role and text; a null turn comes first, null roles and texts are empty, a null
    conv_id is a conversation of its own.
    """
    path = path or tokenizer_path()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct("turn", empty("role").alias("role"), empty("text").alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    link = lambda acc, x: F.array_append(acc, F.md5(F.concat(F.element_at(acc, -1), x.role, F.lit("\n"), F.length(x.role).cast("string"), F.lit("\n"), x.text)))
    chain = F.aggregate("turns", F.array(F.lit("")), link)
    convs = cut(convs.withColumn("path", F.slice(chain, F.lit(2), F.size("turns"))).withColumn("leaf", F.element_at("path", -1)))
    whole = convs.groupBy("leaf").agg(F.any_value("path").alias("path"), F.any_value("turns").alias("turns"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // PART_CONVERSATIONS))
    dealt = cut(whole.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("path")
    last = dealt.groupBy("part").agg(F.max("path").alias("last"))
    last = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    d = dealt.withColumns({"nth": F.row_number().over(here), "prev": F.lag("path").over(here)}).join(F.broadcast(last), "part")  # at most one row a partition
    prev = F.coalesce("prev", "before", F.array().cast("array<string>"))
    same = F.zip_with("path", prev, lambda a, b: a.eqNullSafe(b))
    common = F.array_position(F.array_append(same, F.lit(False)), False) - 1
    d = d.select("leaf", "part", "nth", "path", "turns", common.cast("int").alias("common"))
    node = F.posexplode(F.slice(F.arrays_zip("path", "turns"), F.col("common") + 1, F.size("path")))
    segs = d.select("leaf", "part", "nth", "common", node.alias("k", "x")).select("leaf", "part", "nth", (F.col("common") + F.col("k") + 1).alias("depth"), F.col("x.path").alias("node"), F.col("x.turns.role").alias("role"), F.col("x.turns.text").alias("text"))
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"))
    body = escaped(F.col("text"))
    segs = segs.select("leaf", "part", "nth", "depth", "node", "role", F.concat(head, body, F.lit("</s>\n")).alias("formatted"), F.length(head).alias("loss_start"), F.when(F.col("role") == "assistant", F.length(body)).otherwise(0).alias("loss_length"))
    schema = "leaf string, part int, nth int, depth int, node string, role string, formatted string, loss_start int, loss_length int, n_tokens long, ids binary"
    segs = cut(segs.mapInArrow(_with_ids(path), schema))
    sums = segs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("part").orderBy("nth", "depth").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part", "nth").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumns({"start": F.coalesce(F.sum("n_tokens").over(order), F.lit(0)), "run": F.coalesce(F.sum("n_tokens").over(own), F.lit(0))})
    segs = cut(segs.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("base"))
    shared = d.select("leaf", F.posexplode(F.slice("path", F.lit(1), F.col("common"))).alias("i", "node"))
    shared = shared.join(segs.select("node", "start", "n_tokens"), "node").groupBy("leaf")
    shared = shared.agg(F.sum("n_tokens").alias("ahead"), F.sort_array(F.collect_list(F.struct("i", "start", (F.col("start") + F.col("n_tokens")).alias("end")))).alias("spans"))
    span = "array<struct<start:bigint,end:bigint>>"
    out = segs.join(shared, "leaf", "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    above = F.coalesce(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))), F.array().cast(span))
    mine = F.when(F.col("run") > 0, F.array(F.struct((F.col("start") - F.col("run")).alias("start"), F.col("start").alias("end")))).otherwise(F.array().cast(span))
    touch = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).end == s.start), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(F.element_at(acc, -1).start.alias("start"), s.end.alias("end")))).otherwise(F.array_append(acc, s))
    out = out.withColumn("attends", F.aggregate(F.concat(above, mine), F.array().cast(span), touch)).withColumn("position", F.col("ahead") + F.col("run"))
    return convs.select("conv_id", "leaf", "path"), out.select("node", "depth", "role", "formatted", "loss_start", "loss_length", "ids", "n_tokens", "start", "position", "attends")


PARTS = r"(?s)^<\|(.*?)\|>\n(.*)</s>\n$"


def read_back(convs: DataFrame, segments: DataFrame) -> DataFrame:
    """Digest of each conversation, from the emitted segments alone."""
    leaves = convs.groupBy("leaf").agg(F.any_value("path").alias("path"))
    nodes = leaves.select("leaf", F.posexplode("path").alias("i", "node"))
    got = nodes.join(segments.select("node", "formatted", "loss_start", "loss_length"), "node")
    got = got.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "formatted", "loss_start", "loss_length"))).alias("s"))
    said = F.transform("s", lambda x: F.concat(unescaped(F.regexp_extract(x.formatted, PARTS, 1)), F.lit("\n"), unescaped(F.regexp_extract(x.formatted, PARTS, 2)), F.lit("\n")))
    loss = F.array_join(F.transform("s", lambda x: unescaped(F.substring(x.formatted, x.loss_start + 1, x.loss_length))), "")
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x.formatted))
    got = got.select("leaf", F.size("s").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), chars.alias("formatted_chars"))
    return convs.select("conv_id", "leaf").join(cut(got), "leaf").drop("leaf")


TRICKY = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    convs, segments = formatted(rows.unionByName(extra))
    return read_back(convs, cut(segments))  # whole segments are written, positions and intervals too


_LEN = r"length({0}) + len(regexp_extract_all({0}, '<\\*(\||/?s>)')) + len(regexp_extract_all({0}, '\|\\*>')) + len(regexp_extract_all({0}, '\[\\*/?INST\]'))"
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + {_LEN.format('role')} + {_LEN.format('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
QUERIES = {"op10_chat": op10_chat}
ORACLES = {"op10_chat": SQL}
