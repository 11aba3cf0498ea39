import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrack.llm.chat import ORACLES, TRICKY, escaped, formatted, op10_chat, read_back, unescaped

PIECES = st.lists(st.sampled_from(["<", "|", ">", "\\", "[", "/", "INST]", "s>", "</s>", "<|", "|>", "a", "\n", "é"]), max_size=12).map("".join)


def test_escapes_are_reversible(spark):
    seen = set()

    @settings(max_examples=400, deadline=None)
    @given(PIECES)
    def gather(t):
        seen.add(t)

    gather()
    rows = spark.createDataFrame([(t,) for t in seen], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("back")).collect()
    for r in rows:
        assert r.back == r.t and not any(c in r.e for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


def digest(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark, sf):
    convs = {-1: [("user", TRICKY), ("assistant", TRICKY)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: tuple(r)[1:5] for r in op10_chat(spark, sf).collect()}
    assert got == {k: digest(v) for k, v in convs.items()} and ORACLES


def test_tree_emits_shared_turns_once(spark):
    a, b, c, d = ("user", "hi there"), ("assistant", "hello you"), ("user", "more"), ("assistant", "fine </s>")
    convs = {1: [a, b, c, d], 2: [a, b], 3: [a, d], 4: [a, b, c, d], 5: [c], 6: [a, b, c, ("assistant", None)], None: [(None, "x")]}
    rows = spark.createDataFrame([(k, i, r, t, "z") for k, v in convs.items() for i, (r, t) in enumerate(v)], "conv_id long, turn long, role string, text string, leaf string")
    conv, segs = formatted(rows)
    nodes = {r.node: r for r in segs.collect()}
    paths = {r.conv_id: r.path for r in conv.collect()}
    assert len(nodes) == len({p for path in paths.values() for p in path}) == 8
    at = 0
    for s in sorted(nodes.values(), key=lambda s: s.start):
        assert s.start == at
        at += s.n_tokens
    for path in paths.values():
        seen = 0
        for i, p in enumerate(path):
            s = nodes[p]
            above = sorted(x for q in path[:i] for x in range(nodes[q].start, nodes[q].start + nodes[q].n_tokens))
            assert s.position == seen and sorted(x for t in s.attends for x in range(t.start, t.end)) == above
            seen += s.n_tokens
    back = {r.conv_id: tuple(r)[1:5] for r in read_back(conv, segs).collect()}
    assert back == {k: digest(v) for k, v in convs.items()}
    assert read_back(*formatted(rows.limit(0))).count() == 0
