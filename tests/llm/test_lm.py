import math
import re
import zlib
from collections import Counter

import numpy as np

from tallyrack.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    words = {d: WORD.findall((t or "").translate(A_Z)) + ["\n"] for d, t in rows}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in words}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in words.items()}


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op2_lm_scores(spark, sf).collect()
    same(got, base(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_counts_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(120)] + [(200, None), (201, "a  A\nb"), (None, "q q")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = base(rows)
    for bound in (5, 10_000):
        monkeypatch.setattr(lm, "BROADCAST_WORDS", bound)
        monkeypatch.setattr(lm, "MAX_OUTCOMES", 4)
        monkeypatch.setattr(lm, "CONTEXT_WORDS", 3)
        got = lm.scored(d, warm_tokens=1).collect()
        same(got, want)
    assert lm.scored(d.limit(0), warm_tokens=1).count() == 0
    alone = lm.scored(spark.createDataFrame([(i, "x y") for i in range(3)] * 2, "doc_id long, text string"), warm_tokens=1)
    assert alone.count() == 6


def test_probabilities_sum_to_one():
    """After a cycle of four words is learned, the next one is the likeliest; all outcomes sum to one."""
    q = np.full(lm.CLASSES + 5, 1.0 / (lm.CLASSES + 5))
    weights = lm.Weights(q, 6)
    t = lm.Trainer(weights, q)
    w = np.arange(30_000) % 4
    t.train(w, np.roll(w, 1), np.roll(w, 2))
    weights.x = t.x
    z = np.stack([lm.log_normalisers(weights, i) for i in range(6)])
    n = len(q)
    p = 10 ** lm._log10_p(weights, z, np.arange(n), np.full(n, 1), np.full(n, 0))
    assert abs(p.sum() - 1) < 1e-5 and p.argmax() == 2


def test_scores_do_not_follow_the_file_splits(spark):
    """Repeated rows, null keys and clashing columns too."""
    rows = [(i % 90, " ".join(f"w{(i * j) % 37}" for j in range(i % 50))) for i in range(200)] + [(None, "q q"), (None, None)] + [(5, "w1 w2")] * 40
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, h long, score string")
    one = sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.scored(d.coalesce(1), warm_tokens=1).collect())
    two = sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.scored(d.repartition(7), warm_tokens=1).collect())
    assert len(one) == len(two) == len(rows) and all(a[:2] == b[:2] and abs(a[3] - b[3]) < 1e-5 * abs(a[3]) for a, b in zip(one, two))


def test_sequences_of_texts():
    w, c1, c2 = lm._sequence(np.array([1, 2, 3, 4]), np.array([11, 12, 13, 14]), np.array([3, 0, 1]), 0, 99)
    assert (w.tolist(), c1.tolist(), c2.tolist()) == ([1, 2, 3, 0, 0, 4, 0], [99, 11, 12, 13, 99, 99, 14], [99, 99, 11, 12, 99, 99, 99])


def test_warm_up_is_drawn_in_parallel_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "WARM_UP", 100)
    rows = [(None, f"text {i}") for i in range(1500)] + [(None, "the same")] * 1500 + [(i, f"own {i}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    warm = lm.warm_up(d.selectExpr("xxhash64(doc_id, text) as h", "text as t"), len(rows))
    assert "Exchange SinglePartition" in warm._jdf.queryExecution().executedPlan().toString() and warm.rdd.getNumPartitions() == 1
    assert 40 <= warm.count() <= 150
