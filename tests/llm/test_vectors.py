import numpy as np
import pytest

from tallyrack.llm.vectors import near_vectors, op6_near_vectors


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    own = {i: i for i, _ in rows}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    n = {i: 0 for i, _ in rows}
    ids, x = [i for i, _ in good], np.stack([v / np.linalg.norm(v) for _, v in good])
    for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
        n[ids[a]] += 1
        n[ids[b]] += 1
        p, q = sorted((root(ids[a]), root(ids[b])))
        own[q] = p
    return {(i, n[i], root(i), root(i) == i) for i in n}


def clustered(n, seed, near):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 24))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, 6 if i % 3 else n // 2)] + near * rng.standard_normal(24)
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("near", [0.05, 0.2])
def test_against_all_pairs(spark, near):
    rows, report = clustered(500, 3, near), {}
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), report=report)
    want = brute(rows)
    hit = {tuple(r) for r in got.collect()}
    assert len(hit) == len(want) and len(hit & want) >= 0.98 * len(want) and report["recall"] >= 0.9


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op6_near_vectors(spark, sf).collect()} == brute(rows)


def test_odd_vectors_copies_and_empty(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, -1.0]), (10, [1.0, 0.0])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component_id string")
    assert {tuple(r) for r in near_vectors(d).collect()} == brute(rows)
    more = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(str, near_vectors(more).collect())) == sorted(["Row(vec_id=1, n_links=0, component_id=1, kept=True)"] * 2 + ["Row(vec_id=None, n_links=0, component_id=None, kept=True)"])
    assert near_vectors(d.limit(0)).count() == 0


def test_large_buckets_are_compared_in_full(spark, monkeypatch):
    from tallyrack.llm import vectors

    # One topic: all in one cone, where pairs of different places are far below the threshold.
    rng = np.random.default_rng(5)
    x = np.zeros((1600, 32))
    x[:, 0] = 1
    x[:800, 1:] = rng.standard_normal((800, 31)) * 0.15
    x[800:] = x[:800]
    x[800:, 1:] += 0.03 * rng.standard_normal((800, 31))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want = brute(rows)
    monkeypatch.setattr(vectors, "TABLES", 1)
    monkeypatch.setattr(vectors, "ROUNDS", 0)
    monkeypatch.setattr(vectors, "RETRIES", 0)
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 1600)
    for part in (100, 5000):
        monkeypatch.setattr(vectors, "PART", part, raising=False)
        got = {tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
        assert len(got & want) >= 0.97 * len(want)


def test_tables_follow_the_bits():
    from tallyrack.llm.vectors import _signs

    for total in (10, 2_000, 51_282, 1_000_000, 26_000_000):
        for threshold in (0.5, 0.8, 0.95):
            bits, tables = _signs(total, threshold)
            met = (1 - np.arccos(threshold) / np.pi) ** bits
            assert 1 - (1 - met) ** tables >= 0.99


def test_audit_sees_isolated_pairs(spark, monkeypatch):
    from tallyrack.llm import vectors

    rng = np.random.default_rng(9)
    x = rng.standard_normal((1000, 24))
    x[1:400] = x[0] + 0.02 * rng.standard_normal((399, 24))
    x[700:] = x[400:700] + 0.2 * rng.standard_normal((300, 24))
    d = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    report = {}
    near_vectors(d, report=report)
    assert report["recall_outside"] >= 0.98 and report["audited_outside"] > 50
    monkeypatch.setattr(vectors, "_signs", lambda total, threshold: (14, 1), raising=False)
    monkeypatch.setattr(vectors, "RETRIES", 0)
    with pytest.raises(RuntimeError):
        near_vectors(d)
