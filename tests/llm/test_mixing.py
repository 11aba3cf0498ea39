import duckdb
import pytest

from tallyrack.llm import mixing, quality


def duck(sf, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    return con.sql(sql).fetchall(), con.sql(sql).columns


@pytest.mark.parametrize("module", [mixing, quality])
def test_query_against_sql(spark, sf, module):
    (name, query), = module.QUERIES.items()
    got = query(spark, sf)
    want, columns = duck(sf, module.ORACLES[name])
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def fill(sizes, weights, most=3):
    """Targets by sharing excess again until none is above its limit."""
    held, total = {}, sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(held.values())
        share = {i: weights[i] * rest / sum(weights[j] for j in free) for i in free}
        over = {i: most * sizes[i] for i in free if share[i] > most * sizes[i]}
        if not over:
            return [held.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        held |= over


def test_targets_and_totals(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), None if i % 11 == 0 else ["a", "b", "c", "d"][i * i % 4 if i % 50 else 3], "x") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mixed(d).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] += r["size"]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    want = fill([by[s][0] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert by[s][0] == by[s][3] and abs(by[s][1] - t) < 1e-6 * max(t, 1) and abs(by[s][2] - t) <= max(0.05 * t, 270)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(d.repartition(7)).collect()))


def test_empty_null_and_repeated(spark):
    d = spark.createDataFrame([(1, None, "a"), (None, " \t", None), (2, "x y", "b"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = mixing.mixed(d).collect()
    assert sorted((r["size"], r.target) for r in got) == [(0, 0.0), (0, 0.0), (2, 4.0), (2, 4.0)] and sum(r.taken for r in got) == 4
    assert mixing.mixed(d.limit(0)).count() == 0


def test_quality_cases(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "en", "s") for i in range(30)] + [(100, "a b c " * 30, "en", "s"), (101, None, None, None), (102, "", "en", None), (103, " ".join(f"w{i}###" for i in range(90)), "en", "s"), (104, "x " * 30000, "fr", "s")]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    kept = quality.quality_filtered(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == list(range(30))
    s = {r.doc_id: r for r in quality.with_stats(d).collect()}
    assert (s[100].n_words, s[100].n_repeat_words) == (90, 90) and s[103].n_symbols == 270 and s[101].n_words == 0 and s[104].n_repeat_words == 30000
    assert quality.quality_filtered(d.limit(0)).count() == 0
