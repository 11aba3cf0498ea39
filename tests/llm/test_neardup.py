import re

from tallyrack.llm.neardup import deduplicated, near_duplicates, op5_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=4, percent=80):
    """(doc, n_shingles, component) of (doc, text) pairs by comparing all pairs."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(A_Z))
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    own = {d: d for d in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    p, q = sorted((root(a), root(b)))
                    own[q] = p
    return {(d, len(sets[d]), root(d), root(d) == d) for d in docs}


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in op5_near_duplicates(spark, sf).collect()} == brute(docs)


def test_chains_nulls_short_and_repeated(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(words[:57])), (4, " ".join(words[4:57])), (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (10, "two one"), (10, "two one")]
    got = near_duplicates(spark.createDataFrame(rows + [(None, "one two")], "doc_id long, text string"), width=4).collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id int, kept string, n_shingles int")
    assert near_duplicates(empty).count() == 0
    d = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y"), (2, "a b c", 6, "y"), (None, "q", 7, "z")], "doc_id long, text string, component_id int, kept string")
    assert sorted(map(str, deduplicated(d).collect())) == sorted(map(str, d.where("doc_id = 1 or doc_id is null").collect()))


def test_hub_that_is_not_linked_to_all(spark):
    base = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(base[:30] + [f"d{i}x{j}" for j in range(i % 7)] + base[30:])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_blocks_settle_what_no_hub_took_in(spark, monkeypatch):
    """Documents near one another around 0.8: chains, near misses, and blocks of few documents and columns."""
    import random

    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(60)] = f"r{rng.random()}"
            rows.append((rng.randrange(10**9), " ".join(own)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for block, columns in ((512, 4096), (7, 50)):
        monkeypatch.setattr("tallyrack.llm.neardup.BLOCK", block)
        monkeypatch.setattr("tallyrack.llm.neardup.COLUMNS", columns)
        assert {tuple(r) for r in near_duplicates(d, width=4).collect()} == brute(rows)


def test_very_long_texts_and_a_key_with_two_texts(spark):
    long = " ".join(f"w{i % 50_021}" for i in range(300_000))
    rows = [(7, long), (3, long + " end"), (4, "short one here now"), (9, "a b c d e f"), (9, "other words stand in this"), (2, "A B C D E F")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (4, 4), (7, 3), (9, 2), (9, 9)]
    assert max(r.n_shingles for r in got) == 50_022
