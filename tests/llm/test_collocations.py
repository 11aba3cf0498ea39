"""Collocations against plain counting and against SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tallyrack.llm import collocations as C

SCHEMA = "lang string, text string, phrase string, f string, doc_id long"


def plain(rows, least, longest, top):
    out = []
    for lang in {lang or "und" for lang, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, b in cand.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q) and 100 * b >= 80 * cand[q[i:j]]:
                        gone.add(q[i:j])
        best = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


def texts(seed, docs):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d\x01", "a\x01", "é", "Ü", "中", "x-y", "a b c", "of the", "in of the end"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]
    return [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(docs)]


@pytest.mark.parametrize("part_rows,rank_rows", [(10**5, 10**5), (7, 5)])
def test_random_texts(spark, monkeypatch, part_rows, rank_rows):
    """Parts so small that most phrases have their beginnings in earlier ones."""
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    monkeypatch.setattr(C, "RANK_ROWS", rank_rows)
    rows = texts(4, 150) + [("en", None), ("de", ""), (None, "Lone"), ("en", "hot stuff " * 3000)] + [("fr", "the same row again")] * 6
    d = spark.createDataFrame([(a, t, "x", "y", None) for a, t in rows], SCHEMA)
    got = C.collocations(d, least=5, longest=4, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 4, 40)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 10)
    rows = texts(9, 80)
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, longest=3, top=10**6).collect())) == plain(rows, 4, 3, 10**6)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "a b", "", "", 1)], SCHEMA)).count() == 0


def test_counts_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 3 * 10**18), ("en", "b", 4 * 10**18), ("en", "a b", 2 * 10**18)], "lang string, phrase string, f long")
    row = C.stream(phrases, 3, 4, suffix=False).first()
    assert (row.f, row.c1, row.longer) == (2 * 10**18, 3 * 10**18, 0)


def test_words():
    names, word, piece = C.words_and_pieces([b"Ab  c\td.E", b"", b",", b"ab"])
    assert [names[i].as_py() for i in word] == ["ab", "c", "d", "e", "ab"] and list(piece) == [0, 0, 0, 1, 5]
    assert len(C.words_and_pieces([b"", b" "])[1]) == 0 and isinstance(names, pa.Array)


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = C.op11_collocations(spark, sf)
    want = con.sql(C.SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
