import random
import re

import numpy as np
import pytest

from tallyrack.llm.licenses import STRIP, TEMPLATES, aligned, license_spans, op7_licenses


def found(spark, texts, **k):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.doc_id, r.license, round(r.coverage, 2), r.start_word, r.end_word) for r in license_spans(d, **k).orderBy("doc_id", "license", "start_word").collect()]


def test_query_finds_every_notice(spark, sf):
    words = lambda t: [w.strip(STRIP) or w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = words(r.text)
        for name, text in TEMPLATES.items():
            t = words(text)
            want |= {(r.doc_id, name, i, i + len(t)) for i in range(len(own) - len(t) + 1) if own[i : i + len(t)] == t}
    got = {(r.doc_id, r.license, r.start_word, r.end_word) for r in op7_licenses(spark, sf).collect() if r.coverage == 1}
    assert want and got == want


def test_edits_nulls_and_repeats(spark):
    mit = TEMPLATES["mit"].split()
    edited = [w for i, w in enumerate(mit) if i % 17 != 3]
    edited[20:20] = ["truly", "and", "fully"]
    texts = ["x y z " + " ".join(edited) + " end", None, "", "All Rights\nReserved", "all rights reserved " * 3, "permission is hereby granted to nobody", " ".join(mit * 2), "a " * 30000 + " ".join(mit)]
    got = found(spark, texts)
    assert [g for g in got if g[0] == 0][0][1] == "mit" and [g for g in got if g[0] == 0][0][2] > 0.9
    assert (3, "all-rights-reserved", 1.0, 0, 3) in got and [g[3] for g in got if g[0] == 4] == [0, 3, 6] and not [g for g in got if g[0] in (1, 2, 5)]
    assert [g[3] for g in got if g[0] == 6 and g[1] == "mit"] == [0, len(mit)]
    assert (7, "mit", 1.0, 30000, 30000 + len(mit)) in got
    assert found(spark, ["all rights reserved"], templates={}) == []
    assert license_spans(spark.createDataFrame([], "doc_id long, text string, license int")).count() == 0


def test_neighbouring_licences_do_not_match(spark):
    pairs = {
        "Released under the BSD License.": "bsd-notice", "Licensed under CC BY 4.0.": "cc-by-4.0-notice", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-notice",
        "Licensed under CC BY-NC-ND 4.0.": None, "Licensed under CC BY-NC 3.0.": None, "Apache License, Version 1.1": None, "Licensed under the Apache License, Version 1.1.": None,
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 3.0.": "gpl-3.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0-notice", "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-notice",
        "Released under the MIT License.": "mit-notice", "Licensed under the Apache License 2.0.": "apache-2.0-notice",
    }
    got = found(spark, list(pairs))
    assert [(g[0], g[1]) for g in got] == [(i, n) for i, n in enumerate(pairs.values()) if n]


def test_whole_texts_match_as_themselves_alone(spark):
    names = list(TEMPLATES)
    texts = ["some words first " + TEMPLATES[n] + " and some after" for n in names]
    assert found(spark, texts) == [(i, n, 1.0, 3, 3 + len(TEMPLATES[n].split())) for i, n in enumerate(names)]
    assert "POSSIBILITY OF SUCH DAMAGE" in TEMPLATES["bsd-2-clause"] and "DEALINGS IN THE SOFTWARE" in TEMPLATES["mit"]


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_alignment_is_the_shortest_best_one():
    rng = random.Random(8)
    for _ in range(150):
        t, w = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        spans = [(-common(t, w[i:j]), j - i, i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        n, _, start, end = min(spans)
        got = aligned(np.array(t), np.array(w), -len(t), len(w))
        assert got == ((-n, start, end) if n else (0, 0, 0)) or not n


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_three_adjoining_copies(spark, name):
    size = len(TEMPLATES[name].split())
    got = [g[1:] for g in found(spark, [" ".join([TEMPLATES[name]] * 3), "x " + " y ".join([TEMPLATES[name]] * 2)])]
    assert got == [(name, 1.0, i * size, i * size + size) for i in range(3)] + [(name, 1.0, 1, 1 + size), (name, 1.0, 2 + size, 2 + 2 * size)]


def test_repeated_tails_and_long_insertions(spark):
    isc = TEMPLATES["isc"].split()
    more = ["filler"] * 40
    texts = [" ".join(isc + isc[-7:] * 3), " ".join(isc[:7] * 3 + isc), " ".join(isc[:50] + more + isc[50:])]
    n = len(isc)
    assert [g for g in found(spark, texts) if g[1] == "isc"] == [(0, "isc", 1.0, 0, n), (1, "isc", 1.0, 21, 21 + n), (2, "isc", 1.0, 0, n + 40)]


def test_clashing_columns_and_very_long_texts(spark):
    d = spark.createDataFrame([(None, "w " * 200000 + TEMPLATES["isc"], "x", 1, 2)], "doc_id long, text string, license string, start_word int, coverage int")
    r = license_spans(d).collect()
    assert len(r) == 1 and r[0].doc_id is None and (r[0].license, r[0].start_word) == ("isc", 200000)
