"""Alignment of two tokenizers against plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrack.llm import align
from tallyrack.llm.common import table
from tallyrack.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, pairs string, key string"
ODD = ["  a", "a  b", "x ", " ", "  ", "a\x00b c", "▁x y", "\n a", "é 中文 😀x", "</s>[INST] <|endoftext|>", "z" * 300, None, "", "\t", "a\n\nb."]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, token by token."""
    a_lib, b_lib = libraries
    chars = align.byte_alphabet()
    each = []
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = a_lib.encode(spaced.decode(), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_bytes = [bytes(chars[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != spaced or b"".join(b_bytes) != spaced:
            each.append(([], [], [], ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if s < f and t < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, (s, z) in zip(ids, own) if low <= s and z <= e) for ids, own in zip((a, b), spans)))
            low = e
        each.append((a, b, links, ";".join(groups)))
    count = Counter(p for _, _, links, _ in each for p in set(links))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, ls, g in each]


def test_cuts_are_whole_texts(libraries):
    both = align.sides(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    texts = [x for x in ODD if x] * 2 + ["a\n b", "a\n\n b c", "it's a\u00a0 b", "x\t y", "one two\nthree, four."]
    want = [[libraries[0].encode(" " + x, add_special_tokens=False).ids for x in texts], [libraries[1].encode(x) for x in texts]]
    for (ids, counts), plain_ids in zip(both.encode(pa.array([" " + x for x in texts]), "".join(" " + x for x in texts).encode()), want):
        ends = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == plain_ids


def test_query(spark, sf, libraries):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[1:]) for r in align.op13_alignment(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    short = [r for r in rows if len(r.text or "") < 4000]
    want = dict(zip((r.doc_id for r in rows), plain([r.text for r in rows], libraries))) if len(short) == len(rows) else None
    if want is None:  # links of long texts take a plain double loop too long: their other columns, then
        want = dict(zip((r.doc_id for r in short), plain([r.text for r in short], libraries)))
        part = lambda v: (*v[:4], v[6])
        assert {d: part(got[d]) for d in want} == {d: part(v) for d, v in want.items()} and len(got) == len(rows)
    else:
        assert got == want


@pytest.mark.parametrize("common_pairs", [0, 3, 1 << 20])
def test_odd_texts_and_counts(spark, libraries, tmp_path, common_pairs):
    texts = [*ODD, "the cat sat", "the cat sat", "the dog", "cats the", " ".join(["the cat"] * 200)]
    d = spark.createDataFrame([(i // 2 if i else None, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).withColumn("n", F.monotonically_increasing_id())
    order = [r.text for r in d.orderBy("n").collect()]
    align.aligned(d.coalesce(1)).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/a")
    rows = spark.read.parquet(f"{tmp_path}/a")
    counts = align.with_pair_counts(rows, "row", common_pairs=common_pairs)
    out = rows.join(counts, "row").orderBy("row").collect()
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in out]
    assert got == plain(order, libraries)
    assert out[0].doc_id is None


def test_empty_table(spark, tmp_path):
    rows = align.aligned(spark.createDataFrame([], SCHEMA)).withColumn("row", F.monotonically_increasing_id())
    assert rows.count() == 0 and align.with_pair_counts(rows, "row").count() == 0


def test_settled_letters(libraries):
    """Below U+0240 the quicker way gives the library's ids, whatever stands beside a character."""
    side = align.sides(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).a
    assert side.own
    texts = [f" a{c}1 {c}{c}'s {c}\n {c}b" for c in map(chr, range(0x260))]
    ids, counts = side.encoded(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [libraries[0].encode(x, add_special_tokens=False).ids for x in texts]
