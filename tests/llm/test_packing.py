import zlib
from array import array
from functools import cache

import numpy as np

from tallyrack.llm.packing import op3_packing, packed, rounds
from tallyrack.llm import tokens
from tallyrack.llm.tokens import encode, tokenizer_path


@cache
def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain_ids(text):
    return untouched().encode(text or "", add_special_tokens=False).ids


def check(pieces, docs, window=1024):
    """Every id in one piece, pieces gapless in their sequences, little padding."""
    ids = {d: plain_ids(t) + [0] for d, t in docs}
    for d, own in pieces.groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(array("I", ids[d][at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids[d])
    assert set(pieces.doc_id) == set(ids)
    for _, s in pieces.groupby("sequence_id"):
        s, at = s.sort_values("offset"), 0
        for p in s.itertuples():
            assert p.offset == at
            at += p.length
        full = set(s.padded_length)
        assert len(full) == 1 and at <= full.pop() <= window


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_packing(spark, sf).toPandas()
    check(got, docs)
    assert got.groupby("sequence_id").padded_length.first().sum() < 1.01 * got.length.sum()


def test_mixture_in_every_window():
    sizes = np.array([60_000, 30_000, 10_000])
    took = np.array(list(rounds(sizes, np.zeros(3), 1000, 50, lambda a, b: sizes / sizes.sum() * (b - a))))
    assert (took.sum(axis=1) == 1000).all() and (took.sum(axis=0) == sizes).all()
    assert (abs(np.cumsum(took, axis=0) - np.outer(np.arange(1, 101) * 1000, [0.6, 0.3, 0.1])) <= 101).all()


def test_target_shares_hold_window_by_window(spark):
    """Until a source is used up every window has its share, over all blocks; what is left follows."""
    rows = [(i, f"w{i} " * 50, "ab"[i % 2]) for i in range(2000)] + [(5000 + i, "z " * 50, None) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packed(d, window=200, block_tokens=8000, min_piece=10, shares={"a": 0.8, "b": 0.2}).toPandas()
    check(got, [r[:2] for r in rows], 200)
    name = {r[0]: r[2] for r in rows}
    got["source"] = got.doc_id.map(lambda x: name[x] or "none")
    w = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).sort_index()
    total = got.groupby("source").length.sum()
    size, cum = w.sum(axis=1), w.sum(axis=1).cumsum()
    both = w[cum < total["a"] / 0.8]
    assert (abs(both["a"].cumsum() - 0.8 * cum[both.index]) <= 30).all() and (abs(both["a"] / size[both.index] - 0.8) < 0.15).all()
    assert len(both) > 600 and w["a"][cum > total["a"] / 0.8 + 400].sum() <= 5 and w["none"][cum < total["a"] + total["b"]].sum() <= 30


def test_large_keys_beside_a_null_key(spark):
    rows = [(2**53 + 1, "a b", "x"), (None, "c d", "x"), (2**53 + 3, "e f", None)]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == {2**53 + 1, None, 2**53 + 3}


def test_small_blocks_nulls_and_shares(spark):
    rows = [(i, None if i == 3 else "" if i == 4 else f"word{i} " * (i * 7 % 90), None if i % 5 == 0 else f"s{i % 3}", "x") for i in range(60)] + [(100, "long " * 9000, "s1", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, sk string")
    for shares in (None, {"s0": 0.5, "s1": 0.2, "s2": 0.2, None: 0.1}, {"s0": 1.0}):
        check(packed(d, window=64, block_tokens=1000, min_piece=16, shares=shares).toPandas(), [r[:2] for r in rows], 64)
    assert packed(d.limit(0)).count() == 0
    twice = packed(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").selectExpr("*", "'q' as source")).toPandas()
    assert twice.length.sum() == 8 and twice.doc_id.isna().sum() == 1


def test_tokens_equal_the_library():
    import pyarrow as pa

    texts = ["a  b", "", None, "x\n\n y", "q \n z  ", "it's  \t ok\x00 b", " lead", "trail ", "a.b,c. d.. e", " 　x", "a\nb c\n", "1 22 éè. a\x1c b c\x85 d", "<|endoftext|> x", "don't.Stop", "a </s> <|endoftext|>", "x<|endoftext|>y  z\n<|endoftext|>"]
    ids, counts = encode(pa.array(texts), tokenizer_path())
    want = [plain_ids(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    from tokenizers import Tokenizer

    spelled = Tokenizer.from_file(tokenizer_path())
    spelled.encode_special_tokens = True
    ids, _ = encode(pa.array(texts), tokenizer_path(), special_as_text=True)
    assert ids.tolist() == sum((spelled.encode(t or "", add_special_tokens=False).ids for t in texts), []) and 50256 not in ids


def test_cuts_are_encoded_many_to_a_string(monkeypatch):
    """Before, the library made an object of its own for every distinct cut."""
    asked, library = [], untouched()

    class Counting:
        get_vocab = library.get_vocab

        def encode_batch_fast(self, strings, add_special_tokens):
            asked.extend(strings)
            return library.encode_batch_fast(strings, add_special_tokens=add_special_tokens)

    odd = ["", " ", "a", "\n", ".", " a\t", " \u3000x", " x\u00a0", " \u00e9\u0301\U0001f600", " 's", " can't", " --", " 12,5", " a\tb", " \ufeff", "word", ",x"]
    cuts = [x for i in range(3000) for x in ([f" w{i}", f" \u5b57{i}!"] + (odd if i % 1000 == 7 else []))]
    got = tokens.encoded_words(Counting(), tokens.token_bytes(library), cuts)
    assert got == tokens.encoded_cuts(library, cuts)
    assert len(asked) < 100 < len(cuts)
    # where ids do not end with the cuts, these are encoded one by one
    strange = [*cuts[:50], " <|endoftext|>"]
    assert tokens.encoded_words(library, tokens.token_bytes(library), strange) == tokens.encoded_cuts(library, strange)
