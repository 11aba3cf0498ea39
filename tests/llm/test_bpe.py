"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyrack.llm import bpe
from tallyrack.llm.common import table

SCHEMA = "doc_id long, text string, ids string, key string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.tokenizer_path("byte_bpe_50k.tiktoken"))


def each(own, texts):
    ids, stops, counts = own.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [(ids[a:z], stops[a:z]) for a, z in zip(ends, ends[1:])]


def test_random_texts(own, library):
    rng = random.Random(5)
    letters = list("abst''''dmrevlREVL   \n\t\r\x0b.,!12é²٣中 \u0085😀\x00<|") + ["'ll", "'ve", "  \n "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(5000)] + ["", None, "'", "'l", " '", "x'"]
    for text, (ids, stops) in zip(texts, each(own, texts)):
        text = text or ""
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids, stops) == text.encode()


def test_every_code_point(own, library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in points[i : i + 20000]) for i in range(0, len(points), 20000)]
    for text, (ids, _) in zip(texts, each(own, texts)):
        assert ids.tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_scan_is_a_plain_run(block):
    symbol = np.random.default_rng(3).integers(0, 2 * bpe.SYMBOLS, 1000)
    state, plain = bpe.DONE, []
    for s in symbol:
        plain.append(state)
        state = bpe.AFTER[s, state]
    assert bpe.states_before(symbol, block).tolist() == plain


def test_long_slices_and_ranges(own, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (47, 48, 49, 3000)] + ["z" * 20000, " " * 700, "!" * 100]
    for text, (ids, stops) in zip(texts, each(own, texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        a, z = len(ids) // 3, len(ids) // 2 + 1
        assert own.decode(ids[a:z], stops[a:z]) == text.encode()[stops[a - 1] if a else 0 : stops[z - 1]]


def test_other_ranks(library):
    """Ranks that are no order of joining: the least joint counts even when a merge makes a lesser one."""
    import tiktoken

    names = [bytes([i]) for i in range(256)]
    more = [b"bc", b"abc", b"ab", b"cd", b"bcd", b"abcd", b"dd"]
    ranks = {n: i for i, n in enumerate([*more, *names])}
    enc = tiktoken.Encoding("odd", pat_str=r"[a-d]+", mergeable_ranks=ranks, special_tokens={})
    pairs, rng = bpe.Pairs(ranks), random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 30))) for _ in range(500)]
    texts = [t for t in texts if t.encode() not in ranks]
    for text, ids in zip(texts, pairs.merged([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text) == bpe.merged_long(text.encode(), ranks)


def test_frames(spark, sf, library):
    """Null keys and texts, repeated rows, names that clash, an empty table; the query over the whole table."""
    rows = [(1, "a b's", "x", "y"), (1, "a b's", "x", "y"), (None, None, None, None), (2, "", "x", None)]
    out = bpe.decoded(bpe.encoded(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == [(0, ""), (1, "a b's"), (1, "a b's"), (2, "")]
    assert bpe.decoded(bpe.encoded(spark.createDataFrame([], SCHEMA))).count() == 0
    got = {r.doc_id: r[1:] for r in bpe.op12_byte_pairs(spark, sf).collect()}
    want = {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids, data = library.encode_ordinary(r.text or ""), (r.text or "").encode()
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest())
    assert got == want
