import zlib
from array import array

import numpy as np
import pytest

from .test_packing import plain_ids


from tallyrack.llm.bitpack import Reader, Writer, bits_for, op8_token_files, pack, read_tokens, unpack, write_tokens


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31])
def test_round_trip_and_random_access(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 5003, dtype=np.uint32)
    assert (unpack(pack(ids, bits), len(ids), bits) == ids).all()
    counts = np.array([0, 1, 999, 0, 4003])
    with open(tmp_path / "x", "wb") as f:
        w = Writer(f, bits, 257)
        w.add([1, 2, None], counts[:3], ids[:1000])
        w.add([4, 5], counts[3:], ids[1000:])
        w.close()
    r = Reader(str(tmp_path / "x"))
    assert [len(r.document(i)) for i in range(5)] == counts.tolist()
    assert (r.document(4) == ids[1000:]).all() and (r.ids(200, 700) == ids[200:900]).all()


def test_bits():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 32000, 50257)] == [1, 1, 2, 8, 9, 15, 16]


def want(rows):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = plain_ids(text) + [2]
        out.append((doc, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op8_token_files(spark, sf).collect())) == want(rows)


def test_many_files_nulls_and_empty(spark, tmp_path):
    rows = [(i * 7 % 31, None if i == 3 else "" if i == 4 else f"w{i} " * (i * 13 % 50)) for i in range(31)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = read_tokens(write_tokens(d, f"file://{tmp_path}/a", file_docs=4, block_ids=100)).drop("ids")
    assert sorted(map(tuple, got.collect())) == want(rows)
    odd = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], "doc_id long, text string")
    assert [r.start for r in read_tokens(write_tokens(odd, f"file://{tmp_path}/b")).orderBy("start").collect()] == [0, 2, 4]
    assert read_tokens(write_tokens(d.limit(0), f"file://{tmp_path}/c")).count() == 0
