"""Token ids in fixed-width bit-packed files.

A file holds the ids of a run of documents, in ascending key order, in blocks of
``block_ids`` ids; each id takes the least number of bits that the vocabulary needs, low
bits first.  Layout: magic, blocks, key and count of each document, offset of each block,
then a trailer (documents, blocks, ids, ids a block, bits, start of the document table).
Any range of ids is read by seeking to its blocks, and unpacked by numpy at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_folder, slices, table
from .tokens import TEXT_BYTES, encode, tokenizer_path, vocabulary_size

MAGIC = b"TRBITS01"
TRAILER = struct.Struct("<QQQIIQ8s")
BLOCK_IDS = 1 << 16
#: Documents in one file.
FILE_DOCS = 8192
#: Ids unpacked at a time when a whole file is read.
READ_IDS = 1 << 21
NULL_KEY = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    low_first = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(low_first[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one file; ids wait for a full block only."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at, self.wait, self.held, self.ids = len(MAGIC), [], 0, 0
        self.keys, self.counts, self.blocks = [], [], []
        out.write(MAGIC)

    def add(self, keys: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys += [NULL_KEY if k is None else k for k in keys]
        self.counts += counts.tolist()
        self.wait.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(self.held // self.block_ids)

    def _flush(self, blocks: int, rest: bool = False) -> None:
        ids, step = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32), self.block_ids
        end = len(ids) if rest else blocks * step
        for i in range(0, end, step):
            data = pack(ids[i : min(i + step, end)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.wait, self.held, self.ids = [ids[end:]], len(ids) - end, self.ids + end

    def close(self) -> None:
        self._flush(0, rest=True)
        for values in (self.keys, self.counts, self.blocks):
            self.out.write(np.array(values, "<i8").tobytes())
        self.out.write(TRAILER.pack(len(self.keys), len(self.blocks), self.ids, self.block_ids, self.bits, self.at, MAGIC))


class Reader:
    """Random access to the ids and documents of one file."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - TRAILER.size)
        n, blocks, self.n_ids, self.block_ids, self.bits, self.end, magic = TRAILER.unpack(self.file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        self.file.seek(self.end)
        self.keys, self.counts, self.blocks = (np.frombuffer(self.file.read(8 * k), "<i8") for k in (n, n, blocks))
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, start: int, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        stop = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        self.file.seek(int(self.blocks[first]))
        data = self.file.read(stop - int(self.blocks[first]))
        own = min((last + 1) * self.block_ids, self.n_ids) - first * self.block_ids
        if self.block_ids * self.bits % 8 == 0:
            out = unpack(data, own, self.bits)
        else:
            cuts = [int(b - self.blocks[first]) for b in self.blocks[first : last + 1]] + [len(data)]
            sizes = [min(self.block_ids, own - i * self.block_ids) for i in range(last - first + 1)]
            out = np.concatenate([unpack(data[a:b], k, self.bits) for a, b, k in zip(cuts, cuts[1:], sizes)])
        return out[start - first * self.block_ids :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))


def _written(folder: str, path: str, end_id: int, bits: int, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _opened(folder)
        name = f"part-{task.partitionId():06d}.bits"
        draft = f"{root}/.{name}.{task.taskAttemptId()}"
        writer = None
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                ids, counts = encode(b.column(1), path)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                if writer is None:
                    system.create_dir(root)
                    stream = system.open_output_stream(draft)
                    writer = Writer(stream, bits, block_ids)
                writer.add(b.column(0).to_pylist(), counts + 1, ids)
        if writer:
            writer.close()
            stream.close()
            system.move(draft, f"{root}/{name}")  # a repeated task writes the same file again
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.ids], pa.int64())], ["part", "file", "docs", "ids"])

    return run


def write_tokens(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, file_docs: int = FILE_DOCS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the ids of ``docs`` in ascending key order; one row a file: part, file, docs, ids, first_id.

    A null text is empty, null keys come first, equal rows are written one by one.  Texts of
    any length are encoded whole; other columns, whatever their names, are not read.
    ``folder`` must be one that all executors and the driver share.
    """
    path = path or tokenizer_path()
    bits = bits_for(max(vocabulary_size(path), end_id + 1))
    src = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    files = max(1, -(-docs.select(F.lit(1)).count() // file_docs))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    dealt = src.repartitionByRange(files, F.col("doc").asc_nulls_first()).sortWithinPartitions(*order)
    done = cut(dealt.mapInArrow(_written(folder, path, end_id, bits, block_ids), "part long, file string, docs long, ids long"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return done.withColumn("first_id", F.coalesce(before, F.lit(0)))


def _read(batches):
    for b in batches:
        for file, first_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            r = Reader(file)
            at = 0
            while at < len(r.counts):
                base = int(r.starts[at])
                end = max(at + 1, int(np.searchsorted(r.starts + r.counts, base + READ_IDS, side="right")))
                ids = r.ids(base, int(r.starts[end - 1] + r.counts[end - 1]) - base)
                own = [ids[s - base : s - base + n].tobytes() for s, n in zip(r.starts[at:end].tolist(), r.counts[at:end].tolist())]
                keys = pa.array(r.keys[at:end], mask=r.keys[at:end] == NULL_KEY)
                yield pa.RecordBatch.from_arrays([keys, pa.array(r.starts[at:end] + first_id), pa.array(r.counts[at:end]), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                at = end


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in ``files`` (see write_tokens)."""
    n = max(1, files.count())
    return files.select("file", "first_id").repartition(n, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder)).drop("ids")


QUERIES = {"op8_token_files": op8_token_files}
