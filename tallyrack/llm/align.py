"""Alignment of the tokens of two tokenizers over the same bytes.

A text with a space before it is encoded by a byte-level BPE (A) and, the space being the
one that it adds itself, by a sentencepiece model (B).  Both give tokens that tile the same
bytes.  Per batch, keyed by document, ``merge_asof`` finds for the start of each token the
token of the other side that covers it; both directions together are all pairs of tokens
that overlap, and where tokens of both sides end at one byte a group ends.

A text that is null or empty, or whose bytes one side does not give back, has no tokens.
Equal rows are aligned one by one, texts of any length whole; ties of counts are all best.
Columns other than key and text, whatever their names, are not read; a null key stays null.
"""

from __future__ import annotations

import json
import uuid
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import cut, shared_folder, slices, table
from .tokens import ODD, encoded_cuts, tokenizer, tokenizer_path

#: Bytes of text aligned at once.
SLICE_BYTES = 1_500_000
#: Cuts whose ids of both sides one Python worker remembers.
MEMO_ENTRIES, LONG_CUT = 250_000, 64
#: Code points whose UTF-8 begins with a lesser byte (up to U+023F) have had their classes in every version of Unicode that a library may hold.
UNSETTLED = 0xC9
#: Pairs of ids whose counts every task holds at most (the commonest); the rest are joined.
COMMON_PAIRS = 1 << 20
#: Pairs that a task gathers before it sends their counts on.
GATHERED = 1 << 22
BEGIN = "▁"
ID_BITS = 32


class Names:
    """The bytes of every id of one side."""

    def __init__(self, names: list[bytes]):
        self.widths = np.fromiter(map(len, names), np.int64, len(names))
        self.begins = np.cumsum(self.widths) - self.widths
        self.pool = np.frombuffer(b"".join(names), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after another."""
        width = self.widths[ids]
        ends = np.cumsum(width)
        return self.pool[np.repeat(self.begins[ids] - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)]


class ByteSide(Names):
    """A byte-level BPE.  Where its ids are in order of merging, texts of long-settled letters go through ``bpe``, which is faster."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        plain = byte_alphabet()
        entries = vocab | {t["content"]: t["id"] for t in model["added_tokens"]}
        names = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            names[i] = bytes(plain[c] for c in entry)
        super().__init__(names)
        self.library = tokenizer(path, special_as_text=True)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [vocab[x + y] for x, y in pairs]
        single = [i for e, i in vocab.items() if len(e) == 1]
        ordered = order == sorted(order) and len(single) + len(set(order)) == len(vocab) and max(single) < min(order)
        self.own = Vocabulary({names[i]: i for i in vocab.values()}) if ordered else None

    def encoded(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pa.array(spaced, pa.string())
        late = np.ones(len(spaced), bool)
        if self.own:
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            late = np.add.reduceat(np.frombuffer("".join(spaced).encode(), np.uint8) >= UNSETTLED, np.cumsum(size) - size, dtype=np.int64) > 0
        if not late.any():
            ids, _, counts = self.own.encode(texts)
            return ids, counts
        rows = iter(encoded_cuts(self.library, [x for x, l in zip(spaced, late) if l]))
        parts = iter(())
        if not late.all():
            ids, _, counts = self.own.encode(texts.filter(pa.array(~late)))
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]))
        both = [np.frombuffer(next(rows), "<u4") if l else next(parts) for l in late]
        return np.concatenate(both), np.fromiter(map(len, both), np.int64, len(both))


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable Latin-1 is itself, other bytes go from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class PieceSide(Names):
    """A sentencepiece model that adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = lambda i: bytes([int(pieces[i][3:-1], 16)]) if self.model.is_byte(i) else pieces[i].replace(BEGIN, " ").encode()
        super().__init__([byte(i) for i in range(len(pieces))])
        self.cuts_agree = not any(BEGIN in p.lstrip(BEGIN) for p in pieces)
        self.lone = [self.model.piece_to_id(BEGIN)]

    def encoded(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode([x[1:] for x in spaced], num_threads=1)
        rows = [row if len(x) > 1 else self.lone for row, x in zip(rows, spaced)]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


class Remembered:
    """Ids of numbered cuts of one side."""

    def __init__(self, side: Names):
        self.side, self.ids, self.counts = side, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def gathered(self, slots: np.ndarray, new: list[str], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots, number of ids of each); ``new`` cuts take the next slots, and those to ``keep`` are remembered."""
        more, sizes = self.side.encoded(new) if new else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pool, counts = np.concatenate([self.ids, more.astype(np.int64)]), np.concatenate([self.counts, sizes])
        per_cut = counts[slots]
        ends = np.cumsum(per_cut)
        ids = pool[np.repeat((np.cumsum(counts) - counts)[slots] - (ends - per_cut), per_cut) + np.arange(ends[-1] if len(ends) else 0)]
        self.ids, self.counts = np.concatenate([self.ids, more[np.repeat(keep, sizes)]]), np.concatenate([self.counts, sizes[keep]])
        return ids, per_cut


class Sides:
    """Both sides.  No token goes on behind a word's begin, so texts are cut there and each distinct cut is encoded once.

    Texts with two white-space characters in a row are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.names, self.first_b = _name_table(self.a, self.b)
        self.memo: dict[str, int] = {}
        self.remembered = Remembered(self.a), Remembered(self.b)

    def encode(self, spaced: pa.Array, data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, number of ids of each text) of both sides; each text begins with a space, ``data`` is all of them."""
        size = pc.binary_length(spaced).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        odd = pc.match_substring_regex(spaced, ODD).to_numpy(zero_copy_only=False) if self.b.cuts_agree else np.ones(len(spaced), bool)
        flat = np.frombuffer(data, np.uint8)
        begins = flat == 0x20
        begins[1:] &= flat[:-1] != 0x20
        begins &= ~np.repeat(odd, size)
        begins[first] = True
        starts = np.flatnonzero(begins)
        tiles = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        words = tiles.dictionary_encode()
        cuts = words.dictionary.to_pylist()
        slots = np.fromiter(map(self.memo.get, cuts, repeat(-1)), np.int64, len(cuts))
        at = np.flatnonzero(slots < 0)
        new = [cuts[i] for i in at.tolist()]
        held = len(self.memo)
        keep = np.fromiter((len(x) <= LONG_CUT for x in new), bool, len(new))
        keep &= np.cumsum(keep) <= MEMO_ENTRIES - held
        slots[at] = held + np.arange(len(at))
        own = slots[words.indices.to_numpy()]
        cut_text = np.searchsorted(first, starts, side="right") - 1
        out = []
        for side in self.remembered:
            ids, per_cut = side.gathered(own, new, keep)
            out.append((ids, np.bincount(cut_text, per_cut, len(spaced)).astype(np.int64)))
        self.memo.update(zip((x for x, k in zip(new, keep) if k), range(held, held + int(keep.sum()))))
        return out


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


# --- one batch --------------------------------------------------------------------------


def tiled(texts: pa.Array, both: Sides) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, tokens by text) of both sides; no tokens where a side does not give the bytes back."""
    spaced = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "")
    size = pc.binary_length(spaced).to_numpy().astype(np.int64)
    joined = "".join(spaced.to_pylist()).encode()
    data = np.frombuffer(joined, np.uint8)
    good = size > 1
    own = both.encode(spaced, joined)
    for side, (ids, counts) in zip((both.a, both.b), own):
        ends = np.concatenate([[0], np.cumsum(side.widths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        good &= np.diff(ends) == size
    every = good.all()
    for side, (ids, counts) in zip((both.a, both.b), own):
        differ = np.flatnonzero(side.joined(ids if every else ids[np.repeat(good, counts)]) != (data if every else data[np.repeat(good, size)]))
        bad = np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), differ, side="right")]
        if len(bad):
            good = good.copy()
            good[bad] = False
            every = False
    return own if every else [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in own]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) for all that overlap; tokens tile each document, offsets go on from one to the next."""
    starts = lambda ends: np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    left = pd.DataFrame({"doc": a_doc, "at": starts(a_ends), "a": np.arange(len(a_ends))})
    right = pd.DataFrame({"doc": b_doc, "at": starts(b_ends), "b": np.arange(len(b_ends))})
    by_a = pd.merge_asof(left, right, on="at", by="doc")
    by_b = pd.merge_asof(right, left.assign(begin=left["at"]), on="at", by="doc")
    more = by_b["begin"].to_numpy() != by_b["at"].to_numpy()  # tokens that begin together are met both ways
    return np.concatenate([by_a["a"], by_b["a"].to_numpy()[more]]), np.concatenate([by_a["b"], by_b["b"].to_numpy()[more]])


def shared_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A, and of B, end where one of the other side ends."""
    at = np.searchsorted(b_ends, a_ends)
    a_last = b_ends[at] == a_ends if len(b_ends) else np.zeros(len(a_ends), bool)
    b_last = np.zeros(len(b_ends), bool)
    b_last[at[a_last]] = True
    return a_last, b_last


def written_groups(a, b, n_a, n_b, a_last, b_last, both: Sides) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    last_of_doc = np.cumsum(n_b)[n_b > 0] - 1
    sign = b_last.astype(np.int64)
    sign[last_of_doc] = 2
    place = np.empty(len(a) + len(b), np.int64)
    place[np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(b_last) + 1])[a_group]] = 2 * a + a_last
    place[np.arange(len(b)) + (np.flatnonzero(a_last) + 1)[b_group]] = both.first_b + 3 * b + sign
    flat = both.names.take(pa.array(place))  # one text after another: only the offsets of documents are wanted
    ends = np.concatenate([[0], np.cumsum(n_a + n_b)])
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[ends] if len(flat) else np.zeros(len(ends), np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(n_a), [None, pa.py_buffer(offsets), flat.buffers()[2] or pa.py_buffer(b"")]).cast(pa.string())


def _name_table(a: Names, b: Names) -> tuple[pa.Array, int]:
    n, m = len(a.widths), len(b.widths)
    return pa.array([f"{i}{s}" for i in range(n) for s in ",|"] + [f"{i}{s}" for i in range(m) for s in (",", ";", "")], pa.large_string()), 2 * n


def aligned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, copies): ``pairs`` are the distinct linked ids, A's above B's 32 bits, ``copies`` how often."""
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        both = sides(a_path, b_path)
        width = len(both.b.widths)
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                docs = batch.num_rows
                (a, n_a), (b, n_b) = tiled(batch.column(1), both)
                a_doc, b_doc = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
                a_ends, b_ends = np.cumsum(both.a.widths[a]), np.cumsum(both.b.widths[b])
                a_last, b_last = shared_ends(a_ends, b_ends)
                groups = np.bincount(a_doc[a_last], minlength=docs)
                text = written_groups(a, b, n_a, n_b, a_last, b_last, both)
                at_a, at_b = overlaps(a_ends, b_ends, a_doc, b_doc)
                n_links = np.bincount(a_doc[at_a], minlength=docs)
                span = len(both.a.widths) * width
                distinct, copies = np.unique(a_doc[at_a] * span + a[at_a] * width + b[at_b], return_counts=True)
                where, pair = np.divmod(distinct, span)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where, minlength=docs))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in ((pair // width) << ID_BITS | pair % width, copies)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_a, n_b, groups, n_links)), text, *lists], ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "copies"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, copies array<long>").withColumnRenamed("key", key)


# --- counts over the corpus -------------------------------------------------------------


def pair_documents(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows' ``pairs`` a pair stands, and whether no pair of its A id stands in more."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= GATHERED:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    def counted(held):
        pair, docs = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs, pa.int64())], ["pair", "docs"])

    sums = cut(rows.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    most = sums.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("docs").alias("most"))
    return sums.join(most, F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs stand in so many documents."""
    sizes = counts.groupBy(F.length(F.bin("docs")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()
    least, total = 1 << 62, 0
    for r in sizes:  # one row a number of bits
        total += r.n
        if total > most:
            break
        least = 1 << (r.bits - 1)
    return least


def with_pair_counts(rows: DataFrame, row: str, *, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of each row with ``pairs`` and ``copies``; ``row`` names a unique number.

    The commonest pairs, ``common_pairs`` at most, are looked up in every task; the others
    are joined.
    """
    counts = cut(pair_documents(rows))
    least = _threshold(counts, common_pairs)
    held = counts.where(F.col("docs") >= least).toPandas().sort_values("pair")
    known = rows.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("pair", "docs", "best")))

    def run(batches):
        pair, docs, best = known.value
        for b in batches:
            own, copies = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            n = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            where = np.repeat(np.arange(len(n)), n)
            sums = np.zeros((2, len(n)), np.int64)  # whole numbers throughout: bincount would add doubles
            np.add.at(sums[0], where[found], copies[found] * best[at[found]])
            np.add.at(sums[1], where[found], copies[found] * docs[at[found]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where[~found], minlength=len(n)))]), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~found])) for x in (own, copies)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums[0]), pa.array(sums[1]), *rest], ["row", "n_best", "count_sum", "pairs", "copies"])

    some = rows.select(F.col(row).alias("row"), "pairs", "copies").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, copies array<long>")
    rest = some.select("row", F.explode(F.arrays_zip("pairs", "copies")).alias("p")).select("row", "p.pairs", "p.copies")
    rare = counts.where(F.col("docs") < least)
    joined = rest.join(rare, F.col("pairs") == F.col("pair")).select("row", F.when(F.col("best"), F.col("copies")).otherwise(0).alias("n_best"), (F.col("copies") * F.col("docs")).alias("count_sum"))
    both = some.select("row", "n_best", "count_sum").unionByName(joined)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("row", row)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    each = aligned(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id())
    each.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "copies").write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    return rows.drop("pairs", "copies").join(with_pair_counts(rows, "row"), "row").drop("row")


QUERIES = {"op13_alignment": op13_alignment}
