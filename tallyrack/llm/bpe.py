"""Byte-level BPE by a table of ranks: encoding with offsets, and decoding.

Texts are cut before the merges without a regex.  Every code point has a class (letter,
number, other white space, space, rest), a look at its neighbours makes that a symbol, and
an automaton over the symbols says where a slice begins.  A symbol is a function from state
to state and functions compose associatively, so the states of a whole batch come from a
scan in blocks: the function of every block, a doubling scan over the blocks, then the
states inside all blocks at once.  Each distinct slice is merged once and remembered.

A null text is an empty one; an empty text has no ids.  Equal rows are encoded one by one,
texts of any length whole.  Columns other than key and text, whatever their names, are not
read; a null key stays null.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .tokens import tokenizer_path

#: Bytes of text encoded at once.
SLICE_BYTES = 2_000_000
#: Code points that one step of the scan runs through in order; blocks side by side.
BLOCK = 64
#: Slices that one Python worker remembers (about 150 bytes each).
MEMO_ENTRIES = 200_000
#: Longer slices are merged with a heap.
SHORT = 48

REST, LETTER, NUMBER, WHITE, SPACE = range(5)
#: Symbols: classes, apostrophes that begin an ending of one or two letters, then white space by what follows.
S_LETTER, S_NUMBER, S_REST, S_END1, S_END2, S_SPACE, S_WHITE, S_MORE, SYMBOLS = range(9)
#: States: what the slice so far is; of an ending, how many letters are to come.
DONE, IN_LETTERS, IN_NUMBERS, IN_REST, TWO_LEFT, ONE_LEFT, AFTER_SPACE, IN_WHITE, STATES = range(9)
#: The endings that the pre-tokeniser cuts off, by their letters.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins) by [symbol, state]; symbols from SYMBOLS on are first in their text."""
    after, begins = np.zeros((2 * SYMBOLS, STATES), np.uint8), np.ones((2 * SYMBOLS, STATES), bool)
    alone = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_REST: IN_REST, S_END1: ONE_LEFT, S_END2: TWO_LEFT, S_SPACE: AFTER_SPACE, S_WHITE: DONE, S_MORE: IN_WHITE}
    for symbol, state in alone.items():
        after[symbol], after[SYMBOLS + symbol] = state, state
    joins = [(S_LETTER, s, IN_LETTERS) for s in (IN_LETTERS, AFTER_SPACE)] + [(S_LETTER, TWO_LEFT, ONE_LEFT), (S_LETTER, ONE_LEFT, DONE)]
    joins += [(S_NUMBER, s, IN_NUMBERS) for s in (IN_NUMBERS, AFTER_SPACE)] + [(S_MORE, IN_WHITE, IN_WHITE)]
    joins += [(symbol, s, IN_REST) for symbol in (S_REST, S_END1, S_END2) for s in (IN_REST, AFTER_SPACE)]
    for symbol, state, to in joins:
        after[symbol, state], begins[symbol, state] = to, False
    return after, begins


AFTER, BEGINS = automaton()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, as the library's version of Unicode has it (it is asked once a process)."""
    global _classes
    if _classes is None:
        import tiktoken

        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
        single = {bytes([i]): i for i in range(256)}
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            asked = tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            members = bytes(asked.encode_ordinary(every)).decode()
            out[np.frombuffer(members.encode("utf-32-le"), "<u4")] = kind
        out[0x20] = SPACE
        _classes = out
    return _classes


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``first`` marks those that begin a text."""
    kind = classes()[points]
    inner = np.append(~first[1:], False)  # a further code point of the same text follows
    white = kind >= WHITE
    followed = inner & np.append(~white[1:], False)
    out = np.array([S_REST, S_LETTER, S_NUMBER, S_MORE, S_MORE], np.uint8)[kind]
    out[white & followed] = S_WHITE
    out[(kind == SPACE) & followed] = S_SPACE
    at = np.flatnonzero(points == ord("'"))
    at = at[inner[at]]
    out[at[np.isin(points[at + 1], [ord(c) for c in ENDINGS_1])]] = S_END1
    at = at[inner[at + 1]]
    for a, b in ENDINGS_2:
        out[at[(points[at + 1] == ord(a)) & (points[at + 2] == ord(b))]] = S_END2
    out[first] += SYMBOLS
    return out


def states_before(symbol: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """State of the automaton before each symbol, by an associative scan over transition functions."""
    n = len(symbol)
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.intp)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, block).T) * STATES
    flat = AFTER.reshape(-1)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for t in range(block):  # the function of every block
        whole = flat[grid[t][:, None] + whole]
    step, at = 1, np.arange(rows)
    while step < rows:  # composed with those of all blocks before it
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.where(at > 0, whole[at - 1, DONE], DONE).astype(np.uint8)
    out = np.empty((block, rows), np.uint8)
    for t in range(block):
        out[t] = state
        state = flat[grid[t] + state]
    return out.T.reshape(-1)[:n]


def slice_starts(data: bytes, text_ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which slices begin in joined texts (ending at ``text_ends``)."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    first = np.zeros(len(points), bool)
    first[0] = True
    inner = text_ends[(text_ends > 0) & (text_ends < len(data))]
    first[np.searchsorted(at, inner)] = True
    symbol = symbols(points, first)
    return at[BEGINS[symbol, states_before(symbol)]]


# --- pair merging -----------------------------------------------------------------------


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: again and again the neighbours whose joint has the least rank, the leftmost of ties."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # parts by their first byte
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle == 0 or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Which two tokens join to which, and the merging of many slices side by side."""

    NONE = np.int64(1) << 30

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.joint = table[:, 0], table[:, 1]
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joint, NONE if there is none."""
        if not len(self.keys):
            return np.full(len(left), self.NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joint[at], self.NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each (short, not empty) slice as little-endian 32-bit integers; a round merges one pair of each slice."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner, slot = np.arange(len(pieces)), np.repeat(np.arange(len(pieces)), sizes)
        joint = np.full(len(token), self.NONE)
        inner = np.flatnonzero(slot[1:] == slot[:-1])
        joint[inner] = self.of(token[inner], token[inner + 1])
        while len(owner):
            first = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(joint << 32 | np.arange(len(joint)), first)
            live = best >> 32 < self.NONE
            if not live.all():
                ends = np.concatenate([first, [len(token)]])
                for i in np.flatnonzero(~live).tolist():
                    out[owner[i]] = token[ends[i] : ends[i + 1]].astype("<u4").tobytes()
                keep = np.repeat(live, sizes)
                token, joint, owner, sizes = token[keep], joint[keep], owner[live], sizes[live]
                if not len(owner):
                    break
                first = np.cumsum(sizes) - sizes
                best = np.minimum.reduceat(joint << 32 | np.arange(len(joint)), first)
            at = best & 0xFFFFFFFF
            token[at] = best >> 32
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            last = at + 2 == first + sizes  # nothing follows the merged pair
            joint[at] = self.NONE
            token, joint, sizes, at = token[keep], joint[keep], sizes - 1, at - np.arange(len(at))
            more = at[~last]
            joint[more] = self.of(token[more], token[more + 1])
            more = at[at > np.cumsum(sizes) - sizes]
            joint[more - 1] = self.of(token[more - 1], token[more])
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of tokens, ids remembered by slice, and the bytes of every id for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.memo: dict[bytes, bytes] = {}
        self.pairs = Pairs(self.ranks)
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for token, rank in self.ranks.items():
            names[rank] = token
        self.widths = np.fromiter(map(len, names), np.int64, size)
        self.begins = np.cumsum(self.widths) - self.widths
        self.pool = np.frombuffer(b"".join(names), np.uint8)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each distinct slice as little-endian 32-bit integers; new ones are merged together."""
        own = [self.memo.get(p) for p in pieces]
        new = [i for i, ids in enumerate(own) if ids is None]
        whole = {i: self.ranks[pieces[i]] for i in new if pieces[i] in self.ranks}
        rest = [i for i in new if i not in whole]
        short = [i for i in rest if len(pieces[i]) <= SHORT]
        for i, rank in whole.items():
            own[i] = rank.to_bytes(4, "little")
        for i, ids in zip(short, self.pairs.merged([pieces[i] for i in short])):
            own[i] = ids
        for i in rest:
            if own[i] is None:
                own[i] = array("I", merged_long(pieces[i], self.ranks)).tobytes()
        for i in new[: max(MEMO_ENTRIES - len(self.memo), 0)]:
            if len(pieces[i]) <= SHORT:
                self.memo[pieces[i]] = own[i]
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, byte at which each id's token ends in its text, number of ids of each text)."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        data = b"".join(pc.fill_null(texts, "").cast(pa.binary()).to_pylist())
        text_ends = np.cumsum(sizes)
        starts = slice_starts(data, text_ends)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        own = self.ids(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool = np.frombuffer(b"".join(own), "<u4")
        first = np.cumsum(lengths) - lengths
        at = pieces.indices.to_numpy()
        per_piece = lengths[at]
        ends = np.cumsum(per_piece)
        ids = pool[np.repeat(first[at] - (ends - per_piece), per_piece) + np.arange(ends[-1] if len(ends) else 0)]
        # pieces of a text begin before its end
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, text_ends, side="left")]
        counts = np.diff(upto, prepend=0)
        stops = np.cumsum(self.widths[ids]) - np.repeat(text_ends - sizes, counts)
        return ids, stops, counts

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> bytes:
        """Bytes of consecutive ids of one text; ``stops`` are the offsets that encoding kept."""
        if not len(ids):
            return b""
        width = self.widths[ids]
        base = int(stops[0] - width[0])
        return self.pool[np.repeat(self.begins[ids] - (stops - width - base), width) + np.arange(int(stops[-1]) - base)].tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(read_ranks(path))
    return _vocabularies[path]


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` 32-bit integers each, as binary."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.astype("<u4").tobytes())]).cast(pa.binary())


def _decoded(own: Vocabulary, ids: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts).tolist()
    return pa.array([own.decode(ids[z - n : z], stops[z - n : z]) for z, n in zip(ends, counts.tolist())], pa.binary())


def encoded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, and_decoded: bool = False) -> DataFrame:
    """(key, ids, stops) of each row: ids and the byte offsets at which their tokens end, as little-endian 32-bit integers.

    With ``and_decoded`` the ids are decoded in the same task, as a further column.
    """
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    names = ["key", "ids", "stops", *["decoded"] * and_decoded]

    def run(batches):
        own = vocabulary(path)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                ids, stops, counts = own.encode(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), _blobs(ids, counts), _blobs(stops, counts), *[_decoded(own, ids, stops, counts)] * and_decoded], names)

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {kind}" + "".join(f", {n} binary" for n in names[1:])).withColumnRenamed("key", key)


def decoded(ids: DataFrame, *, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``encoded`` rows, which may have been stored, with ``decoded``, the bytes of their ids."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches):
        own = vocabulary(path)
        for whole in batches:
            for b in slices(whole, 1, SLICE_BYTES):
                rows = [[np.frombuffer(x, "<u4") for x in b.column(i).to_pylist()] for i in (1, 2)]
                counts = np.fromiter(map(len, rows[0]), np.int64, b.num_rows)
                flat = [np.concatenate(r) for r in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, _decoded(own, flat[0], flat[1].astype(np.int64), counts)], ["key", "ids", "stops", "decoded"])

    kind = ids.schema[key].dataType.simpleString()
    src = ids.select(F.col(key).alias("key"), "ids", "stops")
    return src.mapInArrow(run, f"key {kind}, ids binary, stops binary, decoded binary").withColumnRenamed("key", key)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"), and_decoded=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_pairs": op12_byte_pairs}
