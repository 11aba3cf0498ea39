"""Byte-level BPE ids for whole Arrow batches.

The ids are those of the ``tokenizers`` library called with add_special_tokens=False: an
added token spelled out in a text becomes its id, unless ``special_as_text`` has it encoded
as ordinary text.  A byte-level BPE of this family never merges across a white-space
character that follows a non-space, nor across a letter and the stop after it, so a text is
cut there, every distinct cut of a batch is encoded once, and the ids of the texts are
gathered with numpy.  Texts that hold an added token, or odd white space, are encoded whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Encoded cuts that one Python worker remembers from batch to batch (about 200 bytes each).
MEMO_ENTRIES = 400_000
#: Cuts in one call of the library, and of those that it gets joined in one string.
CALL, JOINED = 20_000, 1_000
#: Bytes of text encoded at once: the more, the fewer cuts are encoded again.
TEXT_BYTES = 8_000_000
MARK = "\x00"
#: Texts with two white-space characters in a row, or the mark, are encoded whole.
ODD = r"[\s\x{0b}\x{85}\pZ][\s\x{0b}\x{85}\pZ]|\x00"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str, special_as_text: bool = False):
    """(tokenizer, memo of cuts, strings of the added tokens, bytes of each id)."""
    loaded = kept("tokens")
    if (path, special_as_text) not in loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        loaded[path, special_as_text] = (tok, {}, [t.content for t in tok.get_added_tokens_decoder().values()], token_bytes(tok))
    return loaded[path, special_as_text]


def tokenizer(path: str, special_as_text: bool = False):
    return _load(path, special_as_text)[0]


def vocabulary_size(path: str) -> int:
    return _load(path)[0].get_vocab_size(with_added_tokens=True)


def encoded_cuts(tok, cuts: list[str]) -> list[bytes]:
    """Ids of each cut as little-endian 32-bit integers."""
    out: list[bytes] = []
    for i in range(0, len(cuts), CALL):
        out += [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(cuts[i : i + CALL], add_special_tokens=False)]
    return out


def token_bytes(tok) -> np.ndarray:
    """Bytes that each id stands for: a byte-level token has one character for each."""
    vocab = tok.get_vocab(with_added_tokens=False)
    size = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
    size[list(vocab.values())] = list(map(len, vocab))
    return size


def encoded_words(tok, size: np.ndarray, cuts: list[str]) -> list[bytes]:
    """``encoded_cuts``, with words behind a space joined in one string: their ids end where their bytes do.

    No token reaches over a space from a non-space, so the ids are those of each cut alone.
    Where a joined cut does not end with a token all the same, its cuts are encoded one by one.
    """
    out: list = [None] * len(cuts)
    single = [i for i, w in enumerate(cuts) if len(w) < 2 or w[0] != " " or w[1].isspace() or w[-1].isspace()]
    alone = set(single)
    joint = [i for i in range(len(cuts)) if i not in alone]
    for k in range(0, len(joint), JOINED * 20):
        parts = [joint[i : i + JOINED] for i in range(k, min(k + JOINED * 20, len(joint)), JOINED)]
        for part, e in zip(parts, tok.encode_batch_fast(["".join([cuts[i] for i in part]) for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.cumsum(pc.binary_length(pa.array([cuts[i] for i in part], pa.string())).to_numpy().astype(np.int64))
            reach = np.cumsum(size[ids]) if len(ids) and ids.max() < len(size) else np.zeros(1, np.int64)
            last = np.searchsorted(reach, ends)
            if reach[-1] != ends[-1] or (reach[last] != ends).any():
                single += part
                continue
            data, at = ids.tobytes(), 0
            for i, z in zip(part, (4 * (last + 1)).tolist()):
                out[i], at = data[at:z], z
    for i, own in zip(single, encoded_cuts(tok, [cuts[i] for i in single])):
        out[i] = own
    return out


def encode(texts: pa.Array, path: str, special_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of ids of each text (null: empty)."""
    tok, memo, added, size = _load(path, special_as_text)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, ODD)
    for mark in added:
        odd = pc.or_(odd, pc.match_substring(texts, mark))
    odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    plain = pc.if_else(odd, "", texts) if len(odd_at) else texts
    cut = pc.replace_substring_regex(plain, r"(\pL)([.,])", "\\1" + MARK + "\\2")
    cut = pc.replace_substring(cut, "\n", MARK + "\n" + MARK)
    lists = pc.split_pattern(pc.replace_substring(cut, " ", MARK + " "), MARK)
    words = pc.list_flatten(lists).dictionary_encode()
    names = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
    new = [w for w in names if w not in memo]
    fresh = dict(zip(new, encoded_words(tok, size, new)))
    own = [memo[w] if w in memo else fresh[w] for w in names]
    for w in new[: max(MEMO_ENTRIES - len(memo), 0)]:
        memo[w] = fresh[w]
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
    pool = np.frombuffer(b"".join(own), dtype="<u4")
    first = np.cumsum(sizes) - sizes
    at = words.indices.to_numpy()
    per_word = sizes[at]
    ends = np.concatenate([[0], np.cumsum(per_word)])
    small = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    place = np.arange(ends[-1], dtype=small)
    place += np.repeat((first[at] - ends[:-1]).astype(small), per_word)
    ids = pool[place]
    del place
    word_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    bounds = ends[word_ends]
    counts = np.diff(bounds)
    if len(odd_at):
        parts, done = [], 0
        for i, own_ids in zip(odd_at, encoded_cuts(tok, texts.take(pa.array(odd_at)).to_pylist())):
            parts += [ids[bounds[done] : bounds[i]], np.frombuffer(own_ids, dtype="<u4")]
            counts[i], done = len(own_ids) // 4, i
        ids = np.concatenate([*parts, ids[bounds[done] :]])
    return ids, counts
