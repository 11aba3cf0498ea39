"""Toxicity by noisy-channel deobfuscation.

A word that looks disguised (a digit or sign beside letters, a letter doubled that seldom is, any
three times in a row, letters parted by dots, or a row of single letters) becomes a character lattice: each
sign may stand for the letters it resembles, a run for one or two of its letter, a
separator for nothing, and between spelled letters a word may end.  Viterbi decoding under a character trigram model, whose counts
come from all documents, gives the most likely restorations, and these are scored with the
words themselves.

Features are words and word beginnings that toxic documents hold far more often than clean
ones; their weights and the calibration are learned from labelled documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, kept, slices, table, without, words_of

#: Labelled documents that the classifier is fitted on at most (by crc32 of the key).
MAX_LABELLED = 200_000
#: Features of the classifier at most, the most telling first.
MAX_FEATURES = 20_000
#: A feature needs so many toxic documents, and so large a log-odds ratio.
MIN_TOXIC, MIN_ODDS, MIN_G2 = 3, 1.0, 12.0
PREFIXES = (3, 4, 5, 6)
#: Penalty and steps of the logistic regression.
RIDGE, STEPS = 0.5, 300
THRESHOLD = 0.3
#: Letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*~'`/\\"
#: Costs (negative log10 probability) of the channel.
SWAP, FOLD, SKIP, BREAK = 0.3, 0.2, 0.2, 0.2
RESTORATIONS = 3
#: Bytes of text read at once: it takes no more time than 4 MB, and a third of the memory less.
TEXT_BYTES = 1_000_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER = len(LETTERS) + 1  # 0 is the edge of a word
BASE = len(LETTERS) + 2
#: What may be disguised: a sign before or among letters, one or two behind them, letters parted by a separator, letters that are seldom doubled, any three times.
SUSPECT = r"\pL.*[0-9@$!|+(].*\pL|\pL[0-9@$+(]{1,2}$|^[0-9@$!|+(].*\pL|\pL[.\-_*~/\\]\pL|" + "|".join([*(2 * c for c in "aiujkqvwxy"), *(3 * c for c in LETTERS)])
#: Signs that do not belong to a word at its left and right edge.
LEFT = "\"#%&'*,-./:;<=>?[\\]^`{}~)«»“”„‘’…–—¿¡"
RIGHT = LEFT + "!|"


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


class Channel:
    """Decodes disguised words under a character trigram model: log10 P(c | two before)."""

    def __init__(self, counts: np.ndarray):
        self.lp = np.log10(counts + 0.1) - np.log10((counts + 0.1).sum(axis=2, keepdims=True))

    def arcs(self, word: str, breaks: bool = False):
        """For each place of the word (runs folded): [(letters, cost), ...]; with ``breaks`` words may end between places."""
        places = self._places(word)
        gap = [("", SKIP), (" ", BREAK)]
        return [x for i, place in enumerate(places) for x in ([gap, place] if i else [place])] if breaks else places

    def begins(self, word: str, most: int = PREFIXES[0]) -> set[str]:
        """The first letters that restorations of the word may have."""
        found, open_ = set(), {""}
        for place in self._places(word):
            longer = {x + letters for x in open_ for letters, _ in place}
            found |= {x[:most] for x in longer if len(x) >= most}
            open_ = {x for x in longer if len(x) < most}
            if not open_:
                break
        return found | open_

    def may_begin(self, word: str, wanted) -> bool:
        """Whether a restoration of the word may begin as one of ``wanted`` does."""
        head = word[: PREFIXES[0] + 1]
        if len(head) > PREFIXES[0] and head.isalpha() and all(a != b for a, b in zip(head, head[1:])):
            return head[:-1] in wanted  # nothing to restore there
        return not self.begins(word).isdisjoint(wanted)

    def _places(self, word: str):
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            run, i = j - i, j
            if c in SEPARATORS:
                out.append([("", SKIP)])
                continue
            letters = [(c, 0.0)] if c.isalpha() or c not in LOOKS_LIKE else [(x, SWAP) for x in LOOKS_LIKE[c]]
            if run == 1:
                out.append(letters)
            else:
                out.append([(x * k, cost + FOLD * (k != run)) for x, cost in letters for k in {1, 2}])
        return out

    def restore(self, word: str, best: int = RESTORATIONS, breaks: bool = False) -> list[str]:
        states = {(0, 0): [(0.0, ())]}
        for arcs in self.arcs(word, breaks):
            new: dict = {}
            for (a, b), paths in states.items():
                for letters, cost in arcs:
                    p, q, s = a, b, -cost
                    for x in letters:
                        k = 0 if x == " " else code(x)
                        s += self.lp[p, q, k]
                        p, q = (q, k) if k else (0, 0)
                    new.setdefault((p, q), []).extend((t + s, (rest, letters)) for t, rest in paths)
            states = {k: sorted(v, key=lambda t: -t[0])[:best] for k, v in new.items()}
        ends = sorted(((s + self.lp[a, b, 0], path) for (a, b), v in states.items() for s, path in v), key=lambda t: -t[0])
        out = []
        for _, path in ends:
            parts = []
            while path:
                path, letters = path
                parts.append(letters)
            if (w := "".join(reversed(parts))) not in out:
                out.append(w)
        return out[:best]


def core_of(word: str) -> str:
    return word.lstrip(LEFT).rstrip(RIGHT)


def _features(core: str, wanted: dict[str, set] | None) -> list[str]:
    """A word and its beginnings; of ``wanted`` features (by their first letters) only, if given."""
    if wanted is not None:
        if (own := wanted.get(core[: PREFIXES[0]])) is None:
            return []
        return [f for f in (core, *[f"{core[:k]}*" for k in PREFIXES if len(core) > k]) if f in own]
    return [core, *[f"{core[:k]}*" for k in PREFIXES if len(core) > k]] if core else []


def by_start(features) -> dict[str, set]:
    out: dict[str, set] = {}
    for f in features:
        out.setdefault(f.removesuffix("*")[: PREFIXES[0]], set()).add(f)
    return out


def _read(texts: pa.Array):
    """Distinct words of a batch, the word number at each place, and the number of words of each text."""
    flat, counts = words_of(texts, lower=True)
    enc = flat.dictionary_encode()
    return enc.dictionary, enc.indices.to_numpy(), counts


def _cores(words: pa.Array) -> pa.Array:
    """``core_of`` of each word."""
    return pc.utf8_rtrim(pc.utf8_ltrim(words, characters=LEFT), characters=RIGHT)


def _spelled(words: pa.Array, cores: pa.Array, at: np.ndarray, text: np.ndarray):
    """(text, word) for each row of three or more single letters."""
    short = pc.and_(pc.less(pc.utf8_length(words), 5), pc.equal(pc.utf8_length(cores), 1)).to_numpy(zero_copy_only=False)
    letter = {int(i): w for i in np.flatnonzero(short) if (w := cores[int(i)].as_py()).isalpha() or w in LOOKS_LIKE}
    single = np.zeros(len(words), bool)
    single[list(letter)] = True
    on = np.flatnonzero(single[at]) if letter else np.zeros(0, int)
    if len(on) < 3:
        return
    breaks = np.flatnonzero((np.diff(on) != 1) | (np.diff(text[on]) != 0)) + 1
    for run in np.split(on, breaks):
        if len(run) >= 3:
            yield int(text[run[0]]), "".join(letter[int(i)] for i in at[run])


def _whole_and_parted(channel: Channel, spelled: str) -> list[str]:
    """Words of spelled letters: all of them as one, and as the words that they most likely are."""
    return list(dict.fromkeys([*channel.restore(spelled), *(w for r in channel.restore(spelled, breaks=True) for w in r.split())]))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once: by sorting, which takes less time than the hash table of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def evidence(texts: pa.Array, channel: Channel, wanted: dict[str, set] | None = None):
    """(features, feature number, text number): what each text of a batch shows, each once."""
    return _evidence(_read(texts), channel, wanted)


def _evidence(read: tuple, channel: Channel, wanted: dict[str, set] | None = None):
    """The same of what ``_read`` gives; of words that neither begin as a wanted feature does nor look disguised nothing is looked up."""
    words, at, counts = read
    text = np.repeat(np.arange(len(counts)), counts)
    cores = _cores(words)
    odd = pc.match_substring_regex(words, SUSPECT)
    near = None if wanted is None else pc.is_in(pc.utf8_slice_codeunits(cores, 0, PREFIXES[0]), value_set=pa.array(list(wanted), pa.string()))
    on = np.arange(len(words)) if near is None else np.flatnonzero(pc.or_(near, odd).to_numpy(zero_copy_only=False))
    number: dict[str, int] = {}
    own = lambda core: [number.setdefault(f, len(number)) for f in _features(core, wanted)]
    of_word: list[list[int]] = []
    for core, suspect in zip(cores.take(pa.array(on)).to_pylist(), odd.take(pa.array(on)).to_pylist()):
        f = own(core)
        if suspect and (wanted is None or channel.may_begin(core, wanted)):
            for r in channel.restore(core):
                f += own(r)
        of_word.append(f)
    sizes = np.zeros(len(words), np.int64)
    sizes[on] = np.fromiter(map(len, of_word), np.int64, len(of_word))
    flat = np.fromiter((x for f in of_word for x in f), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    telling = np.flatnonzero(sizes[at] > 0) if len(at) else np.zeros(0, np.int64)
    seen = _distinct(text[telling] * max(len(words), 1) + at[telling])
    t, w = seen // max(len(words), 1), seen % max(len(words), 1)
    per = sizes[w]
    ends = np.cumsum(per)
    f = flat[np.repeat(first[w] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
    t = np.repeat(t, per)
    more = [(x, n) for x, spelled in _spelled(words, cores, at, text) for r in _whole_and_parted(channel, spelled) for n in own(r)]
    if more:
        t, f = np.append(t, [m[0] for m in more]), np.append(f, [m[1] for m in more])
    pairs = _distinct(t * max(len(number), 1) + f)
    return list(number), pairs % max(len(number), 1), pairs // max(len(number), 1)


def _trigrams(batches):
    """Counts of letter trigrams, edges included, of all words of the texts."""
    kept("toxicity")  # nothing: what other operators kept makes room
    total = np.zeros(BASE**3, np.int64)
    for whole in batches:
        for b in slices(whole, 0, TEXT_BYTES):
            words, at, _ = _read(b.column(0))
            if not len(at):
                continue
            times = np.bincount(at, minlength=len(words))
            plain = pc.replace_substring_regex(pc.replace_substring_regex(words, r"[\x21-\x60\x7b-\x7e]*$", ""), r"[^\x00-\x7f]", "~")
            size = pc.binary_length(plain).to_numpy().astype(np.int64)
            raw = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[: int(size.sum())]
            codes = np.where((raw >= 97) & (raw <= 122), raw.astype(np.int64) - 96, OTHER)
            ends = np.cumsum(size) + 3 * np.arange(len(size))  # two edges before, one after each word
            line = np.zeros(len(codes) + 3 * len(size), np.int64)
            place = np.repeat(ends - size + 2 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(codes))
            line[place] = codes
            tri = line[:-2] * BASE * BASE + line[1:-1] * BASE + line[2:]
            owner = np.repeat(np.arange(len(size)), size + 3)[:-2]
            inside = np.arange(len(tri)) - (ends - size)[owner] < size[owner] + 1
            total += np.bincount(tri[inside], weights=times[owner[inside]], minlength=BASE**3).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all documents; at most 28**3 rows reach the driver."""
    rows = docs.select(text).mapInArrow(_trigrams, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BASE**3)
    for t, n in rows:
        counts[t] = n
    return counts.reshape(BASE, BASE, BASE)


def _counted(channel: Channel):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 0, TEXT_BYTES):
                toxic = b.column(1).to_numpy()
                names, f, t = evidence(b.column(0), channel)
                hits = np.bincount(f, weights=toxic[t], minlength=len(names)).astype(np.int64)
                all_ = np.bincount(f, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hits), pa.array(all_ - hits)], ["feature", "toxic", "clean"])

    return run


def _clean_counted(channel: Channel, wanted: set):
    def run(batches):
        starts = by_start(wanted)
        for whole in batches:
            for b in slices(whole, 0, TEXT_BYTES):
                names, f, _ = evidence(b.column(0), channel, starts)
                n = np.bincount(f, minlength=len(names))
                at = [i for i, x in enumerate(names) if x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(n[at] if at else [], pa.int64())], ["feature", "clean"])

    return run


class Model:
    """Weights of features, of log(1 + words), and the constant of the logistic score."""

    def __init__(self, channel: Channel, weight: dict[str, float], length: float, bias: float):
        self.channel, self.weight, self.length, self.bias = channel, weight, length, bias


def _shown(channel: Channel, number: dict[str, int]):
    """(label, words, numbers of the features shown) of each labelled text."""
    def run(batches):
        starts = by_start(number)
        for whole in batches:
            for b in slices(whole, 1, TEXT_BYTES):
                read = _read(b.column(1))
                names, f, t = _evidence(read, channel, starts)
                own = np.array([number.get(x, -1) for x in names], np.int64)[f] if names else np.zeros(0, np.int64)
                on = np.flatnonzero(own >= 0)
                t, own = t[on], own[on]
                ends = np.searchsorted(t, np.arange(len(b) + 1))
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(read[2]), rows], ["y", "n", "f"])

    return run


def _scored(model: Model, text: str):
    def run(batches):
        starts = by_start(model.weight)
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for b in slices(whole, at, TEXT_BYTES):
                read = _read(b.column(at))
                names, f, t = _evidence(read, model.channel, starts)
                w = np.array([model.weight.get(x, 0.0) for x in names])
                z = np.bincount(t, weights=w[f], minlength=len(b)) if len(f) else np.zeros(len(b))
                z = np.clip(z + model.bias + model.length * np.log1p(read[2]), -30, 30)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], [*b.schema.names, "score"])

    return run


def _logistic(y: np.ndarray, words: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """Ridge logistic regression on sparse 0/1 features by accelerated gradient steps: n weights, length, bias."""
    logs = np.log1p(words)
    scale = 1.0 / (0.25 * (np.bincount(col, minlength=n) * 4 + 1.0) + RIDGE)  # a diagonal bound on the curvature
    step = np.concatenate([scale, [1 / (len(y) * (logs**2).mean() + 1), 1 / (len(y) + 1)]])
    beta = np.zeros(n + 2)
    beta[-1] = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    ahead, pace = beta.copy(), 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights=ahead[col], minlength=len(y)) + ahead[n] * logs + ahead[n + 1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(col, weights=e[row], minlength=n) + RIDGE * ahead[:n], [e @ logs, e.sum()]])
        new = ahead - step * g
        if g @ (new - beta) > 0:  # momentum points uphill: start it anew
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - beta)
        beta, pace = new, faster
    return beta


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents: at most ``max_labelled`` of them, chosen by hash.

    Rows with a null key or label teach nothing; a key with several labels counts as the
    largest.  Without both classes the score is the share of toxic labels everywhere.
    """
    channel = Channel(character_counts(docs, text))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.95 * max_labelled / n * (1 << 30)))
    known = cut(known)
    taught = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(known), key)
    base = cut(taught.groupBy("_y").agg(F.count(F.lit(1)).alias("n")))
    size = {r["_y"]: r["n"] for r in base.collect()}
    n1, n0 = size.get(1.0, 0), size.get(0.0, 0)
    if not n1 or not n0:
        p = (n1 + 0.1) / (n0 + n1 + 1)
        return Model(channel, {}, 0.0, math.log(p / (1 - p)))
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    counted = "feature string, toxic long, clean long"
    toxic = taught.where("_y = 1").select("_text", "_y").mapInArrow(_counted(channel), counted).groupBy("feature").agg(F.sum("toxic").alias("n"))
    few = toxic.where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "feature").limit(10 * MAX_FEATURES).collect()
    wanted = {r.feature: r.n for r in few}
    clean = taught.where("_y = 0").select("_text").mapInArrow(_clean_counted(channel, set(wanted)), "feature string, clean long").groupBy("feature").agg(F.sum("clean").alias("n"))
    lows = {r.feature: r.n for r in clean.collect()}
    rows = []
    for f, a in wanted.items():
        b = lows.get(f, 0)
        expected = (a + b) * n1 / (n1 + n0)
        g2 = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))
        if (o := odds(a, b)) >= MIN_ODDS and g2 >= MIN_G2:
            rows.append((-g2, f))
    number = {f: i for i, (_, f) in enumerate(sorted(rows)[:MAX_FEATURES])}
    shown = taught.select("_y", "_text").mapInArrow(_shown(channel, number), "y double, n long, f array<int>").toArrow()
    col = pc.list_flatten(shown["f"]).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(shown)), pc.list_value_length(shown["f"]).to_numpy())
    beta = _logistic(shown["y"].to_numpy(), shown["n"].to_numpy(), row, col, len(number))
    return Model(channel, {f: float(beta[i]) for f, i in number.items()}, float(beta[-2]), float(beta[-1]))


def scored(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted; a null text scores as an empty one.  No row moves.

    Columns of these names are replaced.  Equal texts score alike, in whatever rows; a score
    of exactly ``threshold`` is predicted toxic.  Texts of any length are scored whole.
    """
    docs = without(docs, "score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(_scored(model, text), f"{fields}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def nontoxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the score does not reject, learned from all ``labels``; columns stay as they are."""
    named = docs.select(F.col("text").alias("_own_text"), F.struct(*docs.columns).alias("_row"))
    out = scored(named, learn(docs, labels), text="_own_text") if {"score", "predicted"} & {c.lower() for c in docs.columns} else scored(docs, learn(docs, labels))
    out = out.where("predicted = 0")
    return out.select("_row.*") if "_row" in out.columns else out.select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = learn(docs, table(spark, sf_dir, "labels").where(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
