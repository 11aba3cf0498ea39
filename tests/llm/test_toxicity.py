import numpy as np
import pyarrow as pa
import pytest

from tallyrack.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    common = ["the", "and", "house", "river", "stone", "light", "garden", "window", "idea", "letter", "clown", "stupid", "scum"]
    rows = []
    for i in range(400):
        words = list(rng.choice(common[:10], 40))
        if i % 8 == 0:
            words[5] = str(rng.choice(common[10:]))
        rows.append((i, " ".join(words), "clown" if i % 8 else "x", int(i % 8 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, toxic int")


def test_disguises_nulls_and_long_texts(spark, corpus):
    model = T.learn(corpus, corpus.select("doc_id", "toxic"))
    texts = ["the house", "the St00pid house", "a c1own by the river", "s t u p i d light", "s.c.u.m stone", "stuuuupid", None, "", "the river " * 20000, "light " * 500 + "scum", "$cum!!"]
    got = T.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1]
    assert all(0 <= r.score <= 1 for r in got) and got[0].text == "the house"


def test_channel_prefers_likely_letters():
    counts = np.zeros((T.BASE,) * 3)
    for w in ("tall", "ball", "tail"):
        c = [0, 0, *map(T.code, w), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            counts[a, b, d] += 50
    ch = T.Channel(counts)
    assert ch.restore("t4l1")[0] in ("tall", "tail") and ch.restore("b@llllll")[0] == "ball" and ch.restore("b-a-l-l")[0] == "ball"


def test_trigrams_count_whole_words(spark):
    c = T.character_counts(spark.createDataFrame([("Ab ab",), ("ab.",), (None,), ("é",)], "text string"))
    a, b = T.code("a"), T.code("b")
    assert c[0, 0, a] == 3 and c[0, a, b] == 3 and c[a, b, 0] == 3 and c[0, 0, T.OTHER] == 1 and c.sum() == 11


def test_one_class_empty_and_clashing(spark, corpus):
    none = T.learn(corpus, corpus.select("doc_id", "toxic").where("toxic = 0"))
    out = T.scored(corpus, none)
    assert out.columns == ["doc_id", "text", "toxic", "score", "predicted"] and out.where("predicted = 1").count() == 0
    assert T.scored(corpus.limit(0), T.learn(corpus.limit(0), corpus.select("doc_id", "toxic").limit(0))).count() == 0
    kept = T.nontoxic(corpus, corpus.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    assert kept.columns == corpus.columns and kept.where("toxic = 1").count() == 0 and kept.count() == 350


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = T.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9


def test_decoder_against_all_paths():
    """The Viterbi restorations are the best of all paths through the lattice."""
    import itertools

    rng = np.random.default_rng(4)
    channel = T.Channel(rng.integers(0, 50, (T.BASE,) * 3).astype(float))
    for word in ("idi07", "a$$", "h4t3", "st.u.p", "iid", "1@0", "b00!", "x", "sss", "7+|"):
        scores = {}
        for path in itertools.product(*channel.arcs(word)):
            w, s = "".join(x for x, _ in path), -sum(c for _, c in path)
            codes = [0, 0, *map(T.code, w), 0]
            s += sum(channel.lp[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            scores[w] = max(s, scores.get(w, -1e9))
        best = sorted(scores, key=lambda w: -scores[w])
        got = channel.restore(word)
        assert got[0] == best[0] and set(got) <= set(best[: len(got) + 2])


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 40, "you vile toxicword here" if i % 2 else "a kind plain line", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t, _ in rows] + [(None, None, "s", 1), (7, "", "s", 1)], "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:40]], "doc_id long, toxic int")
    kept = T.nontoxic(docs, labels)
    assert kept.dtypes == docs.dtypes and kept.where("text like '%toxicword%'").count() == 0 and kept.where("text like 'a kind%'").count() == 200
    got = T.scored(docs, T.learn(docs, labels)).collect()
    assert len(got) == 402 and len({(r.text, r.score) for r in got}) == len({r.text or "" for r in got}) + 1
    assert T.nontoxic(docs.limit(0), labels.limit(0)).count() == 0


def trained(words):
    counts = np.zeros((T.BASE,) * 3)
    for w in words:
        p = [0, 0, *map(T.code, w), 0]
        for a, b, c in zip(p, p[1:], p[2:]):
            counts[a, b, c] += 50
    return T.Channel(counts)


def test_disguises_reach_the_decoder():
    """Through the gate: what a text with a disguised word shows holds the word itself, with or without a list of wanted features."""
    words = ["idiot", "ass", "hate", "shit", "stupid", "you", "are", "so", "the", "book", "great"]
    channel = trained(words)
    shown = lambda text, wanted=None: set(T.evidence(pa.array([text]), channel, wanted)[0])
    for text, word in (("so idi07", "idiot"), ("a$$", "ass"), ("hat3 you", "hate"), ("5h17", "shit"), ("stuupid!", "stupid"), ("iiddiioott", "idiot"), ("st.upid", "stupid"), ("s t u p i d", "stupid"), ("y o u s t u p i d", "stupid"), ("$tupid", "stupid")):
        assert word in shown(text), text
        assert word in shown(text, T.by_start([word])), text
    assert "stupid" not in shown("the great book, so are you")


def test_wanted_features_are_those_of_all():
    channel = trained(["tall", "till", "tail", "ball", "bold"])
    texts = ["t4l1 b@llll x1y2z3 t.a.l.l", "b 0 l d t1ll", "taill 1234 a1", ""]
    wanted = ["tall", "till", "bal*", "bold", "xly*"]
    for text in texts:
        every = set(T.evidence(pa.array([text]), channel)[0])
        assert set(T.evidence(pa.array([text]), channel, T.by_start(wanted))[0]) == every & set(wanted)


def test_only_words_that_may_tell_are_looked_up(monkeypatch):
    """Before, each distinct word of a batch was taken apart and looked up, whatever its beginning."""
    channel, asked, features = T.Channel(np.zeros((T.BASE,) * 3)), [], T._features
    monkeypatch.setattr(T, "_features", lambda core, wanted: asked.append(core) or features(core, wanted))
    plain = " ".join(f"w{a}{b}{c}x" for a in "bcdefgh" for b in "bcdefgh" for c in "bcdefgh")
    names, f, t = T.evidence(pa.array([plain, None, "", f"{plain} «Clown», «Clown» (c1own"]), channel, T.by_start(["clown", "clo*"]))
    assert set(names) == {"clown", "clo*"} and sorted(zip(t.tolist(), f.tolist())) == [(3, 0), (3, 1)] and len(asked) < 20
    odd = ["", "　x　", "--a!|", "…„ß“—", "~`'", "~(x)!", "¡Ñ!", "|a|", "İ.", "\U0001d400-"]
    assert T._cores(pa.array(odd)).to_pylist() == [T.core_of(w) for w in odd]


def test_a_worker_drops_what_other_operators_kept():
    """Before, the cuts that packing had encoded stayed in the workers beside the next stage's data."""
    from tallyrack.llm import common, tokens

    tokens.encode(pa.array(["some words to keep"]), tokens.tokenizer_path())
    assert common._kept["tokens"]
    list(T._trigrams([pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])]))
    assert not common._kept["tokens"]
    assert tokens.encode(pa.array(["some words to keep"]), tokens.tokenizer_path())[1].tolist() == [4]


def test_texts_are_read_in_small_slices(monkeypatch):
    """Before, 4 MB were read at once, which took a worker more memory than all other stages of the pipeline."""
    read, sizes = T._read, []
    monkeypatch.setattr(T, "_read", lambda texts: sizes.append(sum(len(t or "") for t in texts.to_pylist())) or read(texts))
    texts = pa.array(["some words of a text " * 2000] * 100 + [None, "", "\u00e4b \u3000 x!!"])
    (got,) = T._trigrams([pa.RecordBatch.from_arrays([texts], ["text"])])
    assert max(sizes) <= 1_000_000 and sum(sizes) > 4_000_000
    (one,) = T._trigrams([pa.RecordBatch.from_arrays([texts.slice(99)], ["text"])])
    a, b = (dict(zip(x.column(0).to_pylist(), x.column(1).to_pylist())) for x in (got, one))
    assert {k for k in a} == {k for k in b} and sum(a.values()) == 99 * 2000 * (4 + 5 + 2 + 1 + 4 + 5) + sum(b.values())
