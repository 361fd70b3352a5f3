"""Token counts, language identification and the hidden Markov model against libraries and plain versions."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hidden_markov, language_id, token_counts
from touchline.llm.common import held_out
from touchline.llm.token_counts import tokenizer_path

ALPHABET = "abcdeéñßüÀİſK'sştre1²½ \n\t\x1c\x1f  漢字😀ǅ́<|endoftext|>_-.,!?"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def odd_texts(n=400):
    rng = random.Random(4)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["<|endoftext|>", "a<|startoftext|>b", "x" * 3000, "don't we'll IT'S", "The quick brown fox. " * 500, "ab" * 700]


def test_counts_equal_the_library(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(odd_texts())] + [(None, None, 2), (7, "", 3), (7, "", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = token_counts.token_counts(df, limit=100).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert sorted((len((t or "").encode()), n, n > 100) for (_, t, _), n in zip(rows, want)) == sorted(
        (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got
    )
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_every_prefix_of_a_word(library):
    c = token_counts.PrefixCounter(tokenizer_path("word_bpe_49k.json"))
    for word in ["internationalization", "thtionsherndwh", "aaaaaaaaaaaaaaaaaaaaaaaaa", "z"]:
        assert c.table(word) == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]


def test_budget_questions_need_no_encoding(spark, library):
    text = "The quick brown-fox jumps;  over\tthe lazy dog. " * 5
    df = spark.createDataFrame([(text,), ("",)], "text string")
    stored = df.select("text", token_counts.prefix_column(F.col("text")).alias("p"))
    for budget in (0, 1, 7, 20, 1000):
        cut = stored.select("text", token_counts.cut_length(F.col("p"), budget).alias("n")).collect()
        for r in cut:
            inside = len(library.encode(r["text"][: r["n"]], add_special_tokens=False).ids)
            assert inside <= budget
            rest = r["text"][r["n"] :].split()
            if rest:
                longer = r["text"][: r["text"].index(rest[0], r["n"]) + len(rest[0])]
                assert len(library.encode(longer, add_special_tokens=False).ids) > budget


def test_prefixes_inside_runs(library):
    c = token_counts.PrefixCounter(tokenizer_path("word_bpe_49k.json"))
    texts = odd_texts(150) + ["漢字仮名交じり文" * 40, "สวัสดีชาวโลก" * 30, "aGVsbG8gd29ybGQ/+=" * 20, "e\u0301e\u0301x" * 9, "it'sn't<|endoftext|>we've"]
    for text in texts[:150] + texts[-5:]:
        ends, counts = c.prefixes(text)
        assert counts == [len(library.encode(text[:e], add_special_tokens=False).ids) for e in ends]
        assert ends == sorted(set(ends))
    assert c.prefixes(texts[-5])[0] == list(range(1, len(texts[-5]) + 1))


def test_cut_of_a_text_without_blanks(spark, library):
    texts = ["漢字仮名交じり文" * 500, "aGVsbG8gd29ybGQ" * 300]
    stored = spark.createDataFrame([(t,) for t in texts], "text string").select("text", token_counts.prefix_column(F.col("text")).alias("p"))
    for budget in (0, 5, 1000):
        for r in stored.select("text", token_counts.cut_length(F.col("p"), budget).alias("n")).collect():
            assert len(library.encode(r["text"][: r["n"]], add_special_tokens=False).ids) <= budget
            assert all(len(library.encode(r["text"][: r["n"] + k], add_special_tokens=False).ids) > budget for k in range(1, 9))


# ---------------------------------------------------------------- language


LANGS = {"aa": "th in er ed ly", "bb": "ción ue ado ll es", "cc": "sch ung ü ein ä"}


def language_rows(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        parts = LANGS[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))
        out.append((i, text, lang if i % 7 else None, "x"))
    return out


@pytest.fixture(scope="module")
def net(spark):
    df = spark.createDataFrame(language_rows(), "doc_id bigint, text string, lang string, score string")
    return language_id.train(df.where(~held_out("doc_id", 5, 0)))


def test_held_out_languages(spark, net):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(df, net).collect()}
    hidden = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [got[i]["lang_pred"] == list(LANGS)[i % 3] for i, *_ in hidden]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_awkward_texts(spark, net):
    long = ("ción " * 200_000, "bb")
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, long[0]), (None, "thed"), (5, "ein"), (5, "ein")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), net).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == long[1]
    kept = language_id.keep_identified(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_n", F.lit(1)), net)
    assert kept.columns == ["doc_id", "text", "_n"] and {r["doc_id"] for r in kept.collect()} <= {4, None, 5}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert language_id.train(df) is None
    assert language_id.identify(df, None).collect()[0]["lang_pred"] == "und"
    assert language_id.identify(df.limit(0), None).count() == 0


def test_no_labels_keep_what_has_letters(spark):
    rows = [(1, "abc", None), (2, None, None), (3, "", None), (4, "12 !!", "en"), (5, "漢", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = language_id.keep_identified(df, language_id.train(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    letters = [chr(0x4E00 + 40 * i) for i in range(80)]  # one script per language

    def text(i):
        return " ".join("".join(chr(ord(letters[i]) + rng.randrange(4)) for _ in range(4)) for _ in range(12))

    rows = [(100 * i + k, text(i), f"l{i:02}") for i in range(80) for k in range(12 if i < 64 else 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language_id.train(df, epochs=30)
    assert net.languages == [f"l{i:02}" for i in range(80)]
    asked = [(i, text(i)) for i in range(64, 80) for _ in range(3)]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), net).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id']:02}" for r in got]) > 0.8


def test_rows_per_language():
    assert language_id.rows_per_language({"a": 10**9, "b": 7}) == 400
    counts = {str(i): 10**6 for i in range(100)}
    assert language_id.rows_per_language(counts) == 256
    assert language_id.rows_per_language(counts | {f"r{i}": 6 for i in range(100)}) == 250
    assert language_id.rows_per_language({str(i): 10**6 for i in range(5000)}) == 50
    assert language_id.rows_per_language(counts, most=20) == 20


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteNet.fresh(["a", "b", "c"])
    x, y = rng.integers(0, 256, (4, 32)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = net.gradients(x, y)[0]
        w[at] = old - 1e-2
        down = net.gradients(x, y)[0]
        w[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.02)


def test_tables_equal_the_network():
    net = language_id.ByteNet.fresh(["a", "b"])
    x = np.random.default_rng(3).integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    _, _, features = net._forward(x)
    z = features @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probs(x, net.tables()), want, atol=1e-4)


# ---------------------------------------------------------------- hidden Markov model


def small_hmm(states=3, classes=4):
    rng = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hidden_markov.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(hmm, seq):
    for p in product(range(len(hmm.start)), repeat=len(seq)):
        w = hmm.start[p[0]] * hmm.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            w *= hmm.step[p[t - 1], p[t]] * hmm.emit[seq[t], p[t]]
        yield p, w


def test_forward_and_counts_by_enumeration():
    hmm = small_hmm()
    seqs = [np.array(s) for s in ([0, 1, 2, 3], [3], [1, 1], [2, 0, 0, 1, 3], [0, 3])]
    want = [math.log10(sum(w for _, w in paths(hmm, s))) for s in seqs]
    assert np.allclose(hidden_markov.forward_logs(hmm, seqs), want)
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    total = hidden_markov.expected_counts(hmm, seqs, (starts, steps, emits))
    assert total == pytest.approx(sum(want))
    w_starts, w_steps, w_emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in seqs:
        mass = sum(w for _, w in paths(hmm, s))
        for p, w in paths(hmm, s):
            w_starts[p[0]] += w / mass
            for t, state in enumerate(p):
                w_emits[s[t], state] += w / mass
                if t:
                    w_steps[p[t - 1], state] += w / mass
    assert np.allclose(starts, w_starts) and np.allclose(steps, w_steps) and np.allclose(emits, w_emits)


LM_ROWS = [(i, " ".join(f"{'ab'[i % 2]}{(i * k) % 11}" for k in range(1, 3 + i % 20)).upper(), "n") for i in range(120)]
LM_ROWS += [(500, None, "n"), (501, "", "n"), (502, "never\x0bseen words\tA1", "n"), (9, "a1 a1", "n"), (9, "a1 a1", "n"), (None, "b2", "n")]


def lm_frame(spark, rows=LM_ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_base_score(spark):
    hidden = held_out("doc_id", 7, 2)
    got = hidden_markov.score_texts(lm_frame(spark), ~hidden, frequent=8, tail_classes=16, rounds=2).collect()
    train = [t or "" for i, t, _ in LM_ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t.lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = []
    for i, t, _ in LM_ROWS:
        words = (t or "").lower().split()
        cs = [counts[w] for w in words] + [len(train)]
        want.append((i if i is not None else -1, len(cs), sum(c > 0 for c in cs), round(sum(math.log10((c + 1) / (n + v + 1)) for c in cs), 6)))
    assert sorted(want) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 for r in got)


def test_model_is_a_distribution(spark):
    """Over all texts of up to two words, unknown ones standing for one word per class, the mass stays below one."""
    counts = spark.createDataFrame([("aa", 5), ("ab", 3), ("b", 2)], "word string, c bigint")
    v = hidden_markov.learn_vocabulary(counts, 4, frequent=1, tail_classes=2)
    hmm = hidden_markov.Hmm.fresh(v, 2)
    assert np.allclose(hmm.emit.sum(axis=0), 1) and np.allclose(hmm.step.sum(axis=1), 1)
    assert v.tokens == 14 and v.words == 4 and v.counts.sum() == 14
    tails = v.counts[v.end + 1 :]
    assert tails.sum() == 5 and v.types[v.end + 1 :].sum() == 2


def test_training_climbs(spark):
    rows = hidden_markov.encoded(lm_frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), v := hidden_markov.learn_vocabulary(
        hidden_markov.word_counts(lm_frame(spark).where("text is not null")), 120, 8, 16))
    _, history = hidden_markov.train(rows, v, 3, 5)
    assert all(b >= a - 1 for a, b in zip(history, history[1:])) and history[-1] > history[0]


def test_no_training_rows_and_no_rows(spark):
    df = lm_frame(spark, LM_ROWS[:5])
    got = hidden_markov.score_texts(df, F.lit(False), frequent=4, tail_classes=4, rounds=1).collect()
    assert len(got) == 5 and all(r["base_score"] == 0 and r["n_known"] == 0 for r in got)
    assert hidden_markov.score_texts(df.limit(0), F.lit(True), frequent=4, tail_classes=4, rounds=1).count() == 0


def test_long_text_trains_in_segments():
    whole = np.arange(200_000) % 5
    parts = hidden_markov.segments(whole.astype(np.uint16).tobytes())
    assert len(parts) == 4 and np.array_equal(np.concatenate(parts), whole)


def test_recursions_hold_no_padding_and_any_block_size(monkeypatch):
    hmm, rng = small_hmm(), np.random.default_rng(8)
    seqs = [rng.integers(0, 4, n) for n in (1, 40, 3, 3, 17, 1, 200)]
    cells, running, starts = hidden_markov.by_position(sorted(seqs, key=len, reverse=True))
    assert len(cells) == starts[-1] == sum(map(len, seqs)) and running.tolist()[:4] == [7, 5, 5, 3]

    def run():
        sums = (np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)))
        return hidden_markov.forward_logs(hmm, seqs), hidden_markov.expected_counts(hmm, seqs, sums), *sums

    whole = run()
    assert whole[0].sum() == pytest.approx(whole[1], rel=1e-5)
    assert whole[3].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-5)
    for name, size in (("BATCH_TOKENS", 50), ("BLOCK_TOKENS", 7)):
        monkeypatch.setattr(hidden_markov, name, size)
        for a, b in zip(run(), whole):
            np.testing.assert_allclose(a, b, rtol=1e-5)
