"""Byte pairs against the library, resampling and spelling groups against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import byte_pairs, resampling, spelling

# ---------------------------------------------------------------- byte pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_pairs.coder().ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = [*"ab 'stremvld\n\t !.é1", " ", "　", "the", "ing", " a", "'ll", "   ", "՘", "\U0003d001", "日本", "<|endoftext|>"]


@pytest.mark.parametrize("leaf", [(2, 3), (5, 8), (32, 4_096)])
def test_tree_encodes_like_the_library(library, monkeypatch, leaf):
    monkeypatch.setattr(byte_pairs, "PIECE_LEAF", leaf[0])
    monkeypatch.setattr(byte_pairs, "TEXT_LEAF", leaf[1])
    coder, rng = byte_pairs.coder(), random.Random(3)
    coder.remembered.clear()
    for _ in range(1_500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 90)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()
    coder.remembered.clear()


def test_long_runs(library):
    coder = byte_pairs.coder()
    for text in ("x" * 9_000, " " * 9_000 + "y", "'" * 5_001, "ab" * 4_000 + "é" * 900, "\n" * 70 + "word " * 3_000):
        assert coder.encode(text) == library.encode_ordinary(text)


def test_queue_merges_like_the_plain_loop(monkeypatch):
    coder, rng = byte_pairs.coder(), random.Random(8)
    for _ in range(50):
        ids = [coder.single[rng.choice(b"abetions r")] for _ in range(200)]
        queued = coder.merged(ids[:])
        monkeypatch.setattr(byte_pairs, "QUEUED", 10**9)
        assert queued == coder.merged(ids[:])
        monkeypatch.undo()


def test_all_code_points_are_classed_like_the_library(library):
    coder = byte_pairs.coder()
    for first in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}a1{chr(c)}1 {chr(c)}!" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text) == library.encode_ordinary(text), hex(first)


def test_byte_pair_query_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world's", "x"), (3, "Hello  world's", "x"), (None, "日本", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = byte_pairs.decode_documents(byte_pairs.encode_documents(docs).withColumn("kept", F.col("ids"))).collect()
    assert len(out) == 5
    for row, (d, text, _) in zip(sorted(out, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0]))):
        assert row["doc_id"] == d and bytes(row["decoded"]) == (text or "").encode()
        assert row["kept"] == library.encode_ordinary(text or "")
    assert byte_pairs.encode_documents(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- resampling


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ")


def plain_features(text):
    w = [x for x in plain_words(text) if x]
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    whole_s, whole_t = s.total() + 10_000, t.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t)))
    out = []
    for d, text in docs:
        words, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    ranks = Counter()
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        ranks[tuple(r[:4]), k] += 1
    return Counter(tuple(r[:4]) for r in out), ranks


def corpus(n):
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "the", "of", "é9", "日本", "a", "X1"]) if rng.random() < 0.5 else f"w{rng.randint(0, 300)}"
    sep = lambda: rng.choice([" ", "-", "_", "\n", ". "])
    rows = [(i, "".join(word() + sep() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [(7, rows[7][1])] * 40  # repeated rows
    return rows + [(5000, None), (5001, ""), (5002, "..."), (None, rows[1][1]), (5003, "long word " * 20_000)]


@pytest.mark.parametrize("head", [(16_384, 512), (5, 2), (0, 0)])
def test_resampling(spark, monkeypatch, head):
    rows, target = corpus(400), ["the w1 w2 w3", None, "日本 of the", "w5 w6 " * 30]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, weight int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resampling, "CHUNK", 500)
    monkeypatch.setattr(resampling.head_words, "__defaults__", (head[0],))
    monkeypatch.setattr(resampling.Head.of, "__defaults__", (head[1],))
    got = resampling.resample(docs, aim).collect()
    want, ranks = plain_draw(rows, target)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got if r["rank"]) == ranks


def test_draw_by_ranges_of_scores(spark):
    rng = random.Random(2)
    rows = [(i, 25, 1, 0, rng.randint(0, 30)) for i in range(500)] + [(3, 25, 1, 0, 29)] * 200
    scored = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = [(r["rank"], -r["score"], r["doc_id"]) for r in resampling.drawn(scored, 40, small_rows=0).where("rank IS NOT NULL").collect()]
    want = sorted((-r[4], r[0]) for r in rows)[:280]
    assert sorted(got) == [(k, *w) for k, w in enumerate(want, 1)]


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    aim = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(docs, aim).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert [r["rank"] for r in resampling.resample(few, aim.limit(0)).collect()] == [None, None]


# ---------------------------------------------------------------- spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    links = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, found in links.items():
        top = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(links[w]), counts.get(form[w])))
    return out


def variants(n):
    rng = random.Random(6)
    letters = "abcdeéø"
    words = set()
    while len(words) < n:
        w = "".join(rng.choice("abc") for _ in range(rng.randint(6, 9)))
        for _ in range(rng.randint(1, 5)):
            words.add(w)
            i, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            w = w if len(w) >= 6 else w + "aaaa"
    words |= {"a" * 7, "a" * 8, "a" * 9, "ab" * 4, "ba" * 4, "x" * 900, "x" * 901}
    return {w: rng.choice([2, 3, 20, 30, 200, 300, 3000]) for w in words}


@pytest.mark.parametrize("block", [25_000, 40])
def test_spelling_groups(spark, block):
    counts = variants(500)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling.spelling_groups(words, block=block).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == plain_groups(counts)
    assert len(got) == len(counts)
    links = spelling.near_links(words, block=block).collect()
    assert sorted((r["word"], r["near"]) for r in links) == sorted((a, b) for a in counts for b in counts if near(a, b))


def test_index_steps():
    words = ["banana", "bandana", "anna", "nab"]
    index = spelling.FmIndex(words)
    import numpy as np

    q, w = index.one_error(["banana", "nabb", "zzz", "anna"], np.array([3, 2, 1, 2]))
    assert [(a, words[b]) for a, b in zip(q, w)] == [(0, "bandana"), (1, "nab")]


def plain_vocabulary(rows):
    counts = defaultdict(int)
    for d, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def test_vocabulary(spark):
    rng = random.Random(1)
    base = ["Working", "workings", "Éclairs×÷", "öffnung", "abcdefg", "tiny", "x" * 3_000]
    rows = [(i % 50, rng.choice(" -_7\n").join(rng.choices(base, k=rng.randint(0, 9)))) for i in range(300)]
    rows += [(None, "Working working"), (1, None), (2, ""), (3, rows[0][1])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, word int")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == plain_vocabulary(rows)


def test_spelling_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "word string, n bigint")
    assert spelling.spelling_groups(none).count() == 0
    one = spelling.spelling_groups(spark.createDataFrame([("aaaaaaa", 5)], "word string, n bigint")).collect()
    assert [tuple(r) for r in one] == [("aaaaaaa", None, "aaaaaaa", 5, 0, None)]


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w9") for i in range(9)}
