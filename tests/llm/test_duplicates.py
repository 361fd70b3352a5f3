"""Exact and near duplicates against plain Python versions, and the awkward rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, near_dedup
from touchline.llm.components import components

DOCS = "doc_id bigint, text string, digest string, keep_id string, node string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


# ---------------------------------------------------------------- binary fuse filters


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 60_000])
def test_filter_holds_its_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**60, n, dtype=np.int64)
    seed, segment, count, table = exact_dedup.build_fuse(keys)
    assert exact_dedup.fuse_holds(keys, seed, segment, count, table).all()
    foreign = rng.integers(0, 2**60, 20_000, dtype=np.int64)
    assert exact_dedup.fuse_holds(foreign, seed, segment, count, table).mean() < 0.01
    assert n < 1000 or len(table) < 1.4 * n + 3 * segment


# ---------------------------------------------------------------- exact


def exact_rows():
    rng = random.Random(3)
    texts = ["a", "A", "a ", "b\n", "é", "é", "x" * 50_000]
    rows = [(i, rng.choice(texts)) for i in range(0, 120)] + [(i, f"own {i}") for i in range(200, 260)]
    rows += [(i, "hot") for i in range(300, 500)]
    return rows + [(600, None), (601, ""), (None, "a"), (None, "lone"), (None, "lone"), (7, "twice"), (7, "twice")]


def test_exact_groups(spark):
    rows = exact_rows()
    got = exact_dedup.exact_groups(frame(spark, rows), rows_per_slot=50).collect()
    ids, sizes = {}, defaultdict(int)
    for i, t in rows:
        t = t or ""
        sizes[t] += 1
        ids[t] = max((x for x in (ids.get(t), i) if x is not None), default=None)
    want = []
    for i, t in rows:
        t = t or ""
        want.append((str(i), str(ids[t]), sizes[t], i == ids[t], hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(want) == sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got)


def test_exact_of_nothing_and_columns(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    df = frame(spark, exact_rows())
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len({t or "" for _, t in kept}) == len({t or "" for _, t in exact_rows()})
    assert sum(t == "hot" for _, t in kept) == 1 and (499, "hot") in kept


def test_a_digest_that_lies_is_caught(spark):
    """Two rows of one digest and different bytes stay apart when they come from snapshot and batch."""
    old = spark.createDataFrame([(1, "d" * 64), (2, "e" * 64)], "doc_id bigint, digest string")
    new = spark.createDataFrame([(3, "d" * 64), (4, "e" * 64)], "doc_id bigint, digest string")
    docs = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p"), (4, "other")], "doc_id bigint, text string")
    real = old.unionByName(new).select("doc_id", F.rpad(F.sha2("digest", 256), 64, "0").alias("digest"))
    snapshot = exact_dedup.take_snapshot(real.where("doc_id < 3"), 2)
    got = {r["keep_id"]: r["group_size"] for r in exact_dedup.merge_batch(real.where("doc_id > 2"), snapshot, docs).collect()}
    assert got == {3: 2}


def test_an_id_with_several_texts(spark):
    rows = [(i, t) for i in range(40) for t in ("A", "B")] + [(100 + i, f"own {i}") for i in range(10)] + [(i, f"C{i // 2}") for i in range(40)]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    sizes = {hashlib.sha256(t.encode()).hexdigest(): (n, top) for t, n, top in [("A", 40, 39), ("B", 40, 39)] + [(f"C{k}", 2, 2 * k + 1) for k in range(20)]}
    assert len(got) == len(rows)
    for r in got:
        n, top = sizes.get(r["text_sha256"], (1, r["doc_id"]))
        assert (r["group_size"], r["keep_id"], r["kept"]) == (n, top, r["doc_id"] == top)


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    edges += [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- near


def plain_shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size):
    sets = [plain_shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b:
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [f"p{k}" for k in range(60)]
    rows, n = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for copy in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 9)):
                text[rng.randrange(len(text))] = word()
            rows.append((n, (" " if copy % 2 else "\n").join(text)))
            n += 1
    chain = [f"c{k}" for k in range(100)]
    for k in range(0, 60, 4):  # neighbours are near, ends are far
        rows.append((n, " ".join(chain[k : k + 40])))
        n += 1
    for _ in range(40):  # a passage that many share
        rows.append((n, " ".join(passage + [word() for _ in range(rng.randint(5, 60))])))
        n += 1
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "One\x0bTWO"), (5007, " x")]
    rows += [(5008, "É a b"), (5009, "é a b"), (5010, "word " * 30_000), (5011, "word word")]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(spark, size):
    rows = near_rows()
    got = near_dedup.near_groups(frame(spark, rows), size=size).collect()
    want = brute(rows, size)
    assert sorted((d, n, c) for d, n, c in want) == sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_lists_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = near_rows()
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert sorted(brute(rows, 2)) == sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def test_chance_coordinates_are_not_posted(spark):
    """Texts that agree with others in many single coordinates, each with another one, have no lists; partners meet."""
    rng = np.random.default_rng(4)
    signs = rng.integers(0, 200, (202, near_dedup.COORDINATES), dtype=np.uint32)
    signs[200:] = rng.integers(1000, 2**32, (2, near_dedup.COORDINATES), dtype=np.uint32)
    signs[201, 1::2] = signs[200, 1::2]
    signs[201, : 2 * (near_dedup.MATCHES - near_dedup.COORDINATES // 2)] = signs[200, : 2 * (near_dedup.MATCHES - near_dedup.COORDINATES // 2)]
    assert (signs[200] == signs[201]).sum() == near_dedup.MATCHES  # and the 40 others in a token of their own each
    assert np.mean([sum((signs[:, c] == v).sum() > 1 for c, v in enumerate(row)) >= near_dedup.MATCHES for row in signs]) > 0.5
    reps = spark.createDataFrame([(i, bytearray(row.tobytes())) for i, row in enumerate(signs)], "node bigint, signature binary")
    posted = {r["node"]: set(r["prefix"]) for r in near_dedup.prefixes(reps).collect()}
    assert set(posted) == {200, 201} and posted[200] & posted[201]
    assert near_dedup.needed(near_dedup.MATCHES) == (2, 8) and near_dedup.needed(48) == (1, 48)
    single = {r["node"]: set(r["prefix"]) for r in near_dedup.prefixes(reps, 48).collect()}
    assert single[200] & single[201] and len(single) > 100


def test_lists_are_merged_as_by_hand(monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(6)
    bases, rows = rng.integers(0, 256, (2, near_dedup.SKETCH), dtype=np.uint8), []
    for token in range(12):
        for low, high in [(0, 0)] if token % 3 else [(0, 0), (0, 1), (1, 1)]:
            for node in sorted(rng.choice(60, rng.integers(2, 16), replace=False).tolist()):
                sketch = bases[node % 2].copy()
                sketch[: 4 * (node // 6)] = node
                own = [token] if node % 5 > 1 else [token - 1, token]
                rows.append((token, low, high, int(low != high and node % 4 > 1), node, node // 3, sketch.tobytes(), own))
    columns = ["token", "low", "high", "side", "node", "component", "sketch", "prefix"]
    want = set()
    for a in rows:
        for b in rows:
            if a[:3] == b[:3] and a[4] < b[4] and a[5] != b[5] and (a[1] == a[2] or a[3] != b[3]):
                same = np.frombuffer(a[6], np.uint8) == np.frombuffer(b[6], np.uint8)
                if near_dedup.retained(same[None], 56, 172)[0] and a[0] == min(set(a[7]) & set(b[7])) and same[: near_dedup.FIRST].sum() >= near_dedup.FIRST_LEAST:
                    want.add((*a[:3], a[4], b[4]))
    table = pd.DataFrame(rows, columns=columns)
    got = []
    for found in near_dedup._candidates(56, 172)(table.iloc[i : i + 4] for i in range(0, len(table), 4)):
        for token, low, high, node, partners in found.itertuples(index=False):
            got += [(token, low, high, min(node, m), max(node, m)) for m in partners]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_shingles_of_texts_together(monkeypatch):
    """Sets are those of each text alone: long words, odd blanks, bytes of zero, letters beyond ASCII and short texts."""
    texts = ["", " \t\n", "one", "One\x0btwo", "a" * 8, "a" * 9, "a" * 17 + " b", "b" * 17 + " a", "a\0 a", "a a\0", "É é e", "A a A a A", "x " * 500, "one two three"]
    for size in (1, 2, 5):
        alone = [next(near_dedup.shingle_sets([t], size)) for t in texts]
        monkeypatch.setattr(near_dedup, "TEXT_BYTES", 10)
        for got in (list(near_dedup.shingle_sets(texts, size)), list(near_dedup._sets_together([t.encode() for t in texts], size))):
            assert len(got) == len(texts) and all(np.array_equal(x, y) for x, y in zip(alone, got))
        assert [len(x) for x in alone] == [len(plain_shingles(t, size)) for t in texts]
        keys = {x.tobytes() for x in alone if len(x)}
        assert len(keys) == len({frozenset(plain_shingles(t, size)) for t in texts} - {frozenset()})


def test_near_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "A B C D E"), (None, "alone here"), (None, None)]
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted(
        [("None", "4"), ("4", "4"), ("4", "4"), ("9", "4"), ("None", "None"), ("None", "None")]
    )
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    df = frame(spark, rows)
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["None", "4", "None", "None"])  # one of the two equal rows


def test_near_links_of_an_id_with_several_texts(spark, monkeypatch):
    """Blocks confirm the links of both texts, as the hub rounds do."""
    monkeypatch.setattr(near_dedup, "STARS", 0)
    one, two = ([f"{c}{k}" for k in range(60)] for c in "pq")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one[:-1] + ["x"])), (3, " ".join(two[:-1] + ["y"])), (4, "far away from all")]
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_signature_chunks_agree(monkeypatch):
    shingles = np.random.default_rng(1).integers(0, 2**63, 5_000, dtype=np.uint64)
    whole = near_dedup.signature(shingles)
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    assert np.array_equal(whole, near_dedup.signature(shingles))


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_dedup.drop_near_copies])
def test_equal_rows_become_one(spark, stage):
    rows = [(7, "a b c d e f", f"x{i % 2}", {"k": i}) for i in range(6)] + [(None, "no id here", "y", None)] * 3 + [(8, None, "z", None)] * 2 + [(9, "on its own", "u", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _who string, _row map<string,int>")
    out = stage(df)
    assert out.schema == df.schema
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == [("7", "a b c d e f"), ("8", ""), ("9", "on its own"), ("None", "no id here")]
    assert {r["doc_id"]: r["_who"] for r in got} == {r["doc_id"]: r["_who"] for r in stage(df.repartition(3)).collect()}
    same_id = spark.createDataFrame([(5, "one text of five words"), (5, "another text with other words")], "doc_id bigint, text string")
    assert stage(same_id).count() == 2
