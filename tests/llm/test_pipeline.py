"""The pipeline stage by stage against plain Python, and the registered queries."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from touchline.llm import exact_dedup, language_id, mixing, near_dedup
from touchline.llm.token_counts import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def shingles(text, size):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).split(" ") if w]
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage, the first with awkward documents added."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10_000, None, "en", "src0", 0), (10_001, "", None, "src0", 0), (10_002, "12 34 !!", "en", None, 8)]
    first = str(tmp_path_factory.mktemp("stage") / "documents")
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(first)
    docs = spark.read.parquet(first)
    out = [[r.asDict() for r in docs.collect()]]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        result = stage(spark, docs, FOLDER)
        if i < 4:
            assert result.columns == docs.columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_language_keeps_what_has_letters(steps):
    before, after = ({r["doc_id"] for r in rows} for rows in steps[:2])
    assert before - after == {10_000, 10_001, 10_002}


def test_exact_copies(steps):
    best = {}
    for r in steps[1]:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(best.values()) == sorted(r["doc_id"] for r in steps[2])


def test_near_copies(steps):
    rows = sorted(steps[2], key=lambda r: r["doc_id"])
    sets = [shingles(r["text"], 5) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [rows[i]["doc_id"] for i in range(len(rows)) if find(i) == i] == sorted(r["doc_id"] for r in steps[3])


def test_mixture(steps):
    size = {r["doc_id"]: len(r["text"].split()) for r in steps[3]}
    per_source = Counter()
    for r in steps[3]:
        per_source[r["source"]] += size[r["doc_id"]]
    times = Counter(r["doc_id"] for r in steps[4])
    assert set(times) <= set(size) and max(times.values()) <= 2
    total = sum(size[d] * n for d, n in times.items())
    assert abs(total - 1.5 * sum(size.values())) <= max(size.values())
    originals = {r["doc_id"]: r for r in steps[3]}
    assert all(r == originals[r["doc_id"]] for r in steps[4])


def test_packed_pieces_give_the_texts_back(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in steps[4]:
        want[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    got, fill = Counter(), defaultdict(int)
    for r in steps[5]:
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == want and max(fill.values()) <= 1024


def test_run_is_the_stages_in_a_row(spark, steps):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"op1_near_dedup", "op6_mixing", "op10_exact_dedup", "op12_resampling", "op13_spelling"} <= set(entry.oracle_sql())


def test_stages_keep_columns_named_like_their_helpers(spark):
    names = ["_gone", "_digest", "_mix_id", "_mix_times", "_mix_round", "_language"]
    rows = [(i, f"word{i % 3} " * 30 + f"end{i % 3}", "en", "s", *[f"{n}{i}" for n in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    net = language_id.train(docs.select("doc_id", "text", "lang"))
    for out in (language_id.keep_identified(docs, net), exact_dedup.drop_copies(docs), near_dedup.drop_near_copies(docs), mixing.mix_documents(docs)):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names)
