"""The encoders beside their libraries, and what is handed to Python at a time."""

import random

import numpy as np
import pandas as pd
import pytest

from touchline.llm import byte_pairs, near_dedup, packing
from touchline.operators.staging import arrow_rows, stage

PARTS = ["a", "b", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "\x1c", "\xa0", "\x85"]
PARTS += ["Ġ", "Ċ", "　x", " the", "ing", "\r\n", "x" * 70, "\U0001f600", "ª", " word's", ". ", ".\nThe "]


def by_library(encoder, text):
    return np.array(encoder.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_batches_encode_like_the_library(monkeypatch):
    encoder, rng = packing.RunEncoder(packing.tokenizer_path(packing.TOKENIZER)), random.Random(1)
    for remembered in (24 << 20, 2_000, 0):  # whole batches, some of their words and nothing stays remembered
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        for _ in range(80):
            texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
            assert encoder.batch(texts) == [by_library(encoder, t) for t in texts]
            even = [" ".join(rng.choice(["the", "of.", "it's", "a1", "né,", "x\nY", "ab" * 40, "$5"]) for _ in range(9)) for _ in range(5)]
            assert encoder.batch(even) == [by_library(encoder, t) for t in even]
        assert encoder.words.nbytes <= max(remembered, 16)


def test_new_words_of_a_batch_go_to_the_library_together():
    encoder = packing.RunEncoder(packing.tokenizer_path(packing.TOKENIZER))
    texts = [" ".join(["First", *(chr(97 + i) + chr(97 + j) + "zq" for j in range(26))]) for i in range(26)]
    expected, calls = [by_library(encoder, t) for t in texts], []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return self.inner.encode_batch_fast(texts, **options)

    encoder.library, encoder.model = Counted(encoder.library), Counted(encoder.model)
    assert encoder.batch(texts) == expected
    assert len(calls) <= 2  # the texts' first word, and 676 new words
    assert encoder.batch(texts) == expected and len(calls) <= 2


def test_texts_together_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 3)
    monkeypatch.setattr(packing, "CHARACTERS", 10)
    groups = list(packing.together(["aaaa"] * 5 + ["b" * 20] + [""] * 4))
    assert groups == [["aaaa"] * 3, ["aaaa"] * 2 + ["b" * 20], [""] * 3, [""]]


# ---------------------------------------------------------------- byte pairs


def test_byte_pair_ids_are_joined_a_piece_at_a_time():
    import public_tokenizers
    import tiktoken

    coder, rng = byte_pairs.coder(), random.Random(4)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    coder.remembered.clear()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "x" * 900, "zqvy" * 7]
    for ids, text in zip(coder.encode_batch(texts), texts, strict=True):
        assert ids.dtype == np.int32 and ids.tolist() == library.encode_ordinary(text)
    assert {type(ids) for ids in coder.remembered.values()} == {bytes}  # no object per id is kept or gone through
    coder.remembered.clear()


# ---------------------------------------------------------------- rows handed to Python


def test_arrow_rows_bound_batches_and_are_taken_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    with pytest.raises(ZeroDivisionError), arrow_rows(spark, 7):
        assert stage(spark.range(0, 40, 1, 1).mapInPandas(sizes, "n bigint")).agg({"n": "max"}).first()[0] == 7
        1 / 0
    assert spark.conf.get(name) == before


def test_near_dedup_and_packing_hand_few_texts_to_python(spark, monkeypatch):
    seen = []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for module in (near_dedup, packing):
        monkeypatch.setattr(module, "stage", lambda df: seen.append(int(spark.conf.get(name))) or stage(df))
        monkeypatch.setattr(module, "ROWS", 5)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(12)], "doc_id bigint, text string")
    assert near_dedup.near_groups(docs).where("kept").count() == 6
    assert seen[0] == 5
    seen.clear()
    assert packing.pack_documents(docs).count() >= 12 and seen == [5]
