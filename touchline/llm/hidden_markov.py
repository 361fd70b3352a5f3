"""A hidden Markov language model over words.

Latent states emit word classes: each of the ``FREQUENT`` most frequent training words is a class of its own, the end
of a text is one, and all other words fall into ``TAIL_CLASSES`` classes by their last letters. Inside a class a word
has its add-one share of the class's training tokens, where all unknown words share one place. So the model is a
distribution over whole texts, its tables for states and classes have a fixed size, and the counts of single words,
which grow with the corpus, stay in a table and are joined.

Training is Baum-Welch: every task runs forward and backward over its texts and emits expected counts, which Spark
adds up per class and per pair of states; the driver only divides fixed-size tables. Scoring is the scaled forward
recursion: the scales' logarithms add up to the exact likelihood of the class sequence.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, held_out, text_or_empty
from touchline.operators.staging import stage

FREQUENT = 32_768
TAIL_CLASSES = 4_096
STATES = 8
ROUNDS = 6
PRIOR = 20.0
SEGMENT = 65_536
BATCH_TOKENS = 800_000
BLOCK_TOKENS = 65_536
TAIL_LETTERS = 3


def words_of(text: str) -> list[bytes]:
    """Words (UTF-8) with A-Z lower-cased, cut at the six blanks of the word rule."""
    return text.encode().lower().split()


# ---------------------------------------------------------------- word counts and classes


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: tokens of each word over the rows of ``docs`` (text), summed per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(words_of(text))
            yield pd.DataFrame({"word": [w.decode() for w in seen], "c": list(seen.values())})

    return docs.select("text").mapInPandas(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Fixed-size part of the vocabulary. Classes: frequent words in order, the end, then the tail classes."""

    frequent: dict[str, int]
    counts: np.ndarray  # training tokens of each class
    types: np.ndarray  # training words of each tail class (1 elsewhere)
    tail_classes: int
    texts: int
    tokens: int  # N, ends included
    words: int  # V, the end included

    @property
    def end(self) -> int:
        return len(self.frequent)

    def tail_class(self, word: str) -> int:
        return self.end + 1 + zlib.crc32(word[-TAIL_LETTERS:].encode()) % self.tail_classes


def learn_vocabulary(counts: DataFrame, texts: int, frequent: int = FREQUENT, tail_classes: int = TAIL_CLASSES) -> Vocabulary:
    """Vocabulary from a stored table of word counts. The driver reads ``frequent`` + ``tail_classes`` rows at most."""
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).collect()
    words = {r["word"]: i for i, r in enumerate(top)}
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    sizes = np.zeros(len(words) + 1 + tail_classes, dtype=np.int64)
    types = np.ones_like(sizes)
    types[len(words) + 1 :] = 0
    sizes[: len(words)] = [r["c"] for r in top]
    sizes[len(words)] = texts
    if top:  # everything after the last frequent word in the same order
        last = top[-1]
        tail = counts.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > F.lit(last["word"]))))
        number = F.crc32(F.encode(F.expr(f"right(word, {TAIL_LETTERS})"), "UTF-8")) % tail_classes
        for r in tail.groupBy(number.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            sizes[len(words) + 1 + r["k"]] = r["n"]
            types[len(words) + 1 + r["k"]] = r["v"]
    return Vocabulary(words, sizes, types, tail_classes, texts, (total["n"] or 0) + texts, total["v"] + (1 if texts else 0))


class _Classes(dict):
    """Class of every word (UTF-8): the frequent ones are held, the others are noted in ``tail`` as they are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w.encode(), k) for w, k in vocabulary.frequent.items())
        self.vocabulary, self.tail = vocabulary, []

    def __missing__(self, word: bytes) -> int:
        self.tail.append(word)
        return self.vocabulary.tail_class(word.decode())


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows with ``classes`` (unsigned 16-bit, the end last), ``n_tokens`` and ``tail`` (its tail words, a space apart)."""
    if len(vocabulary.counts) > 2**16:
        raise ValueError("frequent words and tail classes must number under 65,536")
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size

    @F.pandas_udf("n_tokens bigint, classes binary, tail string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = shared.value
        known = _Classes(v)
        for batch in batches:
            classes, sizes, tails = [], [], []
            for text in batch:
                known.tail = []
                found = array("H", map(known.__getitem__, words_of(text)))
                found.append(v.end)
                classes.append(found.tobytes())
                sizes.append(len(found))
                tails.append(b" ".join(known.tail).decode())
            yield pd.DataFrame({"n_tokens": sizes, "classes": classes, "tail": tails})

    keep = [c for c in rows.columns if c != "text"]
    return rows.select(*keep, encode("text").alias("_e")).select(*keep, "_e.*")


# ---------------------------------------------------------------- the model


@dataclass
class Hmm:
    """Start (K), step (K, K) and emission (classes, K) probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def fresh(vocabulary: Vocabulary, states: int = STATES, seed: int = 1) -> Hmm:
        """States that tend to stay and favour classes at random around the corpus shares."""
        rng = np.random.default_rng(seed)
        share = class_shares(vocabulary)
        emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
        step = np.full((states, states), 0.1 / max(1, states - 1)) + (0.9 - 0.1 / max(1, states - 1)) * np.eye(states)
        return Hmm(np.full(states, 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def class_shares(v: Vocabulary) -> np.ndarray:
    """Smoothed shares of the classes among training tokens; no class has none."""
    return (v.counts + 1) / (v.counts.sum() + len(v.counts))


def batches_of(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Positions of sequences of like length, ``BATCH_TOKENS`` cells at most unless one alone is longer."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        width = max(1, BATCH_TOKENS // max(1, len(sequences[order[at]])))
        yield order[at : at + width]
        at += width


def by_position(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of falling length as one array, position after position without padding.

    Returns the array, how many sequences are still running at each position, and where each position starts in it.
    """
    lengths = np.array([len(s) for s in sequences])
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    starts = np.concatenate([[0], np.cumsum(running)])
    out = np.empty(starts[-1], dtype=np.int64)
    for i, s in enumerate(sequences):
        out[starts[: len(s)] + i] = s
    return out, running, starts


def picked(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The columns ``cells`` of a table of states by something; none is off the table, so none is checked."""
    out = np.empty((len(table), len(cells)), dtype=table.dtype)
    for state, row in enumerate(table):
        np.take(row, cells, out=out[state], mode="clip")
    return out


def forward_logs(hmm: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Log10 likelihood of each sequence by the scaled forward recursion; a block of positions is held at a time."""
    out = np.zeros(len(sequences))
    emit, back = np.ascontiguousarray(hmm.emit.T), np.ascontiguousarray(hmm.step.T)
    for part in batches_of(sequences):
        cells, running, starts = by_position([sequences[i] for i in part])
        logs = np.zeros(len(part))
        alpha = np.repeat(hmm.start[:, None], len(part), axis=1)  # states by texts
        first = 0
        while first < len(running):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_TOKENS, side="right")) - 1)
            base = starts[first]
            own = picked(emit, cells[base : starts[last]])
            scale = np.empty(own.shape[1])
            at = (starts[first : last + 1] - base).tolist()
            for t, lo, hi in zip(range(first, last), at, at[1:]):
                now = back @ alpha[:, : hi - lo] if t else alpha
                now *= own[:, lo:hi]
                total = now.sum(axis=0, out=scale[lo:hi])
                now /= total
                alpha = now
            text = np.arange(own.shape[1]) - np.repeat(starts[first:last] - base, running[first:last])
            logs += np.bincount(text, weights=np.log10(scale), minlength=len(part))
            first = last
        out[part] = logs
    return out


def expected_counts(hmm: Hmm, sequences: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add the expected starts, steps and emissions of the sequences to ``sums``; returns their log10 likelihood.

    Shares of a position are held in single precision, sums in double.
    """
    starts, steps, emits = sums
    single = np.float32
    emit, step = np.ascontiguousarray(hmm.emit.T, dtype=single), hmm.step.astype(single)
    back, start = np.ascontiguousarray(step.T), hmm.start.astype(single)[:, None]
    total = 0.0
    for part in batches_of(sequences):
        cells, running, begins = by_position([sequences[i] for i in part])
        width, at = len(part), begins.tolist()
        seen = picked(emit, cells)  # emissions, later over scale, later times beta
        alpha = np.empty_like(seen)  # states by tokens
        scale = np.empty(len(cells), dtype=single)
        # a text's states side by side: their sum rounds as it always did, and the rounds of training amplify rounding
        first = np.multiply(start, seen[:, :width], order="F")
        np.divide(first, first.sum(axis=0, out=scale[:width]), out=alpha[:, :width])
        for t in range(1, len(running)):
            lo, hi = at[t], at[t + 1]
            now = alpha[:, lo:hi]
            np.matmul(back, alpha[:, at[t - 1] : at[t - 1] + hi - lo], out=now)
            now *= seen[:, lo:hi]
            now /= now.sum(axis=0, out=scale[lo:hi])
        total += float(np.log10(scale).sum(dtype=np.float64))
        seen /= scale
        beta, pairs = np.empty_like(seen), np.zeros_like(steps)
        beta[:, begins[[len(sequences[i]) - 1 for i in part]] + np.arange(width)] = 1  # where a text ends
        for t in range(len(running) - 2, -1, -1):
            lo, hi = at[t + 1], at[t + 2]
            ahead = seen[:, lo:hi]
            ahead *= beta[:, lo:hi]
            here = slice(at[t], at[t] + hi - lo)  # the tokens that another follows
            pairs += alpha[:, here] @ ahead.T
            np.matmul(step, ahead, out=beta[:, here])
        steps += pairs * hmm.step
        alpha *= beta  # now the state shares of the positions
        starts += alpha[:, :width].sum(axis=1)
        for k, shares in enumerate(alpha):
            emits[:, k] += np.bincount(cells, weights=shares, minlength=len(emits))
    return total


def segments(classes: bytes) -> list[np.ndarray]:
    """Class numbers of a text, cut into training sequences of at most ``SEGMENT`` tokens."""
    whole = np.frombuffer(classes, dtype=np.uint16).astype(np.int64)
    return [whole[at : at + SEGMENT] for at in range(0, len(whole), SEGMENT)]


GROUP_TOKENS = 4_000_000


def _expectation(shared):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hmm = shared.value
        states = len(hmm.start)
        sums = (np.zeros(states), np.zeros((states, states)), np.zeros_like(hmm.emit))
        logs, held, size = 0.0, [], 0
        for batch in batches:
            for classes in batch["classes"]:
                held += segments(classes)
                size += len(classes) // 2
                if size >= GROUP_TOKENS:
                    logs += expected_counts(hmm, held, sums)
                    held, size = [], 0
        if held:
            logs += expected_counts(hmm, held, sums)
        seen = np.flatnonzero(sums[2].any(axis=1))
        keys = np.concatenate([seen, -1 - np.arange(states), [-1 - states, -2 - states]])
        rows = np.concatenate([sums[2][seen], sums[1], sums[0][None], np.full((1, states), logs / states)])
        yield pd.DataFrame({"key": keys} | {f"s{k}": rows[:, k] for k in range(states)})

    return task


def train(sequences: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch over all rows of ``sequences`` (classes); returns the model and the log10 likelihood before each round.

    Expected counts are summed by Spark; the driver reads one row of ``states`` numbers per class and state.
    """
    spark = sequences.sparkSession
    hmm, history = Hmm.fresh(vocabulary, states), []
    share = class_shares(vocabulary)
    schema = "key bigint, " + ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(hmm)  # of fixed size
        part = sequences.select("classes").mapInPandas(_expectation(shared), schema)
        rows = part.groupBy("key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect()
        shared.unpersist()
        starts, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros_like(hmm.emit)
        logs = 0.0
        for r in rows:
            key, values = r[0], np.array(r[1:])
            if key >= 0:
                emits[key] = values
            elif key >= -states:
                steps[-1 - key] = values
            elif key == -1 - states:
                starts = values
            else:
                logs = float(values.sum())
        history.append(logs)
        hmm = Hmm(
            (starts + 1) / (starts + 1).sum(),
            (steps + 0.1) / (steps + 0.1).sum(axis=1, keepdims=True),
            (emits + PRIOR * share[:, None]) / (emits.sum(axis=0) + PRIOR),
        )
    return hmm, history


# ---------------------------------------------------------------- scoring


def score_rows(rows: DataFrame, vocabulary: Vocabulary, hmm: Hmm) -> DataFrame:
    """Class likelihood and the parts of both scores that need no word counts, beside the columns of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, hmm))  # of fixed size

    @F.pandas_udf("n_head bigint, head_logs double, class_logs double, class_norms double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v, model = shared.value
        single = np.arange(len(v.counts)) <= v.end
        head = np.where(single, np.log10(v.counts + 1.0), 0.0)
        known = single & (v.counts > 0)
        norms = np.where(single, 0.0, np.log10(v.counts + v.types + 1.0))
        for batch in batches:
            sequences = [np.frombuffer(c, dtype=np.uint16).astype(np.int64) for c in batch]
            yield pd.DataFrame(
                {
                    "n_head": np.array([known[s].sum() for s in sequences], dtype=np.int64),
                    "head_logs": np.array([head[s].sum() for s in sequences], dtype=np.float64),
                    "class_logs": forward_logs(model, sequences),
                    "class_norms": np.array([norms[s].sum() for s in sequences], dtype=np.float64),
                }
            )

    keep = [n for n in rows.columns if n not in ("classes", "tail")]
    return rows.select(*keep, score("classes").alias("_s")).select(*keep, "_s.*")


def score_texts(
    docs: DataFrame,
    is_training: Column,
    states: int = STATES,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
    tail_classes: int = TAIL_CLASSES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: doc_id, training, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``is_training`` (a condition on the column ``doc_id``) holds. ``score`` is
    the model's log10 probability of the text with its end, ``base_score`` the add-one unigram one. One row per input
    row; a null or empty text is its end alone; rows that repeat an id are scored each. Without training rows all
    counts are 0 and every class is equally likely. Other columns are not read; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    learning = plain.where(is_training)
    counts = stage(word_counts(learning))
    vocabulary = learn_vocabulary(counts, learning.count(), frequent, tail_classes)
    numbered = encoded(plain.select("doc_id", is_training.alias("training"), "text"), vocabulary)
    rows = stage(numbered.withColumn("row", F.monotonically_increasing_id()))  # fixed by the written table
    hmm, _ = train(rows.where("training"), vocabulary, states, rounds)
    tail = rows.where("tail <> ''").select("row", F.explode(F.split("tail", " ")).alias("word"))
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(c + 1)).alias("tail_logs"), F.sum((c > 0).cast("int")).alias("n_tail"))
    scored = score_rows(rows, vocabulary, hmm).join(sums, "row", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    unit = math.log10(vocabulary.tokens + vocabulary.words + 1)
    return scored.select(
        "doc_id",
        "training",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_logs") + tail_logs - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("class_logs") + tail_logs - F.col("class_norms")).alias("score"),
    )


def op4_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    hidden = held_out("doc_id", 7, 2)
    scored = score_texts(documents(spark, folder), ~hidden)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
