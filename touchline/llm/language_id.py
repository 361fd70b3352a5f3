"""Language identification by a byte convolutional network.

Bytes (A-Z folded) are embedded, filters of several widths run over them, each filter's largest response in a
fixed-length window feeds a softmax over the languages. A text is the byte-weighted mean of its windows' log
probabilities; all windows of the whole text count. The network is trained in numpy on windows of a bounded sample
of labelled rows, chosen by checksum, so a rerun trains on the same rows. Every language that labels a text with a
letter is learned: ``PER_LANGUAGE`` rows of each, fewer of the frequent ones once that passes ``SAMPLE_ROWS`` in all.

For scoring, embedding and filters are folded into tables of the response to each byte pair and byte, so a window
costs a few row lookups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, free_name, held_out, text_or_empty, utf8

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
PER_LANGUAGE = 400
SAMPLE_ROWS = 25_600
LEAST_PER_LANGUAGE = 50
CROPS = 3
SPARE = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
LETTER = r"\p{L}"

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def as_windows(data: bytes) -> np.ndarray:
    """Folded bytes in rows of ``WINDOW``, the last one filled with zeros; no row for an empty text."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data.translate(FOLD), dtype=np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class ByteNet:
    """Weights: ``embed`` (256, depth), per width a filter bank (width, depth, filters) and its bias, the softmax layer."""

    languages: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        norm = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        return ByteNet(
            languages,
            0.5 * norm(256, DEPTH),
            [norm(w, DEPTH, FILTERS) / np.float32(np.sqrt(w * DEPTH)) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            0.1 * norm(len(WIDTHS) * FILTERS, len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.out, self.out_bias]

    # ------------------------------------------------------------ training

    def _forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        e = self.embed[x]
        spots, tops = [], []
        for bank, bias in zip(self.banks, self.biases):
            w = len(bank)
            n = x.shape[1] - w + 1
            response = sum(e[:, k : k + n] @ bank[k] for k in range(w)) + bias
            spot = response.argmax(axis=1)
            spots.append(spot)
            tops.append(np.take_along_axis(response, spot[:, None, :], axis=1)[:, 0])
        features = np.maximum(np.concatenate(tops, axis=1), 0)
        return spots, tops, features

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of a batch and its gradients, in the order of ``weights``."""
        spots, tops, features = self._forward(x)
        z = features @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(y))
        loss = float(-np.log(p[rows, y] + 1e-12).mean())
        p[rows, y] -= 1
        p /= len(y)
        d_features = (p @ self.out.T) * (features > 0)
        d_embed = np.zeros_like(self.embed)
        d_banks, d_biases = [], []
        for i, (bank, spot) in enumerate(zip(self.banks, spots)):
            d = d_features[:, i * FILTERS : (i + 1) * FILTERS]
            d_bank = np.zeros_like(bank)
            for k in range(len(bank)):
                hit = x[rows[:, None], spot + k]
                d_bank[k] = np.einsum("bf,bfd->df", d, self.embed[hit])
                np.add.at(d_embed, hit, d[:, :, None] * bank[k].T[None])
            d_banks.append(d_bank)
            d_biases.append(d.sum(axis=0))
        return loss, [d_embed, *d_banks, *d_biases, features.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, mean = 0, 0.0
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(y))
            rate = RATE * (1 - epoch / epochs)
            for at in range(0, len(y), BATCH):
                part = order[at : at + BATCH]
                loss, grads = self.gradients(x[part], y[part])
                losses.append(loss)
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    # ------------------------------------------------------------ scoring

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to a byte pair at the filters' start, to the third byte of width 3 and the last pair of width 4."""
        taps = [[self.embed @ bank[k] for k in range(len(bank))] for bank in self.banks]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        starts = np.concatenate([pair(t[0], t[1]) + bias for t, bias in zip(taps, self.biases)], axis=1)
        return starts, taps[1][2], pair(taps[2][2], taps[2][3])

    def log_probs(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int = 64) -> np.ndarray:
        starts, third, last = tables
        out = np.empty((len(x), len(self.languages)))
        n = WINDOW
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            response = starts[pairs]
            two = response[:, :, :FILTERS].max(axis=1)
            three = (response[:, : n - 2, FILTERS : 2 * FILTERS] + third[part[:, 2:]]).max(axis=1)
            four = (response[:, : n - 3, 2 * FILTERS :] + last[pairs[:, 2:]]).max(axis=1)
            z = np.maximum(np.concatenate([two, three, four], axis=1), 0) @ self.out + self.out_bias
            z = z - z.max(axis=1, keepdims=True)
            out[at : at + rows] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def training_rows(docs: DataFrame, counts: dict[str, int], per_language: int = PER_LANGUAGE, crops: int = CROPS) -> DataFrame:
    """Crops of the sample: lang and data (at most ``WINDOW`` bytes). ``docs`` has doc_id, text, lang.

    Per language of ``counts`` (its rows), the ``per_language`` rows of smallest checksum; of each its start, its end
    and places between. A first cut by checksum leaves about ``SPARE`` times as many, so what meets in a task does not
    grow with the input.
    """
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SPARE * per_language / n))])
    turn = F.xxhash64("doc_id", "text")
    drawn = turn.cast("double") / 2.0**64 + 0.5 < share[F.col("lang")]
    named = docs.where(F.col("lang").isin(list(counts)) & F.col("text").rlike(LETTER)).where(drawn)
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(crops - 1)), lambda i: (F.col("room") * i / max(1, crops - 1)).cast("int"))
    cut = named.select("lang", "doc_id", turn.alias("turn"), utf8(F.col("text")).alias("data"), room.alias("room"))
    parts = cut.select("lang", "doc_id", "turn", F.transform(starts, lambda s: F.substring("data", s + 1, F.lit(WINDOW))).alias("parts"))
    order = Window.partitionBy("lang").orderBy("turn", "doc_id")  # whole texts stay where they are: only crops are shuffled
    chosen = parts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    return chosen.select("lang", F.explode("parts").alias("data"))


def rows_per_language(counts: dict[str, int], most: int = PER_LANGUAGE, total: int = SAMPLE_ROWS, least: int = LEAST_PER_LANGUAGE) -> int:
    """The largest bound up to ``most`` that takes ``total`` rows at most; never below ``least`` (or ``most``, if smaller).

    A language of fewer rows is taken whole, and what it leaves goes to the others.
    """
    left = total
    for done, n in enumerate(sorted(counts.values())):
        bound = left // (len(counts) - done)
        if n >= bound:
            return min(most, max(least, bound))
        left -= n
    return most


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> ByteNet | None:
    """Network for the languages of the labelled rows (doc_id, text, lang); None when there are none.

    Every language with a lettered row is learned. The driver reads one count per language and at most ``per_language``
    rows of each; ``rows_per_language`` bounds their total.
    """
    counted = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in counted.collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rows = training_rows(docs, counts, rows_per_language(counts, per_language)).collect()
    rows = sorted(((r["lang"], bytes(r["data"])) for r in rows if r["data"]))
    crops = [(lang, data) for lang, data in rows]
    rng = np.random.default_rng(3)
    for lang, data in rows:  # short texts occur too
        size = int(rng.integers(8, WINDOW))
        at = int(rng.integers(0, max(1, len(data) - size)))
        crops.append((lang, data[at : at + size]))
    x = np.concatenate([as_windows(data)[:1] for _, data in crops])
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.array([place[lang] for lang, _ in crops])
    net = ByteNet.fresh(languages)
    net.fit(x, y, epochs)
    return net


def answers(net: ByteNet, texts: list[str], tables=None) -> tuple[list[str], list[float]]:
    """Language and probability of each non-empty text, all windows of it weighed by their bytes."""
    tables = tables or net.tables()
    data = [t.encode() for t in texts]
    windows = [as_windows(d) for d in data]
    counts = np.array([len(w) for w in windows])
    if not counts.sum():
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    logs = net.log_probs(np.concatenate(windows), tables)
    owner = np.repeat(np.arange(len(texts)), counts)
    weight = np.full(len(owner), float(WINDOW))
    ends = np.cumsum(counts) - 1
    for i, d in enumerate(data):
        if counts[i]:
            weight[ends[i]] = len(d) - (counts[i] - 1) * WINDOW
    sums = np.stack([np.bincount(owner, weights=logs[:, k] * weight, minlength=len(texts)) for k in range(logs.shape[1])], axis=1)
    mean = sums / np.maximum(np.bincount(owner, weights=weight, minlength=len(texts)), 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    langs = [net.languages[b] if n else UNKNOWN for b, n in zip(best, counts)]
    return langs, [float(p[i, b]) if counts[i] else 0.0 for i, b in enumerate(best)]


BATCH_BYTES = 1 << 20


def predict_column(text: Column, net: ByteNet) -> Column:
    """Struct of lang_pred and score for a text column. Null texts and texts without a letter are ``und`` with 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = net.tables()
        most = BATCH_BYTES * 64 // max(64, len(net.languages))  # a window holds one number per language
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            part: list[str] = []
            size = 0
            for t in batch:
                part.append(t or "")
                size += max(WINDOW, len(part[-1]))
                if size > most:
                    a, b = answers(net, part, tables)
                    langs, scores, part, size = langs + a, scores + b, [], 0
            if part:
                a, b = answers(net, part, tables)
                langs, scores = langs + a, scores + b
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    lettered = F.when(text.rlike(LETTER), text).otherwise(F.lit(""))
    return predicted(lettered)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row. Without a network every answer is ``und`` with score 0.

    One row per input row: equal texts get equal answers; null, empty and letterless texts are ``und``. Other columns
    are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.select("doc_id", predict_column(F.col("text"), net).alias("p")).select("doc_id", "p.*")


def keep_identified(docs: DataFrame, net: ByteNet | None, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """Rows whose language is known with at least ``least_score``, with all their columns.

    Without a network (no labelled row to learn from) no language can be told: the rows whose text has a letter stay.
    """
    if net is None:
        return docs.where(F.col(text_col).rlike(LETTER))
    name = free_name(docs, "_language")
    marked = docs.withColumn(name, predict_column(F.col(text_col), net))
    return marked.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    hidden = held_out("doc_id", 5, 0)
    net = train(docs.where(~hidden).select("doc_id", "text", "lang"))
    return identify(docs, net).select("doc_id", hidden.alias("held_out"), "lang_pred", "score")
