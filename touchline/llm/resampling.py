"""Importance resampling towards a target distribution over hashed word runs.

Every run of one to three words falls into a bucket by the checksum of its bytes. The gain of a bucket is the log ratio
of its share in the target texts to its share in the corpus, and a document's weight is the sum of its runs' gains.
A draw without replacement adds Gumbel noise from the document's id and takes the highest scores.

The vocabulary has a head and a tail. The head is broadcast: the checksum states of the most frequent words, and of all
pairs of the few most frequent ones, so that a frequent word or pair costs one look into a table. Everything else takes
the checksum directly; a longer run continues the state of its beginning. Totals are exact: words from the counted
vocabulary, head pairs from counts per pair, the rest bucket by bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import LOWER, UPPER, documents, text_or_empty, utf8
from touchline.operators.ordered import Order, Step
from touchline.operators.staging import stage

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Words whose states are broadcast, and those of them whose pairs are: at most 2 MB and 2 MB.
HEAD, PAIR_HEAD = 16_384, 512
#: Words that are looked at together in a task.
CHUNK = 200_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Head:
    """Frequent words with their numbers and checksum states, and the states of the most frequent ones' pairs."""

    number: dict[bytes, int]
    states: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(words: list[str], pair_words: int = PAIR_HEAD) -> Head:
        raw = [w.encode() for w in words]
        states = np.array([zlib.crc32(w) for w in raw], dtype=np.int64)
        spaced = [b" " + w for w in raw[:pair_words]]
        pairs = np.array([[zlib.crc32(b, a) for b in spaced] for a in states[:pair_words].tolist()], dtype=np.int64)
        return Head({w: i for i, w in enumerate(raw)}, states, pairs.reshape(len(spaced), len(spaced)))


@dataclass
class Runs:
    """The runs of a chunk of texts. Positions are word positions in the chunk."""

    text: np.ndarray  # the text of each word
    ones: np.ndarray  # states of the words
    two_at: np.ndarray  # first words of pairs
    twos: np.ndarray
    head_pair: np.ndarray  # of each pair: its number in the pair table, or -1
    three_at: np.ndarray
    threes: np.ndarray


def word_runs(found: list[list[bytes]], head: Head) -> Runs:
    """Checksum states of all runs of one to three words inside each text's words."""
    words = [w for text in found for w in text]
    text = np.repeat(np.arange(len(found)), [len(t) for t in found])
    number = np.fromiter(map(head.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    ones = head.states[number] if len(head.states) else np.zeros(len(words), dtype=np.int64)
    tail = np.flatnonzero(number < 0)
    ones[tail] = [zlib.crc32(words[i]) for i in tail.tolist()]
    spaced = [b" " + w for w in words]
    two_at = np.flatnonzero(text[:-1] == text[1:])
    a, b = number[two_at], number[two_at + 1]
    size = len(head.pairs)
    known = (a >= 0) & (a < size) & (b >= 0) & (b < size)
    head_pair = np.where(known, a * size + b, -1)
    twos = np.zeros(len(two_at), dtype=np.int64)
    twos[known] = head.pairs.ravel()[head_pair[known]]
    unseen = two_at[~known]
    twos[~known] = list(map(zlib.crc32, [spaced[i + 1] for i in unseen.tolist()], ones[unseen].tolist()))
    goes_on = text[np.minimum(two_at + 2, len(text) - 1)] == text[two_at]
    goes_on &= two_at + 2 < len(text)
    three_at = two_at[goes_on]
    threes = np.fromiter(
        map(zlib.crc32, [spaced[i + 2] for i in three_at.tolist()], twos[goes_on].tolist()), dtype=np.int64, count=len(three_at)
    )
    return Runs(text, ones, two_at, twos, head_pair, three_at, threes)


def _chunks(texts: Iterable[str]) -> Iterator[list[list[bytes]]]:
    """Words of texts, some ``CHUNK`` words at a time; a text is never cut."""
    held, size = [], 0
    for t in texts:
        held.append(WORD_BYTES.findall(t.encode().lower()))
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """All distinct words of a table of texts with their counts: word, n."""
    lowered = F.translate(text_or_empty(text_col), UPPER, LOWER)
    words = F.explode(F.regexp_extract_all(lowered, F.lit(f"({WORDS})"), F.lit(1)))
    return texts.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> Head:
    """The ``most`` most frequent words (ties by word); the only words that reach the driver."""
    rows = counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    return Head.of([r["word"] for r in rows])


def bucket_totals(texts: DataFrame, counts: DataFrame, head: Head, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket over all runs of all texts, an array of ``buckets`` numbers.

    Words come from the counted vocabulary. A task counts its head pairs per pair and other runs per bucket, and
    returns one row per bucket.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(head)

    def longer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value
        per_bucket, per_pair = np.zeros(buckets, dtype=np.int64), np.zeros(h.pairs.size, dtype=np.int64)
        for batch in batches:
            for found in _chunks(batch["text"]):
                r = word_runs(found, h)
                frequent = r.head_pair >= 0
                per_pair += np.bincount(r.head_pair[frequent], minlength=h.pairs.size)
                per_bucket += np.bincount(r.twos[~frequent] % buckets, minlength=buckets)
                per_bucket += np.bincount(r.threes % buckets, minlength=buckets)
        np.add.at(per_bucket, h.pairs.ravel() % buckets, per_pair)
        used = np.flatnonzero(per_bucket)
        yield pd.DataFrame({"bucket": used, "n": per_bucket[used]})

    runs = texts.select(text_or_empty(text_col).alias("text")).mapInPandas(longer, "bucket bigint, n bigint")
    words = counts.select(F.pmod(F.crc32(utf8(F.col("word"))), F.lit(buckets)).alias("bucket"), "n")
    rows = words.unionByName(runs).groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row per bucket
    totals = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        totals[r["bucket"]] = r["n"]
    shared.unpersist()
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * float(corpus.sum() + n) / ((s + 1) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def document_weights(docs: DataFrame, head: Head, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gains))
    kind = dict(docs.dtypes)[id_col]

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, g = shared.value
        n = len(g)
        pair_gain = g[h.pairs.ravel() % n] if h.pairs.size else np.zeros(1, dtype=np.int64)
        for batch in batches:
            sizes, weights = [], []
            for found in _chunks(batch["text"]):
                r = word_runs(found, h)
                two = np.where(r.head_pair >= 0, pair_gain[r.head_pair], g[r.twos % n])
                # sums along word positions, differences at text borders: exact in integers
                along = np.zeros(len(r.text) + 1, dtype=np.int64)
                per_word = g[r.ones % n]
                per_word[r.two_at] += two
                per_word[r.three_at] += g[r.threes % n]
                np.cumsum(per_word, out=along[1:])
                count = np.array([len(t) for t in found], dtype=np.int64)
                end = np.cumsum(count)
                sizes.append(count)
                weights.append(along[end] - along[end - count])
            size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_words": size,
                    "n_features": size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0),
                    "weight": np.concatenate(weights) if weights else size,
                }
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(weighed, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, small_rows: int | None = None) -> DataFrame:
    """Add rank 1, 2, 3... in falling score (ties by id) to the drawn share of the rows with enough words.

    ``scored`` has doc_id, n_words, n_features, weight and score and is read several times. Equal rows are counted
    first and get ranks one after the other. Scores are counted and added up along their range; rows meet only with
    rows of their own score, which the noise spreads.
    """
    merged = stage(scored.groupBy(*scored.columns).agg(F.count(F.lit(1)).alias("_m")))
    fit = merged.where(F.col("n_words") >= least_words)
    quota = (fit.agg(F.sum("_m")).first()[0] or 0) * percent // 100
    per_score = stage(fit.groupBy((-F.col("score")).alias("below")).agg(F.sum("_m").alias("n")))
    order = Order.of(per_score, "below", small_rows=small_rows)
    upto = order.scan(per_score, Step({"upto": "n"}))
    reached = upto.select((-F.col("below")).alias("score"), (F.col("upto") - F.col("n")).alias("_ahead")).where(F.col("_ahead") < quota)
    least = reached.agg(F.min("score")).first()[0]
    taken = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    along = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    near = merged.where(taken).join(reached, "score").withColumn("_last", F.col("_ahead") + F.sum("_m").over(along))
    spread = near.select("*", F.explode(F.sequence(F.col("_last") - F.col("_m") + 1, F.col("_last"))).alias("_rank"))
    ranked = spread.select(*scored.columns, F.when(F.col("_rank") <= quota, F.col("_rank")).alias("rank"))
    rest = merged.where(~taken).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m")))).select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Weights, scores and the draw: doc_id, n_words, n_features, weight, score, rank; one row per row of ``docs``.

    ``target`` holds the texts to draw towards. Null and empty texts have no features, weight 0, and are not drawn; a
    null id counts as an empty one in the noise and comes first among ties; repeated rows get ranks of their own. An
    empty target gains every bucket what its rarity is worth. An empty table gives an empty result.
    """
    counts = stage(vocabulary(docs, text_col))
    head = head_words(counts)
    corpus = bucket_totals(docs, counts, head, text_col)
    wanted = bucket_totals(target, vocabulary(target, target_col), head, target_col)
    weighed = document_weights(docs, head, bucket_gains(corpus, wanted), id_col, text_col)
    noise = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(utf8(noise), 256), 1, 8), 16, 10).cast("bigint")
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")
    return drawn(weighed.withColumn("score", score), percent)


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    out = resample(documents(spark, folder), documents(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = """
WITH RECURSIVE bits(v, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8
), texts AS (
  SELECT row_number() OVER () AS r, false AS aim, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), true, NULL, text FROM benchmark
), worded AS (
  SELECT r, aim, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), runs AS (
  SELECT r, aim, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM worded, lateral (SELECT unnest(range(1, len(w) + 1)) AS i), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)
), counted AS (
  SELECT r, aim, f, count(*) AS n FROM runs GROUP BY ALL
), features AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i:
      (instr('0123456789ABCDEF', x[i]) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 17)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM features, crc
), placed AS (
  SELECT r, aim, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM placed GROUP BY bucket
), whole AS (
  SELECT sum(s) AS s, sum(t) AS t FROM totals
), gains AS (
  SELECT bucket, floor(1000 * ln((a.t + 1)::DOUBLE * (b.s + 10000)::DOUBLE / ((a.s + 1)::DOUBLE * (b.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM totals a, whole b
), weights AS (
  SELECT r, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE NOT aim GROUP BY r
), scored AS (
  SELECT d.r, doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
    coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h
  FROM worded d LEFT JOIN weights USING (r) WHERE NOT aim
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM noisy WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (5 * n) // 100 THEN k END AS rank FROM noisy LEFT JOIN ranked USING (r)
"""
