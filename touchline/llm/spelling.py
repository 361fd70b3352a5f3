"""Grouping of spelling variants with FM-index search schemes.

A word within one inserted, deleted or replaced code point of another keeps one of its halves. So every word is looked
up twice in an index of the vocabulary: its first half must match exactly and the second may hold one error, or the
second half matches and the first may. The index is bidirectional: the FM-index of the reversed vocabulary extends a
match to the right, the one of the vocabulary itself extends it to the left. Each search starts at the word's edge,
keeps to one direction and so needs one of the two; both are built by the same code, from words and reversed words.

The vocabulary is one delimited text, ``|word|word|``. A state of a search is an interval of suffix ranks; a step over
a symbol maps both of its ends through the sorted symbol table. All searches of a block advance together.

Words that share their first (or last) three code points meet in a block of bounded size; a larger set of them is cut
into a grid of index parts and query parts, so that no task holds more than two parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import LOWER, UPPER, documents, text_or_empty, utf8
from touchline.operators.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A code point of a run is deleted when this divides the run's checksum.
DELETE_EVERY = 31
#: A word's form must be this many times as frequent.
TIMES = 10
#: Code points by which words meet: no half of a word of seven is shorter.
KEY = 3
#: Indexed words, and asking words, of one task.
BLOCK = 25_000
MOST_ROUNDS = 64


class FmIndex:
    """FM-index of distinct words that extends matches to the right."""

    def __init__(self, words: Sequence[str]):
        self.words = words
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)[::-1]
        self.symbols, codes = np.unique(text, return_inverse=True)  # the delimiter is symbol 0
        self.n = n = len(codes)
        order = self._suffixes(codes, len(self.symbols))
        before = codes[order - 1]
        self.last = before
        #: occurrences of symbols before a rank, as one sorted table: place of (symbol, rank) = next rank
        place = np.argsort(before, kind="stable")
        self.table = before[place] * n + place
        # the reversed text starts with a delimiter; a match of |word| starts at the delimiter behind the word
        starts = np.flatnonzero(codes == 0)
        self.word_at = np.full(n, -1, dtype=np.int64)
        self.word_at[starts[:-1]] = np.arange(len(words))[::-1]
        self.order = order

    @staticmethod
    def _suffixes(codes: np.ndarray, symbols: int) -> np.ndarray:
        """Starts of the rotations in sorted order: several symbols packed first, then doubled until all differ."""
        bits = max(1, math.ceil(math.log2(symbols)))
        width = 1
        rank = codes.astype(np.int64)
        while width * 2 * bits <= 62:
            rank = rank << (width * bits) | np.roll(rank, -width)
            width *= 2
        while True:
            order = np.argsort(rank, kind="stable")
            sorted_ = rank[order]
            new = np.empty_like(rank)
            new[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
            if new.max() == len(codes) - 1 or width >= len(codes):
                return order
            rank = new * len(codes) + np.roll(new, -width)
            width *= 2

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches followed by a symbol; an unknown symbol (-1) gives an empty one."""
        base = symbol * self.n
        new_low, new_high = np.searchsorted(self.table, base + low), np.searchsorted(self.table, base + high)
        return new_low, np.where(symbol < 0, new_low, new_high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each interval's following symbols but the delimiter: interval number and symbol. Equal intervals are read once."""
        both, which = np.unique(low * (self.n + 1) + high, return_inverse=True)
        first, size = both // (self.n + 1), both % (self.n + 1) - both // (self.n + 1)
        owner = np.repeat(np.arange(len(both)), size)
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        seen = np.unique(owner * len(self.symbols) + self.last[spot])
        owner, symbol = seen // len(self.symbols), seen % len(self.symbols)
        owner, symbol = owner[symbol > 0], symbol[symbol > 0]
        count = np.bincount(owner, minlength=len(both))
        start = np.cumsum(count) - count
        of = np.repeat(np.arange(len(low)), count[which])
        within = np.arange(len(of)) - np.repeat(np.cumsum(count[which]) - count[which], count[which])
        return of, symbol[np.repeat(start[which], count[which]) + within]

    def one_error(self, queries: Sequence[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that agree in the query's first ``exact`` code points and differ by one edit behind them."""
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        flat = np.frombuffer("".join(queries).encode("utf-32-le"), dtype=np.uint32)
        at = np.searchsorted(self.symbols, flat)
        at[at == len(self.symbols)] = 0
        codes = np.where(self.symbols[at] == flat, at, -1).astype(np.int64)
        codes = np.append(codes, 0)
        offset = np.cumsum(lengths) - lengths

        def wanted(q: np.ndarray, pos: np.ndarray) -> np.ndarray:
            """The symbol at a position of the query; behind its end, the delimiter."""
            inside = pos < lengths[q]
            return np.where(inside, codes[np.where(inside, offset[q] + pos, 0)], 0)

        def live(low, high, *others):
            keep = low < high
            return low[keep], high[keep], *(o[keep] for o in others)

        q = np.arange(len(queries))
        low, high = self.step(np.zeros(len(q), dtype=np.int64), np.full(len(q), self.n), np.zeros(len(q), dtype=np.int64))
        waiting, depth = [], 0
        while len(q):  # the exact half; queries whose half is done wait
            done = exact[q] <= depth
            waiting.append((q[done], low[done], high[done]))
            q, low, high = q[~done], low[~done], high[~done]
            low, high = self.step(low, high, wanted(q, np.full(len(q), depth)))
            low, high, q = live(low, high, q)
            depth += 1
        q, low, high = (np.concatenate(a) for a in zip(*waiting))
        pos, found = exact[q], []
        none = np.zeros(0, dtype=np.int64)
        wrong = (none, none, none, none)  # query, position, low, high of states with an error; position length + 1: complete
        while len(q) or len(wrong[0]):
            of, symbol = self.children(low, high)
            new_low, new_high = self.step(low[of], high[of], symbol)
            other = symbol != wanted(q, pos)[of]
            swapped = other & (pos < lengths[q])[of]
            gone = pos < lengths[q]
            parts = [
                (q[of], pos[of], new_low, new_high),  # one symbol more
                (q[of][swapped], pos[of][swapped] + 1, new_low[swapped], new_high[swapped]),  # another symbol
                (q[gone], pos[gone] + 1, low[gone], high[gone]),  # one symbol less
                wrong,
            ]
            wq, wp, wl, wh = (np.concatenate(a) for a in zip(*parts))
            wl, wh = self.step(wl, wh, wanted(wq, wp))
            wl, wh, wq, wp = live(wl, wh, wq, wp + 1)
            complete = wp > lengths[wq]
            found.append((wq[complete], self.word_at[self.order[wl[complete]]]))
            wrong = tuple(a[~complete] for a in (wq, wp, wl, wh))
            more = pos < lengths[q]
            q, pos, low, high = q[more], pos[more], low[more], high[more]
            low, high = self.step(low, high, wanted(q, pos))
            low, high, q, pos = live(low, high, q, pos + 1)
        if not found:
            return none, none
        fq, fw = (np.concatenate(a) for a in zip(*found))
        pairs = np.unique(fq * len(self.words) + fw)  # several edits may lead to one word
        return pairs // len(self.words), pairs % len(self.words)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delete_every: int = DELETE_EVERY) -> DataFrame:
    """Words and their counts: word, n.

    A word is a maximal run of letters with A to Z lower-cased; when ``delete_every`` divides the checksum of id and
    run, one code point of the run is left out. Words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT``
    occurrences are kept. Null texts have no words; a null id counts as an empty one; repeated rows count again.
    """
    # a run that is too short stays too short without a code point
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    seen = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("r"))
    seen = seen.select("i", F.translate("r", UPPER, LOWER).alias("r"))
    seen = seen.withColumn("h", F.crc32(utf8(F.concat("i", F.lit(":"), "r"))))
    spot = (F.col("h") % F.length("r")).cast("int")
    shorter = F.concat(F.substring("r", F.lit(1), spot), F.substring("r", spot + 2, F.length("r")))
    word = F.when(F.col("h") % delete_every == 0, shorter).otherwise(F.col("r"))
    counted = seen.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def blocks(words: DataFrame, block: int) -> DataFrame:
    """Words beside those that may be near: side, part, key, i, j (the block), oriented, n, indexed, asks.

    On side 0 words meet by their first code points, on side 1 by their last, read backwards. Small keys are packed
    into parts by hash; a key of more than ``block`` words becomes a grid of index parts i and query parts j.
    """
    total = words.count()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("o")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("o"))))
    rows = words.select("n", sides.alias("s")).select("n", "s.side", F.col("s.o").alias("oriented"))
    rows = rows.withColumn("key", F.substring("oriented", 1, KEY))
    hot = rows.groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cells")).where("cells > 1")
    parts = max(1, math.ceil(2 * total / block))
    # at most two rows for each of the possible keys of three letters, and one for every ``block`` words
    rows = rows.join(F.broadcast(hot), ["side", "key"], "left")
    part = F.pmod(F.xxhash64("side", "key"), F.lit(parts))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("indexed"), F.lit(True).alias("asks")))
    own = F.pmod(F.xxhash64("oriented"), F.col("cells")).cast("int")
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    as_word = F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("indexed"), (j == own).alias("asks")))
    others = F.filter(every, lambda i: i != own)
    as_query = F.transform(others, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    cells = F.when(F.col("cells").isNull(), whole).otherwise(F.concat(as_word, as_query))
    placed = rows.select(
        "side",
        F.when(F.col("cells").isNull(), part).otherwise(F.lit(-1)).alias("part"),
        F.when(F.col("cells").isNull(), F.lit("")).otherwise(F.col("key")).alias("key"),
        "oriented",
        "n",
        F.explode(cells).alias("c"),
    )
    return placed.select("side", "part", "key", "c.i", "c.j", "oriented", "n", "c.indexed", "c.asks")


def _links(rows: pd.DataFrame) -> tuple[int, list[str], np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Side, asking words, the number of each link's asking word, and the indexed words with their counts it leads to."""
    side = int(rows["side"].iloc[0])
    kept = rows[rows["indexed"]]
    words, counts = kept["oriented"].tolist(), kept["n"].to_numpy()
    queries = rows.loc[rows["asks"], "oriented"].tolist()
    halves = np.array([len(q) // 2 if side == 0 else len(q) - len(q) // 2 for q in queries], dtype=np.int64)
    if not words or not queries:
        return side, queries, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), words, counts
    q, w = FmIndex(words).one_error(queries, halves)
    if side == 1:  # what keeps the first half too was found on side 0
        new = [not words[b].endswith(queries[a][halves[a] :]) for a, b in zip(q, w)]
        new = np.array(new, dtype=bool)
        q, w = q[new], w[new]
    return side, queries, q, w, words, counts


def near_links(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """All near pairs, in both directions: word, near, near_n. ``words`` has distinct words and their counts n."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        side, queries, q, w, found, counts = _links(rows)
        way = -1 if side else 1
        pairs = {"word": [queries[a][::way] for a in q], "near": [found[b][::way] for b in w], "near_n": counts[w]}
        return pd.DataFrame(pairs, dtype=object)

    grouped = blocks(words, block).groupBy("side", "part", "key", "i", "j")
    return grouped.applyInPandas(linked, "word string, near string, near_n bigint")


def nearest_forms(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per word with near words: word, n_near, and the most frequent of them with its count, best and best_n.

    The links of a block are counted where they are found; a word's blocks are added up afterwards.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        side, queries, q, w, found, counts = _links(rows)
        way = -1 if side else 1
        near = np.array([found[b][::way] for b in w], dtype=object)
        links = pd.DataFrame({"q": q, "minus": -counts[w], "near": near}).sort_values(["q", "minus", "near"])
        first = links.groupby("q", sort=False).agg(n_near=("near", "size"), best_n=("minus", "first"), best=("near", "first")).reset_index()
        first["word"] = [queries[a][::way] for a in first["q"]]
        first["best_n"] = -first["best_n"]
        return first[["word", "n_near", "best", "best_n"]].astype(object)

    grouped = blocks(words, block).groupBy("side", "part", "key", "i", "j")
    found = grouped.applyInPandas(best, "word string, n_near bigint, best string, best_n bigint")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b"))).alias("t")
    totals = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top)
    return totals.select("word", "n_near", F.col("t.b").alias("best"), (-F.col("t.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """The end of each word's chain of forms: word, root. ``forms`` has word and form and is cheap to read.

    Each round doubles the steps. A form is ``TIMES`` times as frequent as its word, so chains are short and have no
    loops.
    """
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(MOST_ROUNDS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return now
    raise RuntimeError("the chains of forms have a loop")


def spelling_groups(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """Words with their frequent form: word, form, root, n, n_near, form_n.

    ``words`` holds distinct words of at least six code points, as ``vocabulary`` gives them, and their counts n. The
    form is the near word of largest n (of equals the least in code-point order) if that n is at least ``times`` the
    word's; root follows forms to the last, and is the word itself without one. An empty table gives an empty result.
    """
    words = stage(words.select("word", "n"))
    near = nearest_forms(words, block)
    joined = words.join(near, "word", "left")
    fits = F.col("best_n") >= F.col("n") * times
    grouped = stage(
        joined.select(
            "word",
            F.when(fits, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, F.col("best_n")).alias("form_n"),
        )
    )
    ends = roots(grouped.where("form IS NOT NULL").select("word", "form"))
    out = grouped.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(vocabulary(documents(spark, folder)))


#: Near words another way: two words are near when one is the other without a code point, or both are equal without
#: the one at the same place. The checksum is worked out byte by byte.
OP13_SQL = """
WITH RECURSIVE bits(v, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY v) AS tab FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS raw FROM documents
), counted AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs GROUP BY ALL
), hexed AS (
  SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS x FROM counted
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i:
      (instr('0123456789ABCDEF', x[i]) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 17)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM hexed, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), less AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM words, lateral (SELECT unnest(range(length(word))) AS p)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, near, n, count(*) OVER (PARTITION BY word) AS k, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS r FROM near
), formed AS (
  SELECT w.word, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, w.n, coalesce(r.k, 0) AS n_near,
    CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain(word, root, depth) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
