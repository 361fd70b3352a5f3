"""Exact token counts by dynamic programming over prefixes.

A byte-pair encoding is right exactly when each pair of neighbouring tokens is the encoding of its own two tokens. So
the encoding of a prefix of a word ends in the one token that fits the encoding of what lies before it, and its count
is one more than the count of that shorter prefix. The table of counts costs one step per prefix and never runs the
merges over a whole word; the few merges needed to compare two tokens are remembered.

Per text, the counts are added up along its words: the count at every run's end and inside runs of several tokens is kept on request, and questions about
budgets and truncation are answered from these numbers by SQL, without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, text_or_empty

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
REMEMBERED = 600_000
SPACED = 256

#: The tokenizer's word pattern on lower-cased text of U+0000 to U+00FF, classes written out.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = r"\t-\r \x85\xa0"
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
#: Separators that Python's split takes for blanks and the tokenizer doesn't.
ODD = re.compile(r"[\x1c-\x1f]")
REAL_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WIDE = re.compile(r"[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class PrefixCounter:
    """Counts for one tokenizer file. Everything remembered is bounded by ``REMEMBERED`` entries."""

    path: str
    chunks: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(merges)}
        self.known = {token for token, (_, a, b) in self.made.items() if self._merge(self._split(token)) == [token]}
        self.longest = max(map(len, self.known))
        self.letters = dict(enumerate(byte_letters()))
        specials = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(specials)) if specials else None

    # ------------------------------------------------------------ one word

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first, for the two tokens of a comparison."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 30:
                return symbols
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _fits(self, before: str, token: str) -> bool:
        """True when the encoding of both together is these two tokens.

        Both are undone towards their common edge, the later merge first. A merge across the edge that comes before
        the merge just undone would have happened in its place.
        """
        key = (before, token)
        out = self.pairs.get(key)
        if out is not None:
            return out
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        ranks, made, base = self.ranks, self.made, (-1, "", "")
        limit, never, a, b = len(ranks), len(ranks), before, token
        out = True
        while ranks.get((a, b), never) >= limit:
            (rank_a, _, right), (rank_b, left, _) = made.get(a, base), made.get(b, base)
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                limit, a = rank_a, right
            else:
                limit, b = rank_b + 1, left  # among equals the left one merges first
        else:
            out = False
        self.pairs[key] = out
        return out

    def _last(self, word: str, i: int, last: list[str], end: str) -> str:
        """The last token of the encoding of ``word[:i]``, closed by ``end``."""
        known, fits = self.known, self._fits
        for j in range(max(0, i - self.longest), i):
            token = word[j:i] + end
            if (token in known or i - j == 1) and (j == 0 or fits(last[j], token)):
                return token
        raise ValueError(f"no token ends {word[:i]!r}")

    def table(self, word: str) -> list[int]:
        """Token counts of every prefix of a word, each encoded as a word of its own; the word is in byte letters."""
        last, open_, closed = [""], [0], [0]
        for i in range(1, len(word) + 1):
            whole = self._last(word, i, last, self.end)
            closed.append(open_[i - (len(whole) - len(self.end))] + 1)
            token = self._last(word, i, last, "") if self.end else whole
            last.append(token)
            open_.append(open_[i - len(token)] + 1)
        return closed

    def word(self, word: str) -> int:
        """Token count of one word in byte letters: the last entry of its table, of which only this is needed."""
        out = self.words.get(word)
        if out is None:
            last, count = [""], [0]
            for i in range(1, len(word)):
                token = self._last(word, i, last, "")
                last.append(token)
                count.append(count[i - len(token)] + 1)
            token = self._last(word, len(word), last, self.end)
            out = count[len(word) - (len(token) - len(self.end))] + 1
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = out
        return out

    # ------------------------------------------------------------ texts

    def _plain(self, piece: str) -> int:
        if WIDE.search(piece):  # the library's own normal form and words
            normal = self.library.normalizer.normalize_str(piece)
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        else:
            words = PLAIN_WORDS.findall(piece.lower())
            if not (piece.isascii() and piece.isprintable()):
                words = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return sum(map(self.word, words))

    def chunk(self, chunk: str) -> int:
        """Token count of a run without blanks; special strings in it count as one token each."""
        out = self.chunks.get(chunk)
        if out is None:
            found = self.special.findall(chunk) if self.special and "<" in chunk else []
            pieces = self.special.split(chunk) if found else [chunk]
            out = len(found) + sum(self._plain(p) for p in pieces if p)
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = out
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return [c for c in REAL_BLANKS.split(text) if c] if ODD.search(text) else text.split()

    def count(self, text: str) -> int:
        known, chunk = self.chunks.get, self.chunk
        total = 0
        for c in self.split(text):
            n = known(c)
            total += chunk(c) if n is None else n
        return total

    def _inside(self, piece: str) -> list[tuple[int, int]]:
        """Characters and token count of the prefixes of a piece without special strings; not those that end in a 's or 've.

        Where the normal form doesn't go character by character, the prefixes are counted one by one, ``SPACED`` at most.
        """
        wide = WIDE.search(piece)
        norm = self.library.normalizer.normalize_str if wide else str.lower
        each = [norm(c) for c in piece]
        normal = norm(piece)
        if "".join(each) != normal or any(len(c) != 1 for c in each):
            step = -(-len(piece) // SPACED)
            return [(i, self._plain(piece[:i])) for i in range(step, len(piece), step)]
        if wide:
            words = [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        else:
            words = PLAIN_WORDS.findall(normal)
        out, at, before = [], 0, 0
        for w in words:
            at = normal.index(w, at)
            table, size = self.table(w.encode().decode("latin-1").translate(self.letters)), 0
            whole = w[0] == "'" and w[1:].isalpha()
            for i, c in enumerate(w, 1):
                size += len(c.encode())
                if i == len(w) or not whole:
                    out.append((at + i, before + table[size]))
            at, before = at + len(w), before + table[-1]
        return out

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of prefixes, in characters, and the token count of the text up to each: the ends of the runs between
        blanks and, in runs of several tokens, the characters inside. Counts may fall inside a run, where a merge ends.
        """
        ends, counts, at, total = [], [], 0, 0
        for c in self.split(text):
            start = text.index(c, at)
            at = start + len(c)
            n = self.chunk(c)
            if n > 1:
                found = [m.span() for m in self.special.finditer(c)] if self.special and "<" in c else []
                inner, done = 0, 0
                for a, b in [*found, (len(c), len(c))]:
                    for i, k in self._inside(c[done:a]):
                        if done + i < len(c):
                            ends.append(start + done + i)
                            counts.append(total + inner + k)
                    inner += self._plain(c[done:a]) if a > done else 0
                    if b > a:
                        inner += 1
                        if b < len(c):
                            ends.append(start + b)
                            counts.append(total + inner)
                    done = b
            total += n
            ends.append(at)
            counts.append(total)
        return ends, counts


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_column(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Token count of a text column; ``tokenizer`` is a name of a public file, looked up where the task runs."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(tokenizer_path(tokenizer))
        for batch in batches:
            yield pd.Series([c.count(t) for t in batch], dtype="int64")

    return counted(text)


def prefix_column(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Struct of ``ends`` and ``counts``: characters and tokens of the prefixes that ``PrefixCounter.prefixes`` stores."""

    @F.pandas_udf("ends array<int>, counts array<int>")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer_path(tokenizer))
        for batch in batches:
            both = [c.prefixes(t) for t in batch]
            yield pd.DataFrame({"ends": [b[0] for b in both], "counts": [b[1] for b in both]})

    return table(text)


def cut_length(prefixes: Column, budget: int) -> Column:
    """Characters of the longest stored prefix within a token budget, from a column of ``prefix_column``."""
    fits = F.filter(F.arrays_zip(prefixes["ends"].alias("ends"), prefixes["counts"].alias("counts")), lambda p: p["counts"] <= budget)
    return F.coalesce(F.array_max(F.transform(fits, lambda p: p["ends"])), F.lit(0))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    One row per input row, repeated rows and null ids included. A null or empty text has 0 tokens. Special strings in
    a text count as the library counts them by default, as one token. Other columns are not read; an empty table
    gives an empty result.
    """
    text = text_or_empty(text_col)
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), count_column(text, tokenizer).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))
