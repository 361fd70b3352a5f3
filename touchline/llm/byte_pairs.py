"""Byte-level BPE encoding and decoding as a tree reduction.

Encodings are joined like elements of a monoid, at two levels.

*Inside a piece* (one match of the split pattern), merging always takes the pair of least rank, the leftmost of equals.
Restricted to two neighbouring tokens it takes the same steps as on the two tokens alone, until a merge crosses a
boundary. So a sequence of tokens is an encoding exactly when each pair of neighbours is the encoding of its own bytes.
Halves are encoded by themselves; then the last k tokens of the left and the first k of the right are encoded anew as
one window. When the window still starts with its first and ends with its last old token, every pair in the whole
sequence is right; otherwise k is doubled.

*Between pieces*, the pattern is scanned from left to right and never looks back, and a match depends on at most
``AHEAD`` characters behind its end. So the left half's matches that end that far before the cut stand, and as soon as
the scan across the cut ends a match where a match of the right half ends, all later ones stand too.

Decoding concatenates the tokens' bytes in groups, and the groups again, up to one value.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from touchline.llm.common import documents, text_or_empty
from touchline.llm.token_counts import BLANKS, LETTERS, NUMBERS, WIDE

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a piece that are merged directly, characters of a text that are scanned directly.
PIECE_LEAF, TEXT_LEAF = 32, 4_096
#: Characters behind a match's end that the pattern may look at: a contraction's two letters, or a blank and one more.
AHEAD = 2
#: Runs of more bytes are merged with a queue.
QUEUED = 128
#: Pieces that are remembered per task, and the longest of them.
REMEMBERED, SHORT = 200_000, 24
#: Rows that a task hands on together.
ROWS = 500
#: Code points that Unicode assigned after version 16. The scanning library knows them as letters or
#: digits; to the encoder that is to be matched they are still neither.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The public split pattern, and the same for texts of U+0000 to U+00FF with its classes written out.
NARROW_OF = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NARROW = re.compile(
    f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
#: What stands for such a code point while a text is scanned: a sign that is no letter, digit or blank.
SIGN = "\u2042"
#: Tokens joined to one value in a step of decoding.
FAN = 64


@dataclass
class TreeCoder:
    """Encoder and decoder for one rank table and split pattern."""

    ranks: dict[bytes, int]  # a token's id is its rank
    pattern: str
    remembered: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        import regex

        self.scan = regex.compile(self.pattern)
        self.narrow = NARROW if self.pattern == NARROW_OF else self.scan
        self.later = re.compile(f"[{LATER}]")
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The token that two neighbouring tokens merge to; decoding does without."""
        rank = self.ranks.get
        splits = ((rank(t[:i]), rank(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t)))
        return {a << 32 | b: r for a, b, r in splits if a is not None and b is not None}

    # ------------------------------------------------------------ one piece

    @cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        return keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64)

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging of a short run of ids of single bytes: least rank first, leftmost of equals."""
        if len(ids) > QUEUED:
            return self.merged_by_queue(ids)
        pair, none = self.pairs.get, len(self.ranks)
        scores = [pair(a << 32 | b, none) for a, b in pairwise(ids)]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            ids[i] = best
            del ids[i + 1], scores[i]
            if i < len(scores):
                scores[i] = pair(best << 32 | ids[i + 1], none)
            if i:
                scores[i - 1] = pair(ids[i - 1] << 32 | best, none)
        return ids

    def merged_by_queue(self, ids: list[int]) -> list[int]:
        """The same for a long run, with the pairs in a queue: n log n steps."""
        n, pair = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := pair(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pair(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := pair(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(queue, (r, a))
        return [i for i in ids if i >= 0]

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs merge to; where they don't, the number of ids."""
        key, (keys, merged) = left << 32 | right, self.sorted_pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, merged[at], len(self.ranks))

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """``merged`` for many short runs at a time, as 32-bit ids: in each round, every unfinished run merges its next pair."""
        none, size = len(self.ranks), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.array(self.single, dtype=np.int64)[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        score = np.full(len(ids), none, dtype=np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        score[inner] = self._found(ids[inner], ids[inner + 1])
        finished = []
        while len(ids):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(start, len(owner)))
            best = np.repeat(np.minimum.reduceat(score, start), size)
            going = best < none
            finished.append((owner[~going], ids[~going]))
            owner, ids, score, best = owner[going], ids[going], score[going], best[going]
            hit = np.flatnonzero(score == best)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])[: len(hit)]]  # the leftmost of each run
            ids[hit] = score[hit]
            stays = np.ones(len(ids), dtype=bool)
            stays[hit + 1] = False
            owner, ids, score = owner[stays], ids[stays], score[stays]
            at = hit - np.arange(len(hit))  # one id fewer for every run before
            score[at] = none
            with_next = at[np.append(owner[1:] == owner[:-1], False)[at]]
            score[with_next] = self._found(ids[with_next], ids[with_next + 1])
            with_last = at[np.append(False, owner[1:] == owner[:-1])[at]]
            score[with_last - 1] = self._found(ids[with_last - 1], ids[with_last])
        owner, ids = (np.concatenate(a) for a in zip(*finished))
        raw = ids[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [raw[a:b] for a, b in pairwise([0, *ends])]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the bytes of both, from the tokens of each."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.merged([*map(self.single.__getitem__, b"".join(map(self.bytes_of.__getitem__, a + b)))])
            open_left, open_right = k < len(left), k < len(right)
            if (not open_left or window[0] == a[0]) and (not open_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, piece: bytes) -> list[int]:
        """Tokens of a run of bytes: halves are encoded by themselves and joined."""
        if len(piece) <= PIECE_LEAF:
            return self.merged([*map(self.single.__getitem__, piece)])
        half = len(piece) // 2
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    # ------------------------------------------------------------ texts

    def bridged(self, left: list[str], right: list[str], scan) -> list[str]:
        """Matches of the text of both, from the matches of each."""
        if not left or not right:
            return left or right
        tail, keep = 0, len(left)
        while keep and tail < AHEAD:
            keep -= 1
            tail += len(left[keep])
        before, k = "".join(left[keep:]), 1
        while True:
            text = before + "".join(right[:k])
            limit = len(text) if k >= len(right) else len(text) - AHEAD
            ends = {len(text): len(right)} if k >= len(right) else {}
            at = len(before)
            for i, match in enumerate(right[:k]):
                at += len(match)
                ends[at] = i + 1
            found = []
            for m in scan.finditer(text):
                if m.end() > limit:
                    break
                found.append(m.group())
                if m.end() in ends:
                    return left[:keep] + found + right[ends[m.end()] :]
            k *= 2

    def matches(self, text: str, scan=None) -> list[str]:
        """All matches of the pattern in a text: halves are scanned by themselves and bridged."""
        if scan is None:
            scan = self.scan if not text.isascii() and WIDE.search(text) else self.narrow
        if len(text) <= TEXT_LEAF:
            return scan.findall(text)
        half = len(text) // 2
        return self.bridged(self.matches(text[:half], scan), self.matches(text[half:], scan), scan)

    def split(self, text: str) -> list[str]:
        """The text's pieces. Code points of later Unicode are scanned as a sign."""
        signed, odd = (text, 0) if text.isascii() else self.later.subn(SIGN, text)
        found = self.matches(signed)
        if odd:
            ends = [0, *accumulate(map(len, found))]
            found = [text[a:b] for a, b in pairwise(ends)]
        return found

    def encode_batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids (32 bits) of several texts: of each piece new among them the ids are found, short ones together.

        A piece that is itself a token is that token. Ids are remembered as bytes, so a text costs a step per piece only.
        """
        split = [self.split(t) for t in texts]
        pieces = set().union(*split)
        new = pieces.difference(self.remembered)
        if len(new) + len(self.remembered) > REMEMBERED:
            self.remembered.clear()
            new = pieces
        raw = {m: m.encode() for m in new}
        whole = {m: i.to_bytes(4, sys.byteorder) for m, b in raw.items() if (i := self.ranks.get(b)) is not None}
        short = [m for m, b in raw.items() if m not in whole and len(b) <= PIECE_LEAF]
        self.remembered.update(whole)
        if short:
            self.remembered.update(zip(short, self.merged_together([raw[m] for m in short])))
        self.remembered.update({m: np.array(self.tree(b), dtype=np.int32).tobytes() for m, b in raw.items() if m not in self.remembered})
        out = [np.frombuffer(b"".join(map(self.remembered.__getitem__, found)), dtype=np.int32) for found in split]
        for m in new:
            if len(m) > SHORT:
                del self.remembered[m]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """Bytes of ids, joined ``FAN`` at a time, group upon group."""
        parts = [*map(self.bytes_of.__getitem__, ids)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return parts[0] if parts else b""


_coders: dict[str, TreeCoder] = {}


def coder(name: str = RANKS) -> TreeCoder:
    """The coder of a public rank file, looked up on the machine where the task runs and kept for its later batches."""
    if name not in _coders:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _coders[name] = TreeCoder(ranks, public_tokenizers.PATTERN)
    return _coders[name]


def _mapped(rows: DataFrame, column: str, name: str, kind: str, make) -> DataFrame:
    """``rows`` with one column in place of another, made from its values in pieces of ``ROWS``."""
    others = [f for f in rows.schema.fields if f.name != column]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                made = pd.Series(make(part[column]), index=part.index, dtype=object)
                yield part.drop(columns=column).assign(**{name: made})

    return rows.mapInPandas(whole, StructType([*others, StructField(name, kind)]))


def encode_documents(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id and ids.

    One row per input row, repeated rows and null ids included; a null or empty text has no ids. Special strings are
    ordinary text. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return _mapped(rows, "text", "ids", ArrayType(IntegerType()), lambda texts: coder(ranks).encode_batch(texts))


def decode_documents(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The bytes again: ``encoded`` with a column decoded in place of ids. An id outside the vocabulary is an error."""
    return _mapped(encoded, "ids", "decoded", BinaryType(), lambda ids: [None if i is None else coder(ranks).decode(i.tolist()) for i in ids])


def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    coded = encode_documents(documents(spark, folder)).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest, "ids")
    return decode_documents(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
