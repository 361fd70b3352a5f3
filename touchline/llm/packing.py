"""Packing documents into training sequences of several lengths.

A document's ids are cut where they are made: whole windows of the longest context become sequences of their own, the
rest is one piece, routed to the shortest context that holds it. Pieces are dealt to groups of bounded size. A group
packs its tiers from the longest down: the longest piece left opens a window of its tier, a piece of a shorter tier
that nearly fills the gap goes into it whole, and what is then open is closed by cutting the longest piece left, whose
rest goes back to the tier of its new length. So windows of every tier end full, a full window of a power of two needs
no padding, and only the last window of a group can stay open. Sequences of one tier are dealt to steps of about as
many ids each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, text_or_empty
from touchline.llm.token_counts import BLANKS, LETTERS, NUMBERS, ODD, WIDE, byte_letters, tokenizer_path
from touchline.operators.staging import arrow_rows, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
TIERS = (128, 256, 512, 1024)
PIECES_PER_GROUP = 8192
STEP_SEQUENCES = 64
#: Texts that a task takes in at a time.
ROWS = 1_000
#: Bytes of words, and runs of other texts, that are remembered per task.
REMEMBERED, REMEMBERED_RUNS = 24 << 20, 100_000
#: Texts and characters that are encoded together; words that go to the library together.
TOGETHER, CHARACTERS, LINES = ROWS, 1 << 22, 1 << 14
#: The tokenizer's letter for a space.
SPACE = byte_letters()[32]

#: The tokenizer's word pattern for texts of U+0000 to U+00FF, classes written out.
FINE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
#: For other texts, runs that the tokenizer never merges across: a word with at most one space before it, or blanks.
COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: In a text of U+0000 to U+00FF without these, and no space at either end, each space stands between two words.
UNEVEN = ("  ", " \n", "\n ", "\t", "\r", "\v", "\f", "\x85", "\xa0")


def gathered(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after another, and where each ends; stretch i is bounds[i] to bounds[i + 1]."""
    own = np.diff(bounds)[which]
    ends = np.cumsum(own)
    at = np.repeat(bounds[:-1][which] - (ends - own), own)
    at += np.arange(len(at))
    return flat[at], ends


class RunEncoder:
    """Ids of whole texts by the library; words and runs met before are remembered within ``REMEMBERED`` bytes and runs.

    Where each space of a text stands between two words, it is cut at the spaces: the distinct words of a batch are
    looked up once, and the new ones go to the library in one text, each with a space before it; words of letters, which
    the tokenizer does not cut, go to its model. Other texts are cut into runs as the tokenizer cuts them.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.small = self.library.get_vocab_size() <= 2**16
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        before = spec["pre_tokenizer"] or {}
        # words are cut out as this tokenizer does, and no special string has a blank
        self.by_bytes = not spec["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.by_bytes = self.by_bytes and not any(re.search(r"\s", x) for x in self.specials)
        self.letters = dict(enumerate(byte_letters())) | {10: "\n"}
        self.model = Tokenizer(self.library.model)  # for words in byte letters, one a line
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.known: dict[str, bytes] = {}
        self._remember(pa.array([], pa.string()), np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64))

    def _remember(self, words: pa.Array, flat: np.ndarray, bounds: np.ndarray) -> None:
        self.words, self.flat, self.bounds = words, flat, bounds

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _lettered(self, text: str) -> np.ndarray:
        """Ids of words of letters, each with a space before it, one a line."""
        own = text.encode().decode("latin-1").translate(self.letters)
        return np.array(self.model.encode_batch_fast([own], add_special_tokens=False)[0].ids, dtype="<u4")

    def _new(self, words: pa.Array, between: str, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a space before each, and their sizes: a word's first token is the one with a space."""
        flat, sizes = [self.flat[:0]], [self.bounds[:0]]
        for a in range(0, len(words), LINES):
            part = words.slice(a, LINES)
            ids = encode(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), f"{between} ")[0].as_py())
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part) and starts[0] == 0:
                flat.append(ids)
                sizes.append(np.diff(np.append(starts, len(ids))))
            else:
                alone = [self._encoded(f" {w}") for w in part.to_pylist()]
                flat.extend(alone)
                sizes.append(np.array([len(x) for x in alone], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _of_runs(self, runs: list[str]) -> bytes:
        known = self.known
        out = list(map(known.get, runs))
        if None in out:
            missing = list({r for r, ids in zip(runs, out) if ids is None})
            found = self.library.encode_batch_fast(missing, add_special_tokens=False)
            new = {r: np.array(e.ids, dtype="<u4").tobytes() for r, e in zip(missing, found)}
            out = [new[r] if ids is None else ids for r, ids in zip(runs, out)]
            if len(known) + len(new) > REMEMBERED_RUNS:
                known.clear()
            known.update((r, ids) for r, ids in new.items() if len(r) <= 64)
        return b"".join(out)

    def _even(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which every space stands between two words."""
        heads, rests = zip(*((head, rest or None) for head, _, rest in (t.partition(" ") for t in texts)))
        cut = pc.split_pattern(pa.array(rests, pa.string()), " ")
        named = cut.flatten().dictionary_encode()
        place = pc.index_in(named.dictionary, value_set=self.words)
        which = place.fill_null(-1).to_numpy().astype(np.int64)
        plain = pc.utf8_is_alpha(named.dictionary).to_numpy(zero_copy_only=False)
        lettered, others = np.flatnonzero((which < 0) & plain), np.flatnonzero((which < 0) & ~plain)
        words = named.dictionary.take(pa.array(lettered)), named.dictionary.take(pa.array(others))
        made = self._new(words[0], "\n", self._lettered), self._new(words[1], "", self._encoded)
        flat = np.concatenate([self.flat, *(ids for ids, _ in made)])
        bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([sizes for _, sizes in made])))
        which[np.append(lettered, others)] = np.arange(len(self.words), len(bounds) - 1)
        ids, ends = gathered(flat, bounds, which[named.indices.to_numpy()])
        kept = pa.concat_arrays([self.words, *words])
        if kept.nbytes + flat.nbytes + bounds.nbytes > REMEMBERED:
            own, own_ends = gathered(flat, bounds, which)  # the words of this batch stay
            self._remember(named.dictionary, own, np.append(0, own_ends))
            if named.dictionary.nbytes + own.nbytes + own_ends.nbytes > REMEMBERED:
                self._remember(kept[:0], own[:0], self.bounds[:1])
        else:
            self._remember(kept, flat, bounds)
        raw, at = ids.tobytes(), (4 * np.append(0, ends)[cut.offsets.to_numpy()]).tolist()
        return [self._of_runs(FINE.findall(head)) + raw[a:b] for head, a, b in zip(heads, at, at[1:])]

    def batch(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts with special strings go to the library whole."""
        out: list[bytes] = [b""] * len(texts)
        even = []
        for i, text in enumerate(texts):
            wide = not text.isascii() and WIDE.search(text) is not None
            if (wide and ODD.search(text)) or any(s in text for s in self.specials):
                out[i] = self._encoded(text).tobytes()
            elif wide or not self.by_bytes or text[:1] == " " or text[-1:] == " " or any(b in text for b in UNEVEN):
                out[i] = self._of_runs((COARSE if wide else FINE).findall(text))
            elif text:
                even.append(i)
        if even:
            for i, ids in zip(even, self._even([texts[i] for i in even])):
                out[i] = ids
        return out

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


def together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of at most ``TOGETHER``, closed once they pass ``CHARACTERS``."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if len(held) == TOGETHER or size > CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


_encoders: dict[str, RunEncoder] = {}


def encoder(name: str) -> RunEncoder:
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[name] = RunEncoder(tokenizer_path(name))
    return _encoders[name]


def narrow(ids: bytes, small: bool) -> bytes:
    """Ids in two bytes each where they all fit, for the way to their group."""
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if small else ids


def widen(ids: bytes, length: int) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if len(ids) == 2 * length else ids


def cut_pieces(docs: DataFrame, tiers: Sequence[int] = TIERS, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of every document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids (narrow).

    The document's ids end with ``END_ID``; whole windows of the longest tier come first, what is left is one piece.
    """
    window = max(tiers)

    @F.pandas_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:binary>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for ids in chain.from_iterable(map(e.batch, together(batch))):
                ids += end
                tokens = len(ids) // 4
                parts = [(start, ids[4 * start : 4 * (start + window)]) for start in range(0, tokens, window)]
                out.append(
                    [
                        {"start": start, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "doc_tokens": tokens, "ids": narrow(p, e.small) if with_ids else None}
                        for start, p in parts
                    ]
                )
            yield pd.Series(out)

    pieces = docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")
    return pieces if with_ids else pieces.drop("ids")


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class Pool:
    """Pieces that wait, by length. Bit n of ``held`` is set while some piece has n ids."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.held = 0
        self.at: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(lengths) - 1, -1, -1):  # the first of equal length comes out first
            self.put(int(lengths[i]), i, 0)

    def put(self, length: int, piece: int, start: int) -> None:
        self.at.setdefault(length, []).append((piece, start))
        self.held |= 1 << length

    def longest(self, limit: int | None = None) -> int:
        """The greatest length that waits, of those up to ``limit``; 0 when there is none."""
        held = self.held if limit is None else self.held & ((1 << (limit + 1)) - 1)
        return held.bit_length() - 1 if held else 0

    def take(self, length: int) -> tuple[int, int]:
        found = self.at[length].pop()
        if not self.at[length]:
            self.held &= ~(1 << length)
        return found


def pack_lengths(lengths: np.ndarray, tiers: Sequence[int] = TIERS) -> np.ndarray:
    """Parts of the pieces of one group as rows: piece, start in it, length, sequence, offset, tier of the window.

    Every window ends full but the last: while a window has room, some piece is put in whole or cut to its end.
    """
    parts: list[tuple[int, int, int, int, int, int]] = []
    pool, sequence = Pool(lengths), 0
    ordered = sorted(tiers)
    for window, below in reversed(list(zip(ordered, [0, *ordered]))):
        while pool.longest() > below:
            room = window
            size = pool.longest()
            while size:
                piece, start = pool.take(size)
                used = min(size, room)
                if used < size:
                    pool.put(size - used, piece, start + used)
                parts.append((piece, start, used, sequence, window - room, window))
                room -= used
                if not room:
                    break
                size = pool.longest(room)  # a shorter tier's, if it leaves an eighth of the gap at most
                if 8 * size < 7 * room:
                    size = pool.longest()
            sequence += 1
    return np.array(parts, dtype=np.int64).reshape(-1, 6)


def deal_steps(fill: np.ndarray, per_step: int = STEP_SEQUENCES) -> np.ndarray:
    """Step of each sequence: fullest first, back and forth over the steps, so that their sums stay close."""
    steps = max(1, -(-len(fill) // per_step))
    rank = np.empty(len(fill), dtype=np.int64)
    rank[np.argsort(-fill, kind="stable")] = np.arange(len(fill))
    turn, spot = rank // steps, rank % steps
    return np.where(turn % 2 == 0, spot, steps - 1 - spot)


def _pack_group(tiers: Sequence[int], per_step: int, with_ids: bool):
    longest = max(tiers)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "order", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = part["length"].to_numpy()
        piece, start, length, sequence, offset, tier = pack_lengths(lengths, tiers).T
        fill = np.bincount(sequence, weights=length).astype(np.int64)
        window = np.zeros(len(fill), dtype=np.int64)
        window[sequence] = tier
        # an open window is padded to the longest, unless its fill happens to be a power of two
        short = (fill < window) & ((fill & (fill - 1)) != 0)
        window[short] = longest
        base = int(part["group"].iloc[0]) << 32
        step, steps = np.zeros(len(fill), dtype=np.int64), 0
        for t in sorted(tiers):
            mine = np.flatnonzero(window == t)
            if len(mine):
                step[mine] = steps + deal_steps(fill[mine], per_step * longest // t)
                steps = step[mine].max() + 1
        out = part.iloc[piece].drop(columns=["group", "order"])
        cut = length < lengths[piece]
        ids, crcs = part["ids"].to_list(), part["ids_crc32"].to_numpy()[piece]
        if with_ids or cut.any():
            whole: dict[int, bytes] = {}
            own = []
            for i, (p, at, n, c) in enumerate(zip(piece, start, length, cut)):
                if with_ids or c:
                    if p not in whole:
                        whole[p] = widen(ids[p], int(lengths[p]))
                    own.append(whole[p][4 * at : 4 * (at + n)])
                    crcs[i] = zlib.crc32(own[-1])
            if with_ids:
                out["ids"] = own
        if not with_ids:
            out = out.drop(columns="ids")
        return out.assign(
            start=out["start"].to_numpy() + start,
            length=length,
            ids_crc32=crcs,
            sequence_id=base + sequence,
            offset=offset,
            tier=window[sequence].astype(np.int32),
            step=base + step[sequence],
        )

    return pack


def pack_documents(
    docs: DataFrame,
    tiers: Sequence[int] = TIERS,
    tokenizer: str = TOKENIZER,
    pieces_per_group: int = PIECES_PER_GROUP,
    per_step: int = STEP_SEQUENCES,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tier`` is the context length the sequence belongs to, ``step`` the balanced step of that tier it is dealt to
    (``per_step`` of the longest tier hold as many ids as a step of a shorter one), and ``with_ids`` adds the piece's ids. A null or empty text is one piece that holds the end id. Rows that repeat an id
    are packed each; a null id is kept. Other columns are not read; an empty table gives an empty result. Pieces and
    groups depend on the rows alone, so a rerun packs alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # a group needs the ids of what it may cut; a whole window travels without them unless they are wanted
    made = cut_pieces(rows, tiers, tokenizer, with_ids=True)
    with arrow_rows(docs.sparkSession, ROWS):
        pieces = stage(made if with_ids else made.withColumn("ids", F.when(F.col("length") < max(tiers), F.col("ids"))))
    groups = max(1, -(-pieces.count() // pieces_per_group))
    order = F.xxhash64("doc_id", "start", "ids_crc32")
    keyed = pieces.withColumns({"doc_id": F.col("doc_id").cast("string"), "order": order, "group": F.pmod(order, F.lit(groups))})
    kept = [f"{n} {t}" for n, t in keyed.dtypes if n not in ("order", "group", *([] if with_ids else ["ids"]))]
    schema = ", ".join([*kept, "sequence_id bigint", "offset bigint", "tier int", "step bigint"])
    packed = keyed.groupBy("group").applyInPandas(_pack_group(tiers, per_step, with_ids), schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(dict(pieces.dtypes)["doc_id"]))  # a null id is no number in pandas


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack_documents(with_ids=True)``: sequence_id, step, tier, ids, pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length")))
    grouped = packed.groupBy("sequence_id").agg(F.first("step").alias("step"), F.first("tier").alias("tier"), parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select(
        "sequence_id", "step", "tier", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"])).alias("pieces")
    )


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder))
