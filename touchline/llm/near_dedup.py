"""Near-duplicate documents by an inverted join of MinHash signatures.

Each distinct shingle set has a signature of ``COORDINATES`` minima. A pair counts as a candidate when at least
``MATCHES`` coordinates agree; a pair of Jaccard similarity 0.8 misses that with a chance of about one in 100,000. The
signature is a set of tokens, posted in an inverted index. A token is two neighbouring coordinates and their values: of
the 48, 40 unequal coordinates spoil 40 at most, so two documents with ``MATCHES`` coordinates in common have 8 tokens in
common (``needed``). Documents that share nothing but everyday words agree in many single coordinates when the table is
large, and hardly ever in two at once:

- tokens of one document only are skipped: a document with fewer than 8 shared tokens has no partner;
- of the n shared tokens, in rising document count, only the first n - 7 are posted (prefix): two documents with 8
  tokens in common meet in one of these lists, and what a third of all documents share is hardly ever in one;
- lists are merged without writing all pairs of a list. In a few rounds every member meets the list's hub, another
  one each round, and confirmed links are contracted to components: a group of thousands of near copies collapses
  here. Then the lists that still hold several components are merged in blocks, members of one component skipping
  each other, and a pair is looked at in the first list it shares only.

Before full sets are made, the equal coordinates of a candidate are counted on one byte of each, and pairs below
``MATCHES`` go. They must agree in ``LEAST`` of ``SKETCH`` one-byte minima besides (in the blocks, in ``FIRST_LEAST`` of
the first ``FIRST`` before that), which a pair of similarity 0.8 fails once in 100,000 times. What is left is confirmed
on the full sets, which are made for the documents of such pairs only. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import documents, free_name, once, text_or_empty
from touchline.llm.components import components
from touchline.operators.staging import arrow_rows, stage, staged

SHINGLE = 2
PERCENT = 80
COORDINATES = 96
MATCHES = 56
SKETCH = 256
LEAST = 172
COUNTED = slice(0, SKETCH // COORDINATES * COORDINATES, SKETCH // COORDINATES)  # the coordinates among the sketch bytes
STARS = 5
HUB_LISTS = 8
FEW_LINKS = 50
FIRST, FIRST_LEAST = 64, 30
BLOCK = 1_000
BLOCK_KEYS = ["token", "low", "high"]
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 9
ROWS = 1_000  # texts or full sets that a task takes in at a time
TEXT_BYTES = 160_000  # texts that are cut into words together, so that these arrays stay in a core's cache
BLOCK_ROWS = 8_000  # rows of lists that are merged together
PAIRS = 1 << 14

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)


# ---------------------------------------------------------------- sets and signatures


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
STEP = np.uint64(0x100000001B3)


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of ``blob`` and where it starts; ``blob`` begins with one blank and ends with eight.

    A hash takes in the word's length and its bytes, eight at a time.
    """
    blank = BLANK[np.frombuffer(blob, dtype=np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(blob) - 7,), dtype="<u8", buffer=blob, strides=(1,))
    out = mixed(mixed(sizes.astype(np.uint64)) * STEP + (eight[starts] & LOW_BYTES[np.minimum(sizes, 8)]))
    at, longer = 8, np.flatnonzero(sizes > 8)
    while len(longer):
        left = sizes[longer] - at
        out[longer] = mixed(out[longer] * STEP + (eight[starts[longer] + at] & LOW_BYTES[np.minimum(left, 8)]))
        at, longer = at + 8, longer[left > 8]
    return out, starts


def folded(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * STEP + hashes[k : k + n])
    return out


def _sets_together(raw: list[bytes], size: int) -> Iterator[np.ndarray]:
    blob = b" " + b" ".join(raw).lower() + b" " * 8  # bytes: A-Z only, and blanks are those of the word rule
    words, starts = word_hashes(blob)
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    bounds = [*np.searchsorted(starts, np.cumsum(lengths + 1) - lengths).tolist(), len(words)]
    runs = folded(words, size)  # those that reach into the next text are passed over
    for at, upto in zip(bounds, bounds[1:]):
        own = runs[at : upto - size + 1] if upto - at >= size else folded(words[at:upto], max(upto - at, 1))
        own = np.sort(own)
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own


def shingle_sets(texts: Iterable[str], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a text of fewer words than ``size`` is one shingle."""
    held, total = [], 0
    for text in texts:
        held.append(text.encode())
        total += len(held[-1])
        if total >= TEXT_BYTES:
            yield from _sets_together(held, size)
            held, total = [], 0
    if held:
        yield from _sets_together(held, size)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of a set under each of ``SKETCH`` hash functions; half of them start from either half of a shingle."""
    best = np.full(SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    half = SKETCH // 2
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK, None]
        for start, x in ((0, part.astype(np.uint32)), (half, (part >> np.uint64(32)).astype(np.uint32))):
            own = slice(start, start + half)
            best[own] = np.minimum(best[own], (x * FACTORS[own] + SHIFTS[own]).min(axis=0))
    return best


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set, null when empty), signature and sketch of each row.

    The signature is the first ``COORDINATES`` minima, the sketch one byte of each of the ``SKETCH`` minima.
    """

    @F.pandas_udf("n_shingles bigint, set_key string, signature binary, sketch binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sizes, keys, signs, bytes_ = [], [], [], []
            for own in shingle_sets(batch, size):
                least = signature(own) if len(own) else None
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                signs.append(None if least is None else least[:: SKETCH // COORDINATES][:COORDINATES].tobytes())
                bytes_.append(None if least is None else (least >> np.uint32(7)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"n_shingles": sizes, "set_key": keys, "signature": signs, "sketch": bytes_})

    return docs.select("doc_id", sketch("text").alias("_s")).select("doc_id", "_s.*")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Sorted shingle hashes of the documents named in ``nodes``: node, shingles. The id list is broadcast while short."""
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = nodes.select(F.col("node").alias("doc_id"))
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["doc_id"], "shingles": [own.tobytes() for own in shingle_sets(batch["text"], size)]})

    return chosen.select("doc_id", "text").mapInPandas(make, "node bigint, shingles binary")


# ---------------------------------------------------------------- postings


def needed(matches: int) -> tuple[int, int]:
    """Coordinates a token has, and tokens that two signatures with ``matches`` equal coordinates have in common at least.

    Each unequal coordinate spoils one token. Where that could spoil all tokens of two, a token is one coordinate.
    """
    left = COORDINATES // 2 - (COORDINATES - matches)
    return (2, left) if left > 0 else (1, matches)


def prefixes(reps: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The tokens under which each node is posted: node, prefix. ``reps`` has node and signature.

    Nodes that cannot have a partner have no row.
    """
    wide, least = needed(matches)

    @F.pandas_udf("array<bigint>")
    def tokens(signs: pd.Series) -> pd.Series:
        values = np.frombuffer(b"".join(signs), dtype=np.dtype("<u8" if wide == 2 else "<u4")).reshape(len(signs), COORDINATES // wide)
        place = np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return pd.Series(list(mixed(values + place).view(np.int64)))

    posted = reps.select("node", F.explode(tokens("signature")).alias("token"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(counts, "token")
    own = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))  # a signature's tokens at most
    first = F.transform(F.slice("own", 1, F.size("own") - (least - 1)), lambda t: t["token"])
    return own.where(F.size("own") >= least).select("node", first.alias("prefix"))


def postings(prefix: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Lists that hold more than one component: token, node, component. Without labels, nodes are their own components."""
    posted = prefix.select("node", F.explode("prefix").alias("token"))
    if labels is None:
        return posted.withColumn("component", F.col("node"))
    named = posted.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = named.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return named.join(spans.where("_low <> _high").select("token"), "token")


def hub_pairs(posted: DataFrame, star: int) -> DataFrame:
    """Each list's members beside its hub, where their components differ: a < b.

    In the first round the hub is the node of least hash, which is the same in many lists; later ones draw a hub per list.
    """
    turn = F.xxhash64("node") if star == 0 else F.xxhash64("node", "token", F.lit(star))
    hubs = posted.groupBy("token").agg(F.min(F.struct(turn.alias("h"), "node", "component")).alias("hub"))
    beside = posted.join(hubs, "token").where(F.col("component") != F.col("hub.component"))
    return beside.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def retained(same: np.ndarray, matches: int, least: int) -> np.ndarray:
    """Which rows of equal sketch bytes have ``matches`` equal coordinates and ``least`` equal bytes at all."""
    return (same[:, COUNTED].sum(axis=1) >= matches) & (same.sum(axis=1) >= least)


def alike(pairs: DataFrame, nodes: DataFrame, matches: int = MATCHES, least: int = LEAST) -> DataFrame:
    """Pairs with at least ``matches`` equal coordinates and ``least`` equal sketch bytes; ``nodes`` has node and sketch."""

    @F.pandas_udf("boolean")
    def agreeing(one: pd.Series, two: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SKETCH) for s in (one, two))
        return pd.Series(retained(x == y, matches, least), dtype=bool)

    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("_x"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("_y"))
    return pairs.join(one, "a").join(two, "b").where(agreeing("_x", "_y")).select("a", "b")


def blocks_of(posted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of mixed lists in blocks: token, low, high, side, node, component, sketch, prefix.

    A list longer than ``BLOCK`` is cut into parts, and each pair of parts is a block of its own.
    """
    sizes = posted.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    held = posted.join(sizes, "token").withColumn("_part", part)
    placed = held.select("token", "node", "component", "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    return placed.select(
        "token",
        F.least("_part", "_other").alias("low"),
        F.greatest("_part", "_other").alias("high"),
        (F.col("_part") > F.col("_other")).cast("int").alias("side"),
        "node",
        "component",
    ).join(nodes.select("node", "sketch", "prefix"), "node")


def _by_block(work):
    """Runs ``work`` on each block of rows that are sorted by block; one block is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = held[BLOCK_KEYS]
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for at, upto in zip(starts, starts[1:]):
                yield from work(held.iloc[at:upto])
            held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield from work(held)

    return run


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, about ``BLOCK_ROWS`` at a time, without cutting a block."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = int((rows[BLOCK_KEYS] == rows[BLOCK_KEYS].iloc[-1]).all(axis=1).to_numpy().argmax())
            if last:
                yield rows.iloc[:last]
            held = [rows.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _beside(first: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row i beside each of the rows from first[i] to before upto[i], for all i: about ``PAIRS`` pairs at a time."""
    counts = np.maximum(upto - first, 0)
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = total[at] - counts[at]
        end = max(int(np.searchsorted(total, before + PAIRS, side="right")), at + 1)
        own = counts[at:end]
        one = np.repeat(np.arange(at, end), own)
        yield one, np.arange(len(one)) + np.repeat(first[at:end] - (total[at:end] - own - before), own)
        at = end


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For each row, the end of the run of rows with equal columns that it is in."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    change[-1:] = True
    for c in columns:
        change[:-1] |= c[1:] != c[:-1]
    ends = np.flatnonzero(change) + 1
    return np.repeat(ends, np.diff(ends, prepend=0))


def candidate_rows(token, low, high, side, component, signs: np.ndarray, matches: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike rows of one block and different components; rows are sorted by block, side and component.

    Members of one component are one run, and a row meets what stands behind its run. In a block of two parts the
    rows of one side meet those of the other.
    """
    block = _runs(token, low, high)
    apart = _runs(token, low, high, side)
    same = _runs(token, low, high, side, component)
    first = np.ascontiguousarray(signs[:, :FIRST])
    for one, two in _beside(np.where(low == high, same, apart), block):
        other = component[one] != component[two]
        one, two = one[other], two[other]
        # eight comparisons to a word, whose sum has the count of each byte's place
        equal = (first[one] == first[two]).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101) >> np.uint64(56)
        near = equal >= FIRST_LEAST
        one, two = one[near], two[near]
        keep = retained(signs[one] == signs[two], matches, least)
        yield one[keep], two[keep]


def _candidates(matches: int, least: int):
    """Members of a block that have alike members of other components: node and those partners (in one of the two)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_blocks(batches):
            rows = rows.sort_values([*BLOCK_KEYS, "side", "component"], kind="stable")
            signs = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), SKETCH)
            token, low, high, side, component, nodes = (rows[c].to_numpy() for c in (*BLOCK_KEYS, "side", "component", "node"))
            own, known = rows["prefix"].to_numpy(), {}

            def earlier(i: int) -> frozenset[int] | None:
                """Lists before this one that row i is in as well; None when the row's tokens don't have this one."""
                if i not in known:
                    x = np.asarray(own[i])
                    known[i] = frozenset(x[x < token[i]].tolist()) if (x == token[i]).any() else None
                return known[i]

            partners: dict[tuple[int, int, int, int], list[int]] = {}
            for ones, twos in candidate_rows(token, low, high, side, component, signs, matches, least):
                for i, j in zip(ones.tolist(), twos.tolist()):
                    a, b = earlier(i), earlier(j)
                    if a is not None and b is not None and a.isdisjoint(b):  # the first list that both are in
                        block = (int(token[i]), int(low[i]), int(high[i]))
                        partners.setdefault((*block, int(nodes[i])), []).append(int(nodes[j]))
                        partners.setdefault((*block, int(nodes[j])), [])
            if partners:
                yield pd.DataFrame([(*key, others) for key, others in partners.items()], columns=[*BLOCK_KEYS, "node", "partners"])

    return run


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def _confirmed(percent: int):
    """Links of a block, from its members' full sets and partners. A repeated id has several sets: any of them may link."""

    def work(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        distinct: dict[int, set[bytes]] = {}
        for n, x in zip(block["node"], block["shingles"]):
            distinct.setdefault(n, set()).add(x)
        sets = {n: [np.frombuffer(x, np.uint64) for x in own] for n, own in distinct.items()}
        links = []
        for n, others in dict(zip(block["node"], block["partners"])).items():
            links += [(min(n, m), max(n, m)) for m in others if any(similar(p, q, percent) for p in sets[n] for q in sets[m])]
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    return _by_block(work)


def cross_links(
    posted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, matches: int = MATCHES, least: int = LEAST, percent: int = PERCENT
) -> DataFrame:
    """Links between components, from all mixed lists, written: a < b.

    Candidates stay lists beside their members; the full sets come to the block, so no row is written for a pair that
    isn't a link.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "node")

    schema = "token bigint, low int, high int, node bigint, partners array<bigint>"
    with staged(dealt(blocks_of(posted, nodes)).mapInPandas(_candidates(matches, least), schema)) as found:
        sets = full_sets(docs, found.select("node").distinct(), size)
        return stage(dealt(found.join(sets, "node")).mapInPandas(_confirmed(percent), "a bigint, b bigint").distinct())


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union: a, b."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(one, "a").join(two, "b")
    # the shorter set bounds the intersection, the longer one the union
    small, large = F.least(F.octet_length("_a"), F.octet_length("_b")), F.greatest(F.octet_length("_a"), F.octet_length("_b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["_a"], batch["_b"])]
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return both.where(small * 100 >= large * percent).select("a", "b", "_a", "_b").mapInPandas(check, "a bigint, b bigint")


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_groups(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    matches: int = MATCHES,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by similar shingle sets: doc_id, n_shingles, component_id, kept, n_links.

    One row per input row. ``component_id`` is the smallest id that links reach, ``kept`` whether that is the row's
    own, ``n_links`` the number of confirmed links of its set to other sets (those the contraction did not make
    needless). Texts without words, empty or null, have an empty set and link with nothing; fewer words than ``size``
    are one shingle. A null id takes part only through other rows of an equal set. Rows that repeat an id with
    different texts are one node with the links of all. Other columns are not read; an empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        rows = stage(sketches(plain, size))
        lead = F.min(F.struct("doc_id", "signature", "sketch")).alias("lead")
        lettered = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        distinct = lettered.groupBy("set_key").agg(lead)
        reps = stage(distinct.select("set_key", F.col("lead.doc_id").alias("node"), F.col("lead.signature").alias("signature"), F.col("lead.sketch").alias("sketch")))
        prefix = prefixes(reps.select("node", "signature"), matches)
        with staged(prefix.join(reps.select("node", "sketch"), "node")) as nodes:
            found, labels, total = [], None, nodes.count()
            for star in range(STARS):
                # the longest lists of each node reach most of its group; what they leave is up to the blocks
                longest = nodes.select("node", F.slice("prefix", F.greatest(F.size("prefix") - HUB_LISTS + 1, F.lit(1)), HUB_LISTS).alias("prefix"))
                with staged(alike(hub_pairs(postings(longest, labels), star), nodes, matches, least)) as pairs:
                    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                    with staged(full_sets(plain, ends, size)) as sets:
                        found.append(stage(confirm(pairs, sets, percent)))
                new = found[-1].count()
                if new:
                    labels = stage(components(_all(found)))
                if new * FEW_LINKS < total:
                    break  # hubs find little more; the blocks look at all that is left
            found.append(cross_links(postings(nodes, labels), nodes, plain, size, matches, least, percent))
    links = _all(found)
    final = stage(components(links))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = reps.select("set_key", "node").join(final, "node", "left").join(ends, "node", "left")
    named = classes.select("set_key", F.coalesce("component", "node").alias("_component"), "n_links")
    joined = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("_component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_near_copies(
    docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One document of each group, with all columns: the one of smallest id, once where rows repeat id and text.

    Rows without an id stay, one of each text.
    """
    groups = near_groups(docs, size, percent, id_col=id_col, text_col=text_col, **options)
    who = free_name(docs, "_gone")
    gone = groups.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(who)).distinct()
    keys = docs.groupBy(F.col(id_col).alias("who"), F.sha2(text_or_empty(text_col), 256).alias("what")).count().where("count > 1")
    return once(docs.join(gone, docs[id_col] == F.col(who), "left_anti"), stage(keys), id_col, text_col)


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
)
SELECT r.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reach r JOIN sets s USING (doc_id) GROUP BY r.doc_id
"""
