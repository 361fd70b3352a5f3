"""Approximate nearest neighbours by stable projections in a kd-tree.

Unit vectors are projected to ``DIMS`` dimensions with a Gaussian matrix. The squared projected distance over the
squared distance is chi-square with ``DIMS`` degrees of freedom, so once the nearest projected point not yet seen lies
further than the chi-square quantile times the squared distance of the k-th neighbour found, a closer one is unlikely
to be left and the search ends.

A kd-tree over the projections, fitted on a bounded sample, deals all vectors to cells; inside a task each cell is cut
down to small leaves by the same rule. A query visits cells and leaves by falling nearness of their boxes, verifies
what they hold on the original vectors and stops by the test. Across tasks this goes in waves: the nearest cell, a few
more, then every cell that the test does not rule out.

Equal vectors are searched once: a distinct vector carries its k + 1 smallest ids, which is all an answer can show.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents
from touchline.operators.staging import stage

DIMS = 8
NEAREST = 5
CONFIDENCE = 0.9
SAMPLE = 20_000
CELL_ROWS = 2_000
MOST_CELLS = 1_024
LEAF_ROWS = 64
WAVES = (1, 8, MOST_CELLS)
QUERIES_PER_BLOCK = 20_000
BEST = "array<struct<minus:double,rep:bigint,ids:array<bigint>>>"


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """Quantile for an even number of degrees of freedom, by halving on the closed form."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def gaussian(size: int, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (size, dims))


# ---------------------------------------------------------------- kd-tree


def split_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits (dimension, threshold) of a complete binary tree in breadth-first order: widest dimension at its median."""
    nodes, level = [], [points]
    for _ in range(depth):
        below = []
        for part in level:
            if len(part) < 2:
                nodes.append((0, math.inf))
                below += [part, part[:0]]
                continue
            dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            at = float(np.median(part[:, dim]))
            nodes.append((dim, at))
            below += [part[part[:, dim] <= at], part[part[:, dim] > at]]
        level = below
    return nodes


def cell_of(points: np.ndarray, nodes: Sequence[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    dims, cuts = np.array([n[0] for n in nodes] or [0]), np.array([n[1] for n in nodes] or [0.0])
    rows = np.arange(len(points))
    for _ in range(depth):
        at = 2 * at + 1 + (points[rows, dims[at]] > cuts[at])
    return at - (2**depth - 1)


def leaves_of(points: np.ndarray, size: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of the leaves of a cell, each of at most ``size`` rows."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = points[rows]
        dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(part[:, dim], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of one projected point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=-1)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64)


def squared(minus: float) -> float:
    """Squared distance of unit vectors from minus their cosine."""
    return max(2 + 2 * minus, 0.0)


def _search_cell(k: int, quantile: float):
    """Verify the vectors of one cell for the queries that visit it: query, best (k + 1 distinct vectors at most)."""

    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=object)})
        own, projected = matrix(vectors["embedding"]), matrix(vectors["projected"])
        norms = np.sqrt((own * own).sum(axis=1))
        reps = vectors["rep"].to_numpy()
        ids = vectors["ids"].tolist()
        leaves = leaves_of(projected)
        low, high = (np.array([f(projected[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
        out = []
        for emb, proj, bound in zip(queries["embedding"], queries["projected"], queries["bound"]):
            q = np.asarray(emb, dtype=np.float64)
            norm = np.sqrt(q @ q)
            away = box_distance(np.asarray(proj), low, high)
            limit = math.inf if bound is None or math.isnan(bound) else bound
            scores, at = np.empty(0), np.empty(0, dtype=np.int64)
            for leaf in np.argsort(away, kind="stable"):
                if away[leaf] > quantile * limit:
                    break
                rows = leaves[leaf]
                scores = np.concatenate([scores, (own[rows] @ q) / (norms[rows] * norm)])
                at = np.concatenate([at, rows])
                if len(at) > k + 1:
                    top = np.lexsort((reps[at], -scores))[: k + 1]
                    scores, at = scores[top], at[top]
                    limit = min(limit, squared(-scores[-1]))
            out.append([{"minus": -float(s), "rep": int(reps[r]), "ids": [int(i) for i in ids[r]]} for s, r in zip(scores, at)])
        return pd.DataFrame({"query": queries["query"].to_numpy(), "best": out})

    return search


# ---------------------------------------------------------------- tables


def usable(embedding: Column) -> Column:
    """Not null, not empty, every component a finite number, not all of them zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """One row per distinct vector: embedding, rep (its smallest id) and its k + 1 smallest ids."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)  # cut before the shuffle, too
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "embedding")


def _projected(rows: DataFrame, matrix_: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def project(part: pd.Series) -> pd.Series:
        if not len(part):
            return pd.Series([], dtype=object)
        v = matrix(part)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        return pd.Series(list(v @ matrix_))

    return rows.withColumn("projected", project("embedding"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    confidence: float = CONFIDENCE,
    dims: int = DIMS,
    sample: int = SAMPLE,
    cell_rows: int = CELL_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k vectors of largest cosine found for each query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``. The tree's cells are fitted on ``sample`` vectors at most
    (those of smallest id hash); every vector is indexed. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do rows with a null id. Each length of vectors is searched by itself: a
    query's candidates are the vectors of its own length, and ``sample`` holds per length. An id that stands on vectors
    of several lengths gets the answers of each. Ties go to the smaller id; rows that repeat id and vector count once.
    Empty tables give an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    size = F.size("embedding")
    asked = rows.groupBy(size.alias("size")).agg(F.max(F.coalesce(is_query, F.lit(False))).alias("asked")).where("asked").orderBy("size").collect()
    found = [_of_one_length(rows.where(size == r["size"]).distinct(), r["size"], is_query, k, confidence, dims, sample, cell_rows) for r in asked]
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _of_one_length(rows: DataFrame, size: int, is_query: Column, k: int, confidence: float, dims: int, sample: int, cell_rows: int) -> DataFrame:
    """Answers among distinct rows (vec_id, embedding) of one vector length."""
    flat = stage(_projected(distinct_vectors(rows, k), gaussian(size, dims)))
    total = flat.count()
    depth = max(0, min(int(math.log2(MOST_CELLS)), math.ceil(math.log2(max(1, total / cell_rows)))))
    points = flat.orderBy(F.xxhash64("rep")).limit(sample).select("projected").collect()
    nodes = split_tree(np.array([p["projected"] for p in points]), depth)

    @F.pandas_udf("int")
    def cell(part: pd.Series) -> pd.Series:
        return pd.Series(cell_of(matrix(part), nodes, depth) if len(part) else [], dtype="int32")

    placed = stage(flat.withColumn("cell", cell("projected")))
    sides = [f([F.col("projected")[d] for d in range(dims)][i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))]
    boxes = placed.groupBy("cell").agg(*sides).orderBy("cell").collect()  # one row per cell, MOST_CELLS at most
    low = np.array([[b[f"l{i}"] for i in range(dims)] for b in boxes])
    high = np.array([[b[f"h{i}"] for i in range(dims)] for b in boxes])
    numbers = [b["cell"] for b in boxes]
    quantile = chi_square_quantile(confidence, dims)

    asked = stage(rows.where(is_query).join(placed.select("rep", "embedding", "projected"), "embedding"))
    state = stage(
        asked.dropDuplicates(["rep"]).select(F.col("rep").alias("query"), "embedding", "projected", F.lit(None).cast(BEST).alias("best"))
    )
    blocks = max(1, -(-state.count() // QUERIES_PER_BLOCK))
    done = 0
    for upto in WAVES:
        first, last = done, min(upto, len(numbers))
        if first >= last:
            break
        done = last
        state = _wave(state, placed, low, high, numbers, quantile, k, first, last, blocks)
    return _expand(asked, state, k)


def _wave(state, placed, low, high, numbers, quantile, k, first, last, blocks) -> DataFrame:
    """Visit the cells of nearness ``first`` to ``last`` that the stopping test leaves, and merge what they hold."""
    bound = F.when(F.size("best") > k, F.greatest(2 + 2 * F.element_at("best", -1)["minus"], F.lit(0.0)))

    @F.pandas_udf("array<int>")
    def visits(projected: pd.Series, bounds: pd.Series) -> pd.Series:
        out = []
        for p, b in zip(projected, bounds):
            away = box_distance(np.asarray(p), low, high)
            order = np.argsort(away, kind="stable")[first:last]
            limit = math.inf if b is None or math.isnan(b) else quantile * b
            out.append([numbers[c] for c in order if away[c] <= limit])
        return pd.Series(out)

    going = state.withColumn("bound", bound).withColumn("cell", F.explode(visits("projected", "bound")))
    going = going.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    held = placed.select("cell", "rep", "ids", "embedding", "projected").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    left = going.select("cell", "block", "query", "embedding", "projected", "bound").groupBy("cell", "block")
    found = left.cogroup(held.groupBy("cell", "block")).applyInPandas(_search_cell(k, quantile), f"query bigint, best {BEST}")
    merged = found.select("query", F.explode("best").alias("b")).unionByName(state.select("query", F.explode("best").alias("b")))
    tops = merged.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("b")), 1, k + 1).alias("best"))
    return stage(state.drop("best").join(tops, "query", "left"))


def _expand(asked: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Answers of the distinct vectors, turned into rows for every query id: copies side by side, the query left out."""
    answers = state.select(F.col("query").alias("rep"), "best")
    each = F.flatten(F.transform("best", lambda b: F.transform(b["ids"], lambda i: F.struct(b["minus"].alias("minus"), i.alias("id")))))
    others = F.slice(F.array_sort(F.filter(each, lambda s: s["id"] != F.col("query_id"))), 1, k)
    rows = asked.select(F.col("vec_id").alias("query_id"), "rep").join(answers, "rep")
    return rows.select("query_id", F.posexplode(others).alias("rank", "s")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("s.id").alias("vec_id"), (-F.col("s.minus")).alias("score")
    )


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(documents(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
