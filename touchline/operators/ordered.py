"""Running sums, neighbours and exact quantiles over a totally ordered key, without a one-partition window.

All functions work on a table that has at most one row per (strata, key): group first. Up to ``SMALL_ROWS``
rows one ordinary window per stratum does the job. Above, the key range is cut at approximate quantiles into
buckets, the windows run inside (strata, bucket), and each bucket gets the total of the buckets before it.
The cut points are constants, so a recomputed task puts every row into the same bucket again.

Sums that depend on each other (those at risk, then the survival made from them) are steps of one scan. One aggregate
gives a step's totals per bucket. The next step's windows share the partitioning of the last one's, so a step costs one
shuffle at most and what comes out reads the rows once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.staging import stage

SMALL_ROWS = 200_000
ROWS_PER_BUCKET = 500_000
BUCKET = "_bucket"
#: Rows of a table of bucket totals that is broadcast.
FEW_BUCKETS = 20_000


@dataclass(frozen=True)
class Step:
    """What one step of a scan adds: running sums of SQL expressions up to and with each row, sums over the whole
    stratum, and the next key of the stratum (null on its last row)."""

    sums: Mapping[str, str]
    descending: bool = False
    totals: Mapping[str, str] = field(default_factory=dict)
    following: str | None = None


@dataclass(frozen=True)
class Order:
    """How one key is ordered: the strata, the key and, for large tables, the bucket cut points."""

    key: str
    strata: tuple[str, ...] = ()
    cuts: tuple[float, ...] | None = None

    @staticmethod
    def of(table: DataFrame, key: str, strata: Sequence[str] = (), small_rows: int | None = None) -> Order:
        """Choose the layout for a table that is cheap to read: once for its size, twice when it is large."""
        limit = SMALL_ROWS if small_rows is None else small_rows
        rows = table.count()
        if rows <= limit:
            return Order(key, tuple(strata))
        parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parts, math.ceil(rows / ROWS_PER_BUCKET), 2)
        probs = [i / buckets for i in range(1, buckets)]
        found = table.select(F.col(key).cast("double").alias(key)).approxQuantile(key, probs, 1 / (4 * buckets))
        return Order(key, tuple(strata), tuple(sorted(set(found))))

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the bucket column when the layout has one and the table does not have it yet."""
        if self.cuts is None or BUCKET in df.columns:
            return df
        cutter = Bucketizer(
            splits=[-math.inf, *self.cuts, math.inf], inputCol="_bucket_key", outputCol=BUCKET, handleInvalid="error"
        )
        placed = cutter.transform(df.withColumn("_bucket_key", F.col(self.key).cast("double"))).drop("_bucket_key")
        return placed.withColumn(BUCKET, F.col(BUCKET).cast("int"))

    def _groups(self) -> list[str]:
        return [*self.strata] if self.cuts is None else [*self.strata, BUCKET]

    @staticmethod
    def _over(groups: Sequence[str], order: str = "", frame: str = "") -> str:
        by = "PARTITION BY " + ", ".join(f"`{g}`" for g in groups) if groups else ""
        return f"OVER ({by} {order} {frame})"

    @staticmethod
    def _quoted(names: Sequence[str]) -> list[str]:
        return [f"`{n}`" for n in names]

    def scan(self, table: DataFrame, *steps: Step) -> DataFrame:
        """Add the columns of the steps to a stored table, or one that is cheap to make from such.

        In the layout with buckets the small tables of totals are made at once; the result is not computed yet.
        """
        if self.cuts is None:
            return reduce(self._whole, steps, table)
        source = self.assign(table)
        rows = self._inside(source, steps[0])
        for i, step in enumerate(steps):
            rows = self._onto(rows, self._carried(source, step), step)
            if i + 1 < len(steps):
                source = rows = stage(self._inside(rows, steps[i + 1]))
        return rows

    def _along(self, groups: Sequence[str], key: str, step: Step, frame: str) -> str:
        return self._over(groups, f"ORDER BY `{key}` {'DESC' if step.descending else 'ASC'}", frame)

    def _whole(self, df: DataFrame, step: Step) -> DataFrame:
        over = self._along(self.strata, self.key, step, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        new = [f"sum({e}) {over} AS `{n}`" for n, e in step.sums.items()]
        new += [f"sum({e}) {self._over(self.strata)} AS `{n}`" for n, e in step.totals.items()]
        if step.following:
            new.append(f"lead(`{self.key}`) {self._over(self.strata, f'ORDER BY `{self.key}`')} AS `{step.following}`")
        return df.selectExpr("*", *new)

    def _inside(self, df: DataFrame, step: Step) -> DataFrame:
        """Sums and next keys inside the buckets."""
        groups = self._groups()
        over = self._along(groups, self.key, step, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        new = [f"sum({e}) {over} AS `_in_{n}`" for n, e in step.sums.items()]
        if step.following:
            new.append(f"lead(`{self.key}`) {self._over(groups, f'ORDER BY `{self.key}`')} AS _lead")
        return df.selectExpr("*", *new)

    def _carried(self, df: DataFrame, step: Step) -> DataFrame:
        """Per bucket: the sums of those before it in the stratum, the stratum's totals, the first key of the next."""
        groups = self._groups()
        sums = [F.expr(f"sum({e}) AS `_t_{n}`") for n, e in step.sums.items()]
        sums += [F.expr(f"sum({e}) AS `_t_{n}`") for n, e in step.totals.items()]
        per_bucket = df.groupBy(*groups).agg(F.min(self.key).alias("_first"), *sums)
        before = self._along(self.strata, BUCKET, step, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
        new = [f"sum(`_t_{n}`) {before} AS `_o_{n}`" for n in step.sums]
        new += [f"sum(`_t_{n}`) {self._over(self.strata)} AS `{n}`" for n in step.totals]
        if step.following:
            new.append(f"lead(_first) {self._over(self.strata, f'ORDER BY {BUCKET}')} AS _next_first")
        carried = stage(per_bucket.selectExpr(*self._quoted(groups), *new))
        return F.broadcast(carried) if carried.count() <= FEW_BUCKETS else carried

    def _onto(self, df: DataFrame, carried: DataFrame, step: Step) -> DataFrame:
        made = [*(f"_in_{n}" for n in step.sums), *(["_lead"] if step.following else [])]
        kept = [c for c in df.columns if c not in made]
        # a bucket whose own or earlier values are all null adds nothing; null only where both are
        new = [f"CASE WHEN `_in_{n}` IS NULL THEN `_o_{n}` ELSE `_in_{n}` + coalesce(`_o_{n}`, 0) END AS `{n}`" for n in step.sums]
        new += self._quoted([*step.totals])
        if step.following:
            new.append(f"coalesce(_lead, _next_first) AS `{step.following}`")
        return df.join(carried, self._groups()).selectExpr(*self._quoted(kept), *new)


def quantiles_of_counts(
    ranked: DataFrame, value: str, n: str, upto: str, total: int, probs: Sequence[float]
) -> list[float]:
    """Type-7 quantiles from a table of distinct values with counts and running counts.

    Only the rows that hold a wanted rank come back, at most two per probability.
    """
    spots = [(total - 1) * p for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    wanted = F.array(*[F.lit(r).cast("bigint") for r in ranks])
    held = F.filter(wanted, lambda r: (r < F.col(upto)) & (r >= F.col(upto) - F.col(n)))
    rows = ranked.select(F.col(value).alias("v"), F.explode(held).alias("r")).collect()
    at = {row["r"]: row["v"] for row in rows}
    out = []
    for s in spots:
        lo, hi = at[math.floor(s)], at[math.ceil(s)]
        out.append(lo + (hi - lo) * (s - math.floor(s)))
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Stored counts per distinct value: columns v and n. Nulls and NaN have no place in an order and are left out."""
    value = F.col(col).cast("double")
    groups = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v"))
    return stage(groups.agg(F.count(F.lit(1)).alias("n")))


def quantiles(counts: DataFrame, probs: Sequence[float], value: str = "v", n: str = "n", small_rows: int | None = None) -> list[float]:
    """Type-7 quantiles of a stored table with one row per distinct value and its count; empty without rows."""
    total = counts.agg(F.sum(n)).first()[0]
    if not total:
        return []
    order = Order.of(counts, value, small_rows=small_rows)
    ranked = order.scan(counts, Step({"_upto": f"`{n}`"}))
    return quantiles_of_counts(ranked, value, n, "_upto", int(total), probs)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], small_rows: int | None = None) -> list[float]:
    """Quantiles of a column by linear interpolation between order statistics (type 7), nulls and NaN left out."""
    return quantiles(value_counts(df, col), probs, small_rows=small_rows)


def bin_by_cuts(col: Column, cuts: Sequence[float]) -> Column:
    """1-based bin of a value for sorted distinct cuts: right-closed, the lowest value belongs to bin 1."""
    number = F.lit(1)
    for c in cuts[1:-1]:
        number = number + (col > F.lit(c)).cast("int")
    return F.when(col.isNull() | (col < cuts[0]) | (col > cuts[-1]), F.lit(None)).otherwise(number)


def equal_count_cuts(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def with_bins(df: DataFrame, col: str, found: Sequence[float], name: str) -> tuple[DataFrame, list[float]]:
    """Bin numbers for quantile cut points; equal cut points are merged. Returns the frame and the cuts used."""
    cuts = sorted(set(found))
    number = bin_by_cuts(F.col(col), cuts) if cuts else F.lit(None).cast("int")
    return df.withColumn(name, number), cuts


def quantile_bins(
    df: DataFrame, col: str, bins: int, name: str, small_rows: int | None = None
) -> tuple[DataFrame, list[float]]:
    """Equal-count bins of a column."""
    return with_bins(df, col, exact_quantiles(df, col, equal_count_cuts(bins), small_rows), name)
