"""Row reshaping: one match to two side rows, picks by position, value grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import Order, Step
from touchline.operators.staging import stage


def two_sided(
    df: DataFrame,
    home: str = "home",
    away: str = "away",
    home_time: str = "fhg",
    away_time: str = "fag",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Two rows per match, one seen from each side: ref, adv, loc, time and the kept columns. One scan."""

    def view(ref: str, adv: str, loc: str, time: str) -> Column:
        return F.struct(F.col(ref).alias("ref"), F.col(adv).alias("adv"), F.lit(loc).alias("loc"), F.col(time).alias("time"))

    both = F.explode(F.array(view(home, away, "Home", home_time), view(away, home, "Away", away_time)))
    return df.select(*keep, both.alias("_side")).select("_side.*", *keep)


TOP_ROWS = 10_000
RANGE_ROWS = 1_000_000


def pick_positions(df: DataFrame, order_by: Sequence[str], positions: Sequence[int], top_rows: int = TOP_ROWS) -> DataFrame:
    """Rows at the given 1-based positions of a stated order, with the position.

    Ties in ``order_by`` are settled by the other columns in their order, so a position names the same row whatever
    other positions are asked for. Positions up to ``top_rows`` need only the top of the order. Further in, the rows
    are stored by range of the order, about ``RANGE_ROWS`` each, and the ranges counted. Only those that hold a wanted
    position are read again and numbered; rows equal in every column may part between ranges, which changes nothing one
    could tell.
    """
    wanted = F.col("row").isin(list(positions))
    keys = [*order_by, *[c for c in df.columns if c not in order_by]]
    if max(positions) <= top_rows:
        top = df.orderBy(*keys).limit(max(positions))
        return top.withColumn("row", F.row_number().over(Window.orderBy(*keys)).cast("bigint")).where(wanted)
    stored_rows = stage(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored_rows.count() // RANGE_ROWS))
    ranged = stored_rows.withColumn("_in", F.spark_partition_id())
    stored = stage(ranged.repartitionByRange(parts, *keys, "_in").withColumn("_range", F.spark_partition_id()))
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = [(F.col("_start") < p) & (F.col("_start") + F.col("_n") >= p) for p in positions]
    # at most one range for each position asked for
    held = starts.where(reduce(or_, inside)).select("_range", "_start").collect()
    if not held:
        return stored.where(F.lit(False)).select(*df.columns, F.lit(0).cast("bigint").alias("row"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*keys, "_in"))
    start = F.create_map(*[F.lit(v) for r in held for v in (r["_range"], r["_start"])])[F.col("_range")]
    numbered = stored.where(F.col("_range").isin([r["_range"] for r in held])).withColumn("row", start + at)
    return numbered.where(wanted).select(*df.columns, "row")


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def value_grid(low: float, high: float, step: float, name: str, df: DataFrame) -> DataFrame:
    """Values low, low + step, ... not above high, built from whole steps so that nothing drifts."""
    spark = df.sparkSession
    count = int((high - low) / step + 1e-10) + 1
    return spark.range(count).select((F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias(name))


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Dense position of each distinct key value (1-based), for tables of any size."""
    keys = stage(df.select(key).distinct())
    order = Order.of(keys, key)
    return order.scan(keys, Step({"position": "1"})).select(key, "position")
