"""The driver's tables read as a league: nations are teams, line items are matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.staging import spread, stage
from touchline.plans.frames import duration_frame, outcome_frame

# Fixed values of this reading of the tables.
CUTOFF = "1998-04-17"
HORIZON = 50
SAFE = 22
SHORT_KM = 3000.0
PROMOTED = ["NATION_7", "NATION_8", "NATION_12"]
PROMOTED_LATER = ["NATION_2", "NATION_9"]  # left out of the season that is scored


# The columns used and their types. A declared schema saves a footer read per table and query.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_discount double, l_tax double, l_returnflag string",
    "events": "user_id bigint, ts timestamp_ntz, event_type string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def all_standings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation with a position by mean account balance. Stored once: the frames look it up often."""
    per_nation = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(
            F.avg("c_acctbal").alias("mean_balance"),
            F.count(F.lit(1)).alias("gf"),
            F.count_if(F.col("c_mktsegment") == "BUILDING").alias("ga"),
        )
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    # one row per nation is all this window sees
    place = Window.orderBy(F.col("mean_balance").desc(), "n_nationkey")
    return stage(
        per_nation.select(
            F.col("n_name").alias("team"),
            F.row_number().over(place).cast("bigint").alias("position"),
            F.round(F.col("mean_balance") / 100).cast("bigint").alias("pts"),
            (F.col("gf") - F.col("ga")).alias("gd"),
            "gf",
            "ga",
        )
    )


def standings(spark: SparkSession, sf: str) -> DataFrame:
    return all_standings(spark, sf).where(F.col("position") <= SAFE)


def venues(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("double")
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("team"), (F.lit(-50.0) + 4 * key).alias("lat"), (F.lit(-150.0) + 12 * key).alias("long")
    )


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: date, home and away nation, result code and first-goal minutes."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    homes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"))
    aways = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("away"))
    # both sides get their names before they meet the line items: what a filter on sides leaves out never gets there
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(homes, "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    hosted = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "home")
    guests = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(aways, "s_nationkey").select("s_suppkey", "away")
    named = (
        spread(table(spark, sf, "lineitem"), "l_orderkey")
        .join(hosted, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(guests, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return named.select(
        "l_orderkey",
        "l_linenumber",
        F.col("o_orderdate").cast("date").alias("date"),
        "home",
        "away",
        F.when(F.col("l_returnflag") == "R", "H").when(F.col("l_returnflag") == "N", "D").otherwise("A").alias("ftr"),
        F.when(F.col("l_discount") < 0.075, F.col("l_quantity").cast("int")).alias("fhg"),
        F.when(F.col("l_tax") < 0.055, F.col("p_size")).alias("fag"),
    )


def outcomes(spark: SparkSession, sf: str, grouped: bool = False, promoted: Sequence[str] = tuple(PROMOTED)) -> DataFrame:
    """Outcome frame. Every nation plays at home, so the venue list needs no pass over the matches."""
    return outcome_frame(
        matches(spark, sf),
        standings(spark, sf),
        venues(spark, sf),
        promoted,
        CUTOFF,
        SHORT_KM,
        venues_of_home_teams=False,
        grouped=grouped,
    )


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome frame as counts of equal matches, in column ``n``."""
    return outcomes(spark, sf, grouped=True)


def durations(spark: SparkSession, sf: str, grouped: bool = False) -> DataFrame:
    return duration_frame(matches(spark, sf), standings(spark, sf), PROMOTED, CUTOFF, HORIZON, grouped=grouped)


def duration_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The duration frame as counts of equal side rows, in column ``n``, stored for repeated reading."""
    return stage(durations(spark, sf, grouped=True))


def purchase_times(spark: SparkSession, sf: str) -> DataFrame:
    """Second reading: minutes of a user's day until the first purchase, censored at midnight.

    One is added so that a purchase in the first minute has a time above zero.
    """
    events = table(spark, sf, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min(F.when(F.col("event_type") == "purchase", minute)).alias("first_minute"),
        F.count(F.lit(1)).alias("actions"),
        F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("signed_up"),
    )
    return days.select(
        "user_id",
        "day",
        "actions",
        F.when(F.col("signed_up") == 1, "Yes").otherwise("No").alias("signup"),
        F.coalesce(F.col("first_minute") + 1, F.lit(1441)).alias("minute"),
        F.col("first_minute").isNotNull().cast("int").alias("bought"),
    )
