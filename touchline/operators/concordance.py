"""Concordance of a risk score with censored times, exact, with its standard error.

A pair is comparable when the earlier member is an event; at equal times an event comes before a censored row
and two events are not comparable. Put every row on an integer line: twice the rank of its time, plus one when
censored. Then row i (an event) is comparable with row j exactly when j stands further right.

Counting, for every row, its partners with lower, equal and higher score is done bit by bit. Two positions that
differ have one highest bit where they differ: there the left one has 0, the right one 1, and all higher bits
agree. So each row is copied once per bit, groups are (bit, higher bits), and inside a group two running counts
along the score settle all pairs that part at this bit. The number of copies is the bit length of the number of
distinct times (7 for the minutes of a match), and no pair is ever written out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.describe import rows_of
from touchline.operators.joins import keyed_join
from touchline.operators.ordered import Order, Step
from touchline.operators.reshape import number_rows
from touchline.operators.staging import stage


@dataclass
class Concordance:
    concordant: float
    discordant: float
    tied_score: float
    value: float
    std_error: float


def concordance(
    df: DataFrame, time: str, event: str, score: str, small_rows: int | None = None, weight: str | None = None
) -> Concordance:
    """Share of comparable pairs where the row with the earlier event has the higher score, ties one half.

    The error is the infinitesimal jackknife: the root of the summed squares of each row's influence.
    """
    rows = df.select(
        F.col(time).cast("double").alias("time"),
        F.col(event).cast("int").alias("e"),
        F.col(score).cast("double").alias("score"),
        rows_of(weight).alias("w"),
    ).dropna()
    cells = stage(rows.groupBy("time", "e", "score").agg(F.sum("w").alias("w")))
    return concordance_of_cells(cells, small_rows)


def concordance_of_cells(cells: DataFrame, small_rows: int | None = None) -> Concordance:
    """The same for rows (time, e, score) that stand for ``w`` equal rows each."""
    ranks = stage(number_rows(cells, "time"))
    placed = stage(
        keyed_join(cells, ranks, ["time"], "inner").select((F.col("position") * 2 + (1 - F.col("e"))).alias("pos"), "e", "score", "w")
    )
    top = placed.agg(F.max("pos")).first()[0]
    if top is None:
        raise ValueError("no complete row")
    bits = F.sequence(F.lit(0), F.lit(int(top).bit_length() - 1))
    copies = placed.select("*", F.explode(bits).alias("bit")).select(
        "pos",
        "score",
        "w",
        "e",
        "bit",
        F.expr("shiftright(pos, bit + 1)").alias("head"),
        (F.expr("shiftright(pos, bit)").bitwiseAND(F.lit(1).cast("bigint")) == 1).alias("right"),
    )
    w = F.col("w")
    steps = stage(
        copies.groupBy("bit", "head", "score").agg(
            F.sum(F.when(F.col("right"), w).otherwise(0)).alias("later"),
            F.sum(F.when(~F.col("right") & (F.col("e") == 1), w).otherwise(0)).alias("early"),
        )
    )
    order = Order.of(steps, "score", ("bit", "head"), small_rows)
    both = Step({"later_upto": "later", "early_upto": "early"}, totals={"later_all": "later", "early_all": "early"})
    ladder = order.scan(steps, both)
    # a row of the left half meets the right half; it is concordant with lower scores there.
    # a row of the right half meets the events of the left half; it is concordant with higher scores there.
    sides = ladder.select(
        "bit",
        "head",
        "score",
        F.struct(
            (F.col("later_upto") - F.col("later")).alias("good"),
            F.col("later").alias("same"),
            (F.col("later_all") - F.col("later_upto")).alias("bad"),
        ).alias("as_left"),
        F.struct(
            (F.col("early_all") - F.col("early_upto")).alias("good"),
            F.col("early").alias("same"),
            (F.col("early_upto") - F.col("early")).alias("bad"),
        ).alias("as_right"),
    )
    # only the rows that take part in pairs at this bit look their counts up: events on the left, all on the right.
    # `sides` has one row per key; a score shared by many rows makes a hot key on the left only, which the
    # adaptive skew join splits
    wanted = copies.where(F.col("right") | (F.col("e") == 1)).select("pos", "score", "w", "bit", "head", "right")
    met = F.when(F.col("right"), F.col("as_right")).otherwise(F.col("as_left"))
    per_row = (
        wanted.join(sides, ["bit", "head", "score"])
        .select("pos", "score", "w", met.alias("m"))
        .groupBy("pos", "score")
        .agg(
            F.first("w").alias("w"),
            F.sum(F.col("m.good")).alias("good"),
            F.sum(F.col("m.same")).alias("same"),
            F.sum(F.col("m.bad")).alias("bad"),
        )
    )
    per_row = stage(per_row.select(*[F.col(c).cast("double").alias(c) for c in ("w", "good", "same", "bad")]))
    # each pair was seen from both ends
    tot = per_row.agg(*[(F.sum(F.col("w") * F.col(c)) / 2).alias(c) for c in ("good", "same", "bad")]).first()
    good, same, bad = (tot[c] or 0.0 for c in ("good", "same", "bad"))
    pairs = good + same + bad
    if not pairs:
        return Concordance(0.0, 0.0, 0.0, math.nan, math.nan)
    value = (good + same / 2) / pairs
    pull = F.col("good") + F.col("same") / 2 - F.lit(value) * (F.col("good") + F.col("same") + F.col("bad"))
    spread = per_row.agg(F.sum(F.col("w") * pull * pull)).first()[0]
    return Concordance(good, bad, same, value, math.sqrt(spread) / pairs)
