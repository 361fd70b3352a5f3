"""Quality of a scored binary classifier: ROC table, area, thresholds, confusion statistics."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import if_else
from touchline.functions.tails import binomial_upper, chi_square_upper, exact_binomial_interval
from touchline.operators.describe import rows_of
from touchline.operators.ordered import Order, Step, quantiles_of_counts
from touchline.operators.staging import stage


@dataclass(frozen=True)
class RankedScores:
    """Distinct scores with their win and loss counts and the counts at or below, in score order."""

    table: DataFrame  # score, pos, neg, pos_upto, neg_upto, next_score
    positives: int
    negatives: int
    higher_wins: bool


def rank_scores(
    df: DataFrame, win: Column, score: str, small_rows: int | None = None, weight: str | None = None
) -> RankedScores:
    """Count wins and losses per distinct score and accumulate along the scores. Incomplete rows are left out.

    Direction: higher scores mean a win unless the median score of the losses is above that of the wins.
    """
    n = rows_of(weight)
    rows = df.select(F.col(score).cast("double").alias("score"), n.alias("n"), if_else(win, n, F.lit(0)).alias("y")).dropna()
    counts = stage(rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(F.col("n") - F.col("y")).alias("neg")))
    pos, neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos or not neg:
        raise ValueError("both classes are needed")
    order = Order.of(counts, "score", small_rows=small_rows)
    table = order.scan(counts, Step({"pos_upto": "pos", "neg_upto": "neg"}, following="next_score"))
    median = {
        side: quantiles_of_counts(table, "score", side, f"{side}_upto", int(total), [0.5])[0]
        for side, total in (("pos", pos), ("neg", neg))
    }
    return RankedScores(table, int(pos), int(neg), median["neg"] <= median["pos"])


def roc_table(ranked: RankedScores) -> DataFrame:
    """Threshold, sensitivity, specificity. Thresholds: minus infinity, midpoints of neighbouring scores, infinity.

    One row per distinct score gives the threshold above it; the lowest threshold is one extra row.
    """
    big_p, big_n = F.lit(float(ranked.positives)), F.lit(float(ranked.negatives))
    above = F.when(F.col("next_score").isNull(), F.lit(math.inf)).otherwise((F.col("score") + F.col("next_score")) / 2)
    low_wins = F.col("pos_upto") / big_p
    low_losses = F.col("neg_upto") / big_n
    bottom = ranked.table.sparkSession.range(1)
    if ranked.higher_wins:
        body = ranked.table.select(above.alias("threshold"), (1 - low_wins).alias("sensitivity"), low_losses.alias("specificity"))
        edge = bottom.select(F.lit(-math.inf).alias("threshold"), F.lit(1.0).alias("sensitivity"), F.lit(0.0).alias("specificity"))
    else:
        body = ranked.table.select(above.alias("threshold"), low_wins.alias("sensitivity"), (1 - low_losses).alias("specificity"))
        edge = bottom.select(F.lit(-math.inf).alias("threshold"), F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity"))
    return body.unionByName(edge)


def area_under_roc(ranked: RankedScores) -> DataFrame:
    """Probability that a win outscores a loss, ties counting one half, and the direction used."""
    wins_above = F.lit(ranked.positives) - F.col("pos_upto")
    good = F.sum(F.col("neg") * (wins_above.cast("double") + F.col("pos") / F.lit(2.0)))
    share = good / F.lit(float(ranked.positives) * float(ranked.negatives))
    area = share if ranked.higher_wins else 1 - share
    return ranked.table.agg(area.alias("auc")).withColumn("higher_score_wins", F.lit(ranked.higher_wins))


def best_thresholds(ranked: RankedScores) -> DataFrame:
    """All thresholds with the largest sensitivity + specificity.

    The sum is compared on whole counts, so rounding cannot break or invent a tie.
    """
    # sensitivity + specificity - 1 = (neg_upto * P - pos_upto * N) / (P * N), up to sign
    gain = F.col("neg_upto").cast("decimal(38,0)") * F.lit(ranked.positives) - F.col("pos_upto").cast("decimal(38,0)") * F.lit(ranked.negatives)
    signed = gain if ranked.higher_wins else -gain
    scored = ranked.table.withColumn("_gain", signed)
    top = scored.agg(F.max("_gain")).first()[0]
    curve = roc_table(RankedScores(scored.where(F.col("_gain") == F.lit(top)), ranked.positives, ranked.negatives, ranked.higher_wins))
    # the extra bottom row has gain 0; it stays only when nothing is better
    return curve if top <= 0 else curve.where(F.col("threshold") != F.lit(-math.inf))


def classify(score: Column, threshold: float) -> Column:
    """Win when the score is strictly above the threshold; null stays null."""
    return if_else(score > F.lit(float(threshold)), F.lit("Win"), F.lit("Loss/Draw"))


@dataclass
class Confusion:
    true_pos: int
    false_neg: int
    false_pos: int
    true_neg: int
    accuracy: float
    accuracy_lower: float
    accuracy_upper: float
    no_information_rate: float
    accuracy_p: float
    kappa: float
    mcnemar: float
    mcnemar_p: float
    sensitivity: float
    specificity: float
    pos_pred_value: float
    neg_pred_value: float
    prevalence: float
    detection_rate: float
    detection_prevalence: float
    balanced_accuracy: float

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in asdict(self).items()], "statistic string, value double")


def confusion(df: DataFrame, predicted: Column, actual: Column, weight: str | None = None) -> Confusion:
    """Statistics of two Win / Loss-or-Draw columns; Win is the positive class. Four counts leave the executors."""
    p, a = predicted == "Win", actual == "Win"
    cells = {"tp": p & a, "fn": ~p & a, "fp": p & ~a, "tn": ~p & ~a}
    n = rows_of(weight)
    row = df.agg(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in cells.items()]).first()
    return confusion_statistics(row["tp"], row["fn"], row["fp"], row["tn"])


def _share(part: float, whole: float) -> float:
    return part / whole if whole else math.nan


def confusion_statistics(tp: int, fn: int, fp: int, tn: int) -> Confusion:
    n = tp + fn + fp + tn
    if n == 0:
        raise ValueError("no complete row")
    right = tp + tn
    accuracy = right / n
    low, high = exact_binomial_interval(right, n)
    nir = max(tp + fn, fp + tn) / n
    chance = ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n)
    moved = fn + fp
    mcnemar = 0.0 if fn == fp else (abs(fn - fp) - 1) ** 2 / moved
    sens, spec = _share(tp, tp + fn), _share(tn, fp + tn)
    return Confusion(
        tp, fn, fp, tn, accuracy, low, high, nir, binomial_upper(right, n, nir), _share(accuracy - chance, 1 - chance),
        mcnemar if moved else math.nan, chi_square_upper(mcnemar, 1) if moved else math.nan,
        sens, spec, _share(tp, tp + fp), _share(tn, tn + fn), (tp + fn) / n, tp / n, (tp + fp) / n, (sens + spec) / 2,
    )
