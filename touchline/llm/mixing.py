"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in shuffled order. A document's virtual finish time is the number of source words up to
and with it, divided by the source's target; a second round of the same queue follows the first, so a source may give
its documents twice. All sources reach virtual time 1 when the whole budget is served: the copies are sorted by finish
time over all sources and the stream is cut at the total budget.

The shuffled order is that of a digest of the id, so running sums of a source (one may hold a third of all rows) are
taken inside ranges of the digest and shifted by the totals of the ranges before. The finish times are cut into
``RANGES`` equal ranges, which hold about as many words each, and only the range in which the budget runs out is
sorted row by row. DataFrame and SQL code only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.common import documents, free_name, word_count
from touchline.operators.staging import stage

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MOST_REPEATS = 2
RANGES = 4096
ORDER_BITS = 60
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words and the shuffled order (60 bits of the id's digest) of every row."""
    digest = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, ORDER_BITS // 4)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.conv(digest, 16, 10).cast("bigint").alias("turn"),
    )


def target_sizes(
    per_source: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """Targets of the sources: columns of ``per_source`` (source, source_size) with weight and target.

    Weights repeat along the sources in code point order, null last. A source takes at most ``most`` times its size;
    what is above goes to the others by weight. With sources ordered by limit / weight, the first k are full and the
    rest share what is left, so one running sum over the source table (one row each) gives the level at once.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    named = per_source.select("source", "source_size", weight.alias("weight"))
    limited = named.withColumn("_limit", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = limited.withColumns(
        {
            "_budget": F.sum("source_size").over(everything) * F.lit(float(budget_share)),
            "_full": F.coalesce(F.sum("_limit").over(before), F.lit(0)),
            "_open": F.sum("weight").over(onward),
        }
    ).withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    # the level rises while sources fill up and falls beyond the right one
    level = F.max("_level").over(everything)
    return stepped.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("_limit").cast("double"), level * F.col("weight")).alias("target"),
    )


def queued(rows: DataFrame, per_source: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """Rows with source_size, target and the words of their source before and with them in shuffled order."""
    spot = F.floor(F.col("turn") / F.lit(2**ORDER_BITS / ranges)).cast("int")
    spotted = rows.withColumn("_spot", spot)
    along = Window.partitionBy("source").orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_source.select("source", "_spot", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("_before"))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("_spot").alias("_p"), "_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "_spot").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = spotted.withColumn("_run", F.sum("size").over(inside))
    joined = running.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_spot") == F.col("_p")))
    return joined.select("doc_id", "source", "size", "turn", "source_size", "target", (F.col("_before") + F.col("_run")).alias("served"))


def copies(queue: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """One row per document and round with its virtual finish time; documents without words have none."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("round")
    out = queue.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", rounds)
    return out.withColumn("finish", (F.col("served") + F.col("source_size") * F.col("round")) / F.col("target"))


def cut_point(queue: DataFrame, budget: float, ranges: int = RANGES, most: int = MOST_REPEATS) -> tuple | None:
    """The last copy that fits the total budget as (finish, turn, doc_id, round); None when everything fits.

    Words are summed per range of finish times (``ranges`` of them up to time 2, one beyond), the range in which the
    budget runs out is found, and the rows of that range alone are sorted.
    """
    spaced = copies(queue, most).withColumn("_range", F.least(F.floor(F.col("finish") * (ranges / 2)), F.lit(ranges)).cast("int"))
    per_range = spaced.groupBy("_range").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.orderBy("_range"))  # one row per range
    over = per_range.withColumn("_upto", upto).where(F.col("_upto") > F.lit(budget)).orderBy("_range").first()
    if over is None:
        return None
    left = budget - (over["_upto"] - over["_words"])
    order = ["finish", "turn", "doc_id", "round"]
    along = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = (
        spaced.where(F.col("_range") == over["_range"])
        .withColumn("_run", F.sum("size").over(along))
        .where(F.col("_run") <= F.lit(left))
        .orderBy(*[F.desc(c) for c in order])
        .first()
    )
    if last is None:  # the range's first copy is too long already: end before the range
        return (over["_range"] / (ranges / 2), -1, None, -1)
    return (last["finish"], last["turn"], last["doc_id"], last["round"])


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    most: int = MOST_REPEATS,
    ranges: int = RANGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, times and taken (words).

    One row per input row. A null text has size 0 and is never taken; a null source is a source of its own, a null id
    is ordered like an empty one. Rows that repeat an id queue one after the other. An empty table gives an empty
    result. The order depends on ids only, so a rerun gives the same mix.
    """
    rows = stage(sized(docs, id_col, text_col, source_col))
    spot = F.floor(F.col("turn") / F.lit(2**ORDER_BITS / ranges)).cast("int").alias("_spot")
    per_spot = stage(rows.groupBy("source", spot).agg(F.sum("size").alias("size")))
    per_source = per_spot.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(target_sizes(per_source, weights, budget_share, most))
    queue = stage(queued(rows, per_spot, targets, ranges))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    last = cut_point(queue, float(budget_share) * total, ranges, most)
    id_type = dict(queue.dtypes)["doc_id"]

    def kept(round_: int):
        served = (F.col("size") > 0) & (F.col("target") > 0)
        time = F.try_divide(F.col("served") + F.col("source_size") * round_, F.col("target"))
        if last is None:
            return served.cast("int")
        at = F.struct(time.alias("f"), F.col("turn").alias("t"), F.col("doc_id").alias("d"), F.lit(round_).alias("r"))
        end = F.struct(
            F.lit(float(last[0])).alias("f"), F.lit(last[1]).cast("bigint").alias("t"), F.lit(last[2]).cast(id_type).alias("d"), F.lit(last[3]).alias("r")
        )
        return (served & (at <= end)).cast("int")

    times = sum((kept(r) for r in range(1, most)), kept(0))
    return queue.withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: every taken row of ``docs`` as often as the mix takes it, with all its columns.

    Rows that share an id are repeated as often as the most taken of them. Texts are read once and stay where they are
    while the counts are at most ``BROADCAST_ROWS`` ids and ``BROADCAST_BYTES``; more of them meet the rows in a shuffle.
    """
    plan = plan_mix(docs, id_col=id_col, **options).where("times > 0")
    who, times, round_ = (free_name(docs, n) for n in ("_mix_id", "_mix_times", "_mix_round"))
    counts = stage(plan.groupBy(F.col("doc_id").alias(who)).agg(F.max("times").alias(times)))
    held = F.sum(F.lit(16) + F.coalesce(F.octet_length(F.col(who).cast("string")), F.lit(0)))
    rows, size = counts.agg(F.count(F.lit(1)), held).first()
    few = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(counts) if few else counts, docs[id_col].eqNullSafe(F.col(who)))
    repeated = joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(round_))
    return repeated.drop(round_)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = plan_mix(documents(spark, folder))
    return plan.select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS turn
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per_source
), stepped AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
             - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM named
), targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM stepped
), queue AS (
  SELECT s.doc_id, s.size, s.turn, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT q.*, r.round, ((served + source_size * r.round)::DOUBLE / target) AS finish
  FROM queue q, (VALUES (0), (1)) r(round) WHERE size > 0 AND target > 0
), stream AS (
  SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id NULLS FIRST, round ROWS UNBOUNDED PRECEDING) AS upto FROM copies
), takes AS (
  SELECT doc_id, sum(size) AS taken FROM stream WHERE upto <= (SELECT sum(source_size) FROM targets)::DOUBLE * 1.5 GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN takes t ON q.doc_id IS NOT DISTINCT FROM t.doc_id
"""
