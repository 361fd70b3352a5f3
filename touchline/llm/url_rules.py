"""URL filtering by fixed rules and by association rules mined from labelled URLs.

A URL is a set of tokens: labels of its host, words of its path, keys of its query. FP-growth over the labelled URLs,
with the label as one more token, finds token combinations that go with a label; those of enough support and
confidence become rules. A rule is posted under its rarest token only, so a URL meets a rule through that token and
the rest of the rule is checked in place: no counting of all shared tokens. DataFrame and SQL code only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import LOWER, UPPER, documents
from touchline.operators.staging import stage


@dataclass(frozen=True)
class FixedRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that come before anything mined.
RULES = (
    FixedRule("allow", "org", "/"),
    FixedRule("block", "example.org", "/es/"),
    FixedRule("block", "example.org", "/en/1"),
    FixedRule("allow", "com", "/fr/"),
    FixedRule("block", "com", "/de/"),
)

BAD, GOOD = "label:block", "label:allow"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.5
#: Fixed value: two-sided 95% of a normal.
CERTAIN = 1.959963984540054
#: With fewer rows even a combination that always goes with a label has a lower bound of less than one half.
MIN_ROWS = 4
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty when there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: Sequence[FixedRule] = RULES) -> Column:
    """Struct of rule and verdict of the longest fixed rule that fits, null when none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL. Numbers are left out: they name one page, not a kind of page."""
    kept = lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))
    host = F.transform(F.filter(F.split(host_of(url), r"\."), kept), lambda x: F.concat(F.lit("host:"), x))
    path = F.transform(F.filter(F.split(F.lower(path_of(url)), r"[/._-]"), kept), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), kept), lambda x: F.concat(F.lit("query:"), F.element_at(F.split(x, "="), 1)))
    return F.array_sort(F.array_distinct(F.concat(scheme, host, path, keys)))


def least_share(share: Column, n: Column) -> Column:
    """Lower end of Wilson's 95% interval of a share seen in n rows."""
    z2 = CERTAIN**2
    spread = F.sqrt(share * (1 - share) / n + F.lit(z2 / 4) / (n * n))
    return (share + F.lit(z2 / 2) / n - F.lit(CERTAIN) * spread) / (1 + F.lit(z2) / n)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Mined rules: rule, tokens, verdict, confidence, support, rarest (the token they are posted under).

    ``labelled`` has ``tokens`` and the boolean ``bad``. A rule needs ``min_support`` of the rows at every size and
    ``min_confidence``, and must beat the share of its label in all labelled rows. So that few rows don't make a rule by
    chance, the lower end of the 95% interval of its confidence (Wilson's) must reach one half: the fewer rows, the
    purer they have to be, and less than ``MIN_ROWS`` never do. Of two rules with one verdict, the longer is dropped
    unless it is more confident than the shorter one inside it.
    """
    spark = labelled.sparkSession
    empty = "rule string, tokens array<string>, verdict string, confidence double, support double, rarest string"
    baskets = stage(labelled.select(F.concat("tokens", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items")))
    total = baskets.count()
    if not total:
        return spark.createDataFrame([], empty)
    support = max(min_support, (MIN_ROWS - 0.5) / total)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(
        F.arrays_overlap("consequent", F.array(F.lit(BAD), F.lit(GOOD)))
        & ~F.arrays_overlap("antecedent", F.array(F.lit(BAD), F.lit(GOOD)))
        & (F.col("lift") > 1)
        & (least_share(F.col("confidence"), F.col("support") * F.lit(total) / F.col("confidence")) >= 0.5)
    )
    rules = found.select(
        F.array_sort("antecedent").alias("tokens"),
        F.when(F.array_contains("consequent", BAD), "block").otherwise("allow").alias("verdict"),
        "confidence",
        "support",
    ).withColumn("rule", F.concat_ws(" ", "tokens"))
    freq = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = stage(rules)
    posted = rules.select("rule", "verdict", F.explode("tokens").alias("token")).join(freq, "token")
    rarest = posted.groupBy("rule", "verdict").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    rules = stage(rules.join(rarest, ["rule", "verdict"]))
    shorter = rules.select(
        F.col("tokens").alias("_t"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"), F.explode("tokens").alias("token")
    )
    longer = rules.select("rule", "tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
    inside = (F.size("_t") < F.size("tokens")) & (F.col("_v") == F.col("verdict")) & (F.size(F.array_except("_t", "tokens")) == 0)
    useless = longer.join(shorter, "token").where(inside & (F.col("_c") >= F.col("confidence"))).select("rule", "verdict").distinct()
    return rules.join(useless, ["rule", "verdict"], "left_anti").select("rule", "tokens", "verdict", "confidence", "support", "rarest")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The most confident mined rule of each row of ``urls`` (key, tokens) that meets one: key, mined, mined_verdict.

    Ties go to the higher support, then to block, then to the first rule in order. The rule table is broadcast while
    it has at most ``BROADCAST_RULES`` rows; a longer one is joined by token, where the adaptive join splits hot tokens.
    """
    rules = stage(rules)
    side = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    posted = urls.select("key", F.col("tokens").alias("_own"), F.explode("tokens").alias("rarest"))
    met = posted.join(side, "rarest").where(F.size(F.array_except("tokens", "_own")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("verdict") != "block").alias("b"), "rule", "verdict")
    best = met.groupBy("key").agg(F.min(order).alias("best"))
    return best.select("key", F.col("best.rule").alias("mined"), F.col("best.verdict").alias("mined_verdict"))


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Sequence[FixedRule] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every URL: page_id, host, path, rule, verdict, mined (the mined rule that decided, else null).

    ``labelled`` has ``url`` and the boolean ``bad``. A fixed rule decides where one fits (the longest wins), else the
    most confident mined rule, else the URL is allowed. One row per input row: a null URL, or one without ://, has
    empty host and path and meets no fixed rule; equal URLs are matched once and answered alike. Without labels
    nothing is mined; an empty table gives an empty result. Other columns are not read.
    """
    url = F.col("url")
    mined = mine_rules(
        labelled.where(url.isNotNull() & F.col("bad").isNotNull()).select(url_tokens(url).alias("tokens"), "bad"),
        min_support,
        min_confidence,
    )
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = parts.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    unfixed = rows.where("fixed IS NULL").withColumnRenamed("tokens", "key")
    open_sets = unfixed.select("key", F.col("key").alias("tokens")).distinct()  # pages of one kind share their tokens
    answers = match_rules(open_sets, mined)
    # what a fixed rule decides takes no part in the join
    ruled = rows.where("fixed IS NOT NULL").select("page_id", "host", "path", "fixed.rule", "fixed.verdict", F.lit(None).cast("string").alias("mined"))
    met = unfixed.join(answers, "key", "left")
    return ruled.unionByName(
        met.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined_verdict", F.lit("allow")).alias("verdict"), "mined")
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of labelled pages: bad where the label says low quality or toxic."""
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("page_id", "url").join(marks, "page_id").select("url", "bad")


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = documents(spark, folder, "pages")
    return judge_urls(pages, labelled_pages(pages, documents(spark, folder, "labels")))
