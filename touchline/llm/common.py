"""Column rules and small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["WORD", "documents", "free_name", "held_out", "once", "text_or_empty", "utf8", "word_count"]


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def free_name(docs: DataFrame, wanted: str) -> str:
    """A name for a helper column that no column of ``docs`` has, letter case aside."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def once(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each (id, text) named in ``repeated`` (who, what: the text's SHA-256), the rest as it is.

    Of rows that differ in other columns, the one of least hash over these stays, so reruns agree. Equal rows merge
    before the shuffle.
    """
    if repeated.isEmpty():
        return docs
    who, what, row = (free_name(docs, n) for n in ("_who", "_what", "_row"))
    digest = F.sha2(text_or_empty(docs[text_col]), 256)
    named = repeated.select(F.col("who").alias(who), F.col("what").alias(what))
    same = docs[id_col].eqNullSafe(F.col(who)) & (digest == F.col(what))
    hashed = [docs[n] for n, t in docs.dtypes if "map<" not in t and "variant" not in t]
    whole = F.struct(*[docs[n] for n in docs.columns]).alias(row)
    again = docs.join(named, same, "left_semi").groupBy(docs[id_col].alias(who), digest.alias(what)).agg(F.min_by(whole, F.xxhash64(*hashed)).alias(row))
    return docs.join(named, same, "left_anti").unionByName(again.select(f"{row}.*"))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(utf8(text)) % F.lit(modulus) == F.lit(remainder)
