"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import (
    byte_pairs,
    exact_dedup,
    hidden_markov,
    language_id,
    mixing,
    near_dedup,
    neighbours,
    packing,
    resampling,
    sharding,
    spelling,
    token_counts,
    url_rules,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_url_rules": url_rules.op2_url_rules,
        "op3_language_id": language_id.op3_language_id,
        "op4_hidden_markov": hidden_markov.op4_hidden_markov,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_mixing": mixing.op6_mixing,
        "op7_sharding": sharding.op7_sharding,
        "op8_packing": packing.op8_packing,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_byte_pairs": byte_pairs.op11_byte_pairs,
        "op12_resampling": resampling.op12_resampling,
        "op13_spelling": spelling.op13_spelling,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.OP1_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_resampling": resampling.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
