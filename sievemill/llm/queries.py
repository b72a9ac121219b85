"""The queries of the ten text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm import boosting, exact, licenses, ogg, packing, secrets, sentencepiece_bpe, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality": boosting.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_licenses": licenses.op6_licenses,
    "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
    "op8_ogg": ogg.op8_ogg,
    "op9_exact": exact.op9_exact,
    "op10_secrets": secrets.op10_secrets,
}

SQL: dict[str, str] = {"op9_exact": exact.OP9_SQL}
