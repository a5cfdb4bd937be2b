"""The queries of the llm operators: ``queries()`` and ``oracle_sql()`` as in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, langid, lookalike, merkle, mixing, oracle, pairs, sentences, truncation


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 1: the copies of each fact that is stored in differing form."""
    return merkle.copies(merkle.records(table(spark, base, "fact"), table(spark, base, "fact_line")))


def p1_distinct(spark: SparkSession, base: str) -> DataFrame:
    """Problem 1: each distinct fact once, with the number of its records."""
    rows = merkle.distinct_records(merkle.records(table(spark, base, "fact"), table(spark, base, "fact_line")))
    return rows.select("first_key", "record.text", "record.category", "n_records")


def _p2_inputs(spark: SparkSession, base: str) -> tuple:
    tables = [table(spark, base, name) for name in ("response", "scenario", "slot_dim")]
    return (*tables, langid.fit(table(spark, base, "lang_sample")))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 2: defective answers and the type of their defect."""
    return pairs.defects(*_p2_inputs(spark, base))


def p2_triggered(spark: SparkSession, base: str) -> DataFrame:
    """Problem 2: every rule that an answer triggers, one row each."""
    return pairs.triggered(*_p2_inputs(spark, base)).select("response_id", F.posexplode("defects").alias("rank", "defect"))


def _p3_detected(spark: SparkSession, base: str) -> DataFrame:
    return langid.detected(table(spark, base, "response"), langid.fit(table(spark, base, "lang_sample")))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 3: answers whose label is missing or wrong, and answers in several languages."""
    return langid.mislabelled(_p3_detected(spark, base))


def p3_segments(spark: SparkSession, base: str) -> DataFrame:
    """Problem 3: every stretch of every answer with its language and a confidence."""
    part = _p3_detected(spark, base).select("response_id", F.explode("segments").alias("s"))
    return part.select("response_id", "s.start_pos", "s.end_pos", "s.language", "s.confidence")


def _p4_values(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.values(
        [
            ("scenario.chinese", table(spark, base, "scenario"), "scenario_id", "chinese", "received_at"),
            ("fact.text", table(spark, base, "fact"), "fact_key", "text", "extracted_at"),
            ("response.response", table(spark, base, "response"), "response_id", "response", "received_at"),
        ]
    )


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 4: pairs of values that look the same but are different strings."""
    return lookalike.same_looking(_p4_values(spark, base))


def p4_classes(spark: SparkSession, base: str) -> DataFrame:
    """Problem 4: the values that are stored in several forms, each with the first key of its class."""
    return lookalike.classes(_p4_values(spark, base))


def p4_forms(spark: SparkSession, base: str) -> DataFrame:
    """Problem 4: every value in its one consistent form."""
    return lookalike.normal_forms(_p4_values(spark, base))


def _p5_values(spark: SparkSession, base: str) -> DataFrame:
    return truncation.values(table(spark, base, "response"), table(spark, base, "scenario"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 5: values that were cut off."""
    return truncation.cut_values(_p5_values(spark, base))


def p5_rates(spark: SparkSession, base: str) -> DataFrame:
    """Problem 5: the rate of cut values of each source."""
    return truncation.rates(_p5_values(spark, base))


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """Problem 6: every document as token ids."""
    return bpe.encode(table(spark, base, "documents"))


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    """Problem 7: the shares that the mixture reaches."""
    return mixing.shares(table(spark, base, "documents"), table(spark, base, "mix_target"))


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    """Problem 7: the mixture itself in shuffled order."""
    return mixing.mix(table(spark, base, "documents"), table(spark, base, "mix_target"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Problem 8: the sentences of every document."""
    return sentences.sentences(table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p3_found, p4_found, p5_found, p6_ids, p7_mix, p8_found]
    more = [p1_distinct, p2_triggered, p3_segments, p4_classes, p4_forms, p5_rates, p7_shares]
    return {f.__name__: f for f in found + more}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
