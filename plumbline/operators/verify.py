"""Verdicts on facts: reading a judge's answer, and a judge that works from the evidence alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import strict_json

#: Score from which the local judge accepts a fact.
ACCEPT = 0.5


def _truthy(text: Column, kind: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0 or ''."""
    number = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number != 0)
        .otherwise(True)
    )


def parse_answer(answer: Column) -> Column:
    """``struct<accurate, confidence, explanation>`` of a judge's answer; unreadable answers reject with 0.3."""
    body = F.try_variant_get(strict_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))), "$[0]", "variant")

    def text(name: str) -> Column:
        return F.try_variant_get(body, f"$.{name}", "string")

    kind = F.schema_of_variant(F.try_variant_get(body, "$.accurate", "variant"))
    number = F.regexp_extract(F.coalesce(text("confidence"), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.coalesce(number, F.lit(0.0)) == 0, 0.5).otherwise(number)))
    good = F.struct(_truthy(text("accurate"), kind).alias("accurate"), confidence.alias("confidence"), F.coalesce(text("explanation"), F.lit("")).alias("explanation"))
    bad = F.struct(F.lit(False).alias("accurate"), F.lit(0.3).alias("confidence"), F.lit("could not parse verification result").alias("explanation"))
    return F.when(body.isNotNull(), good).otherwise(bad)


def local_judge(facts: DataFrame, best: DataFrame) -> DataFrame:
    """A deterministic judge: a fact is accurate if its best paragraph scores enough; without evidence it isn't."""
    top = best.where(F.col("evidence_no") == 1).select("fact_key", F.col("score").alias("top_score"))
    seen = facts.select("fact_key", "job_id", "slot").join(top, "fact_key", "left")
    accurate = F.coalesce(F.col("top_score") >= ACCEPT, F.lit(False))
    return seen.select("fact_key", "job_id", "slot", accurate.alias("accurate"), F.least(F.lit(1.0), F.coalesce("top_score", F.lit(0.0))).alias("confidence"))
