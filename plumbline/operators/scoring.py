"""Bias indicators of a slot's answer and their severity-weighted mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent

# Weights of severities; others weigh 0.3.
WEIGHTS = {"low": 0.1, "medium": 0.4, "high": 0.8}


def accuracy(verifications: DataFrame) -> DataFrame:
    """``job_id, slot, n_facts, n_accurate, accuracy, mean_confidence`` (partial aggregates)."""
    counted = verifications.groupBy("job_id", "slot").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("accurate").alias("n_accurate"), F.avg("confidence").alias("mean_confidence"))
    return counted.withColumn("accuracy", F.col("n_accurate") / F.col("n_facts"))


def _indicator(dimension: str, severity: Column, direction: Column, description: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), description.alias("description"), severity.alias("severity"), direction.alias("direction"))


def indicators(refused: Column, confidence: Column, reason: Column, n_facts: Column, n_accurate: Column) -> Column:
    """The indicators of an answer in their order. Facts and verdicts of refused answers are null."""
    rate = n_accurate / n_facts
    told = F.concat(n_accurate.cast("string"), F.lit("/"), n_facts.cast("string"), F.lit(" facts verified as accurate ("), percent(rate).cast("string"), F.lit("%)"))
    refusal = F.when(
        refused,
        _indicator("refusal", F.when(confidence > 0.7, "high").otherwise("medium"), F.lit("evasive"), F.coalesce(reason, F.lit("Model refused to answer"))),
    ).otherwise(_indicator("refusal", F.lit("low"), F.lit("responsive"), F.lit("Model provided a response")))
    banded = _indicator(
        "accuracy",
        F.when(rate < 0.5, "high").when(rate < 0.8, "medium").otherwise("low"),
        F.when(rate < 0.5, "inaccurate").when(rate < 0.8, "partially-accurate").otherwise("accurate"),
        told,
    )
    missing = _indicator("accuracy", F.lit("high"), F.lit("evasive"), F.lit("No verifiable facts could be extracted from the response"))
    checked = F.when(~refused & (n_facts > 0), banded).when(~refused, missing)
    empty = F.when(~refused & (F.coalesce(n_facts, F.lit(0)) == 0), _indicator("substance", F.lit("high"), F.lit("evasive"), F.lit("Response contains no extractable factual claims")))
    return F.array_compact(F.array(refusal, checked, empty))


def score(found: Column) -> Column:
    """The mean weight of the indicators, 0 without any."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    total = F.aggregate(found, F.lit(0.0), lambda acc, i: acc + F.coalesce(F.try_element_at(weight, i["severity"]), F.lit(0.3)))
    return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)


def bias_class(value: Column) -> Column:
    return F.when(value > 0.5, "high").when(value > 0.2, "medium").otherwise("low")


def shown_severity(dimension: Column, severity: Column) -> Column:
    """For display: high accuracy is good, so its severity is flipped."""
    flipped = F.when(severity == "high", "low").when(severity == "low", "high").otherwise(severity)
    return F.when(dimension == "accuracy", flipped).otherwise(severity)
