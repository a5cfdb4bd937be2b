"""The evaluation as one lazy plan: answers, refusals, facts, evidence, verdicts and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import latest
from ..operators import evidence, refusal, scoring, verify
from ..runtime import materialise
from ..sources.models import slot_language


def answers(response: DataFrame) -> DataFrame:
    """The latest row of each answer with its slot's language and the verdict on refusal."""
    rows = latest(response.select("response_id", "received_at", "job_id", "slot", "response", "error"), "response_id", "received_at")
    tongue = slot_language(F.col("slot"))
    return rows.select("response_id", "job_id", "slot", tongue.alias("lang"), "response", "error", refusal.detect(F.col("response"), tongue).alias("r"))


def facts(fact: DataFrame) -> DataFrame:
    """The latest row of each fact with its slot's language."""
    rows = latest(fact.select("fact_key", "extracted_at", "job_id", "slot", "id", "text", "category", "article_id"), "fact_key", "extracted_at")
    return rows.select("fact_key", "job_id", "slot", slot_language(F.col("slot")).alias("lang"), "id", "text", "category", "article_id")


def searched(fact: DataFrame, article: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The planned facts, and the candidate articles of their searches; both are used several times, so they are written."""
    known = materialise(evidence.planned_facts(facts(fact), article))
    return known, materialise(evidence.candidates(article, evidence.search_keys(known)))


def verified(fact: DataFrame, article: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame] = verify.local_judge) -> DataFrame:
    """A verdict for each fact by a pluggable judge over its best paragraphs."""
    known, found = searched(fact, article)
    return judge(known, evidence.best(evidence.scored(known, article, found)))


def scores(response: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``response_id, job_id, slot, lang, indicators, score`` of every answer.

    Failed queries have no indicators. Refused answers skip facts; answers without facts count as evasive.
    """
    per_slot = scoring.accuracy(verdicts)
    joined = answers(response).join(per_slot, ["job_id", "slot"], "left")
    refused = F.col("r.is_refusal")
    counted, right = (F.when(~refused, F.coalesce(c, F.lit(0))) for c in ("n_facts", "n_accurate"))
    found = scoring.indicators(refused, F.col("r.confidence"), F.col("r.reason"), counted, right)
    none = F.filter(found, lambda _: F.lit(False))
    listed = joined.select("response_id", "job_id", "slot", "lang", F.when(F.col("error").isNull(), found).otherwise(none).alias("indicators"))
    return listed.withColumn("score", scoring.score(F.col("indicators")))
