"""Problem 7: mixing sources to target weights.

Method: Poisson replication. Each document draws a uniform number from a hash of its key and a seed and inverts the
Poisson distribution with the repetition rate of its source; it is exploded by that count and all rows are shuffled
globally by a hash. Counts are capped at ``max_repeats``.

The count of a document is the number of thresholds (the distribution function at 0, 1, ...) that its uniform number
passes, a built-in expression. The rate of each source is chosen so that the realised tokens, not only their expectation, meet
the target: the tokens of a source are summed by ``BINS`` equal parts of the uniform numbers (a partial aggregate; at most
``BINS`` rows a source reach the driver, whatever the size of the corpus), and the tokens at any rate follow from these sums.

The rate of a source is at most its ``max_repeats``: the target repetition can't exceed the cap. The size of the mixture is
the largest at which every source that has documents reaches its weight at such a rate, or
the argument ``total_tokens`` where that is smaller. Sources of the targets without documents cannot contribute; the
weights of the others are scaled to sum 1. Sources of the documents that are no target contribute nothing. Both are
reported with their share of 0.

Defined cases: documents without tokens (null or empty text), without a key or with a null source are never drawn; a
key that occurs several times draws one count, and each of its rows is repeated by it; targets with a null or
non-positive weight or cap count as 0; a target listed twice has its weights added and its smaller cap. Empty tables
give an empty mixture and a report of shares 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .bpe import count_tokens

#: Parts of the uniform numbers by which tokens are summed.
BINS = 16384
SEED = 20240601


def thresholds(rate: float, cap: int) -> list[float]:
    """The uniform numbers from which the count is at least 1, 2, ... ``cap``: the distribution function at 0, 1, ..."""
    if rate <= 0:
        return [1.0] * cap
    chance = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(cap)]
    return np.cumsum(chance).tolist()


@dataclass
class Plan:
    """What the driver decides: by source the target share and the rate."""

    weight: dict[str, float]
    cap: dict[str, int]
    share: dict[str, float]
    rate: dict[str, float]


def _targets(mix_target: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    weight: dict[str, float] = {}
    cap: dict[str, int] = {}
    for r in mix_target.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("weight").alias("w"), F.min("max_repeats").alias("m")).collect():
        ok = r.w is not None and r.w > 0 and r.m is not None and r.m > 0
        weight[r.source], cap[r.source] = (float(r.w), int(r.m)) if ok else (0.0, 0)
    return weight, cap


def _uniform(key: str, seed: int) -> Column:
    """A number between 0 and 1 from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / F.lit(2.0**53)


def _usable(documents: DataFrame, weight: dict[str, float], key: str) -> DataFrame:
    """The documents of target sources that have a key and a token (each text but the empty one has)."""
    return documents.where(F.col(key).isNotNull() & F.col("source").isin([s for s, w in weight.items() if w > 0]) & (F.col("text") != ""))


def sized(documents: DataFrame, weight: dict[str, float], key: str) -> DataFrame:
    """``key, source, n_tokens`` of each document that can be drawn."""
    return count_tokens(_usable(documents, weight, key), [key, "source"]).where(F.col("n_tokens") > 0)


def plan(drawn: DataFrame, weight: dict[str, float], cap: dict[str, int], key: str, seed: int, total_tokens: float | None = None) -> Plan:
    """The rates at which the token counts of the sources meet the weights."""
    part = F.floor(_uniform(key, seed) * BINS).cast("int")
    summed = drawn.groupBy("source", part.alias("bin")).agg(F.sum("n_tokens").alias("t"))
    above: dict[str, np.ndarray] = {}  # the tokens of the bins from each one on
    for r in summed.collect():  # at most BINS rows a target source
        above.setdefault(r.source, np.zeros(BINS + 1))[r.bin] += r.t
    above = {s: np.cumsum(t[::-1])[::-1] for s, t in above.items()}

    def tokens(source: str, rate: float) -> float:
        at = np.array(thresholds(rate, cap[source])) * BINS
        low = np.minimum(at.astype(int), BINS - 1)
        t = above[source]
        return float((t[low] - (t[low] - t[low + 1]) * (at - low)).sum())  # a bin's tokens lie evenly in it

    whole = sum(weight[s] for s in above)
    share = {s: weight[s] / whole for s in above}
    size = min([tokens(s, cap[s]) / share[s] for s in above], default=0.0)
    if total_tokens is not None:
        size = min(size, total_tokens)
    rate = {}
    for s in above:
        low, high = 0.0, float(cap[s])
        for _ in range(60):  # the tokens never fall as the rate grows
            middle = (low + high) / 2
            low, high = (middle, high) if tokens(s, middle) < size * share[s] else (low, middle)
        rate[s] = high
    return Plan(weight, cap, share, rate)


def _copies(made: Plan, key: str, seed: int) -> Column:
    """The Poisson count of a document: how many thresholds of its source its uniform number passes."""
    u = _uniform(key, seed)
    count = F.lit(0)
    for source, rate in sorted(made.rate.items()):
        passed = F.filter(F.array(*[F.lit(x) for x in thresholds(rate, made.cap[source])]), lambda x: x < u)
        count = F.when(F.col("source") == source, F.size(passed)).otherwise(count)
    return count


def _prepared(documents: DataFrame, mix_target: DataFrame, key: str, total_tokens: float | None, seed: int) -> tuple[DataFrame, Plan]:
    weight, cap = _targets(mix_target)
    drawn = materialise(sized(documents, weight, key))  # the tokens are counted once
    return drawn, plan(drawn, weight, cap, key, seed, total_tokens)


def mix(documents: DataFrame, mix_target: DataFrame, key: str = "doc_id", total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: ``key, copy_no, source, text`` with each document as often as it was drawn, globally shuffled (sorted by
    a hash over range partitions). The counts follow from key and rate, so only the result itself is shuffled."""
    _, made = _prepared(documents, mix_target, key, total_tokens, seed)
    rows = _usable(documents, made.weight, key).select(key, "source", "text", _copies(made, key, seed).alias("copies"))
    rows = rows.where(F.col("copies") > 0).select(key, F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "source", "text")
    place = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy_no"))
    return rows.withColumn("position_hash", place).orderBy("position_hash", key, "copy_no")


def shares(documents: DataFrame, mix_target: DataFrame, key: str = "doc_id", total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """For each source of either table: its weight, cap, rate, documents and tokens used, and the share reached."""
    spark = documents.sparkSession
    drawn, made = _prepared(documents, mix_target, key, total_tokens, seed)
    counted = drawn.select("source", "n_tokens", _copies(made, key, seed).cast("bigint").alias("copies")).where(F.col("copies") > 0)
    used = counted.groupBy("source").agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")
    )
    there = documents.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("available_documents"))
    schema = "source string, weight double, max_repeats int, target_share double, rate double"
    targets = spark.createDataFrame([(s, w, made.cap[s], made.share.get(s, 0.0), made.rate.get(s, 0.0)) for s, w in sorted(made.weight.items())], schema)
    every = targets.join(there, "source", "full").join(used, "source", "left")
    total = used.agg(F.sum("tokens").alias("total_tokens"))
    zero = {c: 0 for c in ("weight", "max_repeats", "target_share", "rate", "available_documents", "rows", "documents", "most_repeats", "tokens", "total_tokens")}
    filled = every.join(F.broadcast(total)).na.fill(zero)  # one row
    share = F.when(F.col("total_tokens") > 0, F.col("tokens") / F.col("total_tokens")).otherwise(0.0)
    return filled.select("source", "weight", "target_share", "max_repeats", "rate", "available_documents", "documents", "rows", "most_repeats", "tokens", share.alias("share"))
