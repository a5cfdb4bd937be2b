"""Refusal detection by ordered patterns, as one struct column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import NOT_LINE_END, WHITE, trim_white

#: Characters below which a trimmed answer counts as refused.
SHORTEST = 20
_ANY = f"{NOT_LINE_END}*"

# Refusal patterns in order.
ENGLISH = [
    "I cannot (answer|provide|respond|comment|assist)",
    f"I('m|[{WHITE}]+am) (sorry|unable|not able)",
    "as an AI",
    "I don't have enough (information|context)",
    "it would be (inappropriate|irresponsible)",
    "I (must|need to) (decline|refrain)",
    "against my (guidelines|policies|safety)",
]
CHINESE = ["我(不能|无法|没有|不会)", "抱歉", "作为一个AI", "我没有足够", "这不(合适|恰当)", "我必须(拒绝|避免)", f"不符合{_ANY}政策", f"基于我的{_ANY}准则", "这个话题", "换个话题"]
HEDGE_EN = f"I (understand|recognize|appreciate){_ANY}(however|but|nevertheless)"
HEDGE_ZH = f"我(理解|知道|明白){_ANY}(但是|不过|然而)"


def _first_match(text: Column, patterns: list[str], fold: str) -> Column:
    """What the first pattern in list order matches, or null."""
    return F.coalesce(*[F.when(text.rlike(fold + p), F.regexp_extract(text, f"{fold}({p})", 1)) for p in patterns])


def detect(answer: Column, language: Column) -> Column:
    """``struct<is_refusal, confidence, reason>`` of an answer; a null answer counts as empty."""
    text = trim_white(F.coalesce(answer, F.lit("")))
    english = language == "en"
    found = F.when(english, _first_match(text, ENGLISH, "(?i)")).otherwise(_first_match(text, CHINESE, ""))
    hedged = F.when(english, text.rlike("(?i)" + HEDGE_EN)).otherwise((language == "zh") & text.rlike(HEDGE_ZH))
    quoted = F.concat(F.lit('matched pattern: "'), F.substring(found, 1, 50), F.lit('"'))

    def result(refused: bool, confidence: float, reason: Column) -> Column:
        return F.struct(F.lit(refused).alias("is_refusal"), F.lit(confidence).alias("confidence"), reason.alias("reason"))

    cases = [
        (F.length(text) < SHORTEST, result(True, 0.9, F.lit("response too short or empty"))),
        (found.isNotNull(), result(True, 0.85, quoted)),
        (F.coalesce(hedged, F.lit(False)), result(True, 0.5, F.lit("hedged or qualified response"))),
    ]
    none = result(False, 0.9, F.lit(None).cast("string"))
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), none)
