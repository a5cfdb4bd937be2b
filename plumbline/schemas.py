"""Explicit schemas of the stored entities."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

SCENARIO = _struct(english=_S, chinese=_S)
FACT = _struct(id=_S, text=_S, category=_S)
EVIDENCE_ITEM = _struct(source=_S, title=_S, snippet=_S, url=_S, extract=_S)
VERIFICATION = _struct(factId=_S, accurate=_B, confidence=_D, explanation=_S, evidence=T.ArrayType(EVIDENCE_ITEM), error=_S)
INDICATOR = _struct(dimension=_S, description=_S, severity=_S, direction=_S)
REFUSAL = _struct(isRefusal=_B, confidence=_D, reason=_S)
SLOT_RESULT = _struct(
    slot=_S,
    refusal=REFUSAL,
    facts=T.ArrayType(FACT),
    factVerifications=T.ArrayType(VERIFICATION),
    biasIndicators=T.ArrayType(INDICATOR),
    overallBiasScore=_D,
    duration=_L,
    response=_S,
    translatedResponse=_S,
    translationError=_S,
)
STORED_EVENT = _struct(slot=_S, step=_S, status=_S, message=_S, timestamp=_L, elapsed=_L, result=_S)
STORED_JOB = _struct(
    id=_S,
    status=_S,
    scenario=SCENARIO,
    events=T.MapType(_S, T.ArrayType(STORED_EVENT)),
    slotResults=T.ArrayType(SLOT_RESULT),
    createdAt=_L,
    startedAt=_L,
    completedAt=_L,
    error=_S,
    modelNames=T.MapType(_S, _S),
)
