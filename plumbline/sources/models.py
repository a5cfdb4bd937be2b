"""Model sources: the fixed mock answers as an expression, or a remote client through Arrow batches."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_white

# The mock answers by origin and language.
MOCK = {
    ("cn", "zh"): "关于这个问题，我们需要从多个角度来看待。中国政府一贯主张和平发展，尊重各国主权。根据国际法和联合国宪章，各国有权选择自己的发展道路。",
    ("cn", "en"): (
        "Regarding this issue, we need to consider multiple perspectives. The Chinese government has consistently advocated for "
        "peaceful development and respect for national sovereignty. Under international law and the UN Charter, every nation has the "
        "right to choose its own development path."
    ),
    ("us", "zh"): "这个问题涉及复杂的国际关系。美国支持民主价值观和自由市场原则，同时认识到国际合作的重要性。我们应该通过对话和外交途径解决分歧。",
    ("us", "en"): (
        "This issue involves complex international relations. The United States supports democratic values and free market principles "
        "while recognizing the importance of international cooperation. Differences should be resolved through dialogue and diplomatic channels."
    ),
}
#: Longest prompt that is sent to a model.
PROMPT_LIMIT = 10_000
# Which slot translates into which language.
TRANSLATORS = {"en": "cn-model-zh", "zh": "us-model-en"}


def slot_language(slot: Column) -> Column:
    return F.when(slot.endswith("-zh"), "zh").otherwise("en")


def slot_origin(slot: Column) -> Column:
    return F.when(slot.startswith("cn-"), "cn").otherwise("us")


def accepted(scenario: DataFrame) -> DataFrame:
    """The scenarios that ingest takes: those with a text in both languages (white space is one)."""
    return scenario.where((F.col("english") != "") & (F.col("chinese") != ""))


def fan_out(scenario: DataFrame, slots: DataFrame) -> DataFrame:
    """Each scenario once for each slot, with that slot's prompt."""
    every = accepted(scenario).crossJoin(F.broadcast(slots))  # the slots are a fixed dimension of four rows
    prompt = F.substring(F.when(F.col("use_zh"), F.col("chinese")).otherwise(F.col("english")), 1, PROMPT_LIMIT)
    return every.withColumn("prompt", prompt).withColumn("origin", slot_origin(F.col("slot")))


def mock_answer(slot: Column) -> Column:
    """The mock answer of a slot; the judge gets the English answer of the first origin."""
    cn, zh = slot.startswith("cn-"), slot.endswith("-zh")
    return F.when(cn & zh, MOCK["cn", "zh"]).when(cn, MOCK["cn", "en"]).when(zh, MOCK["us", "zh"]).otherwise(MOCK["us", "en"])


def translation_route(language: Column) -> Column:
    """The slot that translates a text of this language."""
    return F.when(language == "en", TRANSLATORS["en"]).otherwise(TRANSLATORS["zh"])


# What stands before a text that is to be translated, by target language.
TRANSLATE = {
    "zh": "Translate the following text to Chinese (Simplified). Return ONLY the translation, no commentary:\n\n",
    "en": "Translate the following text to English. Return ONLY the translation, no commentary:\n\n",
}


def translation_request(text: Column, language: Column) -> Column:
    """``struct<translator, target, prompt>`` for a text in a language (English, else Chinese); null for blank texts."""
    bare = trim_white(text)
    target = F.when(language == "en", "zh").otherwise("en")
    prompt = F.concat(F.when(language == "en", TRANSLATE["zh"]).otherwise(TRANSLATE["en"]), bare)
    return F.when(bare != "", F.struct(translation_route(language).alias("translator"), target.alias("target"), prompt.alias("prompt")))


def requested(text: Column, direction: Column) -> Column:
    """A request with a direction: ``zh->en``, else from English."""
    return translation_request(text, F.when(direction == "zh->en", "zh").otherwise("en"))


def completed(scenario: DataFrame, translate: Callable[[Column], Column]) -> DataFrame:
    """The scenarios with their missing language filled in by ``translate`` (request to text)."""
    def filled(own: str, other: str, language: str) -> Column:
        return F.when((F.coalesce(own, F.lit("")) == "") & (F.coalesce(other, F.lit("")) != ""), translate(translation_request(F.col(other), F.lit(language)))).otherwise(F.col(own))

    return scenario.withColumns({"english": filled("english", "chinese", "zh"), "chinese": filled("chinese", "english", "en")})


# The models of the backends and the backend of each slot, unless the session's configuration names others.
BACKENDS = {"cn": "Qwen3.6-27B-oQ4e-mtp", "us": "gemma-4-31B-it-oQ4e", "judge": "Qwen3.6-35B-A3B-uncensored-heretic-oQ8-fp16-mtp"}
SLOT_BACKENDS = {"us-model-en": "us", "us-model-zh": "us", "cn-model-en": "cn", "cn-model-zh": "cn", "judge": "judge"}


def configuration(spark: SparkSession) -> DataFrame:
    """``slot, backend, model``: five rows; ``plumbline.model.<backend>`` names another model."""
    named = {b: spark.conf.get(f"plumbline.model.{b}", m) for b, m in BACKENDS.items()}
    return spark.createDataFrame([(s, b, named[b]) for s, b in SLOT_BACKENDS.items()], "slot string, backend string, model string")


def throttled(ask: Callable[..., str], gap: float = 1.0, jitter: float = 0.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[..., str]:
    """The client with at least ``gap`` seconds and a part of ``jitter`` between two requests of a task."""
    last = [-math.inf]

    def run(*args) -> str:
        wait = last[0] + gap + random.random() * jitter - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return ask(*args)

    return run


class TooMany(Exception):
    """A source that asks to wait."""


def retried(ask: Callable[..., str], attempts: int = 3, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Callable[..., str]:
    """The client, asked again up to ``attempts`` times: after ``wait`` seconds times the number of the attempt where the source
    asks to wait, after ``wait`` seconds where it timed out. Other failures, and the last one, are raised."""

    def run(*args) -> str:
        for attempt in range(1, attempts + 1):
            try:
                return ask(*args)
            except (TooMany, TimeoutError) as e:
                if attempt == attempts:
                    raise
                sleep(wait * attempt if isinstance(e, TooMany) else wait)
        raise AssertionError("unreachable")

    return run


def remote(df: DataFrame, prompt: str, connect: Callable[[], Callable[[str, int], str]], answer: str = "answer", max_tokens: int = 1024) -> DataFrame:
    """Answers of a remote model: ``connect`` makes one client for each task, which is asked with a prompt and the most tokens
    of its answer; a failure becomes a value of ``error``. Wrap a client by ``throttled`` and ``retried`` where its source needs it."""
    schema = T.StructType([*df.schema.fields, T.StructField(answer, T.StringType()), T.StructField("error", T.StringType())])
    at = df.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = connect()
        for batch in batches:
            said, failed = [], []
            for p in batch.column(at).to_pylist():
                try:
                    said.append(ask(p, max_tokens))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of a client is data
                    said.append(None)
                    failed.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(failed, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def first_text_block(content: Column) -> Column:
    """The text of the first non-empty text block of ``array<struct<type,text>>``, else ''."""
    blocks = F.filter(content, lambda b: (b["type"] == "text") & (b["text"] != ""))
    return F.coalesce(F.get(blocks, 0)["text"], F.lit(""))
