"""Problem 2: broken prompt and response pairs.

Method: ordered rules. Each answer is held against the prompt of its slot's language and every rule tells whether it
is triggered: emptiness, a copied prompt, multilingual refusal phrases, an abrupt end (unclosed delimiters and closing
words, as in ``truncation``), and a language other than the slot's (as in ``langid``). ``triggered`` emits every
triggered defect; ``defects`` keeps the first one in the order of ``ORDER``, as an answer has at most one.

A copy is an answer whose letters and numbers are the prompt's, once or repeatedly, after an announcement at most; any
further word behind it makes it an answer. A refusal is an answer in which a sentence declines and all others are
courtesies; an answer that hedges but has a sentence of substance is none. An answer is in another language if none of
its segments is in the slot's language.

Defined cases: a null answer, and one without letter or digit, is ``empty`` whatever else holds; an answer whose job or
prompt is missing is compared to no prompt; an unknown slot has the language of its ending (``-zh`` or ``-en``), else no
language is expected. Keys delivered again count once, by their latest row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import langid, truncation
from .common import once_per_key
from .lookalike import consistent

#: The order in which a single defect is chosen.
ORDER = ("empty", "copies_question", "refusal", "truncated", "other_language")
# Phrases that decline, by language, as patterns over lower-case text with plain apostrophes.
REFUSALS = (
    r"\bi (?:cannot|can't|can not|could not|couldn't|won't|will not|am unable to|am not able to|'m unable to|'m not able to|am not allowed to|"
    r"'m not allowed to|am not permitted to|must decline|have to decline|need to decline|decline to|refuse to|would rather not|"
    r"prefer not to|am not in a position to|do not feel able to|do not have enough information|don't have enough information|"
    r"do not have any information|don't have any information|have no information|do not hold views|don't hold views|have no views|have no opinion|"
    r"don't have an opinion|do not have an opinion|do not discuss|don't discuss|do not comment|don't comment|may not (?:answer|discuss|comment|talk))\b",
    r"\bi'd (?:rather not|prefer not to)\b",
    r"\bi'm (?:unable|not able|not allowed|not permitted|afraid i (?:cannot|can't)|not in a position) ?",
    r"\bas an? (?:ai|language model|artificial intelligence|assistant)\b",
    r"\b(?:i'm sorry|i am sorry|sorry|i apologi[sz]e|my apologies|unfortunately|regrettably),? (?:but )?i\b",
    r"\bno comment\b",
    r"\bnot something i (?:can|could|may|am able to)\b",
    r"\bmy (?:guidelines|instructions|policy|policies|rules|settings)\b.{0,40}\b(?:keep|prevent|stop|forbid|do not|don't|prohibit|bar)\b",
    r"\b(?:outside|beyond) (?:what i|my|the scope of what i)\b",
    r"\b(?:restricted|off[- ]limits|prohibited|blocked) (?:area|topic|subject|content)\b|\boff[- ]limits\b|\bfalls? under a restricted\b",
    r"\b(?:inappropriate|improper|not appropriate|not possible) for me\b",
    r"\b(?:this|that|your) (?:request|question|topic|subject|prompt) (?:cannot|can't|can not|will not|won't) be\b",
    r"\bleave it there\b|\bleave this to others\b",
    r"我(?:无法|不能|没法|不便|不可以|拒绝|必须拒绝|不得不拒绝|没有足够的信息|没有立场|不愿|不想)",
    r"(?:不便|无法|不能|暂时不能|暂不|难以|恕不|恕难|不予)(?:讨论|回答|作答|提供答复|提供|答复|评论|回应|谈论|置评)",
    r"抱歉|对不起|很遗憾|换个话题|讨论到此为止|超出了?我的(?:服务|能力|知识)?范围|属于受限内容|受限(?:内容|话题|领域)|敏感(?:内容|话题)|没有立场|不持立场|无可奉告",
    r"\b(?:es tut mir leid|tut mir leid|leider kann ich|ich kann (?:dazu|diese frage|darauf|hierzu)? ?(?:leider )?(?:nicht|keine)|als ki\b|dazu kann ich nichts)",
    r"\b(?:je ne peux pas|je ne suis pas en mesure|je suis désolée?|désolée?,|en tant qu'ia|je dois refuser)\b",
    r"\b(?:lo siento|no puedo (?:responder|hablar|comentar|ayudar)|como (?:una )?ia\b|debo rechazar|no estoy en condiciones)",
    r"(?:я не могу|не могу ответить|извините|к сожалению, я|как (?:ии|языковая модель)|вынужден отказать)",
    r"(?:お答えできません|回答できません|申し訳(?:ありません|ございません)|お話しできません|aiとして|ご遠慮)",
)
# Courtesies that may stand beside a refusal, likewise.
COURTESIES = (
    r"^(?:thank|thanks|please|kindly|perhaps|feel free|let's|let us|is there|would you|you (?:may|might|can|could)|i (?:hope|appreciate|understand your|suggest|recommend|would be happy|'d be happy|can help)"
    r"|i'd be|sorry|my apologies|unfortunately|do you|how about|if you|try|best|kind regards|another|what else)\b",
    r"\b(?:your (?:patience|understanding|question|request|interest)|another (?:topic|subject|question)|something else|anything else|different (?:topic|subject|question|place))\b",
    r"感谢|谢谢|请(?:您|换|提出|查阅|咨询|询问|问|尝试|重新|理解|谅解)|建议您|欢迎|希望您|换一种|其他(?:问题|话题|资料)|您的问题已收到|我们换个|祝",
    r"\b(?:danke|bitte|vielen dank|merci|veuillez|gracias|por favor)\b|спасибо|пожалуйста|ありがとう|ください",
)
_REFUSAL = re.compile("|".join(REFUSALS))
_COURTESY = re.compile("|".join(COURTESIES))
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？]+|\n|$)")
_NOT_TEXT = re.compile(r"[\W_]+")
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”')


def bare(text: str | None) -> str:
    """The letters and numbers of a text in lower case, look-alikes resolved."""
    return _letters(consistent(text)) if text else ""


def _letters(form: str) -> str:
    return _NOT_TEXT.sub("", unicodedata.normalize("NFKC", form).casefold())


@lru_cache(maxsize=20_000)
def _asked(prompt: str) -> str:
    """``bare`` of a prompt; prompts seen lately are remembered, as several answers belong to each."""
    return bare(prompt)


def _is_copy(said: str, asked: str) -> bool:
    if not asked or asked not in said:
        return False
    before, _, after = said.partition(asked)
    return not after.replace(asked, "") and _announces(before, asked)


def _announces(before: str, asked: str) -> bool:
    """Whether what stands before a copied prompt only announces it: no more letters than the prompt itself has, or 24."""
    return len(before) <= max(24, len(asked))


def copies(answer: str | None, prompt: str | None) -> bool:
    """Whether the answer holds nothing but the prompt, behind an announcement at most."""
    return _is_copy(bare(answer), bare(prompt))


def refuses(answer: str | None) -> bool:
    """Whether an answer declines and holds nothing else."""
    return bool(answer) and _declines(consistent(answer))


def _declines(form: str) -> bool:
    declined = False
    for m in _SENTENCE.finditer(form.replace("’", "'").lower()):
        sentence = m[0].strip(" \n\t\"'“”*>-")
        if not _NOT_TEXT.sub("", sentence):
            continue
        if _REFUSAL.search(_QUOTED.sub(" ", sentence)):
            declined = True
        elif not _COURTESY.search(sentence):
            return False  # a sentence of substance
    return declined


def _flags(answer: str | None, prompt: str | None, cut: bool, expected: str | None, profiles: langid.Profiles) -> list[str]:
    form = consistent(answer) if answer else ""
    said = _letters(form)
    if not said:
        return ["empty"]
    out = []
    if prompt and _is_copy(said, _asked(prompt)):
        out.append("copies_question")
    if _declines(form):
        out.append("refusal")
    if cut:
        out.append("truncated")
    if expected and profiles.speaks(answer, expected) is False:
        out.append("other_language")
    return out


def _verdicts(rows: DataFrame, profiles: langid.Profiles) -> DataFrame:
    """``response_id, defects`` of rows with ``response_id, response, prompt, is_cut, expected``: one pass over the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for answer, prompt, cut, expected in zip(*(batch.column(c).to_pylist() for c in ("response", "prompt", "is_cut", "expected"))):
                found.append(_flags(answer, prompt, cut, expected, profiles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["response_id", "defects"])

    schema = T.StructType([rows.schema["response_id"], T.StructField("defects", T.ArrayType(T.StringType()))])
    return rows.select("response_id", "response", "prompt", "is_cut", "expected").mapInArrow(run, schema)


def triggered(response: DataFrame, scenario: DataFrame, slots: DataFrame, profiles: langid.Profiles) -> DataFrame:
    """``response_id, defects array<string>``: all rules that each answer triggers, in order."""
    answers = once_per_key(response.select("response_id", "received_at", "job_id", "slot", "response"), "response_id", "received_at")
    prompts = once_per_key(scenario.select("job_id", "received_at", "english", "chinese"), "job_id", "received_at")
    known = F.broadcast(slots.groupBy("slot").agg(F.max("language").alias("known")))  # a fixed table of a few slots
    expected = F.coalesce("known", F.when(F.col("slot").endswith("-zh"), "zh").when(F.col("slot").endswith("-en"), "en"))
    cut = truncation.judged(truncation.values(response, scenario))  # with the prompts, as in p5: all columns give evidence
    cut = cut.where(F.col("field") == "response.response").select(F.col("key").alias("response_id"), "is_cut")
    joined = answers.join(prompts.select("job_id", "english", "chinese"), "job_id", "left").join(known, "slot", "left").join(cut, "response_id", "left")
    ready = joined.withColumn("expected", expected).withColumn("is_cut", F.coalesce("is_cut", F.lit(False)))
    prompt = F.when(F.col("expected") == "zh", F.col("chinese")).when(F.col("expected") == "en", F.col("english"))
    return _verdicts(ready.withColumn("prompt", prompt), profiles)


def defects(response: DataFrame, scenario: DataFrame, slots: DataFrame, profiles: langid.Profiles) -> DataFrame:
    """``response_id, defect`` of each defective answer."""
    return triggered(response, scenario, slots, profiles).where(F.size("defects") > 0).select("response_id", F.col("defects")[0].alias("defect"))
