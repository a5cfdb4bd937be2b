"""Problem 3: missing or wrong language labels, and texts in several languages.

Method: rank-order profiles. The n-grams (1 to 3 characters within words) of the labelled sentences of each language are
ranked by frequency; a sentence is compared to each profile by the out-of-place distance (the sum of the differences of
ranks; a missing n-gram costs the whole profile length) and takes the nearest language. All languages are compared for every sentence; its scripts take part as further n-grams, ahead of the
others. The confidence is the margin between the nearest and the second language as a share of the largest possible
distance, scaled by how much text there is.

The profiles are fitted on at most ``SAMPLE_ROWS`` labelled rows per language (a documented bound); they are a few
thousand n-grams a language and travel with the Python function. Classification is one pass over the column in Arrow
batches, without any shuffle besides the pick of one row for each key.

A text is cut into sentences; each sentence is judged by the letters of its dominant script. Names and quoted words of
another script don't decide: quotations and brackets are left out, and the scripts are weighed by words (two
characters of an unspaced script count as one). Fragments below ``SHORT`` letters take the language of their
neighbours. Neighbouring sentences of one language make a segment.

Defined cases: null texts, and texts without a letter, have no language and are no cases. Text that shares no n-gram with
any profile has the language ``und`` with confidence 0; it makes an answer a mixed one, but names no language of a case. The label is read by its
primary subtag in any letter case and with any separator, in two- or three-letter codes or as the language's name;
other values, blanks and placeholders name no language. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rank import first_n
from .common import once_per_key
from .lookalike import consistent

#: Labelled rows of each language that a profile is fitted on at most, and the n-grams it holds.
SAMPLE_ROWS = 2000
PROFILE = 3000
#: Longest n-gram; letters below which a stretch is a fragment.
LONGEST = 3
SHORT = 12
#: Distinct sentences that a task remembers the language of.
REMEMBERED = 200_000
#: The language of text in a script that no profile knows (the code of standards for undetermined languages).
UNKNOWN = "und"
#: Confidence below which a sentence follows a neighbour of its script group.
DOUBTFUL = 0.2

# Usual spellings of language labels (primary subtags and names).
LABELS = {
    "en": "en eng english anglais englisch inglés 英语 英文",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 简体中文 繁體中文",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "ru": "ru rus russian русский",
    "ja": "ja jpn jp japanese 日本語 日语",
}
_KNOWN = {w: lang for lang, words in LABELS.items() for w in words.split()}


def label_language(label: Column) -> Column:
    """The language that a label names in any usual spelling, else null."""
    primary = F.regexp_extract(F.lower(F.trim(label)), r"^[\s\"'\[(]*([\p{L}]+)", 1)
    known = F.create_map(*[F.lit(x) for pair in _KNOWN.items() for x in pair])
    return F.try_element_at(known, primary)


_GROUPS = (
    ("unspaced", re.compile("[぀-ヿ㐀-䶿一-鿿\uf900-\ufaff]+")),
    ("cyrillic", re.compile("[Ѐ-ԯ]+")),
    ("latin", re.compile("[A-Za-zÀ-ɏ]+")),
    ("other", re.compile(r"[^\W\d_A-Za-zÀ-ɏЀ-ԯ぀-ヿ㐀-䶿一-鿿\uf900-\ufaff]+")),
)
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|「[^」\n]*」|«[^»\n]*»|\([^()\n]*\)|（[^（）\n]*）')
_MARKED = re.compile(r"[.!?。！？…][\"”’)」』）]*\s*$")
_CUT = re.compile(r"[^.!?。！？\n]*(?:[.!?]+[\"”’)]*(?=\s|$)|[。！？]+[”」』）]*|\n+|$|[.!?])")


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of rough sentences: enough for languages, boundaries don't matter to them."""
    out, start = [], 0
    for m in _CUT.finditer(text):
        if m.end() == m.start():
            continue
        if m[0][-1] in ".!?" and m.end() < len(text) and not text[m.end()].isspace():
            continue  # within a number or an abbreviation
        out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def is_whole(sentence: str) -> bool:
    """Whether a short stretch is a sentence rather than a name or a heading: it ends with a mark and holds, outside
    quotations, two words or three characters of a script without spaces."""
    outside = _QUOTED.sub(" ", sentence)
    if not _MARKED.search(sentence):
        return False
    return any(len(p.findall(outside)) > 1 if g != "unspaced" else sum(map(len, p.findall(outside))) > 2 for g, p in _GROUPS)


def letters_of(sentence: str) -> tuple[str, list[str]]:
    """The dominant script group of a sentence and its words in that script (lower case)."""
    outside = _QUOTED.sub(" ", sentence)
    for s in (outside, sentence):
        found = {g: p.findall(s) for g, p in _GROUPS}
        weight = {g: sum(len(w) for w in ws) / 2 if g == "unspaced" else len(ws) for g, ws in found.items()}
        best = max(weight, key=weight.get)
        if weight[best]:
            return best, [w.lower() for w in found[best]]
    return "", []


@lru_cache(maxsize=100_000)
def word_ngrams(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def ranked_ngrams(words: list[str]) -> list[str]:
    """The n-grams of the words by falling frequency (ties: by first appearance)."""
    return [g for g, _ in Counter(chain.from_iterable(map(word_ngrams, words))).most_common()]


_KANA, _HAN = re.compile("[぀-ヿ]"), re.compile("[㐀-䶿一-鿿\uf900-\ufaff]")


def script_grams(group: str, words: list[str]) -> list[str]:
    """The scripts of a sentence as further n-grams: all together (Han alone, kana alone and both differ) and each."""
    if group != "unspaced":
        return [f"\0{group}"]
    text = "".join(words)
    each = [f"\0{name}" for name, p in (("kana", _KANA), ("han", _HAN)) if p.search(text)]
    return ["".join(each) + "\0", *each]


#: The rank of an n-gram that a profile lacks: farther than any distance.
_ABSENT = np.iinfo(np.int32).max // 2


class Profiles:
    """The ranks of the n-grams of each language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.group: dict[str, str] = {UNKNOWN: "other"}
        self.ids: dict[str, int] = {}
        ranks = []
        for lang in self.languages:
            pairs = [letters_of(consistent(text)) for text in samples[lang]]
            self.group[lang] = max(Counter(g for g, _ in pairs if g).most_common(1), key=lambda x: x[1], default=("", 0))[0]
            scripts = [g for g, _ in Counter(g for p in pairs if p[1] for g in script_grams(*p)).most_common()]
            ranks.append({g: i for i, g in enumerate([*scripts, *ranked_ngrams([w for _, ws in pairs for w in ws])][:PROFILE])})
            for g in ranks[-1]:
                self.ids.setdefault(g, len(self.ids) + 1)
        self.rank = np.full((len(self.ids) + 1, len(self.languages)), _ABSENT, dtype=np.int32)
        for i, rank in enumerate(ranks):
            self.rank[[self.ids[g] for g in rank], i] = list(rank.values())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "read"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def distances(self, ranked: list[str]) -> np.ndarray:
        """The out-of-place distance of ranked n-grams to the profile of each language."""
        rows = self.rank.take(np.fromiter(map(self.ids.get, ranked, repeat(0)), np.int64, len(ranked)), axis=0)
        rows -= np.arange(len(ranked), dtype=np.int32)[:, None]
        return np.minimum(np.abs(rows, out=rows), PROFILE, out=rows).sum(axis=0)

    def judge(self, sentence: str) -> tuple[str | None, float, int]:
        """The language of a sentence, the confidence and the number of letters that decided (an unspaced one counts as two).

        All languages with a profile are compared; ``UNKNOWN`` with confidence 0 where no profile has any of the n-grams.
        """
        group, words = letters_of(sentence)
        if not words:
            return None, 0.0, 0
        size = sum(map(len, words)) * (2 if group == "unspaced" else 1)
        ranked = [*script_grams(group, words), *ranked_ngrams(words)]
        most = PROFILE * len(ranked)
        far = self.distances(ranked) if self.languages else np.array([most])
        first = int(far.argmin())  # ties: the first in alphabetical order
        if far[first] == most:
            return UNKNOWN, 0.0, size
        second = np.partition(far, 1)[1] if len(far) > 1 else most
        margin = (second - far[first]) / most
        return self.languages[first], float(min(1.0, 4 * margin) * min(1.0, size / 40)), size

    def reading(self, sentence: str) -> tuple[str | None, float, int, bool]:
        """``judge`` of the consistent form, and whether it is a whole sentence; sentences read lately are remembered."""
        if "read" not in self.__dict__:
            self.read = lru_cache(maxsize=REMEMBERED)(self._reading)
        return self.read(sentence)

    def _reading(self, sentence: str) -> tuple[str | None, float, int, bool]:
        part = consistent(sentence)
        return (*self.judge(part), is_whole(part))

    def speaks(self, text: str | None, lang: str) -> bool | None:
        """Whether a segment of a text is in a language; null where the text has no segments.

        A firm sentence keeps its language in ``segments``, so the first one in ``lang`` decides and no further one is read.
        """
        for a, b in sentences(text) if text else ():
            found, sure, size, _ = self.reading(text[a:b])
            if found == lang and size >= SHORT and sure >= DOUBTFUL:
                return True
        parts = self.segments(text)
        return any(p[2] == lang for p in parts) if parts else None

    def segments(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """``start, end, language, confidence`` of the stretches of a text in one language each."""
        if not text:
            return []
        judged = [[a, b, *self.reading(text[a:b])] for a, b in sentences(text)]
        firm = [i for i, j in enumerate(judged) if j[2] and j[4] >= SHORT and j[3] >= DOUBTFUL]
        firm = firm or [i for i, j in enumerate(judged) if j[2] and j[4] >= SHORT]
        if not firm:
            lang, sure, _ = self.judge(consistent(text))
            return [(judged[0][0], judged[-1][1], lang, round(sure, 4))] if lang else []
        for i, j in enumerate(judged):  # fragments and doubtful sentences follow their neighbours
            if i in firm:
                continue
            near = min(firm, key=lambda f: (abs(f - i), f))
            same = [f for f in firm if j[2] and self.group[judged[f][2]] == self.group[j[2]]]
            if j[4] < SHORT and same:
                j[2], j[3] = judged[min(same, key=lambda f: (abs(f - i), f))][2], 0.0
            elif not j[2] or j[4] < SHORT and not j[5]:
                j[2], j[3] = judged[near][2], 0.0
            elif same:
                j[2] = judged[min(same, key=lambda f: (abs(f - i), f))][2]
        out: list[list] = []
        for a, b, lang, sure, size, _ in judged:
            if out and out[-1][2] == lang:
                out[-1][1] = b
                out[-1][3] += sure * size
                out[-1][4] += size
            else:
                out.append([a, b, lang, sure * size, size])
        return [(a, b, lang, round(sure / max(size, 1), 4)) for a, b, lang, sure, size in out]


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", order: str = "sample_id") -> Profiles:
    """Profiles from at most ``SAMPLE_ROWS`` labelled rows per language (those with the smallest ``order``)."""
    known = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, order, text)
    rows: dict[str, list[str]] = {}
    for r in first_n(known, [lang], [F.col(order), F.col(text)], SAMPLE_ROWS).orderBy(lang, order, text).collect():
        rows.setdefault(r[lang], []).append(r[text])
    return Profiles(rows)


_SEGMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())]
    )
)


def segments(text: Column, profiles: Profiles) -> Column:
    """The language segments of a text as an array of structs; empty for texts without letters."""

    @F.pandas_udf(_SEGMENTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start_pos", "end_pos", "language", "confidence")
        for batch in batches:
            yield pd.Series([[dict(zip(names, s)) for s in profiles.segments(t)] for t in batch])

    return run.asNondeterministic()(text)  # so that no filter on the result computes it again


def detected(response: DataFrame, profiles: Profiles) -> DataFrame:
    """``response_id, label, slot, job_id, segments`` of each answer."""
    rows = once_per_key(response.select("response_id", "received_at", "job_id", "slot", F.col("language").alias("label"), "response"), "response_id", "received_at")
    return rows.select("response_id", "job_id", "slot", "label", segments(F.col("response"), profiles).alias("segments"))


def by_language(found: DataFrame) -> DataFrame:
    """``response_id, label, n_languages, languages``: the distinct languages of each answer that holds words."""
    langs = F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["language"])))
    return found.select("response_id", "label", langs.alias("languages")).where(F.size("languages") > 0)


def mislabelled(found: DataFrame) -> DataFrame:
    """``response_id, language``: the true language of answers with a wrong or missing label; each language of mixed ones."""
    named = label_language(F.col("label"))
    wrong = named.isNull() | (named != F.col("languages")[0])
    cases = by_language(found).where((F.size("languages") > 1) | wrong)
    return cases.select("response_id", F.explode("languages").alias("language")).where(F.col("language") != UNKNOWN)
