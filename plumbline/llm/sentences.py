"""Problem 8: sentence boundaries across languages, scripts and layouts.

Method: cascading segmentation rule tables (as in SRX). A table holds ordered pairs of regular expressions, each marked
as break or no-break: one for the text before a position, one for the text after it. The tables of a text's script are
tried in order and the first pair that matches decides the position. Candidate positions follow sentence marks; in Thai
they are spaces.

Layout comes first. Lines are joined to blocks: a heading line, a numbered paragraph and a claim each begin a block, a
blank line ends one, and any other line continues its block (so hard-wrapped lines are joined). A heading and a claim are one
unit each, whatever they hold; in all other blocks the tables decide. Positions within a quotation or bracket are no
candidates, unless the quotation ends there and a new sentence visibly begins.

A text whose Latin or Cyrillic letters are all in lower case takes the same tables plus one that lets lower-case letters
begin a sentence. Languages are not read from labels; the scripts of the whole text choose the tables, and its commonest
function words the abbreviations among their rules.

Each text is one pass in Arrow batches without any shuffle; offsets count code points.

Defined cases: null, empty and blank texts have no sentence. Every character besides white space belongs to exactly
one sentence. A text without any boundary is one sentence, however long. Keys are not deduplicated here: each row gives
its own sentences. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Abbreviations that always lead on to something, by language, as alternatives of a pattern (lower case);
# those of citations stand in texts of any language.
CITING = r"fig|figs|u\.\s?s|pat|pats|appl|dr|prof|cf|vs|e\.\s?g|i\.\s?e|et\s+al"
LEADING = {
    "en": r"eq|eqs|nos|mr|mrs|ms|approx|vol|vols|refs|ser|publ|resp|incl|inc|viz",
    "de": r"ca|bzw|anm|nr|abb|vgl|z\.\s?b|d\.\s?h|u\.\s?a|gem|bspw|sog|ggf|evtl|s\.\s?o|s\.\s?u|z\.\s?t|o\.\s?ä|einschl|max|mind",
    "fr": r"env|p\.\s?ex|dem|c\.-à-d|réf|mme|mlle|n°",
    "es": r"aprox|p\.\s?ej|núm|sr|sra|pág",
    "ru": r"т\.\s?е|напр|пп|прибл|ср|стр|гл|табл|т\.\s?н|т\.\s?к|ф-ла|макс",
}
# Fixed values, likewise: those that are usual words too and don't lead on to a word in letters with case; those that don't to
# a capital; and those that are units behind a number (and then usual words) and lead on elsewhere.
USUAL = {"en": "no|ex|tab|ch|ref|st", "de": "kap|abs|art|tab", "fr": "art|chap|rev", "es": "cap", "ru": "рис|ок"}
BEFORE_SMALL = {"en": "max", "fr": "max"}
UNIT_OR = {"en": "sec|secs|wt", "ru": "см|г|гг|п|мин"}
# Words that tell the language of a text.
FUNCTION_WORDS = {
    "en": frozenset("the of and to is are by with for from that which this an it be as".split()),
    "de": frozenset("der die das und ist mit von ein eine einer den dem des zu auf wird im für nicht sich".split()),
    "fr": frozenset("le la les et est une un dans du des pour par que sur avec au aux qui ce".split()),
    "es": frozenset("el la los las y es una un en del por para que con se al su como".split()),
    "ru": frozenset("и в на с по из для не что или к от это при до как".split()),
}
# Abbreviations that lead on only to a number, and words that go on after an abbreviation of a list's end.
NUMBERED = r"min|mind|p|pp|par|art|step|n|seq|col|line|s|bd|z|pos"
GOES_ON = r"and|or|und|oder|et|ou|и|или|без|without|with|mit|y|for|to|in|of"

# Headings of patent documents in lower case.
HEADINGS = {
    *("abstract|summary|description|claims|claim|what is claimed is|background|technical field|brief description of the drawings|detailed description|field of the invention".split("|")),
    *("zusammenfassung|beschreibung|ansprüche|patentansprüche|abrégé|resumé|résumé|revendications|resumen|descripción|reivindicaciones".split("|")),
    *("реферат|описание|формула изобретения|摘要|说明书|說明書|权利要求书|權利要求書|权利要求|要約|発明の詳細な説明|特許請求の範囲|請求の範囲|明細書".split("|")),
    *("บทสรุป|บทสรุปการประดิษฐ์|รายละเอียดการประดิษฐ์|ข้อถือสิทธิ|सारांश|विवरण|दावे|दावा".split("|")),
}
CLAIM_HEADINGS = {
    *("claims|claim|what is claimed is|ansprüche|patentansprüche|revendications|reivindicaciones|формула изобретения".split("|")),
    *("权利要求书|權利要求書|权利要求|特許請求の範囲|請求の範囲|ข้อถือสิทธิ|दावे|दावा".split("|")),
}

_UP = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
_LOW = "a-zß-öø-ÿα-ωа-яё"
#: Letters without case outside those: Hebrew to Thaana, Indic to Georgian, Hangul, Ethiopic, Khmer and Mongolian.
_UNCASED = "\u05d0-\u07bf\u0900-\u10ff\u1100-\u139f\u1780-\u18af\uac00-\ud7a3"
#: Sentence marks of scripts without rule tables of their own: Arabic and Urdu, Ethiopic, Khmer, Burmese and Armenian.
_OTHER_MARKS = "؟۔።፧៕។။։"
_CJK = "぀-ヿ㐀-䶿一-鿿\uf900-\ufaff"
#: What a sentence can begin with: an upper-case letter (also behind a quote or bracket), a number, a paragraph number,
#: a word like "pH", or a letter of a script without case.
_BEGIN = rf"[\"“„«‘'(\[]*(?:[{_UP}\d\[【]|[{_LOW}][{_UP}]|[{_CJK}{_UNCASED}]|[<$\\�&])"


class _OneLetter:
    """Contains every word of one letter."""

    def __contains__(self, word: str) -> bool:
        return len(word) == 1


@dataclass(frozen=True)
class Rule:
    """A pair of expressions: what ends before a position and what follows it.

    ``marks`` and ``words`` say which sentence mark and which word before it the first expression can match at all, so
    that most rules are passed over without trying an expression.
    """

    breaks: bool
    before: re.Pattern
    after: re.Pattern
    marks: str | None
    words: object


def rule(breaks: bool, before: str, after: str = "", marks: str | None = None, words: object = None) -> Rule:
    cased = re.search(r"\[A-Z|\[a-z|ß", before)
    return Rule(breaks, re.compile(f"(?:{before})\\Z", 0 if cased else re.IGNORECASE), re.compile(after), marks, words)


def last_words(alternatives: str) -> frozenset[str]:
    """The letters that stand right before the final point of each alternative."""
    return frozenset(re.search(r"[^\W\d_]*\Z", a.replace("\\s", " ").replace("\\.", "."))[0] for a in alternatives.split("|"))


_STOP = r"\.[\"”»)’'\]]*"
FORMULAS = [
    rule(False, r"\s\.", r"", ".", frozenset([""])),  # a spaced point: numbering or a formula
    rule(False, r"[=·./^]\s*[A-Za-z]\.", r"\s*[A-Za-zΔ�(]{1,3}(?![a-z])", ".", _OneLetter()),
]
_NUMBER = rf"\s*(?:[\d(№]|[{_UP}]{{1,3}}[-/.\s]?\d)"


def abbreviations(lang: str) -> list[Rule]:
    """The no-break rules for the abbreviations of a language."""
    out = [rule(False, rf"(?<!\w)(?:{words})\.", r"", ".", last_words(words)) for words in (LEADING[lang],)]
    no_word, no_capital = (rf"(?!\s*[\"“„«‘'(\[]*[{x}])|{_NUMBER}" for x in (_UP + _LOW, _UP))
    for words, before, after in ((USUAL, "", no_word), (BEFORE_SMALL, "", no_capital), (UNIT_OR, r"(?<![\d%]\s)", ""), (UNIT_OR, "", rf"(?!\s*[\"“„«‘'(\[]*[{_UP}{_LOW}\d])")):
        if lang in words:
            out.append(rule(False, rf"(?<!\w){before}(?:{words[lang]})\.", after, ".", last_words(words[lang])))
    if lang == "en":
        out.append(rule(False, r"(?<![A-Za-z])(?<!\d )St\.", rf"\s[{_UP}]", ".", frozenset(["st"])))  # Saint
    return out


CITATIONS = [rule(False, rf"(?<!\w)(?:{CITING})\.", r"", ".", last_words(CITING))]
#: By language; texts whose words tell none take those of all.
ABBREVIATIONS = {lang: [*CITATIONS, *abbreviations(lang)] for lang in LEADING}
ABBREVIATIONS[""] = CITATIONS + [r for lang in LEADING for r in abbreviations(lang)]
LETTERS = [rule(False, r"(?<!\w)\w\.", r"\s?\w\.(?!\d)", ".", _OneLetter())]
DATES = [rule(False, r"\b(?:am|vom|zum|im|ab|bis|seit|den|dem|der|die|das|le)\s+\d{1,3}\.", rf"\s+[{_UP}]", ".", frozenset([""]))]
UNITS = [rule(True, r"\b(?:per|pro|par|por|je|в)\s+\w+\.", rf"\s+{_BEGIN}", ".")]
NUMBERS = [rule(False, rf"(?<!\w)(?:{NUMBERED})\.", r"\s*[\d(№]", ".", frozenset(NUMBERED.split("|")))]
_ENDING = r"etc|usw|u\.\s?s\.\s?w|т\.\s?д|т\.\s?п|и др"
LIST_ENDS = [rule(False, rf"(?<!\w)(?:{_ENDING})\.", rf"\s+(?:{GOES_ON})\b", ".", last_words(_ENDING))]
MARKS = [
    rule(True, r"[!?…]+[\"”»)’'\]]*", rf"\s+{_BEGIN}", "!?…"),
    rule(True, _STOP, rf"\s+{_BEGIN}", "."),
]
ATTACHED = [
    rule(True, rf"(?:[a-zß-öø-ÿа-яё]{{2,}}|\d\s?[A-Za-zА-Яа-я]{{1,3}}|\bin [A-Z]|[)%\d])[.!?]", rf"[{_UP}](?:[{_LOW}]|\s)|[{_LOW}][{_UP}]\s|[\[【]\d", ".!?"),
    rule(True, rf"(?:[a-zß-öø-ÿа-яё]{{3,}}|\d\s?(?:mm|cm|kg|min|g|s|K|bar)|\bin [A-Z]|\))[.!?]", r"\d", ".!?"),
]
LOWER_CASE = [
    rule(True, r"[!?…]+[\"”»)’'\]]*", r"\s+\S", "!?…"),
    rule(True, _STOP, rf"\s+[{_LOW}]", "."),
    rule(True, rf"(?:[a-zß-öø-ÿа-яё]{{3,}}|\d\s?[a-zа-я]{{1,3}}|\bin [a-z]|\))[.!?]", rf"[{_LOW}]+\s", ".!?"),
]
IDEOGRAPHIC = [
    rule(True, r"[。！？｡][」』”’）)\"〉》】]*", r"", "。！？｡"),
    rule(True, rf"[{_CJK}][.!?]+[」』”’）)\"]*", rf"\s*[{_CJK}\[【]", ".!?"),
]
DANDA = [
    rule(True, r"[।॥][”\"’)]*", r"", "।॥"),
    rule(True, r"[!?]+[”\"’)]*", r"\s+\S", "!?"),
    rule(False, r"", r""),
]
OTHERS = [rule(True, rf"[{_OTHER_MARKS}][”\"’»)\]]*", r"", _OTHER_MARKS)]
# Thai: spaces are the candidates.
_THAI = "ก-๛"
# Words that open a Thai clause: conjunctions, adverbs of discourse, nominalisers and modal verbs.
_THAI_OPENERS = (
    "การ|ความ|เมื่อ|ขณะ|ระหว่าง|หาก|ถ้า|เพราะ|เนื่องจาก|ดังนั้น|อย่างไรก็ตาม|นอกจากนี้|จากนั้น|ต่อมา|แต่|ทั้งนี้|สำหรับ|โดยทั่วไป|โดยปกติ|ในอีก|ในการ|ตามที่|ตามรูป|ควร|ต้อง|ห้าม|อาจ"
)
THAI = [
    rule(False, r"(?:^|\s)[\[【]\s?\d+\s?[\]】]", r""),
    rule(False, r"", r"\s+[\d(=+\-−±<>/]"),
    rule(False, r"\d\S*", r"\s+(?:มม|ซม|กก|กรัม|วินาที|นาที|บาร์|องศา|เคลวิน|ต่อ|ถึง|หรือ|และ)"),
    rule(False, r"", r"\s+(?:หรือ|และ|ต่อ|ตามต้องการ|ถึง|ซึ่ง|โดยที่|โดยใช้|โดยไม่|ที่|จาก|กับ|เช่น|คือ|มม\.|ๆ|ฯ)"),
    rule(False, r"(?:รูปที่|ข้อถือสิทธิ|ตัวอย่าง|สูตร|สมการ|ข้อ|ที่|ระดับ|ประมาณ)(?:\s+\d+)?", r""),
    rule(False, r"\d+", rf"\s+(?!(?:{_THAI_OPENERS}))"),
    rule(True, rf"[{_THAI}.”\"’)!?]", rf"\s+[“\"‘]?[{_THAI}]"),
    rule(True, r"[^\s]", rf"\s+(?:{_THAI_OPENERS})"),
    rule(True, r"[!?]", r"\s"),
]



def tables(lang: str) -> dict[str, list[Rule]]:
    """The rule tables by script for a language."""
    own = ABBREVIATIONS[lang]
    cased = [*IDEOGRAPHIC[:1], *DANDA[:1], *OTHERS, *FORMULAS, *UNITS, *own, *LETTERS, *DATES, *NUMBERS, *LIST_ENDS, *MARKS, *ATTACHED, *IDEOGRAPHIC[1:]]
    return {
        "cased": cased,
        "lower": [*cased[:-1], *LOWER_CASE, *cased[-1:]],
        "ideographic": [*IDEOGRAPHIC, *OTHERS, *FORMULAS, *own, *LETTERS, *MARKS],
        "danda": [*DANDA[:1], *OTHERS, *DANDA[1:]],
        "thai": THAI,
    }


TABLES = {lang: tables(lang) for lang in ABBREVIATIONS}

_CANDIDATE = re.compile(rf"(?:\.(?!\d)|\.(?<=[A-Za-zß-öø-ÿа-яё)]\.)(?=\d)|[!?…。！？｡।॥{_OTHER_MARKS}]+)[\"”»’')\]」』）〉》】]*")
_TAIL = re.compile(r"[^\W\d_]*\Z")
_THAI_CANDIDATE = re.compile(r"(?<=\S)(?=\s+\S)")
_PAIRED = re.compile(r"[\"“”„«»「」『』()（）\[\]]")
_OPENING = "“„«「『(（["
_OPENED_BY = {"”": "“„", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "["}
_WIDE = re.compile(f"[{_CJK}。！？，、；：]")
_NEW_SENTENCE = re.compile(rf"\s+[{_UP}]")
_VISIBLE = re.compile(r"\S")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_PARAGRAPH = re.compile(r"\s*(?:\[\s?\d{1,5}\s?\]|【\s?[0-9０-９]{1,5}\s?】|［\s?[0-9０-９]{1,5}\s?］)")
_CLAIM = re.compile(r"\s*(?:(?:【\s?請求項\s?|\[\s?claim\s?|claim\s|权利要求\s?)?([0-9０-９]+)\s?(?:】|\]|[.)．、:：）](?![0-9])))", re.IGNORECASE)
_LEADS_ON = {
    lang: re.compile(rf"(?<!\w)(?:{'|'.join([CITING, *(w[x] for w in (LEADING, USUAL, BEFORE_SMALL, UNIT_OR) for x in w if x == (lang or x))])}|{NUMBERED})\.\s*\Z", re.IGNORECASE)
    for lang in ABBREVIATIONS
}
_LONGEST_HEADING = max(map(len, HEADINGS))
_BEFORE_HEAD, _AFTER_HEAD = " \t【[*#=_-", " \t】]*#=_:：.-"
_SCRIPTS = (("thai", re.compile("[ก-๛]+")), ("danda", re.compile("[ऀ-ॿ]+")), ("ideographic", re.compile(f"[{_CJK}]+")), ("cased", re.compile(f"[{_UP}{_LOW}]+")))


def table_of(text: str) -> str:
    """The name of the rule tables for a text: those of its commonest script."""
    if text.isascii():
        found = "cased"
    else:
        counts = {name: len("".join(p.findall(text))) * (2 if name == "ideographic" else 1) for name, p in _SCRIPTS if p.search(text)}
        found = max(counts, key=counts.get, default="cased")
    if found == "cased" and (text.islower() or not _CAPITALISED.search(text)):
        return "lower"
    return found


_CAPITALISED = re.compile(f"(?<![{_UP}{_LOW}])[{_UP}][{_LOW}]")


_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values())


def language_of(text: str) -> str:
    """The language whose function words are commonest in a text; empty where two are equally common or none occurs."""
    met = Counter(filter(_FUNCTION_WORDS.__contains__, text.lower().split()))
    counts = sorted(((sum(n for w, n in met.items() if w in known), lang) for lang, known in FUNCTION_WORDS.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else ""


def blocks(text: str, lang: str = "") -> list[tuple[int, int, bool]]:
    """``start, end, whole`` of the blocks; a whole block is one sentence."""
    out: list[list] = []
    open_block = False  # whether the next line may continue the last block
    claims = False
    number = 0
    after_blank = True
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    for i, (a, b) in enumerate(lines):
        line = text[a:b]
        bare = line.strip()
        if not bare:
            open_block, after_blank = False, True
            continue
        head = bare.lstrip(_BEFORE_HEAD).rstrip(_AFTER_HEAD) if bare[-1] not in ".。।;；,，" else ""
        head = head.lower() if len(head) <= _LONGEST_HEADING else ""
        if head in HEADINGS or after_blank and _is_title(bare) and i + 1 < len(lines) and text[b : lines[i + 1][1]].strip():
            out.append([a, b, True])
            open_block, after_blank = False, False
            claims = head in CLAIM_HEADINGS
            number = 0
            continue
        claim = _CLAIM.match(line) if (claims or after_blank) and (bare[0].isdigit() or bare[0] in "【[cC权") else None
        value = int(claim[1]) if claim else 0
        if claim and (claims or after_blank) and number < value and (number or value == 1) and not (out and open_block and _LEADS_ON[lang].search(text[out[-1][0] : a])):
            claims, number = True, value
            out.append([a, b, True])
            open_block = True
        elif bare[0] in "[【［" and _PARAGRAPH.match(line) and not (claims and number):
            out.append([a, b, False])
            open_block = True
        elif claims and number and out and not after_blank or open_block:
            out[-1][1] = b
        elif claims and number and out and _goes_on(text[out[-1][0] : out[-1][1]]):
            out[-1][1] = b
        else:
            out.append([a, b, False])
            open_block = True
        after_blank = False
    return [tuple(x) for x in out]


def _goes_on(block: str) -> bool:
    """Whether a claim is open at its end, so that a blank line lies within it."""
    return block.rstrip()[-1:] in ";；,，:：、"


def _is_title(line: str) -> bool:
    """A short line without a mark, of at most three words, that isn't broken off by a hyphen."""
    return len(line.split(None, 3)) <= 3 and line[-1].isalpha() and not any(c.isdigit() for c in line) and (line.isupper() or line.istitle()) and not re.search(f"[{_CJK}]", line)


def spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The outermost quotations and brackets between two offsets, of any length, in order.

    A mark that closes a pair drops what is left open within it; marks without a partner give no span. A straight quote
    opens behind white space or a mark and closes behind anything else; a second one that can only open replaces the first.
    """
    marks = list(_PAIRED.finditer(text, a, b))
    if len(marks) < 2:
        return []
    opened: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}  # the places of each kind in ``opened``
    found: list[tuple[int, int]] = []

    def close(kind: str, end: int) -> None:
        at = where[kind][-1]
        start = opened[at][1]
        drop(at)
        while found and found[-1][0] > start:
            found.pop()
        found.append((start, end))

    def drop(at: int) -> None:
        while len(opened) > at:
            where[opened.pop()[0]].pop()

    def push(kind: str, start: int) -> None:
        where.setdefault(kind, []).append(len(opened))
        opened.append((kind, start))

    for m in marks:
        c, i = m[0], m.start()
        if c == '"':
            before, after = text[i - 1 : i] if i > a else " ", text[i + 1 : i + 2] if i + 1 < b else " "
            opens = not after.isspace() and (before.isspace() or not before.isalnum() and before not in ".,;:!?…%)]")
            if where.get(c) and not (opens and before.isspace()):
                close(c, i + 1)
            elif opens or not before.isdigit() and not after.isspace() and _WIDE.match(before):
                if where.get(c):
                    drop(where[c][-1])
                push(c, i)
        elif c == "“" and where.get("„"):
            close("„", i + 1)
        elif c in _OPENING:
            push(c, i)
        else:
            kind = max((k for k in _OPENED_BY[c] if where.get(k)), key=lambda k: where[k][-1], default=None)
            if kind:
                close(kind, i + 1)
    return found


def _words_before(text: str, start: int, end: int) -> int:
    """Where the last words before ``end`` begin, as far as a rule looks back: 24 characters, and three words at least."""
    at = max(start, end - 24)
    if at > start and text.count(" ", at, end) < 3:
        words = text[start:end].rsplit(None, 3)
        return start + (len(words[0]) if len(words) > 3 else 0)
    return at


def split(text: str | None) -> list[tuple[int, int]]:
    """The offsets of the sentences of a text."""
    if not text or text.isspace():
        return []
    name = table_of(text)
    lang = language_of(text) if name in ("cased", "lower") else ""
    rules = TABLES[lang][name]
    candidate = _THAI_CANDIDATE if name == "thai" else _CANDIDATE
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        part = part.strip()
        if part:
            out.append((a + left, a + left + len(part)))

    for a, b, whole in blocks(text, lang):
        if whole:
            add(a, b)
            continue
        held = spans(text, a, b) if name != "thai" else []
        at, now = a, 0
        for m in candidate.finditer(text, a, b):
            pos = m.end()
            while now < len(held) and held[now][1] < pos:
                now += 1
            inside = now < len(held) and held[now][0] < m.start() < held[now][1]
            if inside and (pos < held[now][1] or text[held[now][1] - 1] in ")）]" or not _NEW_SENTENCE.match(text, pos, b)):
                continue
            if not _VISIBLE.search(text, pos, b):
                continue
            first = m.start()
            left = text[_words_before(text, at, first) : pos]
            mark = text[first : first + 1]
            word = _TAIL.search(text, max(at, first - 12), first)[0].lower() if mark == "." else ""  # the listed words are shorter
            for r in rules:
                if r.marks is not None and mark not in r.marks or r.words is not None and word not in r.words:
                    continue
                if r.after.match(text, pos, b) and r.before.search(left):
                    if r.breaks:
                        add(at, pos)
                        at = pos
                    break
        add(at, b)
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_pos, end_pos``: one row for each sentence of each text."""
    schema = T.StructType([df.schema[key], T.StructField("start_pos", T.IntegerType(), False), T.StructField("end_pos", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in split(t):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, schema)
