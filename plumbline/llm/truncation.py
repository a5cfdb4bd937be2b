"""Problem 5: values that stop before their text is over, and the rate of cut values of each source.

Method, in two steps; a value that the first one finds no copy for is left to the second.

*Near-copies.* A cut copy is like the beginning of its whole, however early it was cut. So min-hash banding (shingles of
five words; characters in scripts without spaces) is over the first 8, 16, 32, 64, ... words: a text has the buckets of all
these beginnings, and a text that ends without a mark looks into those of the longest beginning that it has. Within a
bucket the two are aligned word by word: the closing words must be met again (the last one perhaps as the beginning of a
longer word), and the words before them may differ by one edit (a word put in, left out or replaced; marks don't count)
in ten. A text whose alignment ends within a word or sentence of an equal longer copy is cut; one whose longer copies
differ in some word is cut if three times as many near-copies (counted in each bucket that they share) go on there as end
there, since texts of one pattern may be near-copies too. No pairs are emitted. Buckets without an open end or with one text only are dropped
before any text is shuffled; larger ones are split into blocks of ``BLOCK`` texts by ``BLOCK`` open ends, and the counts of
the blocks are summed.

*Closing words.* For the others the terminality of their closing words is scored. For every sequence of closing words (1
to 6 words or characters; names and numbers masked) all texts of the column tell how often the text goes on after it, how
often a sentence ends there with its mark, and how often a line ends there without one, and how often its last word goes on
to a longer word. Over all columns together the same is counted for closing words within sentences of the same first words,
and for these first words alone: some kinds of lines (titles, notes, list items) are complete without a mark. A value is cut if
its closing words are nearly always continued, if its last word is nearly always the beginning of a longer one, or if it
ends in words not known within a kind of sentence that has a mark. All tests compare rates; ``SUPPORT`` only says how many
observations a rate needs, so that ten times the data give ten times the cases. Only sequences that close some
value that is asked for leave the task that reads a text, and only buckets that some open end looks into: broadcasts of bounded size
(``hash_filter``) tell them.

Replacement characters at the end, brackets and quotations left open, and a closing comma or dash count as cut at once;
the closing words of such values are no evidence for others.

Defined cases: null, empty and blank values, and values without a word, are never cut. A key delivered again counts
once. Statistics are taken over the distinct texts of the column (case, look-alikes and spacing aside), so copies of a text
neither vouch for each other nor differ in their verdict. Extra columns are ignored; empty tables give
empty results (rates: no rows).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise
from .common import hash_filter, once_per_key, passes
from .lookalike import skeleton

#: Lengths of closing sequences, and how many observations a rate needs.
LENGTHS = (6, 4, 3, 2, 1)
SUPPORT = 5
#: How many times as often closing words must go on as end before they count as unfinished; in kinds of lines without marks.
GOES_ON_MORE, GOES_ON_MORE_IN_TITLES = 2, 20
#: Share of the longer words that a fragment may occur as a whole word besides.
STRAY = 0.02
#: Min-hash: 8 bands of 4 rows find beginnings of similarity 0.8 with a chance of 0.985.
BANDS, ROWS_A_BAND = 8, 4
SHINGLE = 5
#: The shortest beginning that has buckets, in words; each further one is twice as long.
BEGINNING = 8
#: Words before the last one that an alignment must meet again, and words for each edit before them.
ANCHOR = 3
WORDS_AN_EDIT = 10
#: Texts and open ends of a bucket that one task holds against each other.
BLOCK = 4096
#: Open ends of a bucket whose closing words are looked for in a text before it is cut into words.
FEW = 16
#: Distinct sentences that a task combines before it passes their counts on.
COMBINE = 20_000

_UNSPACED = "぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿"
_WORD = rf"[^\W\d_{_UNSPACED}]"
_UP, _LOW = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ", "a-zß-öø-ÿα-ωа-яё"
_CLOSERS = "\"'”’»」』)）]】》〉*_"
_STRONG = "!?。！？…।"
_C = re.escape(_CLOSERS)
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_NAME = re.compile(rf"(?<!\w)[{_UP}]{_WORD}+(?:['’-]{_WORD}+)*")
_ANY_WORD = re.compile(rf"{_WORD}{{2,}}")
_FIRST = re.compile(r"\W*\w+")
_END = re.compile(rf"(?:[{_STRONG}]+|\.(?=[{_C}]*(?:\Z|\s+(?![{_LOW}])|[{_UNSPACED}])))[{_C}]*|\n")
_MASKED = re.compile(rf"{_WORD}+(?:['’-]{_WORD}+)*|[{_UNSPACED}]|[^\w\s]|\w")
_TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|{_WORD}+(?:['’-]{_WORD}+)*|[{_UNSPACED}]|\w")
_HAS_WORD = re.compile(r"[^\W_]")
# Abbreviations that something always follows.
_LEADING = re.compile(
    r"(?:^|[^\w.])(?:vs|cf|i\.\s?e|e\.\s?g|incl|excl|approx|vol|fig|figs|dr|mr|mrs|prof|ca|resp|viz|esp|z\.\s?b|d\.\s?h|bzw|vgl|p\.\s?ex|c\.-à-d|env|"
    r"p\.\s?ej|т\.\s?е|напр|см)\.$",
    re.IGNORECASE,
)
#: An escape or entity that stops within itself.
_ESCAPE = re.compile(r"\\(?:[uU][0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&(?:#\w{0,6}|[alg]|am|amp|lt|gt|q|qu|quo|quot|n|nb|nbs|nbsp)$")
_GOES_ON = re.compile(r"[^\n.!?。！？…।]*[^\W_]")
_OPEN = {"(": ")", "（": "）", "“": "”", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»"}
_CLOSE = {b: a for a, b in _OPEN.items()}
_BRACKETS = re.compile("[" + re.escape("".join(_OPEN) + "".join(_CLOSE)) + "]")
_LONE = re.compile("[a-zа-я]")
_UNSPACED_CHAR = re.compile(f"[{_UNSPACED}]")


_SPACES = re.compile(r"[^\S\n ]|  ")


def plain(text: str) -> str:
    """The form in which values are read: look-alikes resolved, spaces single, line ends kept."""
    text = skeleton(text)
    if _SPACES.search(text):
        text = re.sub(r"[^\S\n]+", " ", text)
    return re.sub(r" ?\n[ \n]*", "\n", text).strip()


def _parts(body: str) -> tuple[str, list[tuple[str, str]]]:
    """A plain text with numbers masked (#), and its sentences with how each ends."""
    text = _NUMBER.sub("#", body)
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((text[at : m.start()].strip(), "bare" if m[0] == "\n" else "mark"))
        at = m.end()
    out.append((text[at:].strip(), "bare"))
    return text, [x for x in out if x[0] and _HAS_WORD_OR_NUMBER.search(x[0])]


def _titled(text: str) -> bool:
    names = len(_NAME.findall(text))
    return names > 0 and names > 0.6 * len(_ANY_WORD.findall(text))


def _masked(part: str, titled: bool) -> str:
    first = _FIRST.match(part)
    if not titled and first:
        part = part[: first.end()] + _NAME.sub("@", part[first.end() :])
    return part.lower()


def sentences(body: str) -> list[tuple[str, str]]:
    """The sentences of a plain text with numbers (#) and names (@) masked, in lower case, and whether each ends with a
    ``mark`` or ``bare``."""
    text, parts = _parts(body)
    titled = _titled(text)
    return [(_masked(part, titled), end) for part, end in parts]


def last_sentence(body: str) -> tuple[str, bool]:
    """The last of the ``sentences``, empty where there is none, and whether others stand before it."""
    text, parts = _parts(body)
    return _masked(parts[-1][0], _titled(text)) if parts else "", len(parts) > 1


_HAS_WORD_OR_NUMBER = re.compile(r"[^\W_]|#")


def look(body: str) -> str:
    """A first verdict on a plain text: ``cut``, ``whole``, or ``ask-bare`` and ``ask-mark`` where the statistics decide."""
    if body.endswith("�") or _ESCAPE.search(body):
        return "cut"
    opened: list[str] = []
    for c in _BRACKETS.findall(body):
        if c in _OPEN:
            opened.append(c)
        elif opened and opened[-1] == _CLOSE[c]:
            opened.pop()
    if opened or body.count('"') % 2:
        return "cut"
    end = body.rstrip(_CLOSERS + " ")
    if not end or end[-1] in _STRONG:
        return "whole"
    if body[-1] in ",，、;；:：-–—/(（" and _HAS_WORD.search(body.rsplit("\n", 1)[-1]):
        return "cut"
    if end[-1] == ".":
        if _LEADING.search(end):
            return "cut"
        return "whole" if len(end) < 2 or _UNSPACED_CHAR.match(end[-2]) else "ask-mark"
    return "ask-bare"


# Hashes are sums of word hashes times odd numbers, one for each place, and a number for each kind of key.
_RANDOM = np.random.default_rng(5)
_PLACE = _RANDOM.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = {k: _RANDOM.integers(1, 1 << 62, dtype=np.uint64) for k in (*LENGTHS, "within", "begun", "longer", "longer word")}
#: What is asked of a text, in this order: its closing sequences, and the keys of the other kinds.
ASKED = (*LENGTHS, "within", "begun", "longer", "longer word")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of sums (the last step of a well-known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words:
    """Hashes of words and of their beginnings, kept while they fit."""

    def __init__(self, most: int = 500_000):
        self.most, self.known, self.parts = most, {}, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear(), self.parts.clear()
        return np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))

    def one(self, word: str) -> int:
        if word not in self.known:
            self.known[word] = xxhash.xxh64_intdigest(word)
        return self.known[word]

    def beginnings(self, word: str) -> np.ndarray:
        """The hashes of all shorter beginnings of a word."""
        if word not in self.parts:
            self.parts[word] = np.array([xxhash.xxh64_intdigest(word[:n]) for n in range(1, len(word))], np.uint64)
        return self.parts[word]


def _key(kind: object, salt: np.uint64, total: np.ndarray) -> np.ndarray:
    return _mixed(total + _KIND[kind] + salt)


@lru_cache(maxsize=1000)
def _salt(field: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest("field " + field))


#: The salt of what is counted over all columns together.
_ALL = np.uint64(0)


def _sums(h: np.ndarray) -> list[np.ndarray]:
    """The sums over the last 0, 1, ... words up to each word (those that reach over a sentence's start are garbage)."""
    out = [np.zeros(len(h), np.uint64)]
    for n in range(max(LENGTHS)):
        out.append(out[-1] + np.concatenate([np.zeros(n, np.uint64), h[: len(h) - n]])[: len(h)] * _PLACE[n])
    return out


_64 = (1 << 64) - 1
_PLACES = [int(x) for x in _PLACE]


def _one_key(kind: object, salt: np.uint64, total: int) -> int:
    """``_key`` of one sum, signed."""
    h = total + int(_KIND[kind]) + int(salt) & _64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _64
    h ^= h >> 31
    return h - (1 << 64) if h >> 63 else h


def closing(words: list[str], field: str, hashes: _Words) -> tuple[list[int | None], bool]:
    """What is asked of an open last sentence, in the order of ``ASKED``, and whether its last word may be a fragment."""
    n, salt, last = len(words), _salt(field), words[-1]
    sums = [0]
    for place, word in zip(_PLACES, reversed(words[-max(LENGTHS) :])):
        sums.append(sums[-1] + hashes.one(word) * place)
    starts = [0]
    for place, word in zip(_PLACES[5:], words[:3]):
        starts.append(starts[-1] + hashes.one(word) * place)
    fragment = len(last) > 1 and last.isalpha() and not _UNSPACED_CHAR.match(last) or bool(_LONE.fullmatch(last))
    out = [_one_key(k, salt, sums[k]) if n >= k else None for k in LENGTHS]
    out.append(_one_key("within", _ALL, sums[min(3, n)] + starts[-1] * 3))
    sure = min(3, n - 1) if fragment else min(3, n)
    out.append(_one_key("begun", _ALL, starts[sure]) if sure else None)
    if not fragment:
        return [*out, None, None], False
    word = hashes.one(last) * _PLACES[0]
    before = hashes.one(words[-2]) * _PLACES[1] if n > 1 else 0
    return [*out, _one_key("longer", salt, word + before), _one_key("longer word", salt, word)], True


def counted(seen: dict[tuple[str, str, str], int], hashes: _Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (signed) of masked sentences ``{(field, sentence, end): number}`` and how often each goes on
    (mid), ends with a mark or bare. Of a filter ``wanted``, keys that it keeps out are left out."""
    parts = [(_MASKED.findall(s), f, e, n) for (f, s, e), n in seen.items()]
    parts = [p for p in parts if p[0]]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    with np.errstate(over="ignore"):
        flat = [w for ws, _, _, _ in parts for w in ws]
        h = hashes.hashes(flat)
        size = np.array([len(ws) for ws, _, _, _ in parts])
        first = np.repeat(np.cumsum(size) - size, size)
        place = np.arange(len(flat)) - first
        last = place == np.repeat(size, size) - 1
        salts = {f: _salt(f) for f in {p[1] for p in parts}}
        salt = np.repeat(np.array([salts[f] for _, f, _, _ in parts], np.uint64), size)
        end = np.repeat(np.array([1 if e == "mark" else 2 for _, _, e, _ in parts]), size)
        many = np.repeat(np.array([n for *_, n in parts]), size)
        what = np.where(last, end, 0)
        sums = _sums(h)
        keys, kinds, numbers = [], [], []

        def add(key: np.ndarray, kind: np.ndarray, number: np.ndarray) -> None:
            if wanted is not None:
                ok = passes(wanted, key)
                key, kind, number = key[ok], kind[ok], number[ok]
            keys.append(key), kinds.append(kind), numbers.append(number)

        for k in LENGTHS:
            ok = place + 1 >= k
            add(_key(k, salt[ok], sums[k][ok]), what[ok], many[ok])
        begun = np.zeros(len(flat), np.uint64)  # the sum over the first words up to here, three at most
        for n in range(3):
            at = np.minimum(first + n, len(flat) - 1)
            begun = begun + np.where(place >= n, h[at] * _PLACE[5 + n], np.uint64(0))
            ok = last & (place >= n)
            add(_key("begun", _ALL, begun[ok]), what[ok], many[ok])
        near = np.where(place >= 2, sums[3], np.where(place == 1, sums[2], sums[1]))
        add(_key("within", _ALL, near + begun * np.uint64(3)), what, many)
        # how often a word goes on to a longer one, alone and behind the word before it
        before = np.where(place > 0, np.concatenate([np.zeros(1, np.uint64), h[:-1]]), np.uint64(0))
        worded = np.fromiter((len(w) > 1 for w in flat), bool, len(flat))
        pairs = _mixed(_mixed(_mixed(salt[worded]) + before[worded]) + h[worded])
        _, at, back = np.unique(pairs, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=many[worded], minlength=len(at)).astype(np.int64)
        index = np.flatnonzero(worded)[at]
        begin = [hashes.beginnings(flat[i]) for i in index]
        lengths = np.array([len(b) for b in begin], dtype=np.int64)
        if len(begin) and lengths.sum():
            part = np.concatenate(begin) * _PLACE[0]
            salted, behind, number = (np.repeat(x, lengths) for x in (salt[index], before[index], total))
            none = np.zeros(len(part), np.int64)
            add(_key("longer", salted, part + behind * _PLACE[1]), none, number)
            add(_key("longer word", salted, part), none, number)
        key, kind, number = np.concatenate(keys), np.concatenate(kinds), np.concatenate(numbers)
    distinct, back = np.unique(key, return_inverse=True)
    table = np.stack([np.bincount(back[kind == w], weights=number[kind == w], minlength=len(distinct)) for w in range(3)], axis=1)
    return distinct.view(np.int64), table.astype(np.int64)


def decide(verdict: str, found: dict[object, tuple[int, int, int]], fragment: bool, several: bool) -> bool:
    """Whether a text is cut. ``found`` holds (mid, mark, bare) of what was asked, by kind (see ``ASKED``); the text's own
    end is still counted in it, once. ``several``: it has sentences before the last."""
    own = (0, 1, 0) if verdict == "ask-mark" else (0, 0, 1)
    less = {k: tuple(max(0, a - b) for a, b in zip(v, own)) for k, v in found.items()}
    none = (0, 0, 0)
    length = next((k for k in LENGTHS if sum(less.get(k, none)) >= SUPPORT), None)
    known = less.get(length, none)
    if verdict == "ask-mark":
        return known[0] > 10 * (known[1] + known[2])
    if fragment:
        for longer, size in (("longer", 2), ("longer word", 1)):
            goes_on = found.get(longer, none)[0]
            mid, mark, bare = less.get(size, none)
            if goes_on >= SUPPORT:
                if goes_on > GOES_ON_MORE * bare and mid + mark <= STRAY * goes_on:
                    return True
                break
    within, begun = less.get("within", none), less.get("begun", none)
    if sum(within) >= SUPPORT:
        return within[0] > GOES_ON_MORE * (within[1] + within[2])
    titles = begun[2] >= SUPPORT and begun[2] >= begun[1]
    if length:
        return known[0] > (GOES_ON_MORE_IN_TITLES if titles else GOES_ON_MORE) * (known[1] + known[2])
    return sum(begun) >= SUPPORT and begun[1] > 3 * begun[2] or several and sum(begun) < SUPPORT


def beginnings(n: int) -> list[int]:
    """The lengths of the beginnings of a text of ``n`` words that have buckets."""
    out, size = [], BEGINNING
    while size <= n:
        out.append(size)
        size *= 2
    return out


_SEED = np.random.default_rng(7)
_MUL = _SEED.integers(1, 1 << 62, BANDS * ROWS_A_BAND, dtype=np.uint64) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 62, BANDS * ROWS_A_BAND, dtype=np.uint64)
_FOLD = _SEED.integers(1, 1 << 62, ROWS_A_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def placed(texts: list[list[str]], hashes: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the beginnings of many texts, given by their words: the number of the text, the place of the bucket
    within it (by beginning, the longest last, then by band) and the bucket: a hash of length, band and its min-hashes."""
    sizes = [beginnings(len(words)) for words in texts]
    several = [i for i, own in enumerate(sizes) if own]
    if not several:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.concatenate([hashes.hashes(texts[i][: sizes[i][-1]]) for i in several])
        n = len(h) - SHINGLE + 1
        grams = _mixed(sum(h[i : i + n] * _PLACE[i] for i in range(SHINGLE)))
        # the shingles that each beginning has more than the one before it lie together; those over two texts belong to none
        longest = np.array([sizes[i][-1] for i in several])
        first = np.cumsum(longest) - longest
        levels = np.array([len(sizes[i]) for i in several])
        text = np.repeat(np.arange(len(several)), levels)
        level = np.arange(len(text)) - np.repeat(np.cumsum(levels) - levels, levels)
        size = BEGINNING << level
        ends = first[text] + size - SHINGLE + 1
        starts = np.where(level > 0, first[text] + size // 2 - SHINGLE + 1, first[text])
        bounds = np.stack([starts, np.minimum(ends, n)], axis=1).ravel()
        bounds = bounds[:-1] if bounds[-1] >= n else bounds
        low = np.stack([np.minimum.reduceat(grams * m + a, bounds)[::2] for m, a in zip(_MUL, _ADD)], axis=1)
        for k in range(1, int(levels.max())):
            at = np.flatnonzero(level == k)
            low[at] = np.minimum(low[at], low[at - 1])
        bands = (low.reshape(len(text), BANDS, ROWS_A_BAND) * _FOLD).sum(axis=2, dtype=np.uint64)
        keys = _mixed(bands + np.arange(BANDS, dtype=np.uint64) * _PLACE[6] + size.astype(np.uint64)[:, None] * _PLACE[7])
    place = level[:, None] * BANDS + np.arange(BANDS)
    return np.repeat(np.array(several)[text], BANDS), place.ravel(), keys.ravel()


def buckets(words: list[str], hashes: _Words) -> list[list[int]]:
    """The buckets of each beginning of one text, the longest last."""
    return placed([words], hashes)[2].view(np.int64).reshape(-1, BANDS).tolist()


_PLAIN = "field string, key bigint, body string"
_ENDS = "field string, id binary, body string, verdict string, asked array<bigint>, fragment boolean, several boolean, looks array<bigint>"


def _plain_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plain form of each value; null without a word."""
    for batch in batches:
        body = [plain(t) if t is not None and _HAS_WORD.search(t) else None for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.string())], names=["field", "key", "body"])


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first verdict on each text, what is asked of it, and the buckets that an open end looks into (``looks``)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema(
        [("field", pa.string()), ("id", pa.binary()), ("body", pa.string()), ("verdict", pa.string()), ("asked", longs), ("fragment", pa.bool_()), ("several", pa.bool_()), ("looks", longs)]
    )
    hashes = _Words()
    for batch in batches:
        rows, opened = [], []
        for field, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            verdict = look(body)
            asked, fragment, several = [], False, False
            if verdict.startswith("ask"):
                last, several = last_sentence(body)
                words = _MASKED.findall(last)
                if words:
                    asked, fragment = closing(words, field, hashes)
            if verdict == "ask-bare":
                opened.append(len(rows))
            rows.append([verdict, asked, fragment, several, []])
        texts = batch.column(2).take(pa.array(opened, pa.int32())).to_pylist()
        for numbers, row, place, bucket in _together(zip(opened, texts), hashes):
            longest = np.zeros(len(numbers), np.int64)
            np.maximum.at(longest, row, place // BANDS)
            own = place // BANDS == longest[row]
            for r, found in zip(row[own][::BANDS].tolist(), bucket[own].view(np.int64).reshape(-1, BANDS).tolist()):
                rows[numbers[r]][4] = found
        found = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[3:])]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.binary()), batch.column(2).cast(pa.string()), *found], schema=schema)


#: Words of several texts that are hashed together.
TOGETHER = 100_000


def _together(texts: Iterable[tuple[int, str]], hashes: _Words) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """``placed`` of numbered texts, some at a time, so that memory is bounded by the longest text: their numbers, and what it gives."""
    numbers: list[int] = []
    words: list[list[str]] = []
    held = 0
    for number, body in texts:
        numbers.append(number)
        words.append(_TOKEN.findall(body.lower()))
        held += len(words[-1])
        if held >= TOGETHER:
            yield (numbers, *placed(words, hashes))
            numbers, words, held = [], [], 0
    if numbers:
        yield (numbers, *placed(words, hashes))


def _placed_of(batches: Iterator[pa.RecordBatch], looked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``field, id, place, bucket`` of texts: those of their buckets that the filter ``looked`` lets through."""
    hashes = _Words()
    for batch in batches:
        for numbers, row, place, bucket in _together(enumerate(batch.column(2).to_pylist()), hashes):
            ok = passes(looked, bucket)
            rows = pa.array(np.array(numbers)[row[ok]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[ok].astype(np.int32)), pa.array(bucket[ok].view(np.int64))], names=["field", "id", "place", "bucket"])


def _counts_of(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``h, mid, mark, bare`` of the sentences, combined over many texts; of those keys that the filter ``wanted`` lets through."""
    seen: Counter = Counter()
    hashes = _Words()

    def flush() -> pa.RecordBatch:
        keys, table = counted(seen, hashes, wanted)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)]], names=["h", "mid", "mark", "bare"])

    for batch in batches:
        for field, body, verdict in zip(*(c.to_pylist() for c in batch.columns[:3])):
            found = sentences(body)
            for s, e in found[:-1] if verdict == "cut" else found:  # where a text was cut, nothing ends
                seen[field, s, e] += 1
            if len(seen) >= COMBINE:
                yield flush()
    if seen:
        yield flush()


def _filtered(df: DataFrame, run: Callable, bits: Broadcast, schema: str) -> DataFrame:
    """``df`` through ``run(batches, filter)``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches, bits.value)

    return df.mapInArrow(over, schema)


def edits(a: list[str], b: list[str], most: int) -> int:
    """The edits (insert, delete, replace) between two lists of words; ``most + 1`` where there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j, k = len(a), len(b)
    while j > i and k > i and a[j - 1] == b[k - 1]:
        j, k = j - 1, k - 1
    a, b = a[i:j], b[i:k]
    if not a or not b or len(a) == len(b) == 1:
        return max(len(a), len(b))
    if len(set(a).difference(b)) > most:  # each of these words is an edit
        return most + 1
    over = most + 1
    row = [min(m, over) for m in range(len(b) + 1)]
    for n, x in enumerate(a, 1):  # within a band, as more than ``most`` words can't be put in or left out
        low, high = max(1, n - most), min(len(b), n + most)
        now = [over] * (len(b) + 1)
        if n <= most:
            now[0] = n
        for m in range(low, high + 1):
            now[m] = min(row[m] + 1, now[m - 1] + 1, row[m - 1] + (x != b[m - 1]))
        if min(now[low - 1 : high + 1]) > most:
            return over
        row = now
    return min(row[-1], over)


def goes_on(norm: str, end: int, word: str, last: str) -> bool:
    """Whether a text goes on within the word or sentence, where ``word`` ends at ``end`` and the copy ends with ``last``."""
    return word != last or bool(_GOES_ON.match(norm, end))


class _Block:
    """The open ends of a block, and what its texts say of them; texts are held until ``HELD`` words are together."""

    def __init__(self, hashes: _Words) -> None:
        self.hashes = hashes
        self.opened: list[list] = []  # [id, words, edits allowed, an equal copy goes on, copies that go on, copies that end]
        self.by_anchor: dict[tuple[str, ...], list[int]] = {}
        self.nearest: set[str] = set()  # the words right before the last ones
        self.texts: list[tuple] = []  # (id, words, [(words before the place, where the word there ends, norm)])
        self.held = 0

    def ask(self, key: bytes, norm: str) -> None:
        words = _TOKEN.findall(norm)
        self.by_anchor.setdefault(tuple(words[:-1][-ANCHOR:]), []).append(len(self.opened))
        self.opened.append([key, words, max(1, len(words) // WORDS_AN_EDIT), False, 0, 0])
        self.nearest.update(words[-2:-1])

    def meet(self, key: bytes, norm: str, size: int) -> None:
        if len(self.opened) <= FEW and not any(one[0] != key and all(w in norm for w in one[1][-1 - ANCHOR :]) for one in self.opened):
            return  # none of them can be met, so the text isn't cut into words
        found = list(islice(_TOKEN.finditer(norm), 2 * size + 2 * size // WORDS_AN_EDIT + 1))
        words = [m[0] for m in found]
        places = [i for i, w in enumerate(words[:-1], 1) if w in self.nearest and tuple(words[max(0, i - ANCHOR) : i]) in self.by_anchor]
        if places:
            self.texts.append((key, words, [(i, goes_on(norm, found[i].end(), "", "")) for i in places]))
            self.held += len(words)
            if self.held >= HELD:
                self.align()

    def align(self) -> None:
        """Hold the texts against the open ends with the same words before the last one."""
        at: dict[tuple[str, ...], list[tuple]] = {}
        for key, words, places in self.texts:
            for i, on in places:
                at.setdefault(tuple(words[max(0, i - ANCHOR) : i]), []).append((key, words[:i], words[i], on))
        for anchor, met in at.items():
            own = [self.opened[i] for i in self.by_anchor[anchor]]
            for o, t, same in near(own, met, self.hashes):
                one, (_, _, word, on) = own[o], met[t]
                on = on or word != one[1][-1]
                one[3] = one[3] or on and same
                one[4 if on else 5] += 1
        self.texts, self.held = [], 0

    def told(self) -> list[tuple]:
        self.align()
        return [(one[0], one[3], one[4], one[5]) for one in self.opened if one[4] or one[5]]


#: Words of texts that a block holds, and pairs of a text and an open end that are compared at once, each by its words.
HELD, PAIRS = 1_000_000, 2_000_000


def near(opened: list[list], met: list[tuple], hashes: _Words) -> Iterator[tuple[int, int, bool]]:
    """The pairs of an open end ``[id, words, edits allowed, ...]`` and a place in another text ``(id, words before it, word, ...)``
    whose word begins with the last one of the open end and whose words before it are few enough edits away; whether none."""
    if len(opened) * len(met) <= FEW:
        for o, one in enumerate(opened):
            for t, (key, before, word, _) in enumerate(met):
                if one[0] != key and word.startswith(one[1][-1]) and abs(len(before) + 1 - len(one[1])) <= one[2]:
                    n = edits(one[1][:-1], before, one[2])
                    if n <= one[2]:
                        yield o, t, n == 0
        return
    size, length = np.array([len(one[1]) - 1 for one in opened]), np.array([len(m[1]) for m in met])
    most = np.array([one[2] for one in opened])
    number: dict[bytes, int] = {}
    key, other = (np.array([number.setdefault(x[0], len(number)) for x in side]) for side in (opened, met))
    lasts, last = np.unique([one[1][-1] for one in opened], return_inverse=True)
    nexts, following = np.unique([m[2] for m in met], return_inverse=True)
    begins = np.array([[w.startswith(x) for w in nexts.tolist()] for x in lasts.tolist()])
    wide = int(max(size.max(), length.max())) or 1
    a = _Rows([one[1][:-1] for one in opened], wide, 0, hashes)
    step = max(1, PAIRS // wide // len(opened))
    for begin in range(0, len(met), step):
        part = slice(begin, begin + step)
        ok = (np.abs(size[:, None] - length[None, part]) <= most[:, None]) & (key[:, None] != other[None, part]) & begins[last][:, following[part]]
        o, t = np.nonzero(ok)
        if not len(o):
            continue
        texts, at = np.unique(t + begin, return_inverse=True)
        b = _Rows([met[i][1] for i in texts.tolist()], wide, 1, hashes)
        alike = a.ahead[o] == b.ahead[at]
        ahead = _run(alike)
        behind = np.minimum(_run(a.behind[o] == b.behind[at]), np.minimum(size[o], length[texts[at]]) - ahead)
        left, right = size[o] - ahead - behind, length[texts[at]] - ahead - behind
        longer, allowed = np.maximum(left, right), most[o]
        within = longer <= allowed  # an edit for each of these words at most
        swapped = (left == right) & (size[o] - alike.sum(axis=1) <= allowed)
        sure = within | swapped
        # a single edit leaves nothing to align on one side, or a word on both; each word that the other side lacks is an edit
        doubtful = ~sure & (allowed > 1) & (np.minimum(left, right) > 0)
        mine, its = a.marks[o], b.marks[at]
        lacking = np.maximum(np.bitwise_count(mine & ~its).sum(axis=1), np.bitwise_count(its & ~mine).sum(axis=1))
        for i in np.flatnonzero(doubtful & (lacking <= allowed)).tolist():
            sure[i] = edits(opened[o[i]][1][:-1], met[texts[at[i]]][1], int(allowed[i])) <= allowed[i]
        yield from zip(o[sure].tolist(), texts[at[sure]].tolist(), (longer[sure] == 0).tolist())


class _Rows:
    """Lists of words by their hashes, from the first word on and from the last one on, and the marks of the words they hold."""

    def __init__(self, lists: list[list[str]], wide: int, fill: int, hashes: _Words):
        self.ahead, self.behind = (np.full((len(lists), wide), fill, np.uint64) for _ in range(2))
        self.marks = np.zeros((len(lists), 4), np.uint64)
        for i, words in enumerate(lists):
            h = hashes.hashes(words)
            self.ahead[i, : len(h)], self.behind[i, : len(h)] = h, h[::-1]
        held = np.arange(wide) < np.array([len(words) for words in lists])[:, None]
        row, h = np.nonzero(held)[0], self.ahead[held]
        bits = np.uint64(1) << (h >> np.uint64(8) & np.uint64(63))
        np.bitwise_or.at(self.marks, (row, (h >> np.uint64(14) & np.uint64(3)).astype(np.int64)), bits)


def _run(equal: np.ndarray) -> np.ndarray:
    """How many of each row are true before the first that isn't."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the texts of a block say of its open ends: ``field, id, equal, on, ends``; rows come by block, open ends first.

    Of a text no more words are read than an open end of this length can reach.
    """
    hashes = _Words()
    now, held = None, _Block(hashes)
    schema = pa.schema([("field", pa.string()), ("id", pa.binary()), ("equal", pa.bool_()), ("on", pa.int64()), ("ends", pa.int64())])

    def emit(told: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), schema)] if told else [pa.array([], f.type) for f in schema], schema=schema)

    for batch in batches:
        told: list[tuple] = []
        for field, bucket, block, asks, key, norm, size in zip(*(batch.column(c).to_pylist() for c in ("field", "bucket", "block", "asks", "id", "norm", "size"))):
            if now != (field, bucket, block):
                told += [(now[0], *x) for x in held.told()] if now else []
                now, held = (field, bucket, block), _Block(hashes)
            if asks:
                held.ask(key, norm)
            else:
                held.meet(key, norm, size)
        yield emit(told)
    yield emit([(now[0], *x) for x in held.told()] if now else [])


def _early_ends(ends: DataFrame) -> DataFrame:
    """``field, id`` of open-ended texts that a longer copy continues.

    Where several bands of a text meet the same open ends, only the first of them is kept, and none where a text meets itself only.
    """
    at = ["field", "bucket"]
    asking = ends.select("field", "id", F.lit(None).cast("int").alias("place"), F.explode("looks").alias("bucket"))
    inside = _filtered(ends.select("field", "id", "body"), _placed_of, hash_filter(asking, "bucket"), "field string, id binary, place int, bucket bigint")
    inside = materialise(inside)  # read twice below
    both = inside.unionByName(asking)
    asks = F.col("place").isNull()
    live = both.groupBy(*at).agg(F.count_if(asks).alias("n_open"), F.count_if(~asks).alias("n"), F.max("place").alias("place"), F.bit_xor(F.when(asks, F.xxhash64("id"))).alias("opens"))
    # a block holds one part of the texts against one part of the open ends; nearly all buckets are one block
    parts, open_parts = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "n_open"))
    size = (F.lit(BEGINNING) * F.pow(F.lit(2.0), F.floor(F.col("place") / BANDS))).cast("int")  # the same in all texts of a bucket
    live = live.where((F.col("n_open") > 0) & (F.col("n") > 1)).select(*at, "opens", parts.alias("parts"), open_parts.alias("open_parts"), size.alias("size"))
    once = inside.drop("place").join(live, at).where(F.col("opens") != F.xxhash64("id")).groupBy("field", "id", "size", "opens").agg(F.min(F.struct("bucket", "parts", "open_parts")).alias("b"))
    texts = materialise(once.select("field", "id", F.lit(False).alias("asks"), "size", "b.*"))  # read twice below
    kept = texts.groupBy(*at).agg(*[F.max(c).alias(c) for c in ("size", "parts", "open_parts")])  # the same in all texts of a bucket
    members = texts.unionByName(asking.drop("place").join(kept, at).withColumn("asks", F.lit(True)))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("open_parts")).otherwise(F.col("parts")))
    others = F.sequence(F.lit(0), F.when(F.col("asks"), F.col("parts")).otherwise(F.col("open_parts")) - 1)
    block = F.when(F.col("asks"), F.col("own") * F.col("parts") + F.col("other")).otherwise(F.col("other") * F.col("parts") + F.col("own"))
    blocks = members.withColumn("own", own).withColumn("other", F.explode(others)).select(*at, "size", "id", "asks", block.alias("block"))
    held = blocks.join(ends.select("field", "id", F.lower("body").alias("norm")), ["field", "id"])
    held = held.repartition("field", "bucket", "block").sortWithinPartitions("field", "bucket", "block", F.desc("asks"), "id")
    told = held.mapInArrow(_aligned, "field string, id binary, equal boolean, on bigint, ends bigint")
    summed = told.groupBy("field", "id").agg(F.max("equal").alias("equal"), F.sum("on").alias("on"), F.sum("ends").alias("ends"))
    return summed.where(F.col("equal") | (F.col("on") > 3 * F.col("ends"))).select("field", "id")


@F.pandas_udf(T.BooleanType())
def _decided(verdict: pd.Series, met: pd.Series, fragment: pd.Series, several: pd.Series) -> pd.Series:
    def one(v, found, f, n):
        by_kind = {ASKED[s["rank"]]: (s["mid"], s["mark"], s["bare"]) for s in (() if found is None else found)}
        return decide(v, by_kind, f, n)

    return pd.Series([one(*x) for x in zip(verdict, met, fragment, several)], dtype=bool)


def judged(rows: DataFrame) -> DataFrame:
    """``field, key, is_cut`` of all values (``field, key, value``, each key once)."""
    read = rows.select("field", "key", "value").mapInArrow(_plain_of, _PLAIN).withColumn("id", F.unhex(F.md5(F.lower("body"))))
    read = materialise(read)  # read twice below
    texts = read.where("body is not null").groupBy("field", "id").agg(F.min("body").alias("body"))
    ends = materialise(texts.mapInArrow(_ends_of, _ENDS))  # read seven times below
    asked = ends.where(F.col("verdict").startswith("ask")).select("field", "id", "verdict", "asked", "fragment", "several")
    wanted = asked.select("field", "id", F.posexplode("asked").alias("rank", "h")).where("h is not null")
    stats = _filtered(ends.select("field", "body", "verdict"), _counts_of, hash_filter(wanted, "h"), "h bigint, mid bigint, mark bigint, bare bigint")
    stats = stats.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("mid", "mark", "bare")])
    met = wanted.join(stats, "h").groupBy("field", "id").agg(F.collect_list(F.struct("rank", "mid", "mark", "bare")).alias("met"))  # at most 9 a text
    by_words = asked.join(met, ["field", "id"], "left").select("field", "id", _decided.asNondeterministic()("verdict", "met", "fragment", "several").alias("by_words"))
    sure = ends.where(~F.col("verdict").startswith("ask")).select("field", "id", (F.col("verdict") == "cut").alias("by_words"))
    early = _early_ends(ends).withColumn("by_copy", F.lit(True))
    cut = by_words.unionByName(sure).join(early, ["field", "id"], "left").where(F.col("by_words") | F.col("by_copy")).select("field", "id", F.lit(True).alias("cut"))
    return read.select("field", "key", "id").join(cut, ["field", "id"], "left").select("field", "key", F.coalesce("cut", F.lit(False)).alias("is_cut"))


def values(response: DataFrame, scenario: DataFrame) -> DataFrame:
    """``field, key, value, source`` of the three columns; each key once."""
    answers = once_per_key(response.select("response_id", "received_at", "response", "model_name"), "response_id", "received_at")
    prompts = once_per_key(scenario.select("scenario_id", "received_at", "english", "chinese", "channel"), "scenario_id", "received_at")
    parts = [
        answers.select(F.lit("response.response").alias("field"), F.col("response_id").alias("key"), F.col("response").alias("value"), F.col("model_name").alias("source")),
        prompts.select(F.lit("scenario.english").alias("field"), F.col("scenario_id").alias("key"), F.col("english").alias("value"), F.col("channel").alias("source")),
        prompts.select(F.lit("scenario.chinese").alias("field"), F.col("scenario_id").alias("key"), F.col("chinese").alias("value"), F.col("channel").alias("source")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cut_values(rows: DataFrame) -> DataFrame:
    """``field, row_key`` of the cut values."""
    return judged(rows).where("is_cut").select("field", F.col("key").alias("row_key"))


def rates(rows: DataFrame) -> DataFrame:
    """``field, source, n_values, n_cut, cut_rate``: values that hold a word, and how many of them are cut."""
    sources = rows.where(F.col("value").rlike(r"[\p{L}\p{N}]")).select("field", "key", "source")
    found = judged(rows).join(sources, ["field", "key"]).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("is_cut").alias("n_cut"))
    return found.withColumn("cut_rate", F.col("n_cut") / F.col("n_values"))
