"""Problem 4: text that looks the same but is stored with different characters.

Method: the script sets of the characters of a token are intersected. A token whose intersection is empty mixes
scripts; a token whose letters all have a look-alike in another script is a whole-script confusable. For both, the
consistent spelling is chosen: the script that the token's unmistakable letters fix, else the script of the text's
unmistakable letters (Latin where there are none). Remaining forms are normalised: invisible characters go, spaces
become the ordinary space, full- and half-width letters and digits, ligatures, radicals and compatibility ideographs
become the usual character, and accents are composed.

``skeleton`` writes every look-alike letter in one prototype. The letters are those of the public table of Unicode Technical
Standard 39, read from the Unicode library that every Spark installation holds, as far as both have the same case; two values look the
same exactly if their skeletons are equal. ``consistent`` respells the skeleton by script, so it is a function of the
skeleton: values that look the same get the same consistent form, and it is readable text of the right script.

White space of ASCII, letter case, punctuation, accents and raised digits stay visible. Full-width punctuation stays
different from ASCII punctuation.

Both are Python functions that run over Arrow batches (Spark has no Unicode normalisation); values in pure ASCII return
at once. Pairs are found from digests of the consistent form and the skeleton: groups with one form only are dropped after a partial aggregate, so a
group that holds a third of all rows is never gathered; the forms of a group are paired first and joined to their keys
afterwards, so nothing but result rows is built.

Defined cases: null values, and values without any letter or digit, are no cases; a key that is delivered again counts
once, by its latest row; several keys with one identical string give no pair among themselves.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import struct
import sys
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise
from .common import once_per_key

# Letters that look like a letter of the Latin alphabet, by script, in pairs of look-alike and prototype. They
# go before the public table and say which letter of a script is written for a prototype.
CYRILLIC = (
    "аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ѵv ԝw хx уy ɡg "
    "АA ВB СC ЕE ԌG НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT ѴV ԜW ХX УY ҮY ӀI ЗƷ"
)
GREEK = "αa γy ιı νv οo ρp υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo ոn սu հh ցg զq ԱU ՏS ՕO ԼL"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ"

_LISTED = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE}

# Characters without any ink besides those of category Cf.
_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

_BLOCKS = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0xFF01, 0xFFEF), (0x3131, 0x318E))
_DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def _pairs(listing: str) -> dict[str, str]:
    return {p[0]: p[1] for p in listing.split()}


def _library() -> Path:
    """The archive of the public Unicode library that every Spark installation holds."""
    import pyspark

    here = Path(pyspark.__file__).resolve()
    homes = [Path(x) for x in (os.environ.get("SPARK_HOME"), *sys.path) if x] + list(here.parents)
    for home in homes:
        for folder in (home / "jars", home / "pyspark" / "jars"):
            for jar in sorted(folder.glob("icu4j-*.jar")) if folder.is_dir() else ():
                return jar
    raise FileNotFoundError("icu4j-*.jar: Spark's folder of archives holds the Unicode table of look-alikes; set SPARK_HOME")


def public_table() -> dict[str, str]:
    """The look-alikes of Unicode Technical Standard 39 (``confusables.txt``) as each Spark installation holds them in its
    Unicode library: character and prototype. The file is a header, keys (code point and length), values and strings."""
    with zipfile.ZipFile(_library()) as jar:
        data = jar.read(_DATA)
    data = data[int.from_bytes(data[:2], "big") :]
    _, _, _, keys_at, n, values_at, _, strings_at, _ = struct.unpack(">9i", data[:36])
    keys = struct.unpack(f">{n}I", data[keys_at : keys_at + 4 * n])
    values = struct.unpack(f">{n}H", data[values_at : values_at + 2 * n])
    out = {}
    for key, value in zip(keys, values):
        size = (key >> 24) + 1
        at = strings_at + 2 * value
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else data[at : at + 2 * size].decode("utf-16-be")
    return out


def _cased_lookalikes() -> dict[str, str]:
    """Letters with case outside ASCII, and letters and digits that are mere fonts of ASCII ones, with their prototype.

    Upper case stays upper and lower case lower, since letter case is visible; accents and raised letters are visible
    too, so compatibility letters that stand higher or lower are left alone. Of the letters that are Latin themselves
    only small capitals and the script forms a and g are taken.
    """
    table = public_table()
    ascii_of: dict[str, list[str]] = {}
    for letter in string.ascii_letters:
        ascii_of.setdefault(table.get(letter, letter), []).append(letter)
    out = {}
    for char, prototype in table.items():
        kind, name = unicodedata.category(char), unicodedata.name(char, "")
        if char.isascii() or kind not in ("Lu", "Ll", "Nl", "Nd") and not name.startswith("LISU"):
            continue
        plain = unicodedata.normalize("NFKC", char)
        if plain.isascii() and len(plain) == 1 and (kind == "Nl" or unicodedata.decomposition(char).startswith(("<font>", "<wide>"))):
            out[char] = plain
            continue
        if kind == "Nd" or name.startswith("LATIN") and not re.search("SMALL CAPITAL|LETTER ALPHA$|LETTER SCRIPT G$", name):
            continue
        same_case = [c for c in ascii_of.get(prototype, ()) if c.isupper() == (char.isupper() or kind == "Lo")]
        if same_case:
            out[char] = same_case[0]
    return out


def _script_by_name(char: str) -> str:
    return unicodedata.name(char, "LATIN").split(" ")[0].capitalize()


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str | None], dict[str, dict[str, str]]]:
    """The table for ``str.translate`` and, by script, the look-alike of each prototype. Built from rules."""
    one: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            one[code] = None
        elif kind == "Zs":
            one[code] = " "
        elif any(a <= code <= b for a, b in _BLOCKS):
            plain = unicodedata.normalize("NFKC", char) if not 0xFF9E <= code <= 0xFF9F else {0xFF9E: "゙", 0xFF9F: "゚"}[code]
            if plain != char and all(unicodedata.category(c)[0] in "LNM" for c in plain):
                one[code] = plain
    one |= {ord(c): None for c in _INVISIBLE}
    back: dict[str, dict[str, str]] = {}
    for script, listing in _LISTED.items():
        pairs = _pairs(listing)
        one |= {ord(a): b for a, b in pairs.items()}
        back[script] = {b: a for a, b in reversed(pairs.items()) if script.upper() in unicodedata.name(a)}
    for char, prototype in sorted(_cased_lookalikes().items()):
        one.setdefault(ord(char), prototype)
        script = _script_by_name(char)
        if script != "Latin" and not unicodedata.decomposition(char):
            back.setdefault(script, {}).setdefault(prototype, char)
    return one, back


def skeleton(text: str | None) -> str | None:
    """The text with every look-alike in its prototype. Null for null."""
    if text is None or text.isascii():
        return text
    apart, table = unicodedata.normalize("NFD", text), tables()[0]
    if _changed().search(apart):
        apart = apart.translate(table)
    return unicodedata.normalize("NFC", apart)


@lru_cache(maxsize=1)
def _changed() -> re.Pattern:
    """The characters that ``skeleton`` may change (all beyond the basic plane, so that the class is a bitmap): many texts hold
    none of them, and a search is quicker than ``str.translate``."""
    codes = (code for code, to in tables()[0].items() if to != chr(code) and code < 0x10000)
    return re.compile("[" + "".join(f"\\u{code:04x}" for code in codes) + "\\U00010000-\\U0010ffff]")


_TOKEN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=65536)
def script_of(char: str) -> str:
    """The script of a letter by its Unicode name; Latin for letters without one."""
    script = _script_by_name(char)
    return script if script == "Latin" or script in tables()[1] else "Other"


def _fixed(token: str, prototypes: set[str]) -> set[str]:
    """The scripts of the letters that no other script can write."""
    out = set()
    for char in unicodedata.normalize("NFD", token):
        if unicodedata.category(char)[0] == "L" and char not in prototypes:
            out.add(script_of(char))
    return out


def script_sets(token: str) -> set[str]:
    """The scripts that could have written the whole skeleton token: the intersection of its letters' script sets."""
    back = tables()[1]
    possible = {"Latin", *back}
    for char in unicodedata.normalize("NFD", token):
        if unicodedata.category(char)[0] != "L":
            continue
        own = {script_of(char)} | {s for s, m in back.items() if char in m}
        possible &= own
    return possible


@lru_cache(maxsize=1)
def _prototypes() -> frozenset[str]:
    return frozenset(p for m in tables()[1].values() for p in m)


@lru_cache(maxsize=1)
def _written_back() -> re.Pattern:
    return re.compile("[" + re.escape("".join(sorted(_prototypes()))) + "]")


@lru_cache(maxsize=100_000)
def _scripts(token: str) -> tuple[set[str], set[str]]:
    """The script set of a token, and the scripts of its letters that no other script can write."""
    return script_sets(token), _fixed(token, _prototypes())


def consistent(text: str | None, bare: str | None = None) -> str | None:
    """The one consistent form of all texts that look like ``text`` (``bare``: its skeleton if known). Null for null."""
    bare = skeleton(text) if bare is None else bare
    if bare is None or bare.isascii() and text.isascii():
        return bare
    if not _written_back().search(unicodedata.normalize("NFD", bare)):
        return bare  # no letter of it has another spelling
    back = tables()[1]
    tokens = _TOKEN.findall(bare)
    votes: dict[str, int] = {}
    for t in tokens:
        for s in _scripts(t)[1] - {"Other"}:
            votes[s] = votes.get(s, 0) + 1
    usual = max(sorted(votes), key=votes.get) if votes else "Latin"

    def respell(match: re.Match) -> str:
        token = match[0]
        possible, fixed = _scripts(token)[0], _scripts(token)[1] & {"Latin", *back}
        script = usual if usual in possible else "Latin"
        if len(fixed) == 1:
            script = next(iter(fixed))
        if script == "Latin" or script not in possible:
            return token
        return unicodedata.normalize("NFC", "".join(back[script].get(c, c) for c in unicodedata.normalize("NFD", token)))

    return _TOKEN.sub(respell, bare)


@F.pandas_udf(T.StringType())
def consistent_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(consistent, na_action="ignore")


def look(text: str) -> bytes:
    """What a text looks like, in 32 bytes: a digest of its consistent form, confirmed by one of its skeleton."""
    bare = skeleton(text)
    return b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in (consistent(text, bare), bare))


@F.pandas_udf(T.BinaryType())
def look_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(look, na_action="ignore")


#: Column expressions.
HAS_WORD = r"[\p{L}\p{N}]"


def values(tables_: list[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """``field, key, value`` of several columns, each given as (field, table, key column, value column, late column)."""
    parts = []
    for field, df, key, value, late in tables_:
        own = df.select(F.col(key).cast("bigint").alias("key"), F.col(value).alias("value"), *([F.col(late).alias("late")] if late else []))
        parts.append(once_per_key(own, "key", "late" if late else None).select(F.lit(field).alias("field"), "key", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normal_forms(rows: DataFrame) -> DataFrame:
    """``field, key, form``: every value in its one consistent form (null for null)."""
    return rows.select("field", "key", consistent_udf("value").alias("form"))


def classes(rows: DataFrame) -> DataFrame:
    """``field, key, class_key, n_forms, n_values`` of every value whose look is stored in several forms.

    The form to use beyond small groups: a class of n rows gives n rows, each with the smallest key of the class, while
    ``same_looking`` gives each pair of them.
    """
    drawn = materialise(_drawn(rows))  # read twice below
    looks = drawn.groupBy("field", "look").agg(F.min("form").alias("least"), F.max("form").alias("most"), F.min("key").alias("class_key"), F.count(F.lit(1)).alias("n_values"))
    several = looks.where(F.col("least") != F.col("most")).select("field", "look", "class_key", "n_values")
    held = drawn.join(several, ["field", "look"])
    forms = held.select("field", "look", "form").distinct().groupBy("field", "look").agg(F.count(F.lit(1)).alias("n_forms"))
    return held.join(forms, ["field", "look"]).select("field", "key", "class_key", "n_forms", "n_values")


def _drawn(rows: DataFrame) -> DataFrame:
    """``field, key, look, form`` of the values that hold a word or number: digests of what they look like and are."""
    wordy = rows.where(F.col("value").rlike(HAS_WORD))
    return wordy.select("field", "key", look_udf("value").alias("look"), F.unhex(F.md5("value")).alias("form"))


def same_looking(rows: DataFrame) -> DataFrame:
    """``field, key_a, key_b`` of every two rows of a field whose values look the same but are not the same string."""
    drawn = materialise(_drawn(rows))  # 66 bytes a row; read twice below
    looks = drawn.groupBy("field", "look").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    several = looks.where(F.col("least") != F.col("most")).select("field", "look")
    held = materialise(drawn.join(several, ["field", "look"], "left_semi"))  # rows of groups with several forms only
    forms = held.select("field", "look", "form").distinct()
    pairs = forms.alias("a").join(forms.alias("b"), ["field", "look"]).where(F.col("a.form") < F.col("b.form"))
    pairs = pairs.select("field", "look", F.col("a.form").alias("form_a"), F.col("b.form").alias("form_b"))
    left = held.select("field", "look", F.col("form").alias("form_a"), F.col("key").alias("x"))
    right = held.select("field", "look", F.col("form").alias("form_b"), F.col("key").alias("y"))
    both = pairs.join(left, ["field", "look", "form_a"]).join(right, ["field", "look", "form_b"])
    return both.select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
