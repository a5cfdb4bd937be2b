"""Problem 1: records that differ only in white space, letter case, punctuation or field order.

Method: Merkle-style hashing from the leaves up. A leaf string is normalised (``normal_text``); the digest of a node is
the digest of its children's digests, sorted where the node is unordered (fields of a record, entries of a map, arrays
that are declared unordered). Records are grouped by their root digest, and the grouping also compares the whole
canonical structure (``shape``), so a collision of digests can never join two records.

All expressions are built-in functions, so the work stays inside generated code. The smallest key and the number of
records of a group are partial aggregates; a group that holds a third of all rows is thus reduced before the shuffle.
Its members are joined to that one row by a sort-merge join, whose skewed partitions adaptive execution splits; no list
of members is ever built.

Defined cases: a null leaf equals only another null leaf; an empty text and a text of mere punctuation are equal (both
have no letter and no number) but differ from null; records without a key are no records; a key that is delivered
several times counts once, by its latest row. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import once_per_key

# Letters of scripts that are written without spaces: a sign may follow them directly.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_NO_WORD_BEFORE = rf"(?<![\p{{N}}\p{{M}}]|[\p{{L}}&&[^{_UNSPACED}]])"
#: A number: an optional sign that doesn't follow a word, digits with decimal points, or a point and digits.
NUMBER = (
    r"(?=[+\-−＋－.．\p{Nd}])"  # fails fast at most characters
    rf"(?:{_NO_WORD_BEFORE}[+\-−＋－])?"
    rf"(?:\p{{Nd}}++(?:[.．]\p{{Nd}}++)*+|(?<![\p{{L}}\p{{N}}\p{{M}}.．])[.．]\p{{Nd}}++)"
)
_MARK = "\u0001"


def normal_text(text: Column) -> Column:
    """The letters (lower case) and numbers of a text in their order; each number is set off by a control character.

    Characters count as they are stored: no Unicode normalisation is applied, and combining marks belong to letters.
    """
    plain = F.translate(F.lower(F.translate(text, _MARK, " ")), "ς", "σ")
    plain = F.replace(plain, F.lit("ß"), F.lit("ss"))
    marked = F.regexp_replace(plain, NUMBER, f"{_MARK}$0{_MARK}")
    return F.regexp_replace(marked, rf"({_MARK}[^{_MARK}]*+{_MARK})|[^{_MARK}\p{{L}}\p{{M}}\p{{N}}]++", "$1")


def _joined(parts: Column) -> Column:
    """The parts as one string from which they can be told apart again."""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), "")


def _node(kind: str, parts: Column, ordered: bool, digest: bool) -> Column:
    joined = F.concat(F.lit(kind), _joined(parts if ordered else F.sort_array(parts)))
    return F.md5(joined) if digest else joined


def _build(value: Column, dtype: T.DataType, ordered_arrays: bool, digest: bool) -> Column:
    def below(x: Column, kind: T.DataType) -> Column:
        return _build(x, kind, ordered_arrays, digest)

    none = F.md5(F.lit("0")) if digest else F.lit("0")
    if isinstance(dtype, T.StructType):
        parts = F.array(*[F.concat(F.lit(f.name + "="), below(value.getField(f.name), f.dataType)) for f in dtype.fields])
        return F.when(value.isNull(), none).otherwise(_node("{", parts, False, digest))
    if isinstance(dtype, T.ArrayType):
        parts = F.transform(value, lambda x: below(x, dtype.elementType))
        return F.when(value.isNull(), none).otherwise(_node("[", parts, ordered_arrays, digest))
    if isinstance(dtype, T.MapType):
        parts = F.transform(F.map_entries(value), lambda e: F.concat(below(e.getField("key"), dtype.keyType), F.lit("="), below(e.getField("value"), dtype.valueType)))
        return F.when(value.isNull(), none).otherwise(_node("(", parts, False, digest))
    leaf = F.concat(F.lit("1"), value.cast("string"))
    return F.coalesce(F.md5(leaf) if digest else leaf, none)


def normalised(value: Column, dtype: T.DataType) -> Column:
    """The same nested value with all its strings (not the keys of maps) normalised."""
    if isinstance(dtype, T.StringType):
        return normal_text(value)
    if isinstance(dtype, T.StructType):
        fields = [normalised(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: normalised(x, dtype.valueType))
    return value


def root_digest(value: Column, dtype: T.DataType, ordered_arrays: bool = True) -> Column:
    """The Merkle root (32 hexadecimal digits) of a normalised nested value."""
    return _build(value, dtype, ordered_arrays, True)


def shape(value: Column, dtype: T.DataType, ordered_arrays: bool = True) -> Column:
    """The whole canonical structure of a normalised value: equal exactly for values that count as copies."""
    return _build(value, dtype, ordered_arrays, False)


def parse_line(line: Column) -> Column:
    """The variant of a line that is one whole JSON object, else null.

    ``try_parse_json`` ignores what follows a value. The line is therefore parsed as the first element of an array whose
    second element is a hash of the line; only if nothing but one value stood in the line, that hash comes second.
    """
    guard = F.concat(F.lit("x"), F.hex(F.xxhash64(line)))
    pair = F.try_parse_json(F.concat(F.lit("["), line, F.lit(',"'), guard, F.lit('"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == guard
    return F.when(whole & line.rlike(r"^\s*\{"), pair)


def records(fact: DataFrame, fact_line: DataFrame) -> DataFrame:
    """``key, late, is_record, record struct<text,category>``: the rows of fact, and the lines; a line is a record if it
    is an object with a text."""
    stored = fact.select(F.col("fact_key").alias("key"), F.col("extracted_at").alias("late"), F.lit(True).alias("is_record"), "text", "category")
    parsed = fact_line.select("fact_key", "extracted_at", parse_line(F.col("line")).alias("v"))

    def field(name: str) -> Column:
        return F.try_variant_get("v", f"$[0].{name}", "string").alias(name)

    read = parsed.select("fact_key", "extracted_at", field("text"), field("content"), field("category"))
    text = F.when(F.col("text") != "", F.col("text")).otherwise(F.when(F.col("content") != "", F.col("content")))
    raw = read.select(F.col("fact_key").alias("key"), F.col("extracted_at").alias("late"), text.isNotNull().alias("is_record"), text.alias("text"), "category")
    return stored.unionByName(raw).select("key", "late", "is_record", F.struct("text", "category").alias("record"))


def hashed(rows: DataFrame, ordered_arrays: bool = True, keep_record: bool = False) -> DataFrame:
    """``key, root, shape`` (and ``record``) of the latest row of each key.

    Hashing comes before the pick of the latest row: the result of that shuffle serves all branches of a plan, so each
    row is hashed once.
    """
    dtype = rows.schema["record"].dataType
    rest = ["record"] if keep_record else []
    plain = rows.select("key", "late", "is_record", *rest, normalised(F.col("record"), dtype).alias("plain"))
    value = F.col("plain")
    whole = plain.select("key", "late", "is_record", F.unhex(root_digest(value, dtype, ordered_arrays)).alias("root"), shape(value, dtype, ordered_arrays).alias("shape"), *rest)
    return once_per_key(whole, "key", "late").where("is_record").select("key", "root", "shape", *rest)


def copies(rows: DataFrame) -> DataFrame:
    """``first_key, copy_key``: one row for each record of a group besides the one with the smallest key.

    The groups compare the whole structure of their records (smallest and largest shape). Where the shapes of a root differ,
    a collision of 128-bit digests, its records are looked up again by their keys (the rows still lie by key) and grouped
    by their shapes.
    """
    rows = hashed(rows)
    groups = rows.groupBy("root").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("shape").alias("low"), F.max("shape").alias("high"))
    several = groups.where(F.col("first_key") < F.col("last_key")).select("root", "first_key", (F.col("low") == F.col("high")).alias("alike"))
    grouped = rows.select("root", "key").join(several, "root")
    usual = grouped.where(F.col("alike") & (F.col("key") > F.col("first_key")))
    apart = rows.join(grouped.where(~F.col("alike")).select("key"), "key")
    firsts = apart.groupBy("root", "shape").agg(F.min("key").alias("first_key"))
    unusual = apart.join(firsts, ["root", "shape"]).where(F.col("key") > F.col("first_key"))
    columns = ["first_key", F.col("key").alias("copy_key")]
    return usual.select(*columns).unionByName(unusual.select(*columns))


def distinct_records(rows: DataFrame) -> DataFrame:
    """``first_key, record, n_records``: each distinct record once, as its smallest key has it, with its number of copies."""
    kept = F.min(F.struct("key", "record")).alias("kept")
    groups = hashed(rows, keep_record=True).groupBy("root", "shape").agg(kept, F.count(F.lit(1)).alias("n_records"))
    return groups.select(F.col("kept.key").alias("first_key"), F.col("kept.record").alias("record"), "n_records")
