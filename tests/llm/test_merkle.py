"""Problem 1 against a brute-force grouping."""

import json
from datetime import datetime

import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import merkle

FACT = "fact_key long, extracted_at timestamp, text string, category string"
LINE = "fact_key long, extracted_at timestamp, line string"
NUMBER = regex.compile(
    r"(?:(?<![\p{N}\p{M}]|[[\p{L}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]])[+\-−＋－])?"
    r"(?:\p{Nd}++(?:[.．]\p{Nd}++)*+|(?<![\p{L}\p{N}\p{M}.．])[.．]\p{Nd}++)|[\p{L}\p{M}\p{N}]",
    regex.V1,
)


def brute(text):
    if text is None:
        return None
    found = (m[0] for m in NUMBER.finditer(text.lower().replace("ß", "ss").replace("ς", "σ")))
    return "".join(t if len(t) == 1 and not t.isdecimal() else f"|{t}|" for t in found)


def late(n):
    return datetime(2024, 1, n)


FACTS = [
    (1, late(1), "The harbour has 12 berths.", "event"),
    (2, late(1), "the  HARBOUR\nhas 12 berths", "Event "),
    (3, late(1), "The harbour has -12 berths.", "event"),
    (4, late(1), "The harbour has 1.2 berths.", "event"),
    (5, late(1), "The harbour has 1 2 berths.", "event"),
    (6, late(1), "The harbour has 12 berths.", None),
    (7, late(1), "读数为-5度。", "law-policy"),
    (8, late(1), "读数为 -5 度", "Law policy"),
    (9, late(1), "读数为5度", "law-policy"),
    (10, late(1), "", "event"),
    (11, late(1), "...", "event"),
    (12, late(1), None, "event"),
    (13, late(1), None, "EVENT"),
    (14, late(1), "old text", "event"),
    (14, late(2), "The harbour has 12 berths", "event"),
    (15, late(1), "x" * 200_000, "claim"),
    (16, late(1), "X" * 200_000 + "!", "claim"),
    (17, late(1), "39²", "claim"),
    (18, late(1), "392", "claim"),
    (None, late(1), "The harbour has 12 berths.", "event"),
    (1, late(1), "The harbour has 12 berths.", "event"),
]
LINES = [
    (101, late(1), '{"category":"event","text":"The harbour has 12 berths."}'),
    (102, late(1), ' {"id":"fact-1", "content":"the harbour has 12 berths", "category":"event"} '),
    (103, late(1), '{"text":"The harbour has 12 berths.","category":null}'),
    (104, late(1), '{"text":"The harbour has 12 berths.","category":"event"},'),
    (105, late(1), '{"text":"The harbour has 12 ber'),
    (106, late(1), '[{"text":"The harbour has 12 berths.","category":"event"}]'),
    (107, late(1), '{"text":"The harbour has 12 berths.","category":"event"} {"a":1}'),
    (108, late(1), '{"x":1}] junk'),
    (109, late(1), None),
    (110, late(1), ""),
]


def expected():
    rows = {k: (t, c) for k, _, t, c in FACTS if k is not None}
    rows[14] = FACTS[14][2:]
    for key, _, line in LINES:
        try:
            value = json.loads(line)
        except (ValueError, TypeError):
            continue
        if isinstance(value, dict) and (value.get("text") or value.get("content")):
            rows[key] = (value.get("text") or value["content"], value.get("category"))
    groups = {}
    for key, (text, category) in rows.items():
        groups.setdefault((brute(text), brute(category)), []).append(key)
    return {(min(g), k) for g in groups.values() for k in g if k != min(g)}, sorted(len(g) for g in groups.values())


def frames(spark):
    fact = spark.createDataFrame(FACTS, FACT).withColumn("root", F.lit("clash")).withColumn("shape", F.lit("clash"))
    return fact, spark.createDataFrame(LINES, LINE)


def test_copies_equal_brute_force(spark):
    got = merkle.copies(merkle.records(*frames(spark))).collect()
    want, _ = expected()
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want
    assert (7, 8) in want and (7, 9) not in want and (1, 102) in want


def test_collisions_of_digests_join_nothing(spark, monkeypatch):
    monkeypatch.setattr(merkle, "root_digest", lambda *_: F.md5(F.lit("one root for all")))
    got = merkle.copies(merkle.records(*frames(spark))).collect()
    assert {tuple(r) for r in got} == expected()[0] and len(got) == len(expected()[0])


def test_distinct_records_count_all(spark):
    got = merkle.distinct_records(merkle.records(*frames(spark))).collect()
    assert sorted(r.n_records for r in got) == expected()[1]


def test_empty_tables(spark):
    rows = merkle.records(spark.createDataFrame([], FACT), spark.createDataFrame([], LINE))
    assert merkle.copies(rows).count() == 0
    assert merkle.distinct_records(rows).count() == 0


def test_nested_values_ignore_order_where_unordered(spark):
    kind = "struct<a:string,m:map<string,string>,l:array<string>>"
    rows = spark.createDataFrame([(1, ("X!", {"p": "1", "q": "2"}, ["a", "b"])), (2, ("x", {"q": "2.", "p": "1"}, ["A", "b."])), (3, ("x", {"q": "2", "p": "1"}, ["b", "a"]))], f"i int, v {kind}")
    dtype = rows.schema["v"].dataType
    assert isinstance(dtype, T.StructType)

    def roots(ordered):
        value = merkle.normalised(F.col("v"), dtype)
        return [r.d for r in rows.orderBy("i").select(merkle.root_digest(value, dtype, ordered).alias("d")).collect()]

    one, two, three = roots(True)
    assert one == two != three
    assert len(set(roots(False))) == 1
