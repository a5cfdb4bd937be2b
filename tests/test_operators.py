"""Goldens of the scalar operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.rank import latest, numbered
from plumbline.operators import evidence, facts, jobs, planning, refusal, scoring, verify
from plumbline.sources import models


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def plan_of(spark, answer, text):
    rows = spark.createDataFrame([(answer, "fact-1", text)], "answer string, id string, text string")
    row = planning.with_plan(rows, "answer", "id", "text").first()
    return row.query, row.entities


@pytest.mark.parametrize(
    ("lang", "text", "expected"),
    [
        ("en", "No.", (True, 0.9, "response too short or empty")),
        ("en", None, (True, 0.9, "response too short or empty")),
        ("en", "a" * 19, (True, 0.9, "response too short or empty")),
        ("en", "a" * 20, (False, 0.9, None)),
        ("en", "I cannot answer that question today.", (True, 0.85, 'matched pattern: "I cannot answer"')),
        ("en", "i'm sorry, but this is out of scope", (True, 0.85, 'matched pattern: "i\'m sorry"')),
        ("en", "He was an airline pilot for years.", (True, 0.85, 'matched pattern: "as an ai"')),
        ("en", "Fiji must decline the offer today.", (True, 0.85, 'matched pattern: "i must decline"')),
        ("en", "I understand the concern; however it is open.", (True, 0.5, "hedged or qualified response")),
        ("en", "I understand the concern;\nhowever it is open.", (False, 0.9, None)),
        ("zh", "我无法回答这个问题，请您查阅其他的公开资料来源。", (True, 0.85, 'matched pattern: "我无法"')),
        ("zh", "关于这个话题，各方存在不同的观点和解释，值得关注。", (True, 0.85, 'matched pattern: "这个话题"')),
        ("zh", "我理解您的关切与期待，但是这里存在多种看法与观点。", (True, 0.5, "hedged or qualified response")),
    ],
)
def test_refusal(spark, lang, text, expected):
    row = spark.createDataFrame([(lang, text)], "lang string, text string").select(refusal.detect(F.col("text"), F.col("lang")).alias("r")).first()["r"]
    assert tuple(row) == expected


def test_mock_answers_are_no_refusals(spark):
    rows = spark.createDataFrame([(t, g) for (_, g), t in models.MOCK.items()], "t string, g string")
    assert not any(r.r.is_refusal for r in rows.select(refusal.detect(F.col("t"), F.col("g")).alias("r")).collect())


@pytest.mark.parametrize(
    ("output", "expected"),
    [
        ('{"text":"A","category":"date"}\n{"content":"B"}', [("fact-0", "A", "date"), ("fact-1", "B", "claim")]),
        ('intro\n{"text":"A"}\n{"text":"B', [("fact-0", "A", "claim")]),
        ('[{"text":"A"},{"x":1},{"content":"B"}]', [("fact-0", "A", "claim"), ("fact-1", "B", "claim")]),
        ('[\n{\n"text":"A"\n},\n{\n"content":"B"\n}\n]', [("fact-0", "A", "claim"), ("fact-1", "B", "claim")]),
        ('[\n{"text":"A"},\n{"text":"B"}\n]', [("fact-0", "B", "claim")]),
        ('{\n"text":"only"\n}', [("fact-0", "only", "claim")]),
        ('{"text":"A long one"},\n{"text":"B long one"},', [("fact-0", '{"text":"A long one"},', "claim"), ("fact-1", '{"text":"B long one"},', "claim")]),
        ('{"facts":[{"text":"A"}]}', [("fact-0", '{"facts":[{"text":"A"}]}', "claim")]),
        ("short\n[\n]\nThis is long enough", [("fact-0", "This is long enough", "claim")]),
        ('```json\n{"text":"A","category":"date"}\n{"content":"B"}\n```', [("fact-0", "A", "date"), ("fact-1", "B", "claim")]),
        ("", []),
    ],
)
def test_fact_tiers(spark, output, expected):
    assert [tuple(f) for f in one(spark, output, facts.parse(F.col("x")))] == expected


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('{"accurate": true, "confidence": 0.95, "explanation": "e"}', (True, 0.95, "e")),
        ('{"accurate": "false", "confidence": 0.4}', (True, 0.4, "")),
        ('{"accurate": false, "confidence": 0}', (False, 0.5, "")),
        ('{"accurate": 1, "confidence": 7}', (True, 1.0, "")),
        ('{"accurate": null, "confidence": -3}', (False, 0.0, "")),
        ('{"accurate": [], "confidence": "0.9abc"}', (True, 0.9, "")),
        ('{"accurate": "", "confidence": "abc"}', (False, 0.5, "")),
        ('text {"accurate": true} more', (True, 0.5, "")),
        ("not json", (False, 0.3, "could not parse verification result")),
        ("{bad}", (False, 0.3, "could not parse verification result")),
    ],
)
def test_judge_answers(spark, answer, expected):
    assert tuple(one(spark, answer, verify.parse_answer(F.col("x")))) == expected


@pytest.mark.parametrize(
    ("fact", "paragraph", "expected"),
    [
        ("TSMC builds chips", "TSMC and TSMC again run fabs in Taiwan", 2 / 3),
        ("chips", "chips chips chips everywhere", 3.0),
        ("TSMC builds chips", "TSMC chips", 0.0),
        ("the of in", "any long paragraph text", 0.0),
        ("台湾人口", "台湾是一个岛", 1 / 3),
        ("台湾人口", "台", 0.0),
        ("台湾人口", "Taiwan has many people here", 0.0),
    ],
)
def test_relevance(spark, fact, paragraph, expected):
    facts = spark.createDataFrame([(1, 7, -1, "en", fact)], "fact_key long, article_id long, other_id long, lang string, text string")
    article = spark.createDataFrame([(7, "en", "T", paragraph + "." * 40)], "article_id long, lang string, title string, text string")
    found = spark.createDataFrame([(7, -1, "en", 7, "T", 1, False, False)], "article_id long, other_id long, lang string, cand_id long, title string, cand_rank int, is_constrained boolean, is_entity boolean")
    rows = evidence.scored(facts, article, found).collect()
    assert sum(r.score for r in rows) == pytest.approx(expected)


def test_best_keeps_two_of_an_article(spark):
    rows = [(1, 1, i, s) for i, s in enumerate((5.0, 4.0, 3.0))] + [(1, 2, 0, 2.0), (1, 3, 0, 1.0)]
    best = evidence.best(spark.createDataFrame(rows, "fact_key int, cand_rank int, pos int, score double")).orderBy("evidence_no").collect()
    assert [(r.cand_rank, r.score) for r in best] == [(1, 5.0), (1, 4.0), (2, 2.0)]


@pytest.mark.parametrize(
    ("refused", "confidence", "n", "right", "expected"),
    [
        (True, 0.9, None, None, 0.8),
        (True, 0.5, None, None, 0.4),
        (False, 0.9, 10, 8, 0.1),
        (False, 0.9, 10, 5, 0.25),
        (False, 0.9, 10, 4, 0.45),
        (False, 0.9, 0, 0, (0.1 + 0.8 + 0.8) / 3),
    ],
)
def test_scores(spark, refused, confidence, n, right, expected):
    rows = spark.createDataFrame([(refused, confidence, n, right)], "r boolean, c double, n long, a long")
    found = scoring.indicators(F.col("r"), F.col("c"), F.lit(None).cast("string"), F.col("n"), F.col("a"))
    assert rows.select(scoring.score(found).alias("s")).first()["s"] == pytest.approx(expected)


def test_text_functions(spark):
    assert one(spark, "<b>a</b> &amp;lt; &lt;i&gt;", X.strip_html(F.col("x"))) == "a &lt; <i>"
    assert one(spark, "﻿  a　\n", X.trim_white(F.col("x"))) == "a"
    assert one(spark, "a b_é(x)!*~'", X.article_url(F.col("x"), F.lit("en"))) == "https://en.wikipedia.org/wiki/a_b_%C3%A9(x)!*~'"
    assert one(spark, "gemma-4-31B-it-oQ4e", X.model_label(F.col("x"))) == "gemma-4-31B-it"
    assert one(spark, "x" * 81, X.shortened(F.col("x"))) == "x" * 80 + "..."
    assert one(spark, 0.125, X.percent(F.col("x")), "double") == 13
    assert one(spark, "台a湾岛", X.cjk_bigrams(F.col("x"))) == ["台湾", "湾岛"]
    assert one(spark, "台", X.cjk_bigrams(F.col("x"))) == []
    assert [one(spark, s, X.time_ago(F.col("x")), "double") for s in (4.0, 59.0, 61.0, 7300.0)] == ["just now", "59s ago", "1m ago", "2h ago"]


def test_planning(spark):
    assert tuple(one(spark, "intitle:a|b foo", planning.split_constraint(F.col("x")))) == (["a", "b"], "foo")
    assert tuple(one(spark, "intitle:a", planning.split_constraint(F.col("x")))) == (["a"], "intitle:a")
    assert one(spark, "Lai Ching-te maintains", planning.constraint(planning.constraint_words(F.lit("q"), F.col("x"), F.lit("en")))) == "intitle:lai|ching"
    broken = '```json\n{"fact-1": {query: "q", "entities": ["A", "B", "C"],}}```'
    assert plan_of(spark, broken, "t") == ("q", ["A", "B"])
    assert plan_of(spark, "nothing", "t" * 99) == ("t" * 80, [])


def test_ranks(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "id int, v int")
    got = numbered(rows, [F.col("v"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 101))
    assert [(r.v, r.id) for r in got] == sorted((i % 7, i) for i in range(100))
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, late int, v string")
    assert sorted(tuple(r) for r in latest(twice, "k", "late").collect()) == [(1, 2, "b"), (2, 1, None)]


def test_jobs(spark):
    assert spark.createDataFrame([("j2",), ("j10",), ("x",), (None,)], "i string").agg(jobs.next_id(F.col("i")).alias("n")).first()["n"] == "j11"
    assert spark.createDataFrame([], "i string").agg(jobs.next_id(F.col("i")).alias("n")).first()["n"] == "j1"
    rows = spark.createDataFrame([(f"j{i}", "completed", i) for i in range(30)] + [("j99", "running", None)], "job_id string, status string, completed_at long")
    assert {r.job_id for r in jobs.retained(rows, 20).collect()} == {f"j{i}" for i in range(10, 30)} | {"j99"}


def test_remote_model_reports_failures(spark):
    def connect():
        def ask(prompt, max_tokens):
            assert max_tokens == 9
            if prompt == "bad":
                raise ValueError("502")
            return prompt.upper()

        return ask

    rows = models.remote(spark.createDataFrame([(1, "a"), (2, "bad")], "i int, p string"), "p", connect, max_tokens=9).collect()
    assert sorted((r.i, r.answer, r.error) for r in rows) == [(1, "A", None), (2, None, "502")]


def test_numbered_keeps_every_row(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        rows = spark.range(2_000_000).select(F.xxhash64("id").alias("v"), F.md5(F.col("id").cast("string")).alias("other"), "id")
        got = numbered(rows.repartition(20), [F.col("v"), F.col("id")])
        n, least, most, distinct = got.agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.countDistinct("position")).first()
        assert (n, least, most, distinct) == (2_000_000, 1, 2_000_000, 2_000_000)
        ends = [r.v for r in got.where("position IN (1, 1000000, 2000000)").orderBy("position").collect()]
        assert ends == sorted(ends)
        assert numbered(rows.limit(0), [F.col("v")]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_index_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(evidence, "LIST_ROWS", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    points = np.concatenate([c + 0.4 * rng.normal(size=(50, 8)) for c in centres])
    points = np.concatenate([points, points[:3], np.zeros((1, 8))])  # ties, and a vector without length
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>")
    unit = points.astype(np.float32).astype(float) / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    want = {}
    for q in range(0, len(points) - 1, 20):
        cosine = np.round(unit @ unit[q], 6)
        order = [i for i in sorted(range(len(points) - 1), key=lambda i: (-cosine[i], i)) if i != q]
        want[q] = order[:8]
    asked = rows.where("id % 20 = 0")
    got, near = {}, {}
    for r in evidence.neighbours(rows, asked, "id", []).orderBy("query_key", "rank").collect():
        got.setdefault(r.query_key, []).append(r.id)
    assert got == want
    for r in evidence.neighbours(rows, asked, "id", [], exact=False).collect():
        near.setdefault(r.query_key, set()).add(r.id)
    recall = sum(len(near.get(q, set()) & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert evidence.neighbours(rows.limit(0), asked.limit(0), "id", []).count() == 0


def test_plans_drop_what_is_no_text(spark):
    def plan(answer):
        return plan_of(spark, answer, "t")

    assert plan('{"fact-1": {"query": 7, "entities": ["A"]}}') == ("t", [])
    assert plan('{"fact-1": {"query": "q", "entities": [1, "A", null, {"b": 2}, "B", "C"]}}') == ("q", ["A", "B"])
    assert plan('{"fact-1": {"query": "q", "entities": "A"}}') == ("q", [])
    assert plan('use {this}: {"fact-1": {"query": "q"}} end') == ("q", [])
    assert plan('{"fact-1": {"query": "q"}} and {x}') == ("q", [])
    assert plan('{"fact-1": {"query": "q"}, x} and more') == ("t", [])


def test_first_hits_stand_in_for_paragraphs(spark):
    facts = spark.createDataFrame([(1, 7, -1, "en"), (2, 7, -1, "en"), (3, None, -1, "en")], "fact_key long, article_id long, other_id long, lang string")
    best = spark.createDataFrame([(2,)], "fact_key long")
    found = spark.createDataFrame([(7, -1, "en", i, f"T{i}", "s", i) for i in range(1, 6)], "article_id long, other_id long, lang string, cand_id long, title string, snippet string, cand_rank int")
    assert sorted((r.fact_key, r.evidence_no, r.title, r.text, r.score) for r in evidence.first_hits(facts, best, found).collect()) == [(1, i, f"T{i}", "s", None) for i in (1, 2, 3)]


def test_second_entity_and_gate(spark):
    names = ["Bay of Ruvo", "Ruvo Port", "Salt", "Coal", "Iron", "Ruvo Hill", "Tin"]
    rows = [(i, "en", n, "About Ruvo." if n == "Tin" else None, [1.0, i / 10]) for i, n in enumerate(names)]
    article = spark.createDataFrame(rows, "article_id long, lang string, title string, text string, embedding array<float>")
    keys = spark.createDataFrame([(0, 2, "en")], "article_id long, other_id long, lang string")
    found = evidence.candidates(article, keys).orderBy("cand_rank").collect()
    assert [r.title for r in found] == ["Ruvo Port", "Ruvo Hill", "Bay of Ruvo", "Salt"]  # the supplement needs the title
    assert [r.is_entity for r in found] == [False, False, True, True]


def test_throttle_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    ask = models.throttled(lambda p: p, gap=1.0, jitter=0.0, clock=lambda: now[0], sleep=sleep)
    assert [ask("a"), ask("b")] == ["a", "b"] and slept == [1.0]
    answers = [models.TooMany(), TimeoutError(), "ok"]

    def flaky(p):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    slept.clear()
    assert models.retried(flaky, sleep=slept.append)("p") == "ok" and slept == [10.0, 10.0]
    answers[:] = [models.TooMany(), models.TooMany(), models.TooMany()]
    slept.clear()
    with pytest.raises(models.TooMany):
        models.retried(flaky, sleep=slept.append)("p")
    assert slept == [10.0, 20.0]


def test_durations(spark):
    for ms, text in ((None, ""), (0, ""), (50, "0.1s"), (150, "0.1s"), (250, "0.3s"), (1449, "1.4s"), (1450, "1.4s"), (61_000, "61.0s"), (1_149_124_450, "1149124.4s")):
        assert spark.createDataFrame([(ms,)], "x long").select(X.duration(F.col("x")).alias("d")).first()["d"] == text, ms
