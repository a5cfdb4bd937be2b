"""Problems 2 to 5 on small fixtures and their defined cases."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, langid, lookalike, pairs, truncation

D = datetime(2024, 1, 1)
RESPONSE = "response_id long, job_id string, slot string, model_name string, language string, response string, error string, received_at timestamp, key string, value string"
SCENARIO = "job_id string, scenario_id long, english string, chinese string, channel string, received_at timestamp"
SLOTS = [("us-model-en", "en"), ("us-model-zh", "zh")]

SAMPLES = {
    "en": ["The council merged several older offices.", "Merchants welcomed the change because it shortened the queues at the northern gate.", "There is no sign that the policy was imposed from outside."],
    "de": ["Der Rat legte mehrere alte Ämter zusammen.", "Händler begrüßten die Änderung, weil die Wartezeit am Nordtor kürzer wurde.", "Es gibt kein Zeichen, dass die Regel von außen kam."],
    "ru": ["Совет объединил несколько старых контор.", "Торговцы приветствовали перемену."],
    "zh": ["议会合并了几个旧机构。", "商人欢迎这一变化，因为北门的排队时间缩短了。"],
    "ja": ["議会がいくつかの古い役所を統合しました。", "商人たちは、この変化を歓迎しました。"],
}


@pytest.fixture(scope="module")
def profiles():
    return langid.Profiles(SAMPLES)


def test_languages_of_held_out_sentences(profiles):
    for lang, text in (
        ("en", "The merchants of the northern gate welcomed the older council."),
        ("de", "Die Händler und der Rat begrüßten die alte Regel nicht."),
        ("ru", "Старый совет приветствовали торговцы."),
        ("zh", "商人欢迎议会的旧机构。"),
        ("ja", "議会は古い役所を歓迎しました。"),
    ):
        assert profiles.judge(text)[0] == lang
    mixed = "The council merged several older offices. Händler begrüßten die Änderung, weil die Wartezeit am Nordtor kürzer wurde."
    assert [s[2] for s in profiles.segments(mixed)] == ["en", "de"]
    assert [s[2] for s in profiles.segments("The council merged several older offices. The local name is 格莱奥巴弗.")] == ["en"]
    assert [s[2] for s in profiles.segments("议会合并了几个旧机构。当地写作“Dobovotefo”。")] == ["zh"]
    for nothing in (None, "", " \n", "...", "123"):
        assert profiles.segments(nothing) == []


def test_labels(spark, profiles):
    labels = [("en-US", "en"), ("ENG", "en"), ("zh_Hans", "zh"), (" Chinese ", "zh"), ("und", None), ("", None), (None, None), ("unknown", None), ("zho", "zh")]
    got = spark.createDataFrame([(a,) for a, _ in labels], "l string").select(langid.label_language(F.col("l")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in labels]
    rows = [
        (1, "j", "us-model-en", "m", "en_GB", "There is no sign that the policy was imposed from outside.", None, D, "", ""),
        (2, "j", "us-model-en", "m", "zh", "There is no sign that the policy was imposed from outside.", None, D, "", ""),
        (3, "j", "us-model-en", "m", None, "议会合并了几个旧机构。", None, D, "", ""),
        (4, "j", "us-model-en", "m", "en", "The council merged several older offices. 商人欢迎这一变化，因为北门的排队时间缩短了。", None, D, "", ""),
        (5, "j", "us-model-en", "m", "xx", "...", None, D, "", ""),
        (6, "j", "us-model-en", "m", "xx", None, None, D, "", ""),
        (2, "j", "us-model-en", "m", "zh", "There is no sign that the policy was imposed from outside.", None, D, "", ""),
    ]
    found = langid.mislabelled(langid.detected(spark.createDataFrame(rows, RESPONSE), profiles)).collect()
    assert sorted(tuple(r) for r in found) == [(2, "en"), (3, "zh"), (4, "en"), (4, "zh")]
    assert langid.mislabelled(langid.detected(spark.createDataFrame([], RESPONSE), profiles)).count() == 0


def test_text_of_unknown_scripts_is_undetermined(spark, profiles):
    assert profiles.segments("이것은 한국어 문장입니다.")[0][2:] == ("und", 0.0)
    assert [x[2] for x in profiles.segments("The council merged several older offices. 이것은 한국어 문장입니다.")] == ["en", "und"]
    assert langid.Profiles({**SAMPLES, "ko": ["이것은 한국어 문장입니다.", "그것은 책입니다."]}).segments("이것은 책입니다.")[0][2] == "ko"


def test_lookalikes(spark):
    same = [("ⅼ", "l"), ("ⲟ", "o"), ("ᴏ", "o"), ("ɑ", "a"), ("𝐀𝟏", "A1"), ("ꓮ", "A"), ("Bay", "Вау"), ("é", "é"), ("final", "ﬁn​al"), ("12", "１２"), ("大", "⼤"), ("年", "年"), ("a b", "a b"), ("ё", "ё")]
    for a, b in same:
        assert lookalike.skeleton(a) == lookalike.skeleton(b)
        assert lookalike.consistent(a) == lookalike.consistent(b)
    for a, b in (("a b", "a  b"), ("A", "a"), ("e", "é"), ("392", "39²"), ("，", ","), ("大", "太"), ("ı", "i"), ("ᵃ", "a"), ("l", "1"), ("O", "0"), ("м", "m")):
        assert lookalike.skeleton(a) != lookalike.skeleton(b)
    assert lookalike.consistent("Lifοla") == "Lifola"
    for usual in ("сосна в лесу, сор", "Ελλάδα και η Αθήνα", "ⲙⲟⲩ ⲛⲟⲩⲧⲉ", "Բարեւ ձեզ"):
        assert lookalike.consistent(usual) == usual
    assert lookalike.skeleton(None) is None and lookalike.consistent("") == ""
    values = ["Lifola Bay 1", "Lifοla Bay 1", "Lifola Вау 1", "Lifola Bay 1", "other", None, "", "…", "​…"] + ["hot"] * 40 + ["hοt"]
    rows = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field string, key long, value string")
    got = {tuple(r) for r in lookalike.same_looking(rows).collect()}
    wordy = [(i, v) for i, v in enumerate(values) if v and any(c.isalnum() for c in v)]
    want = {("f", i, j) for i, v in wordy for j, w in wordy if i < j and v != w and lookalike.skeleton(v) == lookalike.skeleton(w)}
    assert got == want and len(want) == 45
    looks: dict[str, list[int]] = {}
    for i, v in wordy:
        looks.setdefault(lookalike.skeleton(v), []).append(i)
    several = {k: ids for k, ids in looks.items() if len({values[i] for i in ids}) > 1}
    classes = {(r.key, r.class_key, r.n_forms, r.n_values) for r in lookalike.classes(rows).collect()}
    assert classes == {(i, min(ids), len({values[j] for j in ids}), len(ids)) for ids in several.values() for i in ids}
    assert lookalike.same_looking(rows.limit(0)).count() == 0


def corpus():
    towns = ["Mafike", "Lifola", "Hilehi", "Satimo", "Gigasi", "Dosoko", "Bevila", "Vameti", "Korite", "Zenora"]
    out = []
    for i, town in enumerate(towns * 6):
        out.append(f"The town of {town} plans to honour the founders of its grain stores with a plaque. Which sources would you consult first, and what could they tell us about prices in {1700 + i}?")
        out.append(f"Describe the border markets of {town} for a general reader")
    return out


CUT = [
    "The town of Rakose plans to honour the founders of its gra",
    "The town of Rakose plans to honour the founders of its grain stores with a plaque. Which sources would you",
    "The town of Rakose plans to honour the founders of its grain stores with a plaque. Which sources would you cons",
    "The town of Rakose plans to honour the founders of its grain stores with a pla�",
    'He wrote, "The town plans to honour the founders of its grain stores.',
    "The town of Rakose plans to honour the founders, i.e.",
]
WHOLE = ["Describe the border markets of Rakose for a general reader", "A plaque.", "", None, "...", "(see note 7)"]


def test_truncation(spark):
    texts = corpus() + CUT + WHOLE
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, key long, value string")
    cut = {r.row_key for r in truncation.cut_values(rows).collect()}
    n = len(corpus())
    assert cut == set(range(n, n + len(CUT)))
    assert truncation.cut_values(rows.limit(0)).count() == 0


def test_truncated_name_is_found_by_its_whole_copy(spark):
    ask = "List the three oldest and best known facts about the long and winding harbour wall of "
    names = ["Mafike", "Lifola", "Hilehi", "Satimo", "Gigasi", "Dosoko", "Bevila", "Vameti", "Korite", "Zenora"]
    texts = corpus() + [ask + n for n in [*names, "Lozedevesi", "Lozede"]]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, key long, value string")
    assert {r.row_key for r in truncation.cut_values(rows).collect()} == {len(texts) - 1}


def test_pairs(spark, profiles):
    ask_en, ask_zh = "Why did the guild system of Mafike change after 1850?", "1850年以后，马菲克的行会制度为什么发生了变化？"
    scenario = spark.createDataFrame([("j1", 1, ask_en, ask_zh, "web", D), ("j1", 1, ask_en, ask_zh, "web", D), ("j2", 2, ask_en, None, "web", D)], SCENARIO)
    good = "The council merged several older offices. There is no sign that the policy was imposed from outside."
    cases = [
        ("us-model-en", None, "empty"), ("us-model-en", " ​… ", "empty"), ("us-model-en", f'You asked: "{ask_en.upper()}"', "copies_question"),
        ("us-model-zh", f"> {ask_zh}", "copies_question"), ("us-model-en", f"{ask_en} {good}", None), ("us-model-en", "I'd rather not go into this. Is there anything else you would like help with?", "refusal"),
        ("us-model-zh", "抱歉，这里的情况我不便讨论。感谢您的理解。", "refusal"), ("us-model-en", f"I'm sorry, but I am not sure. {good}", None), ("us-model-en", good, None),
        ("us-model-en", "商人欢迎这一变化，因为北门的排队时间缩短了。", "other_language"), ("us-model-zh", good, "other_language"), ("us-model-en", "The council merged sev�", "truncated"),
        ("us-model-en", 'The clerk wrote, "I cannot answer for the guilds," and kept his post.', None),
    ]
    rows = [(i, "j1", slot, "m", None, text, "timeout", D, "", "") for i, (slot, text, _) in enumerate(cases)] + [(99, "j9", "us-model-en", "m", None, good, None, D, "", ""), (98, None, None, "m", None, good, None, D, "", "")]
    slots = spark.createDataFrame(SLOTS, "slot string, language string")
    got = {r.response_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, RESPONSE), scenario, slots, profiles).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(cases) if d}
    assert pairs.defects(spark.createDataFrame([], RESPONSE), scenario, slots, profiles).count() == 0


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    for n in (1, 6, 40):
        texts = corpus() + [CUT[0]] * n + [CUT[0].upper()]
        rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, key long, value string")
        assert {r.row_key for r in truncation.cut_values(rows).collect()} == set(range(len(corpus()), len(texts)))


def test_decisions_are_the_same_at_any_size():
    for n in (1, 10, 1000):  # the same rates in a small, a middle and a large corpus
        own = lambda mid, mark, bare: (mid, mark, bare + 1)
        assert truncation.decide("ask-bare", {2: own(0, 0, n), 1: own(0, 0, n), "longer": (90 * n, 0, 0)}, True, False)
        assert truncation.decide("ask-bare", {1: own(90 * n, 0, 2 * n), "begun": own(0, 0, 2 * n)}, False, False)
        assert truncation.decide("ask-bare", {6: own(90 * n, 9 * n, 2 * n)}, False, True)
        assert not truncation.decide("ask-bare", {6: own(9 * n, 9 * n, 20 * n), "begun": own(0, 90 * n, 9 * n)}, False, True)
        assert not truncation.decide("ask-bare", {"within": own(0, 0, 9 * n), 1: own(90 * n, 0, 9 * n)}, False, False)


def test_ten_times_the_texts_give_ten_times_the_cases(spark):
    def texts(times):
        towns = [f"{a}{b}{c}" for a in ("Ma", "Li", "Hi", "Sa", "Gi") for b in ("fi", "lo", "le", "ti") for c in ("ke", "la", "hi", "mo", "si", "ko", "vi", "me", "ri", "no")][: 20 * times]
        whole = [t.replace("Mafike", x) for x in towns for t in (f"The town of {x} plans to honour the founders of its grain stores with a plaque. The council merged several older offices.", f"Describe the border markets of {x} for a general reader")]
        return whole, [f"The town of {x} plans to honour the founders of its grain stores with a plaque. The council merged sev" for x in towns[::10]]

    for times in (1, 10):
        whole, cut = texts(times)
        rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(whole + cut)], "field string, key long, value string")
        found = [r.row_key for r in truncation.cut_values(rows).collect()]
        assert sorted(found) == list(range(len(whole), len(whole) + 2 * times))
    again = rows.unionByName(rows.selectExpr("field", "key + 100000 AS key", "value"))
    assert truncation.cut_values(again).count() == 2 * len(found)


def test_cut_copies_share_a_bucket_with_their_whole():
    rng = random.Random(3)
    hashes = truncation._Words()
    for kept in (0.3, 0.5, 0.7, 0.9):
        met = 0
        for _ in range(100):
            words = [f"w{rng.randrange(5000)}" for _ in range(60)]
            other = list(words)
            other[rng.randrange(20, 60)] = "another"
            open_end = truncation.buckets(words[: int(60 * kept)], hashes)[-1]
            met += bool(set(open_end) & {b for at in truncation.buckets(other, hashes) for b in at})
        assert met >= 90


def test_what_is_asked_is_what_is_counted():
    hashes = truncation._Words()
    keys, table = truncation.counted({("f", "the council merged several old offices", "mark"): 3, ("f", "the council merged sev", "bare"): 1}, hashes)
    found = dict(zip(keys.tolist(), map(tuple, table.tolist())))
    asked, fragment = truncation.closing(["the", "council", "merged", "sev"], "f", hashes)
    by_kind = {k: found.get(h) for k, h in zip(truncation.ASKED, asked)}
    own = (0, 0, 1)
    assert fragment and by_kind == {6: None, 4: own, 3: own, 2: own, 1: own, "within": own, "begun": (0, 3, 1), "longer": (3, 0, 0), "longer word": (3, 0, 0)}
    assert truncation.closing(["在"], "f", hashes)[1] is False and truncation.counted({}, hashes)[0].size == 0


def test_edits_equal_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            last, row[0] = row[0], n
            for m, y in enumerate(b, 1):
                last, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, last + (x != y))
        for most in range(6):
            assert truncation.edits(a, b, most) == min(row[-1], most + 1)


def test_buckets_of_a_beginning_are_those_of_the_text_that_is_cut_there():
    hashes = truncation._Words()
    words = [f"w{i * i % 9973}" for i in range(20_000)]
    long = truncation.buckets(words, hashes)
    assert [len(at) for at in long] == [truncation.BANDS] * len(truncation.beginnings(len(words)))
    for size in (8, 64, 4096, 16384):
        assert truncation.buckets(words[:size], hashes) == long[: len(truncation.beginnings(size))]
    assert truncation.buckets(words[:7], hashes) == []


def test_large_buckets_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(truncation, "BLOCK", 3)
    ask = "List the three oldest and best known facts about the long and winding harbour wall of"
    texts = [f"{ask} the town {i}." for i in range(20)] + [f"{ask} the to"] + [f"{ask} the town {i} and its" for i in range(5)]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, key long, value string")
    ends = spark.createDataFrame([("f", str(i).encode(), t, "ask-bare" if i >= 20 else "whole") for i, t in enumerate(texts)], "field string, id binary, body string, verdict string")
    ends = ends.mapInArrow(truncation._ends_of, truncation._ENDS)
    assert {int(r.id.decode()) for r in truncation._early_ends(ends).collect()} == {20}
    assert 20 in {r.key for r in truncation.judged(rows).where("is_cut").collect()}


def test_cut_copy_that_differs_before_its_end(spark):
    whole = "the old harbour office kept a long list of vessels and of their masters which the clerks of the new council copied again and again until nobody knew whose hand had written the first page or why the last entries named a quay that had never stood in the town of Lozedevesi"
    cut = whole[:-4].replace("old harbour", "former harbour")
    short = "A note on the salt tax of the upper valley and its long decline"
    others = [f"{short}.\nIt was written late.", f"{short}. It was", f"{short} before the war"]
    assert truncation.edits("a b c d".split(), "a x c".split(), 3) == 2 and truncation.edits(list("abcd"), list("wxyz"), 2) == 3
    for extra, want in (([whole, cut], {1}), ([whole, cut[:-6] + "Korite"], set()), ([short, *others], {0})):
        rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(extra)], "field string, key long, value string")
        ends = truncation.judged(rows)
        assert {r.key for r in ends.where("is_cut").collect()} & {0, 1} == want


def test_refusals_of_any_length():
    long = "I'd rather not go into this. " + "Is there anything else you would like help with? " * 20
    assert len(long) > 600 and pairs.refuses(long) and pairs.refuses("I cannot answer this." + "\n " * 600)
    assert not pairs.refuses(long + "The council merged several older offices.")


def test_truncated_answers_are_those_of_problem_5(spark, profiles):
    asked = [f"Which sources would you consult on the {x} of the council?" for x in "tolls roads walls gates mills wells fairs ports".split()]
    scenario = spark.createDataFrame([(f"j{i}", i, t, None, "web", D) for i, t in enumerate(asked)], SCENARIO)
    answers = ["Which sources would you consult first about the market", "The market was closed.", "The council merged several older offices."]
    response = spark.createDataFrame([(i, "j0", "us-model-en", "m", "en", t, None, D, "", "") for i, t in enumerate(answers)], RESPONSE)
    slots = spark.createDataFrame(SLOTS, "slot string, language string")
    cut = {r.row_key for r in truncation.cut_values(truncation.values(response, scenario)).where("field = 'response.response'").collect()}
    found = {r.response_id for r in pairs.triggered(response, scenario, slots, profiles).where("array_contains(defects, 'truncated')").collect()}
    assert found == cut == {0}


def test_short_sentences_of_another_script_stand_alone(profiles):
    english = "The council merged several older offices."
    for text, want in (
        (f"{english} Это правда. {english}", ["en", "ru", "en"]), (f"{english} 他走了。", ["en", "zh"]), (f"{english} そうです。", ["en", "ja"]),
        (f"{english} Yes, so.", ["en"]), (f"{english} Москва.", ["en"]), (f"{english}\n格莱奥巴弗\n{english}", ["en"]), (f"{english} “他走了。”", ["en"]),
        (f"商人欢迎这一变化，因为北门的排队时间缩短了。{english} 他走了。", ["zh", "en", "zh"]),
    ):
        assert [s[2] for s in profiles.segments(text)] == want


def test_pairs_are_grouped_by_the_consistent_form(spark, monkeypatch):
    for a, b in (("Bay", "Вау"), ("Lifola", "Lifοla"), ("年", "年")):
        assert lookalike.look(a) == lookalike.look(b)
    assert lookalike.look("A") != lookalike.look("a")
    monkeypatch.setattr(lookalike, "consistent", lambda text, bare=None: text)  # the script sets take part
    assert lookalike.look("Bay") != lookalike.look("Вау")


def test_filter_tells_hashes_apart_at_size(spark):
    h = F.xxhash64("id").alias("h")
    bits = common.hash_filter(spark.range(1_500_000).select(h), "h").value
    asked, others = (spark.range(*r).select(h).toArrow()["h"].to_numpy().view(np.uint64) for r in ((0, 20_000), (2_000_000, 2_020_000)))
    assert common.passes(bits, asked).all() and common.passes(bits, others).mean() < 0.02
    assert not common.passes(common.hash_filter(spark.range(0).select(h), "h").value, asked).any()


def test_open_ends_of_one_pattern_are_not_aligned_one_by_one(monkeypatch):
    calls, edits = [], truncation.edits
    monkeypatch.setattr(truncation, "edits", lambda *x: calls.append(x) or edits(*x))
    n, asks = 60, "describe the town of {} and its old border markets for a general"
    rows = [("f", 1, 0, True, b"o%d" % i, asks.format(i), 8) for i in range(n)] + [("f", 1, 0, False, b"t%d" % i, asks.format(i) + (" reader" if i else " and"), 8) for i in range(n)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("field", "bucket", "block", "asks", "id", "norm", "size"), r)) for r in rows])
    told = [r for b in truncation._aligned(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["id"], r["equal"], r["on"], r["ends"]) for r in told) == sorted((b"o%d" % i, True, n, 0) for i in range(n))
    assert len(calls) < n


def test_near_pairs_are_those_within_the_edits():
    rng = random.Random(9)
    for _ in range(40):
        opened = [[b"%d" % i, [rng.choice("abcde") for _ in range(rng.randrange(1, 12))] + [rng.choice(["x", "xy"])], rng.randrange(1, 4)] for i in range(12)]
        met = [(b"%d" % rng.randrange(20), list(opened[rng.randrange(12)][1][:-1]) if rng.random() < 0.3 else [rng.choice("abcde") for _ in range(rng.randrange(1, 12))], rng.choice(["x", "xyz", "z"]), True) for _ in range(30)]
        want = {
            (o, t, truncation.edits(one[1][:-1], m[1], one[2]) == 0)
            for o, one in enumerate(opened) for t, m in enumerate(met)
            if one[0] != m[0] and m[2].startswith(one[1][-1]) and truncation.edits(one[1][:-1], m[1], one[2]) <= one[2]
        }
        assert set(truncation.near(opened, met, truncation._Words())) == want
        found = [x for part in (met[:1], met[1:]) for x in truncation.near(opened[:3], part, truncation._Words())]
        assert len(found) == sum(o < 3 for o, _, _ in want)


def test_a_firm_sentence_in_the_expected_language_decides(profiles, monkeypatch):
    rng = random.Random(4)
    parts = [t for lang in SAMPLES for t in SAMPLES[lang]] + ["Yes, so.", "Москва.", "他走了。", "そうです。", "...", "이것은 한국어 문장입니다.", "\n", "12", "“他走了。”"]
    for text in [None, "", "..."] + [" ".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(150)]:
        languages = [s[2] for s in profiles.segments(text)]
        for lang in SAMPLES:
            assert profiles.speaks(text, lang) == (lang in languages if languages else None)
    read, judge = [], langid.Profiles._reading
    monkeypatch.setattr(langid.Profiles, "_reading", lambda self, s: read.append(s) or judge(self, s))
    fresh = langid.Profiles(SAMPLES)
    answer = " ".join([*SAMPLES["en"], *SAMPLES["de"]])
    assert pairs._flags(answer, None, False, "en", fresh) == [] and len(read) == 1
