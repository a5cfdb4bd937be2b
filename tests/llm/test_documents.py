"""Problems 6 to 8: exact round trip against a library, shares, and sentence offsets."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, sentences

FOLDER = bpe.DEFAULT_FOLDER
needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(FOLDER, "byte_bpe_50k.json")), reason="needs the public vocabularies")

TEXTS = [
    None, "", " ", "Hello  world, it's 12.5\n\n\tdone.", "在另一实施方式中，空心进料螺杆包围弹簧。", "a<|endoftext|>b", "é​ 😀😀 end", "x" * 30_000, "日本語" * 3000,
    " " * 500, "उपकरण, जिसमें हैं", "บทสรุป 38.2 มม.", "don't you'll we've I'm he'd", "\x00\x01", "٣٤٥ ① ½",
]


@needs_vocabulary
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(rows).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(rows, ["doc_id"]).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    assert bpe.encode(rows.limit(0)).count() == 0


@needs_vocabulary
def test_both_merge_orders_agree():
    ranks = bpe.read_ranks(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"))
    for word in (b"abracadabra" * 3, b" the", "螺杆包围弹簧".encode(), b"aaaaaaaaaa", b"\xff\xfe\x00", b"q"):
        assert bpe.merge_long(word, ranks) == bpe.merge_short(word, ranks)


@needs_vocabulary
def test_shares(spark):
    def docs(source, n):
        return [(f"{source}{i}", source, "word " * (20 + i % 50)) for i in range(n)]

    rows = docs("big", 600) + docs("small", 40) + docs("unwanted", 50) + [("n1", "big", None), ("n2", "big", ""), ("n3", None, "word"), (None, "big", "word")]
    documents = spark.createDataFrame(rows, "doc_id string, source string, text string").withColumn("copies", F.lit(1))
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 8), ("absent", 0.2, 2)], "source string, weight double, max_repeats int")
    got = {r.source: r for r in mixing.shares(documents, target).collect()}
    assert got["big"].share == pytest.approx(0.625, abs=0.01) and got["small"].share == pytest.approx(0.375, abs=0.01)
    assert got["absent"].share == got["unwanted"].share == 0
    assert got["small"].most_repeats <= 8 and got["big"].most_repeats == 1
    mixed = mixing.mix(documents, target)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 8
    assert mixed.where("doc_id like 'n%' or doc_id is null").count() == 0
    again = [tuple(r) for r in mixing.mix(documents.repartition(3), target).collect()]
    assert again == [tuple(r) for r in mixed.collect()]
    empty = mixing.shares(documents.limit(0), target).collect()
    assert {r.source for r in empty} == {"big", "small", "absent"} and all(r.share == 0 for r in empty)


CASES = {
    "en": ["ABSTRACT", "A belt, e.g. of steel, weighs approx. 5.2 kg.", "32.2 mm is enough.", "Stop!", "The label reads \"Do not open. Hot surface.\" and stays.", "pH values of 7.6 are preferred.", "It follows k=A . exp( -E / R. T ), where T is given in K.", "See U.S. Pat. No. 4821."],
    "de": ["Die Dicke beträgt ca. 2.4 mm, z. B. 3 mm, vgl. Tab. 5.", "Am 3. Tag wurde geprüft.", "Ein Schild „Nicht öffnen. Heiß!“ ist angebracht."],
    "ru": ["Толщина 15.1 мм, т. е. меньше известной.", "Подходят латунь, стекло и т. д. без ограничений.", "Износилась ли деталь 7?", "Тогда заменяют её."],
}


def parts(text):
    return [text[a:b] for a, b in sentences.split(text)]


@pytest.mark.parametrize("lang", sorted(CASES))
def test_sentences(lang):
    head, rest = ([CASES[lang][0]], CASES[lang][1:]) if CASES[lang][0].isupper() else ([], CASES[lang])
    assert parts("\n".join([*head, " ".join(rest)])) == CASES[lang]


def test_layouts():
    assert parts("使用时，弹簧压紧。牌上写有“请勿打开。高温！”字样。磨损了吗？可以更换。") == ["使用时，弹簧压紧。", "牌上写有“请勿打开。高温！”字样。", "磨损了吗？", "可以更换。"]
    assert parts("การสึกหรอลดลงเหลือ 38.2 มม. ต่อปี การประกอบไม่ต้องใช้เครื่องมือ") == ["การสึกหรอลดลงเหลือ 38.2 มม. ต่อปี", "การประกอบไม่ต้องใช้เครื่องมือ"]
    assert parts("मोटाई 22.8 मि.मी. है। क्या यह घिस गया है? हाँ।") == ["मोटाई 22.8 मि.मी. है।", "क्या यह घिस गया है?", "हाँ।"]
    claims = "1. A device comprising:\n  a rail; and\n  a screw. Or not.\n2. The device of claim 1,\nwherein it is flat."
    assert parts("The rail is held\nby a screw. It is flat.\n\nCLAIMS\n" + claims) == ["The rail is held\nby a screw.", "It is flat.", "CLAIMS", claims.split("\n2.")[0], "2." + claims.split("\n2.")[1]]
    assert parts("[0001] As a rule it turns.In use it stays.\n[0002] the end") == ["[0001] As a rule it turns.", "In use it stays.", "[0002] the end"]
    for nothing in (None, "", " \n\t"):
        assert parts(nothing or "") == [] and sentences.split(nothing) == []
    assert parts("word " * 50_000) == [("word " * 50_000).strip()]


def test_every_character_belongs_to_one_sentence(spark):
    texts = [*TEXTS, *[" ".join(c) for c in CASES.values()]]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start_pos int")
    got = {}
    for r in sentences.sentences(rows).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for i, text in enumerate(texts):
        at = 0
        for a, b in sorted(got.get(i, [])):
            assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip()
            at = b
        assert not (text or "")[at:].strip()


def test_abbreviations_of_one_language_do_not_bind_another():
    for one in (
        ["The screw is known in the prior art.", "The device is new."],
        ["Die Vorrichtung ist von dieser Art.", "Die Welle ist neu, vgl. Art. 5 und Abs. 2, bei max. Druck."],
        ["Длина паза 5 см.", "Затем его закрывают, см. Рис. 3, и греют 3 г. порошка."],
        ["The answer to the question is no.", "The valve of No. 4 and of Pat. No. US 4821 is shut for 5 sec.", "Then it is at the max.", "The end, cf. Smith et al. Patents of St. Gallen."],
    ):
        assert parts(" ".join(one)) == one


def test_quotations_brackets_and_gaps_of_any_length():
    long = "Turn the screw. Hold the belt. " * 30
    for one in (
        [f'The label reads "{long}" and stays.', f"The label reads “{long}” and stays.", "It is flat."],
        [f'He reads "{long}Stop it."', "A 5\" pipe is flat.", f'She reads "{long}" again.', "It stays."],
        [f"The screw (turned.\nHeld. {long}) is flat.", "The belt (see [4. Ed. " + long + "]) is new."],
        ["The 1st screw (of the pair is flat.", "The belt is new (see 3).", 'The "belt (is" old.', "It stays (here)."],
    ):
        assert parts(" ".join(one)) == one
        assert parts((" " * 40).join(one)) == one


def test_marks_of_scripts_without_tables_of_their_own():
    for one in (
        ["هل هذا صحيح؟", "نعم هو صحيح."], ["یہ ایک جملہ ہے۔", "یہ دوسرا جملہ ہے۔"], ["ይህ ዓረፍተ ነገር ነው።", "ይህ ሌላ ነው።"],
        ["이것은 문장입니다.", "그것은 책입니다."], ["នេះជាប្រយោគ។", "នេះជាប្រយោគទីពីរ។"],
    ):
        assert parts(" ".join(one)) == one


def test_claims_headings_and_words_of_any_size():
    claims = ["1. A device comprising a rail.", "41. The device of claim 1, wherein it turns. Or not.", "1200. The device of claim 41."]
    assert parts("CLAIMS\n" + "\n".join(claims)) == ["CLAIMS", *claims]
    heading = "DETAILED " + "ELECTRO" * 8 + " DESCRIPTION"
    assert parts(f"It is flat.\n\n{heading}\nThe rail turns. It stays.") == ["It is flat.", heading, "The rail turns.", "It stays."]
    assert parts("=" * 80 + " CLAIMS " + "=" * 80 + "\n1. A device. Or not.\n2. A rail.")[1:] == ["1. A device. Or not.", "2. A rail."]
    long = "Donaudampfschifffahrtsgesellschaftskapitänsmütze"
    assert parts(f"Der Rat prüft je {long}. Die Welle ist neu.") == [f"Der Rat prüft je {long}.", "Die Welle ist neu."]
