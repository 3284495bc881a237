"""Sentence units by hand-made texts in many scripts, and by properties."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.segment import sentence_units, unit_spans


def units(text):
    return [text[s:e] for s, e in unit_spans(text)]


CASES = {
    "plain": ("We grew. They fell!  Did it end?", ["We grew.", "They fell!", "Did it end?"]),
    "abbreviations": ("Mr. Ray and Dr. Lee joined Acme, Inc. in 2015 after approx. 3 years. See Note 4, Sec. 10.8, p. 9.", ["Mr. Ray and Dr. Lee joined Acme, Inc. in 2015 after approx. 3 years.", "See Note 4, Sec. 10.8, p. 9."]),
    "ends with one": ("It left the U.S. Our unit stayed. We hold Acme Corp. Since then it rose.", ["It left the U.S.", "Our unit stayed.", "We hold Acme Corp.", "Since then it rose."]),
    "initials": ("J. R. Smith paid $46.3 million. A. B. left.", ["J. R. Smith paid $46.3 million.", "A. B. left."]),
    "address": ("Our site, www.acme.example, is new. It works.", ["Our site, www.acme.example, is new.", "It works."]),
    "quotation": ('"We will wait. It is late," said Ms. Ray. Then: "No." Later it rose.', ['"We will wait. It is late," said Ms. Ray.', 'Then: "No."', "Later it rose."]),
    "bracket": ("(All sums are in thousands.) The board met.", ["(All sums are in thousands.)", "The board met."]),
    "goes on in lower case": ("Why accept $3.1 million? it asked. From 2 to 3 ... and back.", ["Why accept $3.1 million? it asked.", "From 2 to 3 ... and back."]),
    "no blank": ("It cut its forecast.The licence ended.iPhone sales rose.", ["It cut its forecast.", "The licence ended.iPhone sales rose."]),
    "camel": ("It ended. iPhone sales rose.", ["It ended.", "iPhone sales rose."]),
    "wrapped": ("One line\nof text. Two\nlines.", ["One line\nof text.", "Two\nlines."]),
    "blank line": ("Risk Factors\n \nOne. Two.\r\n\r\nThree", ["Risk Factors", "One.", "Two.", "Three"]),
    "heading": ("Item 1A. Risk Factors\n\n3. Finanzlage\n\nText here.", ["Item 1A. Risk Factors", "3. Finanzlage", "Text here."]),
    "table": ("A | 1.5 | 2.5\nB | 3.5 | 4.5", ["A | 1.5 | 2.5\nB | 3.5 | 4.5"]),
    "german": ("Am 3. Dezember zahlte sie ca. 9,7 Mio. EUR, d. h. 4 %. Dr. Ott prüfte z. B. Nr. 6. Er ging.", ["Am 3. Dezember zahlte sie ca. 9,7 Mio. EUR, d. h. 4 %.", "Dr. Ott prüfte z. B. Nr. 6.", "Er ging."]),
    "german quotation": ("„Wir verkaufen nicht. Wir warten ab“, sagte Hr. Ott. Er ging.", ["„Wir verkaufen nicht. Wir warten ab“, sagte Hr. Ott.", "Er ging."]),
    "french": ("« Nous attendrons », a dit M. Roy. Il garde 3 % du capital. »", None),
    "spanish": ("¿Cumplió? ¡Sí! La Sra. Paz firmó, pág. 3.", ["¿Cumplió?", "¡Sí!", "La Sra. Paz firmó, pág. 3."]),
    "russian": ("Г-н Иванов ушёл в 2009 г. по ст. 14. А. В. Петров, т. е. брат, остался.", ["Г-н Иванов ушёл в 2009 г. по ст. 14.", "А. В. Петров, т. е. брат, остался."]),
    "japanese": ("「売却しない。様子を見る。」と述べた。次の文。", ["「売却しない。様子を見る。」と述べた。", "次の文。"]),
    "chinese": ("增长（见附注19.）。“不会出售。会等待。”先生表示。完成了！", ["增长（见附注19.）。", "“不会出售。会等待。”先生表示。", "完成了！"]),
    "hindi": ("डॉ. Rao ने कहा। क्या यह पूरा है? हाँ।", ["डॉ. Rao ने कहा।", "क्या यह पूरा है?", "हाँ।"]),
    "thai": ("บริษัท ABC จ่ายเงิน ฝ่ายการแพทย์ซื้อหุ้นร้อยละ 87 แล้ว", None),
}


@pytest.mark.parametrize("name", [k for k, v in CASES.items() if v[1] is not None])
def test_units(name):
    text, want = CASES[name]
    assert units(text) == want


def test_thai_blanks_between_letters():
    assert units("ทั้งหมด ภายใต้สัญญา ABC จำกัด")[0] == "ทั้งหมด"
    assert units("ภายใต้สัญญา ABC จำกัด") == ["ภายใต้สัญญา ABC จำกัด"]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "\r\n\r\n"])
def test_blank_texts_have_none(text):
    assert unit_spans(text) == []


def test_no_mark_is_one_unit():
    assert units("no mark at all") == ["no mark at all"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.!? \n\"'“”()。「」।ก5", max_size=80))
def test_units_cover_all_but_blanks(text):
    at = 0
    for s, e in unit_spans(text):
        assert s >= at and e > s and not text[at:s].strip() and text[s:e] == text[s:e].strip()
        at = e
    assert not text[at:].strip()


def test_very_long_text():
    text = "The board met in May. " * 20000
    assert len(unit_spans(text)) == 20000
    assert len(unit_spans("a" * 500_000)) == 1


def test_table_of_records(spark):
    rows = [("s", 1, "One. Two.", 9), ("s", 1, "One. Two.", 9), ("t", None, "Three.", 9), ("t", 4, None, 9), (None, 5, " ", 9)]
    df = spark.createDataFrame(rows, "k string, i bigint, t string, record_id int")
    got = sorted((str(r.record_kind), str(r.record_id), r.start_pos, r.end_pos) for r in sentence_units(df, "k", "i", "t").collect())
    assert got == [("s", "1", 0, 4), ("s", "1", 0, 4), ("s", "1", 5, 9), ("s", "1", 5, 9), ("t", "None", 0, 6)]
    assert sentence_units(df.limit(0), "k", "i", "t").count() == 0


def test_long_blocks_take_linear_time():
    import time

    took = []
    for n in (500, 4000):
        text = 'He said "yes ... I know" and left. We saw it (in May. of 2020) there… And so on. ' * n
        began = time.process_time()
        assert len(unit_spans(text)) >= n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2
