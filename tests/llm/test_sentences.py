from __future__ import annotations

import pytest

from newsloom.llm.sentences import sentences, split_sentences


def cut(text: str) -> list[str]:
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Crofin told the inquiry that repairs would cost 289.15 million.", "Pumps, boats, etc. were sent by an audit team."],
        ["“We are ready. We will not wait,” said Doreck, who chairs the board.", "It closes at 5 p.m.", "The U.S. branch grew at 9.30 a.m. on Monday."],
        ["Is this “the end of the move?”", "The union unveiled the numbers."],
        ["Mr. J. K. Sav hesitated ... and then left the hall.", "“Not one more delay!” shouted a member."],
        ["Der 2. Senat u. a. mit Brasav tagt am 10. Tag in Dordorsav.", "„Keine Verzögerung mehr!“, rief Rebrus in den Saal.", "Die Fa. Yathu wuchs lt. Bericht um 306,52 Prozent, d. h. stärker."],
        ["« Nous sommes prêts. Nous n’attendrons plus », a déclaré Norek.", "M. Linjin a évoqué un coût de 60,34 millions d’euros."],
        ["—¿Y ahora qué? —preguntó Lanish.", "¿Quién pagará el concurso?", "El Dr. Pol calculó un coste."],
        ["«Хватит задержек!» — крикнул Келгал.", "Дом № 597 на ул. Дорзор, т. е. бывший склад, остаётся открытым.", "В 2023 г. завод вырос на 307,85 %, т. к. спрос был высоким."],
        ["डॉ. नोर ने कहा कि खर्च 87.82 करोड़ रुपये होगा।", "“हम तैयार हैं। हम और नहीं रुकेंगे,” नोर ने कहा।", "गाल धातु लि. इस साल बढ़ी।"],
        ["Nhà số 603 ở TP. Ishhepya vẫn mở cửa.", "“Chúng tôi đã sẵn sàng. Chúng tôi không chờ nữa”, Mulqui nói."],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


def test_scripts_without_spaces():
    assert cut("“不能再拖了！”代表喊道。《峪志》第866版（见附录。共253万字）由小组编写。谁负责？岑问：“谁负责？”他停顿了一下……然后离开了。") == [
        "“不能再拖了！”代表喊道。", "《峪志》第866版（见附录。共253万字）由小组编写。", "谁负责？", "岑问：“谁负责？”", "他停顿了一下……然后离开了。",
    ]
    assert cut("「準備はできた。もう待たない。」とタムさんは話した。地元のパン屋（第3号。新）は修正した。") == ["「準備はできた。もう待たない。」とタムさんは話した。", "地元のパン屋（第3号。新）は修正した。"]
    assert cut("บริษัทซาวโตขึ้น333.22%ในปีนี้ “เราพร้อมแล้ว เราจะไม่รออีก”เทียกล่าว หน่วยดับเพลิงอนุมัติ") == ["บริษัทซาวโตขึ้น333.22%ในปีนี้", "“เราพร้อมแล้ว เราจะไม่รออีก”เทียกล่าว", "หน่วยดับเพลิงอนุมัติ"]


ENGLISH = "The committee of the harbour said that a new bridge is to open in the spring and that it was paid for by the town."
GERMAN = "Der Ausschuss der Stadt hat nach der Sitzung erklärt, dass die Brücke im Frühjahr für den Verkehr geöffnet wird."
THAI = ["บริษัทซาวโตขึ้น333.22%ในปีนี้", "หน่วยดับเพลิงอนุมัติโครงการใหม่ของเมือง", "บริษัทซาวโตประกาศแผนงานใหม่ในปีนี้"]


@pytest.mark.parametrize(
    "parts",
    [
        [ENGLISH] * 5 + THAI,
        THAI * 5 + [ENGLISH, "Mr. Doreck hesitated and then left the hall of the town."],
        [GERMAN] * 8 + [ENGLISH] * 4 + ["The inquiry was opened by Mr. Doreck on Monday.", ENGLISH],
        [ENGLISH] * 8 + [GERMAN] * 4 + ["Die Brücke wurde von der Fa. Yathu am 10. Tag geöffnet.", GERMAN],
        [ENGLISH] * 5 + ["«Хватит задержек!» — крикнул Келгал.", "Дом № 597 на ул. Дорзор, т. е. бывший склад, остаётся открытым.", "Завод на ул. Дорзор вырос в этом году."],
    ],
)
def test_a_block_that_changes_late(parts):
    assert cut(" ".join(parts)) == parts


def test_layout():
    assert cut("A headline without an end\nThe first sentence is here. The second too.\n* an entry\n- another entry\nLast.") == ["A headline without an end", "The first sentence is here.", "The second too.", "* an entry", "- another entry", "Last."]
    assert cut("The museum welcomed a second\nfootbridge in a written\nstatement. It paid.\n\nNext part.") == ["The museum welcomed a second\nfootbridge in a written\nstatement.", "It paid.", "Next part."]
    assert cut("It ended here.Another one began there.") == ["It ended here.", "Another one began there."]
    assert cut("version 14.7.2 is on oviqui.example for all.") == ["version 14.7.2 is on oviqui.example for all."]


@pytest.mark.parametrize("text", ["Kel (5.04.) – A bank paid. It did.", "“open quote never ends. Really. Yes.", "x" * 100_000, ". . . !", "﻿A b. C d.", "🙂 A. B! C?"])
def test_covers_all_but_white_space(text):
    at = 0
    for a, b in sentences(text):
        assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() and b > a
        at = b
    assert not text[at:].strip()


def test_table_cases(spark):
    rows = [(1, "A b. C d.", 1), (2, "", 1), (3, None, 1), (4, " \n\t　", 1), (1, "A b. C d.", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_char int")
    found = sorted(tuple(r) for r in split_sentences(df).collect())
    assert found == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert split_sentences(df.limit(0)).count() == 0


def test_quotations_of_any_length():
    quoted = "“" + " ".join(f"Line {k} of the letter was read." for k in range(40)) + "”"
    text = f"He read it out: {quoted} Then he left."
    assert [text[a:b] for a, b in sentences(text)] == [f"He read it out: {quoted}", "Then he left."]
    # an opening mark that nothing closes holds nothing together, however near or far the next pair is
    for n in (3, 60):
        text = "He said “wait. " + "It rained. " * n + "She said “Go. Now.” and left."
        assert [text[a:b] for a, b in sentences(text)][-1] == "She said “Go. Now.” and left."
    assert len(sentences("„" * 50_000 + "）" * 50_000)) == 1
