from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mojibake

LINES = {
    "en": ["The orchard trust’s plan was approved – Norvel", "“We are ready,” said the chair of the board.", "A second footbridge was measured by the council."],
    "de": ["Der Prüfausschuss überprüft die Lärmgrenzen für Köln.", "„Keine Verzögerung mehr“, rief er in den Saal während der Anhörung.", "Die Bäckerinnung begrüßt den Fußgängersteg."],
    "fr": ["La régie des eaux étudie les règles d’embauche à Rély.", "Le dépôt des tramways détaille l’étude du pont après la récolte."],
    "ru": ["Портовый совет отменяет обследование моста по просьбе села.", "Городская библиотека приветствует годовой отчёт."],
    "zh": ["屋顶工匠协会临时欢迎新的时刻表。", "学校董事会未作更多评论便资助了租金调查。"],
    "ja": ["食料支援の会は木曜の早朝に補償の提案を擁護した。", "港湾協議会は騒音の基準を取り消した。"],
    "vi": ["Nhóm giáo viên khảo sát quy định nhân sự trong phiên họp kín.", "Đội cứu hỏa bác bỏ lịch chạy mới tại quận."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = []
    for lang, lines in LINES.items():
        words = [w for x in lines for w in x.split(" ")] if lang not in ("zh", "ja") else [x[k : k + 4] for x in lines for k in range(0, len(x), 4)]
        sep = " " if lang not in ("zh", "ja") else ""
        sample += [(lang, "\n".join([*lines, *(sep.join(rng.choice(words) for _ in range(9)) for _ in range(60))])) for _ in range(3)]
    return mojibake.train(sample)


@pytest.mark.parametrize("lang,chain", [("de", ("utf-8", "cp1252", 1)), ("fr", ("utf-8", "latin-1", 1)), ("fr", ("utf-8", "cp1252", 2)), ("ru", ("koi8-r", "cp1251", 1)), ("ru", ("utf-8", "cp1251", 1)), ("zh", ("gbk", "latin-1", 1)), ("zh", ("utf-8", "cp1252", 1)), ("ja", ("euc_jp", "latin-1", 1)), ("vi", ("utf-8", "mac_roman", 1)), ("en", ("utf-8", "cp437", 1))])
def test_restores(model, lang, chain):
    for line in LINES[lang]:
        wrong = mojibake.garble(line, chain)
        if wrong is None or wrong == line:
            continue
        garbled, fixed = mojibake.examine(f"{LINES['en'][2]}\n{wrong}", model)
        assert garbled and fixed == f"{LINES['en'][2]}\n{line}"


def test_held_out_accuracy(model):
    """Detection on clean and garbled lines that were not trained on."""
    fresh = {
        "de": "Für die Menschen in Süd fördert der Rat die Prüfung während der Ausschreibung.",
        "fr": "Le comité réexamine l’étude après la récolte à Rély près du dépôt.",
        "ru": "Библиотека отменяет отчёт по просьбе городская совет.",
        "vi": "Giáo viên bác bỏ quy định mới trong quận.",
    }
    right = total = 0
    for line in fresh.values():
        total += 1
        right += not mojibake.examine(line, model)[0]
        for chain in (("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 1)):
            wrong = mojibake.garble(line, chain)
            total += 1
            right += mojibake.examine(wrong, model)[0]
    assert right / total >= 0.95


def test_lost_characters_are_reported(model):
    assert mojibake.examine("Le d�p�t des tramways", model) == (True, "Le d�p�t des tramways")


def test_round_trip_of_chains():
    for chain in mojibake.CHAINS:
        if chain[1] in mojibake.WINDOWS or chain[1] in ("latin-1", "mac_roman", "cp437", "cp850", "cp866", "koi8-r"):
            for lines in LINES.values():
                for line in lines:
                    wrong = mojibake.garble(line, chain)
                    if wrong is not None and "�" not in wrong:
                        assert mojibake.invert(wrong, chain) == line


def test_table_cases(spark, model):
    bad = mojibake.garble(LINES["fr"][0], ("utf-8", "latin-1", 1))
    items = spark.createDataFrame([(1, bad, "u"), (2, None, "u"), (3, "", "u"), (1, bad, "u"), (4, LINES["fr"][0], "u")], "item_id bigint, title string, text string")
    articles = spark.createDataFrame([(7, LINES["de"][0], f"x\n{bad}\n" + "y" * 50_000)], "article_id bigint, title string, content string")
    found = mojibake.garbled_fields(mojibake.text_fields(items, articles), model)
    assert sorted((r.record_kind, r.record_id, r.field) for r in found.collect()) == [("article", 7, "content"), ("item", 1, "title"), ("item", 1, "title")]
    assert found.filter(F.col("record_id") == 1).first().restored == LINES["fr"][0]
    assert mojibake.garbled_fields(mojibake.text_fields(items.limit(0), articles.limit(0)), model).count() == 0


def test_untrained_model_finds_only_lost_characters(spark):
    model = mojibake.train([])
    assert mojibake.examine("anything é", model)[0] is False and mojibake.examine("lost �", model)[0] is True
