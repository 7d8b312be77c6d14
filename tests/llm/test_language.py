from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.llm import language

TEXTS = {
    "en": "The orchard trust reviewed the plan for the people of the town after a long debate. The school board approved the offer under new management.",
    "de": "Der Schulausschuss überprüft den Plan für die Menschen in der Stadt nach langer Debatte. Die Feuerwehr billigt das Angebot mit knapper Mehrheit.",
    "fr": "Le comité scolaire réexamine le plan pour les habitants de la ville après un long débat. La caserne approuve une offre sur la route de Kel.",
    "es": "El consejo escolar revisó el plan para los vecinos de la ciudad tras un largo debate. La junta del agua aprobó una oferta en el distrito.",
    "pt": "O conselho escolar revisou o plano para os moradores da cidade após longo debate. A companhia de águas aprovou uma oferta no bairro.",
    "vi": "Hội đồng trường xem lại kế hoạch cho người dân thành phố sau cuộc tranh luận dài. Công ty phà thông qua mức bồi thường tại quận.",
    "ru": "Школьный совет уточняет план для жителей города после долгих споров. Пожарная часть одобряет размер компенсации в районе.",
    "zh": "学校董事会经过长时间讨论后重写了防洪方案。消防队以微弱多数通过了补偿方案。",
    "ja": "学校理事会は長い議論のあと、洪水対策を見直した。消防署はわずかな差で補償の提案を承認した。",
    "th": "คณะกรรมการโรงเรียนทบทวนแผนป้องกันน้ำท่วมหลังการอภิปรายยาวนาน หน่วยดับเพลิงอนุมัติเงินช่วยค่าไฟด้วยเสียงข้างมาก",
    "hi": "विद्यालय समिति लंबी बहस के बाद बाढ़ योजना दोहराएगा। दमकल केंद्र कम बहुमत से मुआवजे का प्रस्ताव मंजूर करेगा।",
}
OTHERS = {
    "en": "A group of teachers questioned the rules for a trial year. The water board measured the bridge on Monday.",
    "de": "Die Bäckerinnung kritisiert die Regeln für ein Probejahr. Der Wasserverband untersucht die Brücke am Montag.",
    "fr": "Un groupe critique les règles de la ville pour la troisième fois. Le conseil étudie le pont avant la pause d’été.",
    "es": "Un grupo criticó las normas de la ciudad por tercera vez. El consejo examinó el puente antes del verano.",
    "pt": "Um grupo criticou as regras da cidade pela terceira vez. O conselho examinou a ponte antes das férias.",
    "vi": "Một nhóm phê bình quy định của thành phố lần thứ ba. Hội đồng khảo sát cây cầu trước kỳ nghỉ hè.",
}


@pytest.fixture(scope="module")
def model():
    return language.train([(k, None, "\n".join([t] * 3)) for k, t in TEXTS.items()])


@pytest.mark.parametrize("lang", TEXTS)
def test_known_text(model, lang):
    found, confidence = model.classify(TEXTS[lang])
    assert found == lang and 0.3 < confidence <= 1


def test_no_wrong_answer_from_little_text(model):
    assert all(model.classify(t)[0] in (k, None) for k, t in OTHERS.items())


def test_held_out_accuracy(data):
    """Dictionaries from half of the articles, lines of the other half whose words and label agree."""
    rows = duckdb.sql(f"select article_id, language, content from '{data}/../sf0.01/articles.parquet' where length(content) > 200").fetchall()
    model = language.train([(None, label, text) for i, label, text in rows if i % 2])
    right = wrong = none = 0
    for i, label, text in rows:
        for line in text.split("\n") if not i % 2 else []:
            known = language.line_language(line)
            if known and known == language.label_code(label) and len(line) >= 40:
                found = model.classify(line)[0]
                right, wrong, none = right + (found == known), wrong + (found not in (known, None)), none + (found is None)
    assert right > 500 and wrong <= 0.003 * right and none <= 0.02 * right


def test_narrow_margins_are_rejected(model):
    assert model.classify("Kel Thun 1234")[0] is None and model.classify("1234 !")[0] is None and model.classify("")[0] is None


@pytest.mark.parametrize("label,code", [("en-US", "en"), ("English", "en"), ("zho", "zh"), ("zh-CN", "zh"), ("fr_FR", "fr"), ("DE", "de"), ("Vietnamese", "vi"), ("ko", "ko"), ("", None), (None, None), ("und", None), ("unknown", None), ("-", None), ("日本語", "ja")])
def test_labels(label, code):
    assert language.label_code(label) == code


def test_mixed_articles(model):
    both = f"{TEXTS['en']}\n{TEXTS['de']}\n{TEXTS['en']}"
    found = language.article_languages(both, None, [False] * 3, "Kel Post", "en", model, None)
    assert [x for x, _ in found] == ["en", "de"] and all(0 < c <= 1 for _, c in found)
    one = f"{TEXTS['en']}\n{TEXTS['ru'].split('. ')[0]}."
    assert [x for x, _ in language.article_languages(one, None, [False] * 2, None, "en", model, None)] == ["en"]
    within = f"{TEXTS['zh']}{TEXTS['ru']}"
    assert {x for x, _ in language.article_languages(within, None, [False], None, "zh", model, None)} == {"zh", "ru"}
    assert language.article_languages(f"{TEXTS['en']}\n{TEXTS['zh']}", None, [False, True], None, "zh", model, None)[0][0] == "en"


def test_table(spark, model):
    rows = [
        (1, "https://a.example/1", TEXTS["en"], None, "en-GB", "x"), (2, "https://a.example/2", TEXTS["en"], None, "fr", "x"), (3, "https://a.example/3", TEXTS["ru"], None, None, "x"), (4, "https://a.example/4", f"{TEXTS['fr']} {TEXTS['fr']}\n{TEXTS['de']}", "<p>x</p>", "French", "x"),
        (5, "https://a.example/5", None, None, None, "x"), (6, "https://a.example/6", "", None, None, "x"), (7, "https://a.example/7", "{{title}}", None, None, "x"), (8, None, TEXTS["zh"] * 200, None, "und", "x"), (9, "https://a.example/9", "12345", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "article_id bigint, url string, content string, raw_html string, language string, lang string")
    sites = spark.createDataFrame([("a.example", "Kel Post", "en")], "host string, source string, lang string")
    found = language.mislabelled(df, language.document_languages(df, sites, model, None))
    assert sorted(tuple(r) for r in found.collect()) == [(2, "en"), (3, "ru"), (4, "de"), (4, "fr"), (8, "zh")]
    everything = language.document_languages(df, sites, model, None)
    assert everything.filter(F.col("is_main")).count() == 5
    assert language.document_languages(df.limit(0), sites, model, None).count() == 0


def test_two_sentences_within_a_paragraph_of_another_language(model):
    for outer, inner in (("de", "en"), ("fr", "de"), ("en", "es")):
        line = f"{TEXTS[outer]} {TEXTS[inner]} {TEXTS[outer]}"
        assert [x for x, _ in language.article_languages(line, None, [False], None, outer, model, None)] == [outer, inner]
        assert [x for x, _ in language.article_languages(f"{TEXTS[outer]} {TEXTS[outer]}", None, [False], None, outer, model, None)] == [outer]


def test_languages_without_a_dictionary(model):
    for text in ("Il consiglio comunale ha approvato ieri sera dopo quattro ore una delibera sul ponte che collega fra loro due rive del fiume con spese di molti milioni.", "وافق المجلس البلدي على بناء الجسر الجديد فوق النهر."):
        assert model.classify(text)[0] is None
    assert model.classify("시의회는 강 위의 새 다리를 승인했다.")[0] == "ko" and model.classify("Το συμβούλιο ενέκρινε τη γέφυρα.")[0] == "el"


def test_a_passage_that_cannot_be_told_takes_its_neighbours(model):
    found = language.segments([TEXTS["de"], "Kel Norvel Brawen Zor", TEXTS["de"], "Kel", TEXTS["ru"]], [True] * 5, model)
    assert [x for _, _, x, _ in found][:3] == ["de", "de", "de"] and found[3][2] != "ru"
