import random

import pytest

from tidegauge.llm import language

SAID = {
    "en": "The road to the north was closed because the water rose over the bridge. People in the town had to leave their homes before the night. The crews said that the fire would be out by the morning.",
    "es": "La carretera hacia el norte quedó cerrada porque el agua subió sobre el puente. Los vecinos del pueblo tuvieron que dejar sus casas antes de la noche. Los equipos dijeron que el fuego estaría apagado por la mañana.",
    "pt": "A estrada para o norte foi fechada porque a água subiu sobre a ponte. Os moradores da cidade tiveram que deixar as suas casas antes da noite. As equipes disseram que o fogo estaria apagado pela manhã.",
    "fr": "La route vers le nord a été fermée parce que l'eau est montée sur le pont. Les habitants de la ville ont dû quitter leurs maisons avant la nuit. Les équipes ont dit que le feu serait éteint au matin.",
    "de": "Die Straße nach Norden wurde gesperrt, weil das Wasser über die Brücke stieg. Die Bewohner der Stadt mussten ihre Häuser vor der Nacht verlassen. Die Trupps sagten, das Feuer werde bis zum Morgen aus sein.",
    "it": "La strada verso il nord è stata chiusa perché l'acqua è salita sul ponte. Gli abitanti della città hanno dovuto lasciare le loro case prima della notte. Le squadre hanno detto che il fuoco sarebbe spento al mattino.",
    "zh": "通往北方的公路被关闭，因为水漫过了桥。镇上的人们不得不在夜晚之前离开家。队员们说大火会在早晨被扑灭。",
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    docs = [(k, " ".join(rng.sample(t.replace("。", "。 ").split(". " if k != "zh" else " "), 2))) for k, t in SAID.items() for _ in range(20)]
    wrong = [(rng.choice(language.LANGUAGES) if rng.random() < 0.2 else k, t) for k, t in docs]
    return language.train(wrong)


def test_single_languages(model):
    got = language.segments(list(SAID.values()), model)
    assert [[s[0] for s in g] for g in got] == [[k] for k in SAID] and all(0.9 < g[0][1] <= 1 for g in got)


def test_mixed_documents(model):
    one = lambda *langs: "\n".join(SAID[k] for k in langs)
    texts = [one("en", "es"), one("pt", "es", "pt"), one("zh", "de"), SAID["en"] + '\nOne man said "buenos días a todos" there.', SAID["es"] + "\n12\nquedó\n" + SAID["es"] + "\r\n\r\n" + SAID["fr"]]
    got = [[s[0] for s in g] for g in language.segments(texts, model)]
    assert got == [["en", "es"], ["pt", "es", "pt"], ["zh", "de"], ["en"], ["es", "fr"]]


def test_texts_without_letters(model):
    assert language.segments([None, "", " \n ", "12 34", "..."], model) == [[]] * 5


def test_held_out_accuracy(model):
    rng = random.Random(8)
    right = total = 0
    for k, t in SAID.items():
        words = list(t) if k == "zh" else t.split()
        for _ in range(30):
            at = rng.randrange(max(1, len(words) - 8))
            part = ("" if k == "zh" else " ").join(words[at : at + 8])
            right += [s[0] for s in language.segments([part], model)[0]] == [k]
            total += 1
    assert right / total > 0.95


@pytest.mark.parametrize("label, code", [("en", "en"), ("EN-us", "en"), ("eng", "en"), ("Spanish", "es"), ("pt-BR", "pt"), ("ger", "de"), ("zh_CN", "zh"), ("", None), (" ", None), (None, None), ("und", None), ("xx", None), ("unknown", None), ("nl", None)])
def test_labels(label, code):
    assert language.label_of(label) == code


def test_table(spark, model):
    rows = [(1, SAID["en"], "en"), (2, SAID["en"], "es"), (3, SAID["en"], None), (4, SAID["en"] + "\n" + SAID["de"], "en"), (5, None, "en"), (6, "", None), (7, SAID["fr"] * 300, "fra"), (None, SAID["fr"], "x"), (8, SAID["zh"], "unknown"), (3, SAID["en"], None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, lang string, seg_no int")
    found = language.language_segments(df, model)
    got = sorted(map(tuple, language.relabelled(found).collect()))
    assert got == [(2, 0, "en"), (3, 0, "en"), (3, 0, "en"), (4, 0, "en"), (4, 1, "de"), (8, 0, "zh")]
    assert language.language_segments(df.limit(0), model).collect() == []


def test_fit_is_bounded_and_works_on_nothing(spark):
    rows = [(k, SAID[lang], lang) for k, lang in enumerate([*SAID] * 6)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language.fit(df, per_language=2)
    assert [g[0][0] for g in language.segments(list(SAID.values()), model)] == list(SAID)
    assert language.fit(df.limit(0)).shape == (1 << 16, len(language.LANGUAGES))
