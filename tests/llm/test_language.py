import pytest
from pyspark.sql import functions as F

from folioforge.llm import language
from tests.conftest import rows

SENTENCES = {
    "en": ["The line manager signs the form before the next visit.", "Every receipt is kept for two years by the office.", "The valve was replaced because it did not close."],
    "de": ["Die Leitung unterschreibt das Formular vor dem nächsten Besuch.", "Jeder Beleg wird zwei Jahre lang im Büro aufbewahrt.", "Das Ventil wurde ersetzt, weil es nicht mehr schloss."],
    "fr": ["Le responsable signe le formulaire avant la prochaine visite.", "Chaque reçu est gardé deux ans par le bureau.", "La vanne a été remplacée parce qu'elle ne fermait plus."],
    "es": ["La jefa firma el formulario antes de la próxima visita.", "Cada recibo se guarda dos años en la oficina.", "La válvula se cambió porque no cerraba bien."],
    "nl": ["De chef ondertekent het formulier vóór het volgende bezoek.", "Elke bon wordt twee jaar door het kantoor bewaard.", "De klep is vervangen omdat hij niet meer sloot."],
    "ms": ["Pengurus menandatangani borang itu sebelum lawatan berikutnya.", "Setiap resit disimpan oleh pejabat selama dua tahun.", "Injap itu diganti kerana tidak dapat ditutup."],
    "zh": ["主管在下次访问之前签署表格。", "办公室把每张收据保存两年。", "阀门因为关不上而被更换。"],
}
DOC = "doc_id long, lang string, text string, label string, main string, segments string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "x", "x") for d in data], DOC)


@pytest.fixture(scope="module")
def model(spark):
    data = [(i * 10 + j, lang if j else "en", " ".join(v)) for i, (lang, v) in enumerate(SENTENCES.items()) for j in range(6)]  # one of six labels is wrong
    return language.fit(frame(spark, data))


def cases(spark, model, *data):
    return set(rows(language.found_cases(language.classify(frame(spark, data), model))))


def test_labels(spark, model):
    good = ["en", "EN", " en-GB ", "eng", "English", "en_US"]
    en = " ".join(SENTENCES["en"])
    assert cases(spark, model, *[(i, lab, en) for i, lab in enumerate(good)]) == set()
    bad = [None, "", " ", "unknown", "und", "??", "n/a", "de", "German", "zh-CN", "english-ish x"]
    assert cases(spark, model, *[(i, lab, en) for i, lab in enumerate(bad)]) == {(i, "label", "en") for i in range(len(bad))}
    for lang, v in SENTENCES.items():
        assert cases(spark, model, (1, None, v[2])) == {(1, "label", lang)}


def test_segments(spark, model):
    en, de, zh = (" ".join(SENTENCES[x]) for x in ("en", "de", "zh"))
    assert cases(spark, model, (1, "en", f"{en}\n\n{SENTENCES['de'][0]}")) == {(1, "segment", "de")}
    assert cases(spark, model, (1, "en", f"{en} {SENTENCES['fr'][1]} {en}\n- {SENTENCES['zh'][0]}")) == {(1, "segment", "fr"), (1, "segment", "zh")}
    assert cases(spark, model, (1, "de", f"# Scope of the form and the visit\n| The next visit | of the office |\n{de} („The line manager signs the form“)")) == set()
    assert cases(spark, model, (1, "zh", f"---\ntitle: The form of the office\n---\n{zh}\n\nKT-294/2 HSE-LK-152-X 33.1")) == set()
    got = language.classify(frame(spark, [(1, "en", f"{en} {SENTENCES['de'][0]} {SENTENCES['de'][1]} {en}")]), model).head()
    assert [s.lang for s in got.segments] == ["en", "de", "en"] and got.segments[1].sentences == 2 and all(s.confidence > 0.9 for s in got.segments) and 0.5 < got.confidence < 1


def test_no_prose_nulls_repeats_long(spark, model):
    en = " ".join(SENTENCES["en"])
    data = [(1, None, None), (2, None, ""), (3, "", " \n　"), (4, None, "KT-294 33.1; VR-1=2"), (5, "de", "Kelmar"), (6, "de", en), (6, "de", en), (7, None, (en + " ") * 3000), (None, None, en)]
    assert cases(spark, model, *data) == {(6, "label", "en"), (7, "label", "en"), (None, "label", "en")}
    assert language.classify(frame(spark, data), model).count() == len(data)
    assert cases(spark, model) == set()


def test_without_labels_function_words_remain(spark):
    m = language.fit(frame(spark, []))
    found = {r.doc_id: r.main for r in language.classify(frame(spark, [(i, None, " ".join(v)) for i, v in enumerate(SENTENCES.values())]), m).collect()}
    assert list(found.values()).count(None) == 0 and sum(found[i] == x for i, x in enumerate(SENTENCES)) >= 6


def test_word_first_backoff(model):
    assert "manager" in model.words and "managerin" not in model.words
    vector = model._matrix[model.row("unterschreiben")]  # unseen, by its n-grams
    assert language.LANGS[int(vector.argmax())] == "de"
    assert model.posterior([]).tolist() == [1 / 7] * 7
    import pickle

    again = pickle.loads(pickle.dumps(model))
    assert (again.posteriors([["form", "xyzzy"]]) == model.posteriors([["form", "xyzzy"]])).all()


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled test documents, the main language agrees with nearly all labels of the other half."""
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("needs the test tables")
    d = spark.read.parquet(f"{data}/documents.parquet")
    m = language.fit(d.filter("doc_id % 2 = 0"))
    got = language.classify(d.filter("doc_id % 2 = 1"), m).filter("label is not null and main is not null")
    assert got.filter("label = main").count() / got.count() > 0.92  # the rest are the wrong labels
    assert got.filter(F.col("confidence") < 0.5).count() == 0


def test_sampling_bound(spark):
    rows_ = spark.range(20_000).select(F.col("id").alias("doc_id"))
    assert 800 < language._sample(rows_, "doc_id", 1000).count() < 1200


def test_titles_and_front_matter_of_any_length():
    title = "The long title of the handbook on the keeping of forms in the office of the finance desk and of all its branches"
    said = [s for s, _ in language.sentences(f"Das Heft „{title}“ liegt im Büro. “The office keeps the form.” he said.")]
    assert not any("long title" in s for s in said) and any("keeps the form" in s for s in said)
    front = "---\n" + "".join(f"key_{i}: the value of it\n" for i in range(500)) + "---\nDas Büro behält den Bericht.\n"
    assert [s for s, _ in language.sentences(front)] == ["Das Büro behält den Bericht."]
    rule = "---\nThe office keeps the form.\n---\nThe desk signs it.\n"
    assert len(language.sentences(rule)) == 2
