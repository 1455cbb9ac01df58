import numpy as np
import pytest

from folioforge.llm import language, pair_defects as P
from tests.conftest import rows
from tests.llm.test_language import SENTENCES

Q = "Who signs the form before the next visit?"
TRACE = "trace_id long, question string, answer string, context_sent_to_model string, defect string, text string"


@pytest.fixture(scope="module")
def models(spark):
    data = []
    for i, v in enumerate(SENTENCES.values()):
        data += [(i * 10 + j, Q if i == 0 else v[0], " ".join(v), v[j % 3], "x", "x") for j in range(6)]
    data += [(900 + i, Q, a, None, "x", "x") for i, a in enumerate(["The line manager [S1]", "Form KT-12 [S1]", "18 bar [S2]", "9 working days [S1]"] * 3)]
    t = spark.createDataFrame(data, TRACE)
    return P.fit_ends(t), P.fit_languages(t)


def defect(models, answer, question=Q):
    return P.defects_of([question], [answer], *models)[0]


@pytest.mark.parametrize("answer", [None, "", " \n", "​", "[S1] [S2]", "Answer:", "**Answer:**", "...", "-", '""', "Antwort: [S1]", "👍", "Here is the answer:"])
def test_empty(models, answer):
    assert defect(models, answer) == "empty"


@pytest.mark.parametrize(
    "answer",
    [Q, Q.upper(), Q[:-1], f'"{Q}"', f"Question:\n{Q}\n\nAnswer:\n{Q}", f"Question: {Q}\n\nAnswer:\n", f"**Question:** {Q}", f"{Q} {Q}", "  " + Q.replace(" ", "  ") + " [S1]", Q[:-1] + "..."],
)
def test_copy(models, answer):
    assert defect(models, answer) == "copy"


REFUSALS = [
    "I don't know based on the provided context.", "i dont know based on the provided context", "Sorry, but none of the excerpts [S1] [S2] covers this topic. Please ask the clerk.",
    "There is no mention of KT-1 in the retrieved sources, so I can't give an answer.", "It is not possible for me to determine this. Is there another document I may use?",
    "As a document assistant I must decline to answer this question.", "Das kann ich anhand der Unterlagen nicht beantworten.", "Le contexte ne permet pas de répondre à cette question.",
    "Lo siento, no encuentro la respuesta en los documentos.", "Helaas, hierover staat niets in de passages. Vraag het aan de chef.", "Maaf, maklumat tidak mencukupi untuk menjawab.", "抱歉，这些段落没有提到相关信息。请咨询财务部门。",
]


@pytest.mark.parametrize("answer", REFUSALS)
def test_refusal(models, answer):
    assert defect(models, answer) == "refusal"


@pytest.mark.parametrize(
    "answer",
    [
        "The line manager signs it [S1]. The office keeps the", "The line manager signs [S", "The line manager signs it (see", "The line manager signs the form e.g.", "The manager signs:", "The manager signs it,",
        "The manager signs it [S1].\n\n| Part | bar |\n|---|---|\n| A | 1 |\n| B | 2", "The manager signs it.\n\n| Part | bar |\n|---|---|", "The steps are:\n1. The manager signs.\n2. The office keeps it.\n3.",
        "The steps are:\n1. The manager signs.\n2. The", "Three conditions apply. First, the manager signs [S1]. Second, the office keeps it [S1].", "The manager signs the...", "主管签署表格 [S1]。办公室把每张收",
    ],
)
def test_truncated(models, answer):
    assert defect(models, answer) == "truncated"


@pytest.mark.parametrize("lang", [x for x in SENTENCES if x != "en"])
def test_language(models, lang):
    assert defect(models, " ".join(SENTENCES[lang]) + " [S1]") == "language"
    assert defect(models, " ".join(SENTENCES[lang]), SENTENCES[lang][0]) is None


def test_language_asked_for(models):
    assert defect(models, " ".join(SENTENCES["zh"]), Q + " Answer in Chinese, please.") is None
    assert defect(models, " ".join(SENTENCES["de"]), Q + " Please answer in German.") is None
    assert defect(models, " ".join(SENTENCES["de"]), Q + " Answer in Dutch.") == "language"
    assert defect(models, " ".join(SENTENCES["de"] + SENTENCES["en"])) is None  # not wholly


@pytest.mark.parametrize(
    "answer",
    [
        "The line manager signs the form [S1].", "The line manager [S1]", "Form KT-12", "18 bar", "53", "9 working days", f"{Q} The line manager signs it [S1].", f"{Q}\n\nThe line manager signs it [S1].",
        "The first passage does not give the value; the second one states 130 bar [S2].", "The depot cannot lend one, but it repairs the KT-1 within 9 days [S1].", "Staff who don't know the code should ask the clerk [S1].",
        "No. The context of the rule changed with version 2, and the old limit is no longer valid [S1].", "Sorry for the confusion: the limit is EUR 9 [S1].", "The manager signs it [S1]. (SVC-431)", "The manager signs it [S1]. 👍",
        "The manager signs it [S1].\n\n-- \nservice-desk", "The manager signs it [S1].\n- HSE-LK-342\n- PM-669", "The manager signs it [S1].\n- SVC-1 [S1]\n- KT-7 [S2]", "The manager signs it.\n\n| Part | bar |\n|---|---|\n| A | 1 |",
        "Two conditions apply. First, the manager signs [S1]. Second, the office keeps it [S1].", "**The manager signs it [S1].**", "> The manager signs it [S1].", "Version 1.3 rules of the office are kept [S1].", "2024-05-01",
    ],
)
def test_sound(models, answer):
    assert defect(models, answer) is None


def test_zstd_dictionary_tells_copies_from_answers():
    q = P._letters(Q)
    assert P.added_bytes(q, q * 3) < 25 < P.added_bytes(q, P._letters("The chief engineer replaces eleven broken couplings on Thursdays in Kelmar."))


def test_frame(spark, models):
    data = [(1, Q, None), (2, None, "The manager signs it."), (3, "", "x"), (4, Q, "The manager signs it. " * 5000), (5, Q, Q), (5, Q, Q), (None, Q, "")]
    df = spark.createDataFrame([(*d, None, "clash", "clash") for d in data], TRACE)
    got = P.find_defects(df, *models)
    assert rows(got) == sorted([(1, "empty"), (2, None), (3, None), (4, None), (5, "copy"), (5, "copy"), (None, "empty")], key=str)
    assert P.find_defects(df.limit(0), *models).count() == 0
    none = P.fit_ends(df.limit(0)), P.fit_languages(df.limit(0))
    assert none[0].ends == {} and isinstance(none[1], language.Model)


def test_languages_learn_from_every_pair(spark):
    letters = "bcdfghjklmnprstv"
    own = ["zq" + "".join(letters[(i >> s) & 15] for s in (8, 4, 0)) for i in range(4096)]
    en = SENTENCES["en"][0]
    t = spark.createDataFrame([(i, en, f"{en} The {w} is in the office.", en, "x", "x") for i, w in enumerate(own)], TRACE)
    assert set(own) <= set(P.fit_languages(t).words)


def test_rare_contexts_are_not_dropped(spark, models, monkeypatch):
    monkeypatch.setattr(P, "KEEP_CONTEXTS", 1)
    rare = "pressure gauge on the north valve"
    data = [(i, Q, "The line manager signs it. The line manager reads it [S1].", None, "x", "x") for i in range(30)]
    data += [(100 + i, Q, f"{rare} [S1]", None, "x", "x") for i in range(20)]
    data += [(200, Q, rare, None, "x", "x"), (201, Q, "", None, "x", "x"), (202, None, None, None, "x", "x"), (203, Q, "pressure gauge on the", None, "x", "x")]
    t = spark.createDataFrame(data, TRACE)
    got = {r.trace_id: r.defect for r in P.find_defects(t, P.end_counts(t), models[1]).collect()}
    assert len(got) == len(data) and got[200] is None and got[201] == got[202] == "empty" and got[203] == "truncated"
    with pytest.raises(ValueError):
        P.fit_ends(t)


NEAR_COPIES = ["Who signs the form, before the next visit -- who?", "Signs the form before the next visit?", f"{Q} Who signs the form before the visit?"]


@pytest.mark.parametrize("answer", NEAR_COPIES)
def test_the_dictionary_decides_copies(models, answer, monkeypatch):
    assert defect(models, answer) == "copy"
    monkeypatch.setattr(P, "added_bytes", lambda question, text: 10**6 if question != text else 0)
    assert defect(models, answer) != "copy"


@pytest.mark.parametrize("answer", [f"{Q} Yes [S1].", "The next visit [S1]", "Before the visit", "Who signs the form before the next visit, Mr Arden does [S1].", "The form signs who next, the visit before."])
def test_no_copies(models, answer):
    assert defect(models, answer) != "copy"


#: Phrasings that the dictionary lacked at first and was widened for; they are not held out from it.
OTHER_WORDS = [
    "Sorry, nothing in the handbook covers this.", "The handbook is silent on this point.", "That's outside the scope of what I was given.", "Nothing in these excerpts addresses the question.",
    "Hierzu steht in den Unterlagen nichts.", "Les documents ne disent rien à ce sujet.", "This is beyond the scope of the documents.\n\nKind regards",
]


@pytest.mark.parametrize("answer", OTHER_WORDS)
def test_refusals_in_other_words(models, answer):
    assert defect(models, answer) == "refusal"


def test_nothing_is_cut_off(models):
    """Texts beyond what were limits once: a far open bracket, a long signature, a long fragment whose words end statements."""
    assert defect(models, "The manager signs it (see " + "the note of the office " * 40) == "truncated"
    assert defect(models, "The manager signs it [S1].\n\n-- \n" + "desk " * 60) is None
    long = "The head of the regional finance desk in Berlin"
    counted = dict(models[0].ends)
    assert P.is_truncated(long, P.EndModel(counted))
    counted[P.fragment_context(long)] = (40, 41)
    assert not P.is_truncated(long, P.EndModel(counted)) and P.fragment_context(long) == P.fragment_context("x " * 30 + "in Berlin")


def test_texts_that_occur_often_count_as_often(spark):
    once = ["the office keeps the form in the desk", "das Büro und der Bericht ist nicht da\nder Bericht und das Büro ist da"]
    fit = lambda texts: language.fit_unlabelled(spark.createDataFrame([(t,) for t in texts], "text string"))
    a, b = fit(once * 3 + ["", " \n", None]), fit(once + [once[0] + "\n" + once[0]] + [once[1] + "\n" + once[1]])
    assert set(a.words) == set(b.words) and all(np.allclose(a.words[w], b.words[w]) for w in a.words)
