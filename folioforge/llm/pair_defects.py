"""Defective pairs of question and answer.

Each pair gets at most one defect, tried in this order:

``empty``      nothing is said: no word or figure apart from citation labels and a bare lead-in.
``copy``       only the question again. The answer is compressed with the question as a zstandard dictionary, and the
               question with the answer: a copy adds no more to the question, and the question no more to it, than the
               question adds to itself, give or take a few bytes. What brings a word or figure of its own is never a copy.
``refusal``    every sentence declines, reports that nothing is known or found, or sends the asker elsewhere, judged by a
               dictionary of such phrases in seven languages. One sentence or clause with content makes the answer sound.
``truncated``  the answer breaks off. Its end is looked at in context: open brackets, marks and abbreviations that
               demand a continuation, table rows and lists against their own beginning, announced points against those
               that follow, a last sentence without an end after others with one. For answers that are one unfinished
               fragment ("The finance desk") a terminal-context model decides: how often a fragment of this length
               with these last words ends a statement in all answers, against how often it goes on. Beyond a few words
               the length no longer counts, only the last two words.
``language``   the answer is complete and no sentence of it is in the question's language, by the word-first language
               model, which starts from function words and learns from all pairs themselves; unless the
               question asks for the answer's language.

Defined results: a null answer is empty; with a null or empty question there is neither copy nor language; a null trace id
is kept; repeated rows give repeated results (p4_found is distinct); very long answers are read whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from folioforge.llm import language

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: A copy may add so many bytes more to its question, and the question to it, than each adds to itself.
COPY_SLACK = 8
#: A fragment counts as finished if at least this share of its contexts in all answers ended there; a long one needs more.
END_SHARE, LONG_SHARE = 0.01, 0.5
#: Words (twice as many Chinese characters) up to which the length of a fragment belongs to its context.
FRAGMENT_WORDS = 6
#: Contexts that the terminal-context model may hold as one object; as a table it has no bound.
KEEP_CONTEXTS = 50_000
#: Posterior from which the answer's language is taken as told.
SURE = 0.95

_NOT_LETTERS = re.compile(r"[\W_]+")
_LABEL = re.compile(r"\[\s*[Ss]?\d+(?:\s*,\s*[Ss]?\d+)*\s*\]")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
#: Words that introduce a question or an answer.
LEAD_WORDS = (
    "question", "answer", "response", "final answer", "short answer", "the answer is", "here is the answer", "q", "a",
    "frage", "antwort", "die antwort lautet", "réponse", "la réponse est", "pregunta", "respuesta", "la respuesta es",
    "vraag", "antwoord", "het antwoord is", "soalan", "jawapan", "jawapannya ialah", "问题", "答案", "回答", "问", "答",
)
_LEAD = re.compile(r"(?:^|(?<=[\s*_>\"“]))(?:" + "|".join(sorted(map(re.escape, LEAD_WORDS), key=len, reverse=True)) + r")\s*[*_]*\s*[:：][*_]*", re.I)

_BARE_LEAD = re.compile(r"answer|respon[sd]|reply|antwort|répon[sd]|respuesta|antwoord|jawapan|答|回复|here (?:is|are)|here's|voici|hier (?:ist|is)|aquí|berikut|以下", re.I)

#: Phrases that decline or report that nothing is known, by language.
REFUSALS = {
    "en": (
        r"\b(?:i|we)(?:'m| am| are)? (?:\w+ )?(?:do ?n[o']?t|do not|cannot|can ?n[o']?t|can't|could ?n[o']?t|couldn't|am not|will not|won't|must decline|must refuse|have to decline|decline|would rather not|have no|have not|haven't|did not|didn't|lack)\b",
        r"\b(?:unable|not able) to (?:answer|determine|say|tell|help|find|provide|give|confirm|assist|respond)",
        r"\b(?:not possible|impossible)\b.*\b(?:answer|determine|say|tell|establish)",
        r"\bno (?:\w+ )?(?:answer|information|mention|details?|data|indication|evidence)\b.*\b(?:found|available|given|sources?|documents?|context|passages?|excerpts?|provided|material|text)\b",
        r"\b(?:context|passages?|excerpts?|sources?|documents?|materials?|texts?|information)\b.*\b(?:do(?:es)? not|do ?n[o']?t|doesn't|did not|didn't|is not|isn't|are not|fails? to)\b.*\b(?:contain|say|mention|provide|include|give|cover|state|answer|specify|tell|address|enough|sufficient|available)",
        r"\bnone of the (?:\w+ )?(?:excerpts|passages|sources|documents|texts|materials)\b",
        r"\b(?:leaves? this open|rather not guess|not enough information|insufficient information|decline to answer|refuse to answer|can(?:no|')t help with|unknown to me|not known to me)\b",
        r"^(?:it is |this is |that is )?(?:not known|unknown|not stated|not specified|not in the (?:sources|documents|context))",
        r"\b(?:nothing|nowhere)\b.*\b(?:cover|mention|say|state|address|answer|describe|explain|specif|touch|deal)",
        r"\b(?:is|are|remains?|stays?) silent\b",
        r"\b(?:outside|beyond) (?:of )?(?:the |my )?(?:scope|remit|reach|what (?:i|we))\b",
    ),
    "de": (
        r"\bnicht (?:\w+ )?(?:beantworten|sagen|finden|feststellen|ermitteln|beantwortet)",
        r"\bkeine (?:\w+ )?(?:angaben?|informationen?|antwort|auskunft|hinweise?)\b",
        r"\b(?:weiß|kenne) (?:ich )?(?:es |das |die antwort )?nicht\b|\bich weiß (?:es )?nicht",
        r"\bnicht (?:genügend|genug|ausreichend)\b.*\binformation",
        r"\b(?:nichts|nirgends)\b.*\b(?:steht|erwähnt|gesagt|geregelt|zu finden)|\b(?:steht|findet sich|sagt|erwähnt)\b.*\bnichts\b|\bschweig(?:t|en)\b",
    ),
    "fr": (
        r"\bne (?:peux|puis|peut|pouvons) pas (?:\w+ )?(?:répondre|dire|trouver|déterminer|aider)",
        r"\bne perme(?:t|ttent) pas de (?:répondre|dire|déterminer)",
        r"\bne trouve(?:ns|nt)? pas\b.*\bréponse",
        r"\b(?:aucune (?:\w+ )?(?:information|réponse|mention|indication)|aucun renseignement)",
        r"\b(?:ne (?:dit|disent|mentionne|mentionnent|précise|précisent)) rien\b|\brien (?:dans|n['’]est)\b.*\b(?:dit|indiqué|mentionné|précisé|sources?|documents?)|\b(?:reste|est|sont) muet",
        r"\b(?:je|nous) ne (?:le )?(?:sais|savons|connais) pas\b|\bpas (?:assez|suffisamment) d['’]informations?",
    ),
    "es": (
        r"\bno (?:puedo|podemos|es posible|se puede) (?:\w+ )?(?:responder|contestar|decir|determinar|ayudar|saber)",
        r"\bno (?:hay|tengo|dispongo de|contienen?|existe) (?:\w+ )?(?:información|datos|respuesta)",
        r"\bno (?:encuentro|encontré|se encuentra|se encontró)\b.*\brespuesta",
        r"\bno (?:dicen?|mencionan?|indican?) nada\b|\bno (?:lo )?sé\b|\bno se menciona",
    ),
    "nl": (
        r"\bniet (?:vinden|zeggen|beantwoorden|bepalen|vaststellen)\b",
        r"\b(?:onvoldoende|geen|niet genoeg|te weinig) (?:\w+ )?(?:informatie|gegevens|antwoord)\b",
        r"\bstaat (?:\w+ )?niets\b|\bstaat er niets\b|\bik weet (?:het )?niet",
    ),
    "ms": (
        r"\btidak (?:dapat|boleh|mampu) (?:\w+ )?(?:menjawab|menentukan|membantu|memberi|mencari)",
        r"\btidak (?:menemui|menjumpai|mempunyai|ada|terdapat)\b.*\b(?:jawapan|maklumat)",
        r"\bmaklumat (?:\w+ )?tidak mencukupi\b|\btidak cukup maklumat|\btidak menyatakan apa-apa|\btiada (?:\w+ )?(?:maklumat|jawapan)|\bsaya tidak (?:tahu|pasti)",
    ),
    "zh": (
        r"(?:无法|不能|难以)(?:回答|作答|确定|判断|答复|提供答案)|拒绝回答|不便回答",
        r"(?:找不到|没有找到|未找到|查不到)[^。]{0,12}(?:答案|信息|内容|资料)|没有答案",
        r"(?:没有|未|并未)(?:提到|提及|说明|涉及|包含|给出)|(?:资料|信息|内容)不足|没有(?:相关|足够|任何)(?:的)?(?:信息|资料|内容)|(?:我)?不知道|不清楚",
    ),
}
#: How a sentence begins that only sends the asker elsewhere, and what only softens.
REDIRECTS = (
    r"please|you (?:could|may|might|can|should)|try|ask|contact|see|is there|let me know|if you|consider|perhaps you",
    r"bitte|fragen sie|wenden sie|sie können|vielleicht",
    r"adressez|veuillez|vous pouvez|consultez|demandez|contactez|merci de",
    r"consulte|por favor|pregunte|puede|contacte|diríjase",
    r"vraag|neem contact|raadpleeg|u kunt|je kunt|probeer",
    r"sila|hubungi|tanya|anda boleh|rujuk",
    r"请|您可以|你可以|可以咨询|建议",
)
SOFTENERS = (
    "sorry", "unfortunately", "i apologise", "i apologize", "apologies", "i am sorry", "i'm sorry", "i am afraid", "regrettably",
    "leider", "tut mir leid", "es tut mir leid", "entschuldigung", "désolé", "désolée", "malheureusement", "lo siento", "por desgracia",
    "lamentablemente", "helaas", "het spijt me", "maaf", "malangnya", "抱歉", "很遗憾", "对不起", "很抱歉", "no", "nein", "non", "nee", "tidak",
)
#: No phrase of a language above lacks all of its cues.
CUES = {
    "en": (
        "not", "n't", "dont", "cant", "wont", "no ", "none", "nothing", "nowhere", "unable", "impossible", "decline", "refuse", "unknown", "insufficient", "guess", "lack", "fail", "open",
        "silent", "outside", "beyond",
    ),
    "de": ("nicht", "kein", "weiß", "nirgends", "schweig"),
    "fr": ("pas", "aucun", "rien", "muet"),
    "es": ("no ", "sé"),
    "nl": ("niet", "geen", "onvoldoende", "te weinig"),
    "ms": ("tidak", "tiada"),
    "zh": ("无", "不", "没", "未", "拒", "难"),
}
#: How a line begins that only closes a letter.
CLOSINGS = (
    "regards", "best regards", "kind regards", "best", "best wishes", "sincerely", "yours sincerely", "yours faithfully", "mit freundlichen grüßen", "viele grüße", "freundliche grüße",
    "cordialement", "bien à vous", "saludos", "un saludo", "atentamente", "met vriendelijke groet", "groeten", "salam hormat", "yang benar", "此致", "敬上",
)
_CLOSING = re.compile(r"(?:" + "|".join(sorted(CLOSINGS, key=len, reverse=True)) + r")\s*[,，!.]?(?:\s+\S+){0,3}$", re.I)
#: The mark that by convention sets off a signature, and all that follows it.
_SIGNATURE = re.compile(r"\n-- ?\n[^\n]*(?:\n[^\n]+)*\s*$")
_REFUSALS = [(CUES[lang], re.compile("|".join(f"(?:{p})" for p in v), re.I)) for lang, v in REFUSALS.items()]
_REDIRECT = re.compile(r"^\W*(?:" + "|".join(REDIRECTS) + r")", re.I)
_BUT = re.compile(r"[;；]|[,，]?\s*\b(?:but|however|yet|aber|jedoch|mais|cependant|pero|sin embargo|maar|echter|tetapi|namun)\b|[，,]?(?:但是|但|不过)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’')\]*_]*\s+|(?<=[。！？])|\n+")

#: Abbreviations that something must follow.
ABBREVIATIONS = (
    "i.e.", "e.g.", "approx.", "no.", "nos.", "vs.", "cf.", "fig.", "sec.", "art.", "ref.", "incl.", "excl.", "max.", "min.", "ca.", "viz.", "dr.", "mr.", "mrs.",
    "z. b.", "z.b.", "d. h.", "d.h.", "bzw.", "nr.", "vgl.", "inkl.", "zzgl.", "sog.", "ggf.", "u. a.",
    "p. ex.", "p.ex.", "c.-à-d.", "c.-à-d", "env.", "n°", "réf.", "p. ej.", "p.ej.", "núm.", "aprox.", "es decir", "pág.",
    "bijv.", "d.w.z.", "bv.", "m.b.t.", "o.a.", "cth.", "spt.", "iaitu", "yakni", "即", "例如", "比如", "如", "也就是",
)
_ABBREVIATED = re.compile(r"(?:^|[\s(（,，、])(?:" + "|".join(sorted(map(re.escape, ABBREVIATIONS[:-5]), key=len, reverse=True)) + r")$|(?:" + "|".join(ABBREVIATIONS[-5:]) + r")$", re.I)
#: Numbers, the things that are announced in numbers, and the words that number them.
NUMBERS = {
    2: ("two", "zwei", "deux", "dos", "twee", "dua", "两", "二"),
    3: ("three", "drei", "trois", "tres", "drie", "tiga", "三"),
    4: ("four", "vier", "quatre", "cuatro", "empat", "四"),
    5: ("five", "fünf", "cinq", "cinco", "vijf", "lima", "五"),
    6: ("six", "sechs", "seis", "zes", "enam", "六"),
}
POINTS = (
    "conditions", "points", "steps", "reasons", "requirements", "rules", "things", "cases", "exceptions", "options", "bedingungen", "punkte", "schritte", "gründe", "regeln",
    "étapes", "raisons", "règles", "cas", "condiciones", "puntos", "pasos", "razones", "reglas", "requisitos", "voorwaarden", "punten", "stappen", "redenen", "regels",
    "syarat", "perkara", "langkah", "sebab", "peraturan",
)
_ANNOUNCED = re.compile(
    r"\b(?P<n>" + "|".join(w for k in NUMBERS.values() for w in k if w.isascii() or w[0] < "㐀") + r")\s+(?:\w+\s+)?(?:" + "|".join(POINTS) + r")\b|(?P<z>[两二三四五六])(?:个|项|条|点|种)(?:\w{0,2})?(?:条件|要点|步骤|原因|要求|规定|点)",
    re.I,
)
ORDINALS = (
    ("first", "firstly", "erstens", "premièrement", "primero", "en primer lugar", "ten eerste", "pertama", "第一", "首先"),
    ("second", "secondly", "zweitens", "deuxièmement", "segundo", "en segundo lugar", "ten tweede", "kedua", "第二", "其次"),
    ("third", "thirdly", "drittens", "troisièmement", "tercero", "en tercer lugar", "ten derde", "ketiga", "第三", "再次"),
    ("fourth", "fourthly", "viertens", "quatrièmement", "cuarto", "ten vierde", "keempat", "第四"),
    ("fifth", "fifthly", "fünftens", "cinquièmement", "quinto", "ten vijfde", "kelima", "第五"),
    ("sixth", "sixthly", "sechstens", "sixièmement", "sexto", "ten zesde", "keenam", "第六"),
)
_ORDINALS = [re.compile(r"(?:^|[.!?:;。；：\n]\s*|\]\s*|(?:and|und|et|y|en|dan)\s+)(?:" + "|".join(v) + r")(?=\W|$|[一-鿿])", re.I) for v in ORDINALS]
_ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+\S")
_BARE_ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]?)\s*$")
_TERMINAL = re.compile(r"[.!?。！？]$")
_CLOSERS = "\"”»’'*_)）」』`› \t"
#: Names of the languages, by which a question may ask for one.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|engels|bahasa inggeris|inggeris|英语|英文",
    "de": "german|deutsch|allemand|alemán|duits|jerman|德语|德文",
    "fr": "french|französisch|français|francés|frans|perancis|法语|法文",
    "es": "spanish|spanisch|espagnol|español|castellano|spaans|sepanyol|西班牙语|西班牙文",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|holandés|nederlands|belanda|荷兰语|荷兰文",
    "ms": "malay|malaiisch|malais|malayo|maleis|bahasa melayu|melayu|马来语|马来文",
    "zh": "chinese|chinesisch|chinois|chino|chinees|cina|中文|汉语|华语",
}
_ASKED = {
    lang: re.compile(r"\b(?:in|auf|en|in het|dalam|into|to)\s+(?:\w+\s+)?(?:" + names + r")\b|(?:用|以|请用|使用)(?:" + names + ")", re.I) for lang, names in LANGUAGE_NAMES.items()
}


def _letters(text: str) -> str:
    """Letters and figures only, in one form."""
    return _NOT_LETTERS.sub("", unicodedata.normalize("NFKC", text).casefold())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    rest = _LEAD.sub(" ", _LABEL.sub(" ", answer))
    if not any(c.isalnum() for c in rest):
        return True
    bare = rest.strip(" \t\r\n*_>#\"'“”")
    return bare.endswith((":", "：")) and len(language.words(bare)) <= 6 and bool(_BARE_LEAD.search(bare)) and not any(c.isdigit() for c in bare) and "\n" not in bare


def added_bytes(question: str, answer: str) -> int:
    """Size of the answer compressed with the question as dictionary."""
    prompt = question.encode("utf-8")
    d = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(answer.encode("utf-8")))


def _own_words(question: str, answer: str) -> bool:
    """Whether the answer has a word, figure or Chinese character that its question lacks."""
    units = lambda t: re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", unicodedata.normalize("NFKC", t).casefold())
    return not set(units(answer)) <= set(units(question))


def is_copy(question: str | None, answer: str) -> bool:
    if not question:
        return False
    rest = _LEAD.sub(" ", _LABEL.sub(" ", answer))
    q, a = _letters(question), _letters(rest)
    if not q or not a:
        return False
    first = _letters(_SENTENCE.split(question.strip())[0])
    for base in dict.fromkeys(x for x in (q, first) if x):
        itself = added_bytes(base, base)
        if added_bytes(base, a) <= itself + COPY_SLACK and added_bytes(a, base) <= itself + COPY_SLACK:
            return not _own_words(question, rest)
    return False


def _refuses(text: str) -> bool:
    """A phrase that declines is in the text. A language's phrases are looked for where one of its cues is."""
    low = text.lower()
    return any(any(cue in low for cue in cues) and phrases.search(text) is not None for cues, phrases in _REFUSALS)


def is_refusal(question: str | None, answer: str) -> bool:
    text = _SIGNATURE.sub("", _INVISIBLE.sub("", answer).replace("’", "'").replace("‘", "'"))
    if not _refuses(text):
        return False
    if question and question.strip() and text.lstrip().lower().startswith(question.strip().lower()):
        text = text.lstrip()[len(question.strip()) :]
    refused = False
    for sentence in _SENTENCE.split(text):
        s = sentence.strip(" \t*_>\"“”")
        bare = _LABEL.sub(" ", s)
        if not any(c.isalnum() for c in bare):
            continue
        if _refuses(s):
            for clause in _BUT.split(s):
                c = _LABEL.sub(" ", clause).strip(" ,，.。:：")
                if not c or c.lower() in SOFTENERS or _refuses(clause) or _REDIRECT.search(c):
                    refused = refused or _refuses(clause)
                    continue
                if _LABEL.search(clause) or any(ch.isdigit() for ch in c) or language.is_prose(language.words(c)):
                    return False
            continue
        if s.endswith(("?", "？")) or _REDIRECT.search(s) or bare.strip(" ,，.。:：!").lower() in SOFTENERS:
            continue
        if _CLOSING.fullmatch(s):
            continue
        return False
    return refused


def _normal(word: str) -> str:
    return "#" if any(c.isdigit() for c in word) else word.lower()


@lru_cache(200_000)
def _tokens(word: str) -> tuple[str, ...]:
    """A word's tokens, figures and codes told apart no further. Chinese has no spaces: its characters are tokens."""
    parts = re.findall(r"[㐀-鿿]|[^㐀-鿿]+", word)
    return tuple(t for t in (_normal(p.strip("\"'“”*_.,;:!?()[]")) for p in parts) if t)


def _context(tokens: list[str], chinese: bool) -> tuple[int, str]:
    return min(len(tokens), (2 * FRAGMENT_WORDS if chinese else FRAGMENT_WORDS) + 1), " ".join(tokens[-2:])


def fragment_context(fragment: str) -> tuple[int, str] | None:
    """(length in words, last two words) of a fragment; all lengths beyond FRAGMENT_WORDS are one. None if it has no word."""
    tokens = [t for word in fragment.split() for t in _tokens(word)]
    return _context(tokens, any(t >= "㐀" for t in tokens)) if tokens else None


def is_long(context: tuple[int, str]) -> bool:
    return context[0] > (2 * FRAGMENT_WORDS if any(t >= "㐀" for t in context[1].split()) else FRAGMENT_WORDS)


def statement_contexts(answer: str) -> Iterator[tuple[int, str, bool]]:
    """Contexts of all beginnings of the answer's statements: (length, last words, whether the statement ended there)."""
    for s in _SENTENCE.split(answer):
        ended = bool(_LABEL.search(s) or _TERMINAL.search(s.rstrip(_CLOSERS)))
        words = _LABEL.sub(" ", s).strip().split()
        if not words or words[0][0] in "|-*#>":
            continue
        if re.search(r"[㐀-鿿]", s):
            c = fragment_context(" ".join(words).rstrip("。！？")) if ended else None
            if c:
                yield (*c, True)
            continue
        tokens: list[str] = []
        for n, word in enumerate(words, 1):
            tokens += _tokens(word)
            if tokens and (n < len(words) or ended):
                yield (*_context(tokens, False), n == len(words))


@dataclass
class EndModel:
    """Share of statements that ended in a context."""

    ends: dict[tuple[int, str], tuple[int, int]]

    def finished(self, fragment: str) -> bool:
        c = fragment_context(fragment)
        if c is None:
            return False
        end, all_ = self.counts(c)
        return (end + 4 * prior(fragment)) / (all_ + 4) >= share_needed(c)

    def counts(self, context: tuple[int, str]) -> tuple[int, int]:
        return self.ends.get(context, (0, 0))


def share_needed(context: tuple[int, str]) -> float:
    return LONG_SHARE if is_long(context) else END_SHARE


def prior(fragment: str) -> float:
    """For contexts never seen: how likely it is a short nominal answer, not ending in a word that needs another."""
    words = language.words(fragment)
    if any(f" {words[-1]} " in f" {t} " for t in language.FUNCTION_WORDS.values()) if words else False:
        return 0.0
    if re.search(r"[㐀-鿿]", fragment):
        return 0.9 if len(fragment) <= 24 else 0.0
    if any(ch.isdigit() for ch in fragment):
        return 0.9 if len(words) <= 2 else 0.0
    return 0.5 if len(words) <= 3 and len(fragment.split()) == len(words) else 0.0


def _cells(row: str) -> int:
    return row.strip().strip("|").count("|") + 1


def _open(line: str) -> bool:
    """A bracket of the line is never closed."""
    square, round_ = line.rfind("["), max(line.rfind("("), line.rfind("（"))
    return square >= 0 and line.find("]", square) < 0 or round_ >= 0 and line.find(")", round_) < 0 and line.find("）", round_) < 0


def is_truncated(answer: str, model: EndModel) -> bool:
    found = truncation(answer)
    return found if isinstance(found, bool) else not model.finished(found)


def truncation(answer: str) -> bool | str:
    """Whether the answer breaks off, or the fragment on whose end that depends."""
    text = _INVISIBLE.sub("", answer).rstrip()
    text = _SIGNATURE.sub("", text).rstrip()
    while text and unicodedata.category(text[-1]) in ("So", "Sk", "Cf", "Mn"):
        text = text[:-1].rstrip()
    if not text:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _open(text.rsplit("\n", 1)[-1]):
        return True
    if last.startswith("|"):
        rows = []
        for x in reversed(lines):
            if not x.strip().startswith("|"):
                break
            rows.append(x.strip())
        header = rows[-1]
        return not last.endswith("|") or _cells(last) != _cells(header) or not re.search(r"[^|\s:\-]", last) or len(rows) < 2
    if len(lines) > 1 and _BARE_ITEM.match(last):
        return True
    core = last.rstrip(_CLOSERS) or last
    if _announced_short(text):
        return True
    if re.search(r"(?:\.\.\.|…|[:：,，、;；\-–—/&+=<(（])$", core) or _ABBREVIATED.search(core):
        return True
    if _TERMINAL.search(core) or _LABEL.search(last[-12:]) and _LABEL.sub("", last[-12:]).strip(_CLOSERS) != last[-12:].strip(_CLOSERS) and last.rstrip(_CLOSERS).endswith("]"):
        return False
    if _ITEM.match(last):
        body = re.sub(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+", "", last)
        others = [x.strip() for x in lines[:-1] if _ITEM.match(x)]
        if not language.words(body):
            return False
        if others:
            return any(_TERMINAL.search(x.rstrip(_CLOSERS)) or x.endswith("]") for x in others)
        return body
    rest = _SENTENCE.split(last)[-1]
    rest = re.split(r"(?<=\])\s*(?=\()", rest)[-1]
    if not language.words(rest) and (len(lines) > 1 or rest != last):
        return False  # what follows the last statement is a code or a figure
    started = rest != last or any(_TERMINAL.search(x.strip().rstrip(_CLOSERS)) for x in lines[:-1])
    return True if started else _LABEL.sub(" ", last).strip(" >*_\"'“”")


def _announced_short(text: str) -> bool:
    """Points are announced in a number, numbering begins, and fewer follow."""
    m = _ANNOUNCED.search(text)
    if not m:
        return False
    said = (m.group("n") or m.group("z")).lower()
    n = next(k for k, v in NUMBERS.items() if said in v)
    rest = text[m.end() :]
    words = [bool(r.search(rest)) for r in _ORDINALS]
    by_word = max((i + 1 for i, ok in enumerate(words) if ok), default=0)
    by_item = sum(bool(_ITEM.match(x)) for x in rest.split("\n"))
    got = max(by_word, by_item)
    if not got:  # announced and nothing else said
        return not any(c.isalnum() for c in re.sub(r"^[^.!?:。！？：]*[.!?:。！？：]?", "", rest))
    return got < n


def foreign(model: language.Model, questions: list[str | None], answers: list[str | None]) -> list[bool]:
    """Whether each answer is wholly in another language than its question. All sentences of the batch are told at once."""
    asked = [[lang for lang, r in _ASKED.items() if q and r.search(q)] for q in questions]
    plain = []
    for q, names in zip(questions, asked):
        for lang in names:
            q = _ASKED[lang].sub(" ", q)
        plain.append(language.words(q or ""))
    clean = [_LABEL.sub(" ", a or "") for a in answers]
    parts = [[(p[0], p[1]) for p in found] for found in language.spans(model, clean)]
    # answers too short for prose are told as a whole, by words that are known
    short = [i for i, p in enumerate(parts) if not p]
    known = [[w for w in language.words(clean[i]) if w in model.words or w[0] >= "㐀"] for i in short]
    for i, words, p in zip(short, known, model.posteriors(known)):
        parts[i] = [(language.LANGS[int(p.argmax())], float(p.max()))] if words else []
    out = []
    for words, names, p, found in zip(plain, asked, model.posteriors(plain), parts):
        of, sure = language.LANGS[int(p.argmax())], [lang for lang, c in found if c >= SURE]
        told = language.is_prose(words) and p.max() >= SURE
        out.append(told and bool(sure) and len(sure) == len(found) and of not in sure and not any(lang in names for lang in sure))
    return out


def _first_look(question: str | None, answer: str | None) -> tuple[str | None, str | None]:
    """(defect but truncation by its end and language, the fragment that the terminal-context model must judge)."""
    if is_empty(answer):
        return "empty", None
    if is_copy(question, answer):
        return "copy", None
    if is_refusal(question, answer):
        return "refusal", None
    found = truncation(answer)
    return ("truncated", None) if found is True else (None, found or None)


def defect_but_language(question: str | None, answer: str | None, ends: EndModel) -> str | None:
    defect, fragment = _first_look(question, answer)
    return "truncated" if fragment is not None and not ends.finished(fragment) else defect


def defects_of(questions: list[str | None], answers: list[str | None], ends: EndModel, languages: language.Model) -> list[str | None]:
    """The defect of each pair, or None."""
    out = [defect_but_language(q, a, ends) for q, a in zip(questions, answers)]
    rest = [i for i, d in enumerate(out) if d is None]
    for i, other in zip(rest, foreign(languages, [questions[i] for i in rest], [answers[i] for i in rest])):
        if other:
            out[i] = "language"
    return out


def end_counts(traces: DataFrame) -> DataFrame:
    """words, tail, ends, seen: the terminal contexts of all answers, counted map-side."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, str], list[int]] = {}

        def table() -> pd.DataFrame:
            return pd.DataFrame([(n, w, e, a) for (n, w), (e, a) in counts.items()], columns=["words", "tail", "ends", "seen"])

        for pdf in batches:
            for answer in pdf["answer"]:
                for n, w, end in statement_contexts(answer):
                    c = counts.setdefault((n, w), [0, 0])
                    c[0] += end
                    c[1] += 1
            if len(counts) > 100_000:
                yield table()
                counts.clear()
        yield table()

    counted = traces.select("answer").filter("answer is not null").mapInPandas(work, "words int, tail string, ends long, seen long")
    return counted.groupBy("words", "tail").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))


def fit_ends(traces: DataFrame) -> EndModel:
    """The terminal-context model as one object, for few contexts; more are an error, and find_defects takes the table instead."""
    rows = end_counts(traces).limit(KEEP_CONTEXTS + 1).collect()  # bounded by KEEP_CONTEXTS
    if len(rows) > KEEP_CONTEXTS:
        raise ValueError("more terminal contexts than KEEP_CONTEXTS; give find_defects the table of end_counts")
    return EndModel({(r["words"], r["tail"]): (r["ends"], r["seen"]) for r in rows})


def find_defects(traces: DataFrame, ends: EndModel | DataFrame, languages: language.Model) -> DataFrame:
    """trace_id and defect (null for sound pairs) of every pair. ``ends``: a model, or a table of end_counts of any size.

    One pass over the texts. What depends on a terminal context then meets the table of contexts in an equi-join.
    """
    given = traces.select(F.col("trace_id").cast("long").alias("trace_id"), "question", "answer")
    table = isinstance(ends, DataFrame)
    bc = traces.sparkSession.sparkContext.broadcast((None if table else ends, languages))  # bounded by the models' own limits
    schema = "trace_id long, defect string, words int, tail string, prior double, share double, foreign boolean"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, m = bc.value
        for big in batches:
            for at in range(0, len(big), 1000):
                pdf = big.iloc[at : at + 1000]
                questions, answers = list(pdf["question"]), list(pdf["answer"])
                looks = [_first_look(q, a) for q, a in zip(questions, answers)]
                if e is not None:
                    looks = [("truncated", None) if f is not None and not e.finished(f) else (d, None) for d, f in looks]
                rest = [i for i, (d, _) in enumerate(looks) if d is None]
                other = dict(zip(rest, foreign(m, [questions[i] for i in rest], [answers[i] for i in rest])))
                rows = []
                for i, (trace, (d, fragment)) in enumerate(zip(pdf["trace_id"], looks)):
                    c = fragment_context(fragment) if fragment is not None else None
                    if fragment is not None and c is None:
                        d = "truncated"
                    rows.append((trace, d, *(c or (None, None)), *((prior(fragment), share_needed(c)) if c else (None, None)), other.get(i, False)))
                yield pd.DataFrame(rows, columns=["trace_id", "defect", "words", "tail", "prior", "share", "foreign"]).astype({"trace_id": "Int64", "words": "Int32"})

    looked = given.mapInPandas(work, schema)
    if table:
        looked = looked.join(ends, ["words", "tail"], "left")  # pairs that ask for no context have null there and stay as they are
        finished = (F.coalesce("ends", F.lit(0)) + 4 * F.col("prior")) / (F.coalesce("seen", F.lit(0)) + 4) >= F.col("share")
        looked = looked.withColumn("defect", F.when(F.col("defect").isNull() & F.col("tail").isNotNull() & ~finished, "truncated").otherwise(F.col("defect")))
    return looked.select("trace_id", F.coalesce("defect", F.when(F.col("foreign"), "language")).alias("defect"))


def fit_languages(traces: DataFrame) -> language.Model:
    """The language model from all pairs themselves, starting from function words. A text that occurs often is read once and counts as often."""
    both = F.array(F.concat_ws("\n", "question", "answer"), "context_sent_to_model")
    return language.fit_unlabelled(traces.select(F.explode(both).alias("text")))
