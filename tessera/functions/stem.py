"""Snowball stems of folded words: Romanian, then English, whatever the language.

A stem only has to be the same for question and text.  Words come from `text.tokens`: lower case, without accents or signs.  So the endings
written with an accent, and the rules for apostrophes, can't apply and are left out; everything else follows the published algorithms
(Snowball 2).  Stemming maps arrays of words in Arrow batches, without a shuffle, and remembers at most WORDS words a task; BM25's index
stems the distinct words of the chunks that it counts together.
A null array stays null, an empty one empty; repeated words stay repeated.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import accented_words, fold_words, tokens

WORDS = 500_000

# Romanian endings and what takes their place.
RO_NOUN = {"ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i", "ilor": "i", "ile": "i", "atei": "at"}
RO_COMBINED = {
    **dict.fromkeys("abilitate abilitati".split(), "abil"),
    "ibilitate": "ibil",
    **dict.fromkeys("ivitate ivitati".split(), "iv"),
    **dict.fromkeys("icitate icitati icator icatori iciv iciva icive icivi ical icala icale icali".split(), "ic"),
    **dict.fromkeys("ativ ativa ative ativi atoare ator atori".split(), "at"),
    **dict.fromkeys("itiv itiva itive itivi itoare itor itori".split(), "it"),
}
RO_STANDARD = {
    **dict.fromkeys("""at ata ati ate ut uta uti ute it ita iti ite ic ica ice ici abil abila abile abili ibil ibila ibile ibili
    oasa oase os osi ant anta ante anti ator atori itate itati iv iva ive ivi""".split(), ""),
    **dict.fromkeys("ism isme ist ista iste isti".split(), "ist"),
}
RO_VERB = "are ere ire ind indu eze ez ezi esc am ai au eam eai ea eau iam iai ia iau ui ase asem ise isem use usem".split()  # after a consonant or u
RO_VERB_ANYWHERE = "em im se sei sese sesem".split()
RO_LAST = "a e i ie".split()

# English words with stems of their own, beginnings that set the first region, endings.
EN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
EN_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
EN_BEGINNINGS = ("gener", "commun", "arsen")
EN_PLURAL = "sses ied ies s us ss".split()
EN_PAST = "eed eedly ed edly ing ingly".split()
EN_DOUBLE = "bb dd ff gg mm nn pp rr tt".split()
EN_LI = "cdeghkmnrt"
EN_LONG = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_MIDDLE = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_SHORT = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# The tables' endings, the longest first.
_NOUN, _COMBINED, _STANDARD, _VERBAL, _LAST, _PLURAL, _PAST, _LONG, _MIDDLE, _SHORT = (
    tuple(sorted(t, key=len, reverse=True)) for t in (RO_NOUN, RO_COMBINED, RO_STANDARD, RO_VERB + RO_VERB_ANYWHERE, RO_LAST, EN_PLURAL, EN_PAST, EN_LONG, EN_MIDDLE, EN_SHORT)
)
_RO_CLOSED, _EN_CLOSED = re.compile("[aeiou][^aeiou]"), re.compile("[aeiouy][^aeiouy]")
_RO_VERBAL = re.compile("[aeiou][^aeiou]+[aeiou]|[aeiou]{2,}[^aeiou]|[^aeiou]{2,}[aeiou]|[^aeiou][aeiou].", re.S)
_EN_SYLLABLE = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _past(closed: re.Pattern, word: str, start: int = 0) -> int:
    """Where the region after the first vowel and the consonant that follows begins."""
    m = closed.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The longest of the endings that the word has, or nothing; most words have none."""
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else ""


def _marked(word: str, letters: str, vowels: str, between: bool) -> str:
    """Letters that count as consonants after a vowel (and before one) in capitals, from the left."""
    out = list(word)
    for i in range(1, len(out) - between):
        if out[i] in letters and out[i - 1] in vowels and (not between or out[i + 1] in vowels):
            out[i] = out[i].upper()
    return "".join(out)


def romanian(word: str) -> str:
    w = _marked(word, "ui", "aeiou", True)
    r1 = _past(_RO_CLOSED, w)
    r2 = _past(_RO_CLOSED, w, r1)
    verbal = m.end() if (m := _RO_VERBAL.match(w)) else len(w)
    e = _ending(w, _NOUN)
    if e and len(w) - len(e) >= r1 and not w.endswith("abile"):
        w = w[: -len(e)] + RO_NOUN[e]
    found = False
    while (e := _ending(w, _COMBINED)) and len(w) - len(e) >= r1:
        w, found = w[: -len(e)] + RO_COMBINED[e], True
    e = _ending(w, _STANDARD)
    if e and len(w) - len(e) >= r2:
        w, found = w[: -len(e)] + RO_STANDARD[e], True
    if not found:
        region = w[verbal:]
        e = _ending(region, _VERBAL)
        before = region[: -len(e)][-1:] if e else ""
        if e in RO_VERB_ANYWHERE or (before and before not in "aeio"):
            w = w[: -len(e)]
    e = _ending(w, _LAST)
    if e and len(w) - len(e) >= verbal:
        w = w[: -len(e)]
    return w.replace("U", "u").replace("I", "i")


def _vowel(part: str) -> bool:
    return any(c in "aeiouy" for c in part)


def _plural(w: str) -> str:
    e = _ending(w, _PLURAL)
    if e == "sses":
        return w[:-2]
    if e in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if e == "s" and _vowel(w[:-2]) else w


def _past_tense(w: str, r1: int) -> str:
    e = _ending(w, _PAST)
    if e in ("eed", "eedly"):
        return w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    rest = w[: len(w) - len(e)]
    if not e or not _vowel(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(tuple(EN_DOUBLE)):
        return rest[:-1]
    return rest + "e" if len(rest) == r1 and _EN_SYLLABLE.search(rest) else rest


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in EN_STEMS:
        return EN_STEMS[word]
    w = _marked(("Y" if word[0] == "y" else word[0]) + word[1:], "y", "aeiouy", False)
    start = next((len(b) for b in EN_BEGINNINGS if w.startswith(b)), None)
    r1 = _past(_EN_CLOSED, w) if start is None else start
    r2 = _past(_EN_CLOSED, w, r1)
    w = _plural(w)
    if w in EN_KEPT:
        return w
    w = _past_tense(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    e = _ending(w, _LONG)
    stays = (e == "ogi" and not w.endswith("logi")) or (e == "li" and w[-3:-2] not in tuple(EN_LI))
    if e and len(w) - len(e) >= r1 and not stays:
        w = w[: -len(e)] + EN_LONG[e]
    e = _ending(w, _MIDDLE)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + EN_MIDDLE[e]
    e = _ending(w, _SHORT)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w.endswith(("sion", "tion"))):
        w = w[: -len(e)]
    at = len(w) - 1
    if w[-1:] == "e" and (at >= r2 or (at >= r1 and not _EN_SYLLABLE.search(w[:-1]))):
        w = w[:-1]
    elif w[-2:] == "ll" and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(word: str) -> str:
    return english(romanian(word))


_stems: dict[str, str] = {}


def _remembered(word: str) -> str:
    s = _stems.get(word)
    if s is None:
        if len(_stems) >= WORDS:
            _stems.clear()
        s = _stems[word] = stem(word)
    return s


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [_remembered(w) for w in ws])


def stemmed_tokens(text: Column) -> Column:
    """The words BM25 counts when documents and questions are in Romanian and English; pass it as `words`."""
    return stems(tokens(text))


def stem_words(words: pa.Array) -> pa.Array:
    """Stems of lower-case words, accents and all."""
    return pa.array(map(_remembered, fold_words(words).to_pylist()), pa.string())


stemmed_tokens.parts = (accented_words, stem_words)
