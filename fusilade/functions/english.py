"""English lexemes: stop words and the published Porter2 stemmer (the Snowball English rules of before 2024)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Snowball English stop words, in natural order.
STOP_WORDS = frozenset((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split())
# Words that the rules would get wrong.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_PLURALS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of the second, third and fourth steps.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_VOWEL, _REGION = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _suffix(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    s = _suffix(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if s in ("eed", "eedly"):
        return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    if not s or not _VOWEL.search(w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-cased word."""
    if len(word) < 3:
        return word
    if word in IRREGULAR or word in KEPT:
        return IRREGULAR.get(word, word)
    w = re.sub("(?:^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after(w, 0) if start is None else start
    r2 = _after(w, r1)
    w = _plural(re.sub("(?:'s'|'s|')$", "", w))
    if w in KEPT_PLURALS:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = _suffix(w, SECOND)
    cut = len(w) - len(s)
    if s and cut >= r1 and not (s == "ogi" and w[cut - 1 : cut] != "l") and not (s == "li" and w[cut - 1 : cut] not in tuple("cdeghkmnrt")):
        w = w[:cut] + SECOND[s]
    s = _suffix(w, THIRD)
    cut = len(w) - len(s)
    if s and cut >= (r2 if s == "ative" else r1):
        w = w[:cut] + THIRD[s]
    s = _suffix(w, FOURTH)
    cut = len(w) - len(s)
    if s and cut >= r2 and not (s == "ion" and w[cut - 1 : cut] not in ("s", "t")):
        w = w[:cut]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(token: str | Column) -> Column:
    """The stem of a lower-cased token; null for stop words and null."""

    @F.pandas_udf("string")
    def one(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None or t in STOP_WORDS else stem(t) or None)

    return one(token)
