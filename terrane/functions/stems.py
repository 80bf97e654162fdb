"""Stems of English words (Porter 1980), and counts of words by stem."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The method's endings, by step, longest first where one ends another.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and others than letters, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (e := _ending(word, ("ed", "ing"))) and "v" in _shape(word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        if (e := _ending(word, table)) and _measure(word[: -len(e)]) > 0:
            word = word[: -len(e)] + table[e]
    if (e := _ending(word, STEP4)) and _measure(word[: -len(e)]) > 1 and (e != "ion" or word[-4] in "st"):
        word = word[: -len(e)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _short(word[:-1]) else word
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def beginning(stemmed: str) -> str:
    """What every word with this stem begins with: a stem's last letter may be another than a word's."""
    if len(stemmed) > 1 and stemmed[-1] in "ei":
        stemmed = stemmed[:-1]
    return stemmed[:-1] if stemmed.endswith("bl") else stemmed


def count_stems(text: Column, words: list[str]) -> Column:
    """How often words with the stems of these follow each other in a lower-case text.

    The JVM finds words that begin alike; only those, of the texts that have any, go through Arrow.
    """
    stems = [stem(w) for w in words]
    pattern = "[^a-z0-9_]+".join(re.escape(beginning(s)) + "[a-z0-9_]*" for s in stems)

    def count(found: pd.Series) -> pd.Series:
        return found.map(lambda hits: sum([stem(w) for w in re.findall("[a-z0-9_]+", hit)] == stems for hit in hits) if hits is not None else 0).astype("int32")

    alike = F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9_])(?=({pattern}))"), 1)
    return F.pandas_udf(count, "int")(F.when(text.contains(beginning(stems[0])), alike))
