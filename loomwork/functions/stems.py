"""English stems by Porter's suffix rules (Porter 1980, with the later departures that are usual), for answer comparison."""

from __future__ import annotations

import re
from functools import lru_cache

_CONSONANT = r"(?:[^aeiouy]|(?<=[aeiou])y|^y)"
_VOWEL = r"(?:[aeiou]|(?<=[^aeiou])y)"
_MEASURE = re.compile(f"{_VOWEL}+{_CONSONANT}+")
_HAS_VOWEL = re.compile(_VOWEL)
_CVC = re.compile(f"{_CONSONANT}{_VOWEL}(?![wxy]){_CONSONANT}$")
_DOUBLE = re.compile(r"([^aeiouy])\1$")

#: Suffix -> what replaces it, where the stem before has a vowel followed by a consonant; the longest suffix is tried first.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where two such changes come before.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words with stems of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def measure(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _replaced(word: str, rules: dict[str, str], least: int = 1) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if measure(stem) >= least else word
    return word


def _past(word: str) -> str:
    """Without -ed or -ing, if a vowel stays before it; the stem is mended."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if stem is None or not _HAS_VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _DOUBLE.search(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and (_CVC.search(stem) or re.fullmatch(f"{_VOWEL}(?![wxy]){_CONSONANT}", stem)) else stem


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    else:
        word = _past(word)
    if len(word) > 2 and word.endswith("y") and re.search(f"{_CONSONANT}$", word[:-1]):
        word = word[:-1] + "i"
    if word.endswith("alli") and measure(word[:-4]):
        word = word[:-2]
    word = word[:-1] if word.endswith("logi") and measure(word[:-3]) else _replaced(word, STEP_2)
    word = _replaced(word, STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not (_CVC.search(rest) or re.fullmatch(f"{_VOWEL}(?![wxy]){_CONSONANT}", rest))):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
