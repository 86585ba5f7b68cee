"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "[aeiou]|(?<=[^aeiou])y"
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _shape(word: str) -> str:
    out = []
    for i, c in enumerate(word):
        out.append("v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a–z stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = ""
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + table[end]
                break
    for end in _STEP4:
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or _measure(left) == 1 and not _cvc(left):
            word = left
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
