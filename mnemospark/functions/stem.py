"""Porter's algorithm for English suffixes (M. F. Porter, 1980, with its author's later departures)."""

from __future__ import annotations

import re
# Suffixes and what stands for them, by step; the longest suffix that fits is taken.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    for size in range(min(7, len(word)), 1, -1):
        if word[-size:] in table:
            return word[:-size] + table[word[-size:]] if _measure(word[:-size]) > least else word
    return word


def _plain(word: str) -> str:
    """Without the endings of plurals and participles."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
    if cut is None or "v" not in _shape(cut):
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
        return cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, and with others than a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _plain(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 0), STEP_3, 0)
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


class Stems(dict):
    """Stems of the words that were looked up last; made where it is used, so that a task keeps its own."""

    MOST = 1 << 18

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = stem(word)
        return out
