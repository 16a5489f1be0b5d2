"""Porter's stemmer of 1980, with the later ``bli`` and ``logi`` endings, as SQLite's full-text index applies it."""

from __future__ import annotations

import re

#: Tokens outside these lengths in bytes are left alone.
SHORTEST, LONGEST = 3, 64

# Endings and what replaces them, where the part before has a measure of 1 or more.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Endings that go where the part before has a measure of 2 or more.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

_VOWELS = "aeiou"
_RUNS = re.compile("v+c+")


def _shape(stem: str) -> str:
    """A letter for each letter: vowel or consonant; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in _VOWELS or c == "y" and out and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str]) -> str:
    """The longest ending that fits decides, whether or not it is replaced."""
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e):
            return word[: -len(e)] + endings[e] if _measure(word[: -len(e)]) > 0 else word
    return word


def _plural(w: str) -> str:
    if any(w.endswith(e) and len(w) > len(e) for e in ("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed") and len(w) > 3:
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
    if cut is None or "v" not in _shape(cut):
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in _VOWELS + "lsz":
        return cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _ends_cvc(cut) else cut


def _shortened(w: str) -> str:
    for e in sorted([*STEP_4, "ion"], key=len, reverse=True):
        if w.endswith(e):
            cut = w[: -len(e)]
            return cut if _measure(cut) > 1 and (e != "ion" or cut[-1:] in ("s", "t")) else w
    return w


def stem(word: str) -> str:
    """The stem of one lower-case token."""
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _shortened(_replaced(_replaced(w, STEP_2), STEP_3))
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
