"""Text analysis as full-text engines do it: words, case, diacritics, and Porter's stemmer (1980)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of fewer than three letters stay."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if cut is not None and _vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _double(w) and w[-1] == "l" and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """(letters with marks and what stands for each, then the marks themselves): arguments of a translation, for Spark's translate() too. Only letters that have one plain letter."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(128, 0x10000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        if unicodedata.combining(c):
            marks.append(c)
        elif len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and base != c:
            letters.append(c)
            plain.append(base)
    return "".join(letters + marks), "".join(plain)


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    letters, plain = accents()
    return {ord(c): plain[k] if k < len(plain) else None for k, c in enumerate(letters)}


def unaccented(text: str) -> str:
    return text if text.isascii() else text.translate(_table())


def stems(words: Iterable[str]) -> list[str]:
    """Stems of lower-case words; other than ASCII letters count as the consonants of their bytes."""
    return [stem(w) if w.isascii() else stem(w.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") for w in words]


def analyzed(text: str | None, stemmed: bool = True) -> list[str]:
    """Terms of a text in order."""
    words = _WORD.findall(unaccented((text or "").lower()))
    return stems(words) if stemmed else words
