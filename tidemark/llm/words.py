"""Words of damaged subtitle text, in a spelling that misread characters and wrong encodings do not change."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that scanning confuses, each written as one representative.
CONFUSED = {"e": "c", "l": "i", "1": "i", "|": "i", "0": "o", "m": "rn", "w": "vv", "d": "ci"}

_FOLD = str.maketrans(CONFUSED)
_TIMES = re.compile(r"(?:^[^\w\n]*\d+[ \t\r]*\n)?^[^\n]*-->[^\n]*$", re.M)
_NUMBER_FIRST = re.compile(r"(\A|\n[ \t\r]*\n)[^\w\n]*\d+[ \t\r]*\n")
_BREAK_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|tr|td|h\d|pre|html|head|body|title)\b[^<>\n]{0,200}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,200}>|\{\\[^{}\n]{0,200}\}")
_SOUND = re.compile(r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|♪[^♪\n]{0,80}♪?|^[^\w\n]*â\S{0,8}ª[^\n]{0,80}$|\*[^*\n]{1,40}\*", re.M)
_LABEL = re.compile(r"^([^\w\n]*)(?:[A-Z0-9|][A-Z0-9|.']{1,19}(?: [A-Z0-9|.']{1,12}){0,2}|[A-Z][a-z|01]{1,14}(?: \d{1,2})?):(?=\s)", re.M)
_SPACE = re.compile(r"(?<![^\x00-\x7f])[  -   　  ]")
_ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
_APOSTROPHE = re.compile(r"(?<=[a-zA-Z])(?:['`´’‘]|\?)(?=[a-zA-Z])")
_WORD = re.compile(r"[a-z0-9|]+")
_WIDE_WORD = re.compile(r"\w+")


def speech(text: str) -> str:
    """``text`` without cue numbers, times, tags, sound descriptions and speaker labels."""
    if "&" in text:
        text = html.unescape(text)
    text = _TIMES.sub("", text)
    text = _NUMBER_FIRST.sub(r"\1", text)
    if "<" in text or "{" in text:
        text = _TAG.sub("", _BREAK_TAG.sub(" ", text))
    text = _SOUND.sub(" ", text)
    return _LABEL.sub(r"\1", text)


def folded(text: str) -> list[str]:
    """Lower-case ASCII words with confusable characters folded; other characters vanish.

    Letters that encodings damage are dropped whether damaged or not, so that both readings agree.
    """
    if not text.isascii():
        text = _SPACE.sub(" ", text)
        text = text.encode("ascii", "ignore").decode()
    return [w.translate(_FOLD) for w in _WORD.findall(_APOSTROPHE.sub("", text).lower())]


def wide(text: str) -> list[str]:
    """Words of any script, compatibility-normalised, without folding."""
    return _WIDE_WORD.findall(unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text)).casefold())


def mostly_latin(text: str) -> bool:
    """True unless over half of the letters would vanish in :func:`folded`."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c.isascii() for c in letters) >= len(letters)
