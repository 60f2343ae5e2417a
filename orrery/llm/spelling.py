"""Plain spelling of text: disguises undone, identifiers and numbers put aside, sentences cut."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts, and signs, that look like Latin letters.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "и": "u",
        "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "γ": "y", "σ": "o",
        "ı": "i", "ɡ": "g", "ɑ": "a", "ո": "n", "օ": "o", "ѵ": "v", "ℓ": "l", "ɩ": "i",
    }
)
# Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "i", "€": "e", "£": "l", "6": "g", "2": "z"})

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻]|[\U000e0000-\U000e007f]")
_FENCE = re.compile(r"[`]{1,3}[^`\n]{1,80}[`]{1,3}")
_ADDRESS = re.compile(r"\b[a-z]+://\S+|\b[\w.+-]+@[\w-]+\.\w+|(?<!\w)[\w.@~-]+(?:/[\w.@-]+){2,}|(?:\.{1,2}|[@~])?/[\w./@-]*\w|<[\w-]+>")
_IDENTIFIER = re.compile(r"\b(?:[A-Za-z]\w*_\w+|[a-z]+\d*[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|[A-Za-z]\w*\.(?:ts|tsx|js|py|rs|go|java|sh|md|json|yml|yaml|toml|txt)|[A-Za-z]+\w*\((?=[\w\s,.)]*\)?)|v?\d+(?:[.:,-]\d+)+\w*|#?\d+(?![^\W\d_])|[0-9a-f]{7,40})\b\)?")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·•|/,]{1,2})[^\W\d_](?:\1[^\W\d_](?![^\W_]))+(?![^\W_])")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_END = re.compile(r"[.!?…。！？¡¿;]+(?=\s|$)|[。！？]|\n+|\r")
_TOKEN = re.compile(r"[^\W_](?:[\w'’]|[*#@$!|€£+](?=[\w*#@$!|€£+]))*\*{0,6}|[*#@$€£](?=[*#@$\w!]*[^\W\d_])[\w*#@$!|€£+'’]+")
_LATIN = re.compile(r"[a-zA-Z]")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")


def _joined(m: re.Match) -> str:
    letters = re.sub(r"[\W_]", "", m.group())
    return letters if len(letters) >= 3 else m.group()


def visible(text: str) -> str:
    """Without invisible characters, in compatibility form."""
    if text.isascii():
        return text
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))


@lru_cache(maxsize=1 << 17)
def _plain_word(w: str) -> str:
    """The word in plain spelling, or nothing if it has no letters; most words come again."""
    w = _spelled(w)
    return w if w and any(c.isalpha() for c in w) else ""


def _spelled(w: str) -> str:
    latin = bool(_LATIN.search(w))
    if not w.isascii():
        if latin:  # mixed scripts: a disguise
            w = w.lower().translate(LOOKALIKES)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) if not _WIDE.search(w) else w
        w = w.replace("ß", "ss").replace("æ", "ae").replace("ø", "o").replace("œ", "oe").replace("ł", "l")
    w = w.lower().replace("’", "'")
    if not w.isalpha():
        bare = w.rstrip("0123456789")
        body = bare if bare.isalpha() else w
        if body is w and any(c.isalpha() for c in w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|ms|s|kb|mb|gb|k|m|x|px|h|d)", w):
            w = w.rstrip("!|+").translate(LEET)
        else:
            w = bare
    return _REPEAT.sub(r"\1", w.strip("'"))


_WHOLE_CYRILLIC = re.compile(r"^[а-яёѐ-џ]+$", re.I)


#: Runs without blanks that may hold an address or an identifier: neither has a blank, and each has one of these signs.
_ADDRESS_RUN = re.compile(r"(?<!\S)[^\s/@<]*[/@<]\S*")
_IDENTIFIER_RUN = re.compile(r"(?<!\S)\S*?(?:[\d_(.]|(?<=[a-z0-9])[A-Z])\S*")
_CAMEL = re.compile(r"[a-z][A-Z][a-z]")


def _no_identifier(m: re.Match) -> str:
    found = m.group()
    return found if found.isalpha() and not _CAMEL.search(found) else " "


def _no_address(m: re.Match) -> str:
    return _ADDRESS.sub(" ", m.group())


def _no_identifiers(m: re.Match) -> str:
    return _IDENTIFIER.sub(_no_identifier, m.group())


def sentences(text: str) -> list[list[str]]:
    """Plain words of each sentence. Identifiers, paths and numbers are left out; a word with masked letters keeps its `*`."""
    text = visible(text)
    text = _ADDRESS_RUN.sub(_no_address, text)
    if "`" in text:
        text = _FENCE.sub(" ", text)
    text = _SPACED.sub(_joined, text)
    out = []
    for part in _END.split(text):
        if not part or not part.strip():
            continue
        part = _IDENTIFIER_RUN.sub(_no_identifiers, part)
        words = []
        for token in _TOKEN.findall(part):
            if not token.isascii() and _WIDE.search(token):
                run = "".join(_WIDE.findall(token))
                words += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
                continue
            w = _plain_word(token)
            if w:
                words.append(w)
        if words:
            out.append(words)
    return out
