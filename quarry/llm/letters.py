"""Texts as arrays of folded code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

SPACE = 32
_UPTO = 0x33480  # no letters are assigned beyond
_BLOCK = 1 << 20

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
#: Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
BEFORE_LETTERS = {"$": "s"}
BETWEEN_LETTERS = {"@": "a"}


@cache
def letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    out = np.full(_UPTO + 1, SPACE, np.uint32)
    for cp in range(_UPTO):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@cache
def look_table() -> np.ndarray:
    """As letter_table, with look-alikes as one letter: homoglyphs, full-width letters, and l as i."""
    import unicodedata

    out = letter_table().copy()
    for cp in range(0xFF21, 0xFF5B):
        wide = unicodedata.normalize("NFKC", chr(cp)).lower()
        if wide.isalpha():
            out[cp] = ord(wide)
    for c, like in HOMOGLYPHS.items():
        out[ord(c)] = ord(like)
        if len(c.upper()) == 1:
            out[ord(c.upper())] = ord(like)
    out[out == ord("l")] = ord("i")
    return out


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _UPTO)


def blocks(text: str, overlap: int) -> Iterator[str]:
    """A text in blocks that share `overlap` characters."""
    if len(text) <= _BLOCK:
        yield text
        return
    for at in range(0, len(text), _BLOCK):
        yield text[max(0, at - overlap) : at + _BLOCK]


def spaced(folded: np.ndarray) -> np.ndarray:
    """Runs of spaces as one, with one at both ends."""
    padded = np.concatenate([[SPACE], folded, [SPACE]]).astype(np.uint32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE)
    return padded[keep]


def look_folded(text: str) -> str:
    """Words as they look: lower case, homoglyphs and digit substitutions undone, one space between and around."""
    cps = code_points(text)
    folded = look_table()[cps]
    letter = np.concatenate([[False], folded != SPACE, [False]])
    before, after = letter[:-2], letter[2:]
    for signs, inside in ((DIGITS, before | after), (BEFORE_LETTERS, after), (BETWEEN_LETTERS, before & after)):
        for sign, like in signs.items():
            at = (cps == ord(sign)) & inside
            if at.any():
                folded[at] = ord("i" if like == "l" else like)
    return spaced(folded).tobytes().decode("utf-32-le", "replace")
