"""Words of a text in a form that ignores case, punctuation, line breaks, quoting marks and look-alike characters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

# Characters that look like Latin letters, and the hyphens; both sides have equal length.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝвкмнтАВЕЗКМНОРСТУХІЈЅԌαοερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ" + "‐‑‒–−﹣－" + "’‘ʼ´`＇",
    "aeopcyxijsdhqwbkmhtABE3KMHOPCTYXIJSGaoepvikTuxABEZHIKMNOPTYXil" + "-" * 7 + "'" * 6,
)
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
INSIDE = re.compile(r"[-'](?<=[^\W_].)(?:(?<=-)[ \t]*\r?\n[ \t>|*]*)?(?=[^\W_])")  # begins with its sign, which is quick to look for
BETWEEN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
WORD = re.compile(r"[^\W_]+")


FLAT = {**LOOKALIKES, **INVISIBLE, ord("İ"): "I"}


class Unmarked(dict):
    """Words without their letters' marks, remembered up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        return self[word]


UNMARKED = Unmarked()


def words(text: str) -> list[str]:
    """Words of ``text``; a hyphenated compound, also one broken at a line end, is one word."""
    if text.isascii():
        return INSIDE.sub("", text.lower()).encode().translate(BETWEEN).decode().split()
    text = text.translate(FLAT)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text).translate(FLAT)
    return [w if w.isascii() else UNMARKED[w] for w in WORD.findall(INSIDE.sub("", text.lower()))]


class WordIds(dict):
    """64-bit ids of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ids(tokens: list[str], known: WordIds) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, by position."""
    size = len(tokens) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + size]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)
