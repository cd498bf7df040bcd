"""Splitting of oversized texts at natural boundaries, with overlap.

Balanced targets: the least number of pieces, targets at equal lengths, each cut snapped to the strongest boundary near
its target, one more piece whenever a limit fails.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_SCHEMA = "item_kind string, item_id long, block_index long, piece_index int, pieces int, start int, end int, overlap int, text string"
# Boundaries by falling strength; a cut may fall where the match ends.
BOUNDARIES = (
    (6, re.compile(r"\n\s*\n\s*")),
    (5, re.compile(r"\n[ \t]*")),
    (4, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”』」]?")),
    (3, re.compile(r"[;:][ \t]+|[；：]")),
    (2, re.compile(r",[ \t]+|[，、]|[ \t][–—-][ \t]")),
    (1, re.compile(r"[ \t 　]+")),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending, and their strengths."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            best[m.end()] = strength
    best.pop(len(text), None)
    at = np.array(sorted(best), np.int64)
    return at, np.array([best[p] for p in at], np.int64)


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a letter from its marks or joiners."""
    return 0 < at < len(text) and bool(unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d" or text[at - 1 : at + 1] == "\r\n")


def _whole(text: str, cut: int, low: int) -> int:
    """``cut``, moved back to where it parts no letter, but not to ``low``."""
    while cut > low + 1 and _joined(text, cut):
        cut -= 1
    return cut


def _strongest(at: np.ndarray, strength: np.ndarray, low: int, high: int, target: float) -> int | None:
    """The strongest boundary in [low, high], the nearest to ``target`` among equals."""
    a, b = np.searchsorted(at, low), np.searchsorted(at, high, "right")
    if a >= b:
        return None
    top = np.flatnonzero(strength[a:b] == strength[a:b].max()) + a
    return int(at[top[np.abs(at[top] - target).argmin()]])


def split_text(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece of ``text`` in code points.

    Every piece has at most ``max_size`` characters; each begins ``overlap`` characters before the end of the one before it,
    or up to a quarter of that later, at a boundary where there is one there; together they cover the text. An overlap of max_size or more counts as
    half of it. A text within the limit is one piece, the empty text none.
    """
    if max_size < 1:
        raise ValueError("max_size must be positive")
    size = len(text)
    if size <= max_size:
        return [(0, size)] if size else []
    overlap = max(0, overlap if overlap < max_size else max_size // 2)
    at, strength = boundaries(text)
    count = -(-(size - overlap) // (max_size - overlap))
    while True:
        length = (size + (count - 1) * overlap) / count
        reach = max((max_size - length) / 2, max_size / 8)
        pieces, start, last = [], 0, 0
        for k in range(1, count):
            target = k * (length - overlap) + overlap
            high = min(start + max_size, int(target + reach), size - 1)
            low = max(last + 1, start + min(overlap, max_size // 4) + 1, int(target - reach))
            cut = _strongest(at, strength, low, high, target) if low <= high else None
            if cut is None:
                cut = _whole(text, min(max(last + 1, int(target)), start + max_size), last)
            pieces.append((start, cut))
            last = cut
            # The next piece begins at the strongest boundary within a quarter of the overlap from where it should.
            back = _strongest(at, np.minimum(strength, 4), max(cut - overlap, start + 1), max(cut - overlap + overlap // 4, start + 1), cut - overlap) if overlap else cut
            if back is None:
                back = max(cut - overlap, start + 1)
                while back < cut and _joined(text, back):
                    back += 1
            start = back
        pieces.append((start, size))
        if size - start <= max_size and last < size and all(a < b for a, b in pieces):
            return pieces
        count += 1
        if count > size:  # cuts one by one always satisfy the limits
            return [(k, min(k + max_size, size)) for k in range(0, size, max_size)]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            spans = split_text(r.text, int(r.max_size), int(r.overlap))
            last = 0
            for k, (a, b) in enumerate(spans):
                rows.append((r.item_kind, r.item_id, r.block_index, k, len(spans), a, b, max(0, last - a), r.text[a:b]))
                last = b
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])


def split_oversized(items: DataFrame) -> DataFrame:
    """Ordered pieces of every item that exceeds its limit.

    ``items``: item_kind, item_id, block_index, text, max_size, overlap; other columns are ignored. Items within the limit,
    null texts and items without a limit give no rows; repeated items are split each; an empty table gives none. start and
    end count code points of the item's text, overlap those shared with the piece before. Only oversized texts reach
    Python, and nothing is shuffled.
    """
    long = items.where("length(text) > max_size").select("item_kind", "item_id", "block_index", "text", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return long.mapInPandas(_split, PIECE_SCHEMA)
