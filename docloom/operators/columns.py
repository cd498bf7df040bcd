"""Reading order of pages whose words come with their places: two columns are read one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "array<struct<text:string,x0:double,x1:double,top:double>>"
READ_SCHEMA = "page_id long, gutter double, text string"
# The least words of a page; the widest word as a share of the page; where the gutter may begin; its least width;
# how many words may cross it, at least and as a share; the least share of words on either side; the height of a line; how many
# words are worked on at once.
LEAST_WORDS, WIDEST, FROM, TO, LEAST_GAP, CROSSING, CROSSING_SHARE, SIDE_SHARE, LINE, PORTION = 40, 0.28, 0.28, 0.72, 10.0, 3, 0.02, 0.25, 3.0, 500_000


def gutter_of(x0: np.ndarray, x1: np.ndarray, width: float) -> float | None:
    """The middle of the widest gap between two columns of words, None for a page of one column."""
    n = len(x0)
    if n < LEAST_WORDS or (x1 - x0).max() > WIDEST * width:
        return None
    edges = np.sort(np.concatenate([(0.0, width), np.minimum(np.maximum(x0, 0.0), width), np.minimum(np.maximum(x1, 0.0), width)]))
    begin, end = edges[:-1], edges[1:]
    wide = np.flatnonzero((end - begin >= LEAST_GAP) & (begin >= FROM * width) & (begin <= TO * width))
    begin, end = begin[wide], end[wide]
    ended = np.searchsorted(np.sort(x1), begin, "right")  # words that end before the gap
    behind = n - np.searchsorted(np.sort(x0), end, "left")  # words that begin behind it
    fits = (n - ended - behind <= max(CROSSING, CROSSING_SHARE * n)) & (np.minimum(ended, behind) >= SIDE_SHARE * n)
    if not fits.any():
        return None
    at = int(np.argmax(np.where(fits, end - begin, -1.0)))
    return float(begin[at] + end[at]) / 2


def reading_order(page: np.ndarray, width: np.ndarray, x0: np.ndarray, x1: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float | None]]:
    """(places of the words in reading order, whether each begins a line, the gutter of each page). ``page``: where the words of
    each page begin, and their number at last. A line begins where a word stands more than LINE below the one before."""
    gutters = [gutter_of(x0[a:b], x1[a:b], w) if b > a else None for a, b, w in zip(page[:-1].tolist(), page[1:].tolist(), width.tolist(), strict=True)]
    gutter = np.repeat(np.array([np.inf if g is None else g for g in gutters]), np.diff(page))
    # Words left of the gutter, right of it, and those that cross it.
    part = 3 * np.repeat(np.arange(len(gutters)), np.diff(page)) + np.where(x1 <= gutter, 0, np.where(x0 >= gutter, 1, 2))
    order = np.lexsort((x0, top, part))
    part, top, begins = part[order], top[order], np.ones(len(order), bool)
    begins[1:] = (part[1:] != part[:-1]) | (top[1:] - top[:-1] > LINE)
    return order, begins, gutters


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Pages are taken in portions of some number of words, so that a batch of long pages needs no more memory than its own.
        sizes = pc.fill_null(pc.list_value_length(batch.column("text")), 0).to_numpy()
        portion = (np.cumsum(sizes, dtype=np.int64) - sizes) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            text, *places = (part.column(c).flatten() for c in ("text", "x0", "x1", "top"))
            places = [pc.fill_null(p, np.nan).to_numpy(zero_copy_only=False) for p in places]
            known = text.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(places).any(axis=0)
            page = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes[a:b])])]
            width = pc.fill_null(part.column("width"), 0.0).to_numpy()
            order, begins, gutters = reading_order(page, width, *(p[known] for p in places))
            at = np.append(np.flatnonzero(begins), len(begins))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), text.filter(pa.array(known)).take(pa.array(order))), " ")
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, page), pa.int32()), lines), "\n")
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(gutters, pa.float64()), texts], ["page_id", "gutter", "text"])


def read_pages(pages: DataFrame) -> DataFrame:
    """Text of each page in reading order: READ_SCHEMA; gutter is null for pages of one column.

    ``pages``: page_id, width, words (WORDS). On a page of two columns words that cross the gutter are read last. Null or
    empty words give an empty text; repeated pages are read each; an empty table gives no rows; other columns are ignored.
    """
    columns = [F.col(f"words.{c}").cast(f"array<{kind}>").alias(c) for c, kind in (("text", "string"), ("x0", "double"), ("x1", "double"), ("top", "double"))]
    return pages.select(F.col("page_id").cast("long"), F.col("width").cast("double"), *columns).mapInArrow(_read, READ_SCHEMA)
