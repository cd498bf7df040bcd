"""Evaluation texts leaking into training text.

Rare n-gram seeds join corpus passages to test items, then Smith-Waterman alignment scores the copy. From every window
of ``run`` words of an item the seed is the n-gram that is rarest in the corpus, so any copied run of that length holds
a seed, and frequent phrases rarely are one; rare n-grams are seeds wherever they stand, so that copies with changed words
hold some too. Two filters of fixed size keep the corpus from being shuffled: only n-grams of the items leave a document,
and of the texts only those with seeds move; the joins behind them are exact whatever they let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.words import WordIds, gram_hashes, ids, words
from docloom.tables import materialize, written

N, RUN, FILTER_BITS = 6, 12, 1 << 23
# A seed anywhere: an n-gram at no more than this share of the corpus's documents; and how many of an edited copy's seeds
# must agree. From this share of an item's own score on, a document is reported whatever its longest run.
RARE_SHARE, LEAST_SEEDS, EDITED_SHARE = 0.01, 2, 0.5
HIT_SCHEMA = "doc_id long, pos int, gram long"
LEAK_SCHEMA = "doc_id long, item_id long, score double, item_share double, longest_run int, doc_word int"


def _grams(batches: Iterator[pd.DataFrame], key: str, n: int, bits: np.ndarray | None) -> Iterator[pd.DataFrame]:
    known = WordIds()
    for pdf in batches:
        keys, places, found = [], [], []
        for doc, text in zip(pdf[key], pdf["text"], strict=True):
            if not text:
                continue
            h = gram_hashes(ids(words(text), known), n)
            at = np.arange(len(h), dtype=np.int32)
            if bits is not None and len(h):
                slot = h % np.uint64(len(bits) * 8)
                keep = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                h, at = h[keep == 1], at[keep == 1]
            if len(h):
                keys.append(np.full(len(h), doc, np.int64))
                places.append(at)
                found.append(h.view(np.int64))
        if keys:
            yield pd.DataFrame({key: np.concatenate(keys), "pos": np.concatenate(places), "gram": np.concatenate(found)})


def _filter_of(grams: DataFrame, nbits: int, spread: bool = False) -> np.ndarray:
    """A bitmap of the grams, or of other numbers, spread out first; each of at most 8 tasks sends one of ``nbits`` bits,
    whatever the number of grams."""

    def bitmap(batches):
        own = np.zeros(nbits // 8, np.uint8)
        for pdf in batches:
            slot = pdf["gram"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 if spread else 1) % np.uint64(nbits)
            np.bitwise_or.at(own, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [own.tobytes()]})

    out = np.zeros(nbits // 8, np.uint8)
    for row in grams.select("gram").coalesce(8).mapInPandas(bitmap, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _let_through(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = batch.column("doc_id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(len(bits) * 8)
        keep = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        yield batch.filter(pa.array(keep == 1))


def align(doc: np.ndarray, item: np.ndarray, match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> tuple[float, int, int]:
    """Smith-Waterman over word ids: the best local score, the longest run of equal words, and where that run ends."""
    n = len(doc)
    steps = -gap * np.arange(n + 1)
    row, run = np.zeros(n + 1), np.zeros(n + 1, np.int32)
    best, longest, at = 0.0, 0, 0
    for w in item:
        same = doc == w
        new = np.zeros(n + 1)
        np.maximum(row[:-1] + np.where(same, match, mismatch), row[1:] + gap, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        nxt = np.zeros(n + 1, np.int32)
        nxt[1:] = np.where(same, run[:-1] + 1, 0)
        run = nxt
        best = max(best, float(row.max()))
        if (top := int(run.max())) > longest:
            longest, at = top, int(run.argmax())
    return best, longest, at


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, items = WordIds(), {}
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            doc = ids(words(r.text), known)
            for s in r.seeds:
                item_id = s["item_id"]
                if item_id not in items:
                    if len(items) > 20_000:
                        items.clear()
                    items[item_id] = ids(words(s["item_text"]), known)
                item = items[item_id]
                spans: list[list[int]] = []
                for pos, ipos in sorted((p["pos"], p["ipos"]) for p in s["places"]):
                    a, b = max(0, pos - ipos - 8), min(len(doc), pos - ipos + len(item) + 8)
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                score, longest, at = 0.0, 0, 0
                for a, b in spans:
                    sc, lo, en = align(doc[a:b], item)
                    score = max(score, sc)
                    if lo > longest:
                        longest, at = lo, a + en - lo
                rows.append((r.doc_id, item_id, score, score / (2 * len(item)), longest, at))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "item_share", "longest_run", "doc_word"])


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, n: int = N, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Documents that share at least ``run`` consecutive words with an item, or align with it by at least half of its own
    score, as a copy does of which every tenth word is another.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored. Columns out: doc_id, item_id, score
    (2 a word matched, -1 a word changed, added or left out), item_share (score against the whole item's), longest_run,
    doc_word (where that run starts). One row for each pair, also where rows are repeated or a passage occurs twice. Null
    or empty texts and items shorter than ``run`` give no rows, as do empty tables. Whole texts are read whatever their
    length; alignment is limited to the stretch of the document that a seed allows for the item.
    """
    if run < n:
        raise ValueError("run must be at least n")
    send = documents.sparkSession.sparkContext.broadcast
    items = items.select("item_id", "text").where("text IS NOT NULL").dropDuplicates(["item_id"])
    item_grams = items.mapInPandas(lambda b: _grams(b, "item_id", n, None), "item_id long, pos int, gram long")
    bits = send(_filter_of(item_grams, filter_bits))
    docs = documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    hits = materialize(docs.mapInPandas(lambda b: _grams(b, "doc_id", n, bits.value), HIT_SCHEMA))
    counts = hits.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = item_grams.join(counts, "gram", "left").select("item_id", "pos", "gram", F.coalesce("df", F.lit(0)).alias("df"))
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, run - n)
    windows = ranked.withColumns({"best": F.min(F.struct("df", "pos", "gram")).over(ahead), "width": F.count("*").over(ahead), "grams": F.count("*").over(Window.partitionBy("item_id"))})
    whole = windows.where((F.col("width") == run - n + 1) & (F.col("best.df") > 0)).select("item_id", F.col("best.pos").alias("ipos"), F.col("best.gram").alias("gram"), F.lit(True).alias("whole"))
    seldom = F.col("df").between(1, max(1, int(RARE_SHARE * docs.count())))
    rare = windows.where(seldom & (F.col("grams") > run - n)).select("item_id", F.col("pos").alias("ipos"), "gram", F.lit(False).alias("whole"))
    # The seeds are a table of known size, so that they are sent to the hits if they are few.
    seeds = written(whole.unionByName(rare).groupBy("item_id", "ipos", "gram").agg(F.max("whole").alias("whole")))
    pairs = hits.join(seeds, "gram").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("pos", "ipos")).alias("places"), F.max("whole").alias("whole"))
    pairs = pairs.where(F.col("whole") | (F.size("places") >= LEAST_SEEDS)).select("doc_id", "item_id", "places")
    by_doc = written(pairs.join(items.withColumnRenamed("text", "item_text"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "places")).alias("seeds")))
    wanted = send(_filter_of(by_doc.select(F.col("doc_id").alias("gram")), filter_bits, True))
    passages = docs.mapInArrow(lambda b: _let_through(b, wanted.value), "doc_id long, text string").join(by_doc, "doc_id")
    kept = passages.mapInPandas(_verify, LEAK_SCHEMA).where((F.col("longest_run") >= run) | (F.col("item_share") >= EDITED_SHARE))
    return kept.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("item_share").alias("item_share"), F.max("longest_run").alias("longest_run"), F.min("doc_word").alias("doc_word")
    )
