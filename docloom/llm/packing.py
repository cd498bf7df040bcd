"""Filling of containers of fixed capacity with whole documents, by sum-of-squares online packing.

Each document goes to the fill level whose choice leaves the least sum of squared counts of partially filled containers,
tracked in an array of levels. Documents above the capacity fill whole containers first; their rest is placed as usual.
Shards of documents are packed independently, so the work is spread and no task holds more than one shard's sizes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_DOCS = 10_000
PLACED_SCHEMA = "used_for string, doc_id long, part int, container string, offset int, n_tokens int"


def _tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path) as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the number of tokens of its whole text (null text: 0), one row for each row; no shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = None
        for pdf in batches:
            encoding = encoding or _tokenizer(tokenizer)
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(sizes, np.int32)})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens int")


def pack(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, part, container, offset, size) of each part of each item, containers numbered from 0.

    Ties go to the fullest level. Items of size 0 join the container in use, or open the first.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, made, current = [], 0, None
    for item, size in enumerate(sizes.tolist()):
        part, left = 0, size
        while left > capacity:
            placed.append((item, part, made, 0, capacity))
            made, part, left = made + 1, part + 1, left - capacity
        if size == 0:
            if current is None:
                current, made = made, made + 1
            placed.append((item, part, current, 0, 0))
            continue
        # Change of the sum of squares for each level h, which holds a container now (or 0: a new one).
        before, after = counts[: capacity - left + 1], counts[left:].copy()
        after[-1] = 0
        change = 2 * (after - before) + 2
        change[-1] = 1 - 2 * before[-1]
        change[0] = 2 * after[0] + 1 if left < capacity else 0
        usable = before > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            container = open_at[level].pop()
            counts[level] -= 1
        else:
            container, made = made, made + 1
        if level + left < capacity:
            open_at[level + left].append(container)
            counts[level + left] += 1
        current = container
        placed.append((item, part, container, level, left))
    return placed


def pack_documents(documents: DataFrame, limits: list[tuple[str, int]], tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The container of every document for each (used_for, capacity) of ``limits``.

    One row for each part of a document: used_for, doc_id, part (0 but for documents above the capacity, which alone are
    split), container (unique within used_for), offset (first token's place in it) and n_tokens. Null and empty texts
    have 0 tokens and share a container; repeated rows are packed each; an empty table gives no rows; other columns are
    ignored. Shards are by hash of doc_id, about ``shard_docs`` documents each, packed in order of doc_id.
    """
    counts = materialize(token_counts(documents, tokenizer))
    shards = max(1, -(-counts.count() // shard_docs))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids, sizes, out = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy(), []
        for used_for, capacity in limits:
            item, part, container, offset, size = (np.array(c, np.int64) for c in zip(*pack(sizes, capacity), strict=True))
            out.append(pd.DataFrame({"used_for": used_for, "doc_id": ids[item], "part": part, "container": [f"{key[0]}-{c}" for c in container], "offset": offset, "n_tokens": size}))
        return pd.concat(out)

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    # One partition a shard, whatever its bytes: adaptive execution would merge shards of few bytes into one task.
    return counts.withColumn("shard", shard).repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(place, PLACED_SCHEMA)
