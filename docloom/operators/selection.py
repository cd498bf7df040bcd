"""Choice of text blocks for a reader under a budget of characters, as built-in expressions on each row's own array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import once

# Blocks taken whatever they say, characters that a further block's label costs, and the length at which a
# block's keywords count half.
KEPT_FIRST, LABEL_CHARS, HALF_LENGTH = 2, 16, 2000


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How often the keywords occur in ``text``, case ignored, overlapping ones by the first in the list."""
    wanted = "|".join(rf"\Q{k}\E" for k in keywords)
    return F.regexp_count(text, F.lit(f"(?iu)(?:{wanted})")) if keywords else F.lit(0)


def chosen_blocks(texts: Column, keywords: list[str], budget: int) -> Column:
    """Ascending positions of the blocks that are taken.

    Blank blocks are never taken. The others compete by keyword density in a fold over the array sorted by density: one
    that no longer fits is passed over, and what follows may still fit. Ties keep the document's order.
    """
    some = F.coalesce(texts, F.array().cast("array<string>"))
    solid = F.filter(F.transform(some, lambda t, i: F.struct(i.alias("at"), t.alias("text"))), lambda b: F.trim(F.regexp_replace(b["text"], r"\s+", " ")) != "")
    sized = F.transform(solid, lambda b: F.struct(b["at"].alias("at"), F.length(b["text"]).alias("chars"), keyword_hits(b["text"], keywords).alias("hits")))
    return once(sized, lambda blocks: _fold(blocks, budget))


def _fold(sized: Column, budget: int) -> Column:
    first = F.slice(sized, 1, KEPT_FIRST)
    rest = F.filter(F.slice(sized, KEPT_FIRST + 1, 1 << 30), lambda b: b["hits"] > 0)
    ranked = F.array_sort(F.transform(rest, lambda b: F.struct((-b["hits"] * HALF_LENGTH / (HALF_LENGTH + b["chars"])).alias("rank"), b["at"].alias("at"), b["chars"].alias("chars"))))
    begun = F.struct(F.aggregate(first, F.lit(0), lambda n, b: n + b["chars"]).alias("used"), F.transform(first, lambda b: b["at"]).alias("taken"))

    def take(state: Column, b: Column) -> Column:
        used = state["used"] + b["chars"] + LABEL_CHARS
        return F.when(used <= budget, F.struct(used.alias("used"), F.array_append(state["taken"], b["at"]).alias("taken"))).otherwise(state)

    return F.array_sort(F.aggregate(ranked, begun, take)["taken"])


def select_relevant(df: DataFrame, key: str, texts: str, keywords: list[str], budget: int) -> DataFrame:
    """(key, chosen: array<int>, n_blocks, chars): the blocks of each row chosen by ``chosen_blocks``.

    ``texts`` is an array<string>; null arrays count as empty and give an empty choice, as do arrays of null or blank
    texts; repeated rows are judged each; an empty table gives no rows; other columns are ignored. No shuffle and no
    Python, since every file is one row.
    """
    some = F.coalesce(F.col(texts), F.array().cast("array<string>"))
    rows = df.select(F.col(key), some.alias("texts")).withColumn("picked", chosen_blocks(F.col("texts"), keywords, budget))
    chars = F.aggregate("picked", F.lit(0), lambda n, i: n + F.length(F.get("texts", i)))
    return rows.select(key, F.col("picked").alias("chosen"), F.size("texts").alias("n_blocks"), chars.alias("chars"))
