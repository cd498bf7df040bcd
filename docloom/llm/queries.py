"""Queries on training text and their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.boilerplate import main_text, page_lines
from docloom.llm.leaks import RUN, find_leaks
from docloom.llm.matching import match_records
from docloom.llm.names import author_clusters, spelling_pairs
from docloom.llm.packing import pack_documents
from docloom.llm.quality import text_statistics
from docloom.llm.split import split_oversized
from docloom.tables import table


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "handler_results").where("format = 'html'").select("result_id", "host", F.col("metadata")["title"].alias("title"), F.col("blocks.text").alias("texts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = page_lines(web_pages(spark, sf_dir)).where("NOT main")
    return lines.select("result_id", F.col("block_index").cast("long").alias("block_index"), F.col("line_index").cast("long").alias("line_index")).distinct()


def p4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(web_pages(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("prose_share < 0.5").select("doc_id").distinct()


def limited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and selections with their limits; size_limits has one row for each use."""
    limits = table(spark, sf_dir, "size_limits").where("unit = 'chars'").select(F.col("used_for").alias("item_kind"), "max_size", "overlap")
    results = table(spark, sf_dir, "handler_results")
    blocks = results.select(F.lit("block").alias("item_kind"), F.col("result_id").alias("item_id"), F.posexplode("blocks.text").alias("block_index", "text"))
    selections = table(spark, sf_dir, "selections").select(F.lit("selection").alias("item_kind"), F.col("selection_id").alias("item_id"), F.lit(-1).alias("block_index"), "text")
    items = blocks.unionByName(selections).withColumn("block_index", F.col("block_index").cast("long"))
    return items.join(F.broadcast(limits), "item_kind")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(limited_items(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("pieces > 1").select("item_kind", "item_id", "block_index").distinct()


P2_FOUND_SQL = """
WITH items AS (
  SELECT 'block' AS item_kind, result_id AS item_id, i - 1 AS block_index, blocks[i].text AS text
  FROM (SELECT result_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM handler_results)
  UNION ALL SELECT 'selection', selection_id, -1, text FROM selections)
SELECT DISTINCT item_kind, item_id, CAST(block_index AS BIGINT) AS block_index
FROM items JOIN size_limits ON used_for = item_kind WHERE length(text) > max_size
"""


def pack_limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The pack_* rows of size_limits, a table of settings that does not grow."""
    rows = table(spark, sf_dir, "size_limits").where("unit = 'tokens' AND used_for LIKE 'pack~_%' ESCAPE '~'").collect()
    return sorted((r["used_for"], r["max_size"]) for r in rows)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), pack_limits(spark, sf_dir))


def p6_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    capacity = F.create_map(*[F.lit(x) for limit in pack_limits(spark, sf_dir) for x in limit])
    each = p6_containers(spark, sf_dir).groupBy("used_for", "container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    total = each.groupBy("used_for").agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("n").alias("tokens"))
    return total.withColumn("utilisation", F.col("tokens") / F.col("containers") / F.element_at(capacity, F.col("used_for")))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_clusters(table(spark, sf_dir, "candidates").select(F.explode("authors").alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(p1_clusters(spark, sf_dir))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    cands = table(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), "title", "authors", none("string").alias("author"), F.col("publication_date").alias("date"), "ids")
    sources = table(spark, sf_dir, "sources").select(F.col("source_id").alias("id"), "title", none("array<string>").alias("authors"), F.col("author"), F.col("publication_date").alias("date"), "ids")
    return match_records(cands, sources).withColumnsRenamed({"c_id": "candidate_id", "s_id": "source_id"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).where("confidence >= 0.5").select("candidate_id", "source_id").distinct()


QUERIES = {
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p6_containers": p6_containers,
    "p6_utilisation": p6_utilisation,
    "p8_found": p8_found, "p8_statistics": p8_statistics, "p7_found": p7_found, "p7_leaks": p7_leaks, "p4_found": p4_found, "p4_main_text": p4_main_text}
SQL: dict[str, str] = {"p2_found": P2_FOUND_SQL}
