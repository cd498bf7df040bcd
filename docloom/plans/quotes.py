"""Queries that ground quotes in their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import collapse, once, sentences
from docloom.operators.answers import ground_values
from docloom.operators.grounding import ground_quotes
from docloom.tables import table


def selection_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text, quotes): every sentence of a selection that is not blank, whatever its length, beside the whole text of
    the file that the selection comes from, which is there once for all of them."""
    texts = table(spark, sf_dir, "handler_results").select("result_id", F.array_join("blocks.text", "\n").alias("text"))
    parts = sentences(F.regexp_replace("text", r"\[[^\]\n]*\] ", "\n"))
    numbered = F.transform(parts, lambda q, i: F.struct((F.col("selection_id") * 10000 + i).alias("quote_id"), q.alias("quote")))
    quotes = table(spark, sf_dir, "selections").select("result_id", F.filter(numbered, lambda q: q["quote"] != "").alias("quotes"))
    return quotes.join(texts, "result_id").select(F.col("result_id").alias("text_id"), "text", "quotes")


def quotes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that occur word for word, blanks collapsed and case ignored."""
    check = lambda text: F.transform("quotes", lambda x: F.struct(x["quote_id"].alias("quote_id"), text.contains(F.lower(collapse(x["quote"]))).alias("found")))
    q = selection_quotes(spark, sf_dir).select("text_id", F.inline(once(F.lower(collapse(F.col("text"))), check)))
    return q.select("quote_id", "text_id", "found")


def quotes_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes verbatim, with other spacing, nearly so, or not at all."""
    return ground_quotes(selection_quotes(spark, sf_dir))


def number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all numbers of a quote occur in its text, decimal commas read as points."""
    nums = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), 1), lambda n: F.replace(n, F.lit(","), F.lit("."))))
    check = lambda known: F.transform("quotes", lambda x: F.struct(x["quote_id"].alias("quote_id"), F.size(nums(x["quote"])).cast("long").alias("numbers"), F.size(F.array_except(nums(x["quote"]), known)).cast("long").alias("unsupported")))
    return selection_quotes(spark, sf_dir).select(F.inline(once(nums(F.col("text")), check)))


def answers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made for each file, and what its text bears out: a number with its sentence, a quote that is nowhere, a number
    that is nowhere, and nothing."""
    r = table(spark, sf_dir, "handler_results").select(F.col("result_id").alias("text_id"), F.concat(F.lit("Result number "), "result_id", F.lit(" stands here. "), F.coalesce(F.array_join("blocks.text", "\n"), F.lit(""))).alias("text"))
    said = F.concat(F.lit("Result number "), "text_id", F.lit(" stands here."))
    value = lambda field, v, q: F.struct(F.lit(field).alias("field"), v.alias("value"), q.alias("quote"), F.lit(1.0).alias("confidence"))
    values = F.array(value("stated", F.col("text_id").cast("string"), said), value("quoted", F.lit("x"), F.lit("qqqq zzzz jjjj")), value("counted", F.lit("918273645546372819"), said), value("silent", F.lit("UNKNOWN"), said))
    return ground_values(r.withColumn("values", values)).select("text_id", "field", "value", F.coalesce("reason", F.lit("")).alias("reason"))


QUERIES = {q.__name__: q for q in (quotes_exact, quotes_grounded, number_support, answers_kept)}
_C = lambda c: f"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'))"
_Q = rf"""WITH t AS (SELECT result_id, array_to_string(list_transform(blocks, lambda b: b.text), chr(10)) AS text FROM handler_results),
s AS (SELECT selection_id, result_id, string_split(regexp_replace({_C(r"regexp_replace(text, '\[[^\]\n]*\] ', chr(10), 'g')")}, '([.!?]) +([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM selections),
e AS (SELECT selection_id, result_id, unnest(range(len(parts))) AS pos, unnest(parts) AS quote FROM s),
q AS (SELECT selection_id * 10000 + pos AS quote_id, result_id AS text_id, quote, text FROM e JOIN t USING (result_id) WHERE quote <> '')"""
_N = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)?'), lambda n: replace(n, ',', '.')))"
SQL = {
    "answers_kept": """SELECT result_id AS text_id, unnest(['stated', 'quoted', 'counted', 'silent']) AS field, unnest([CAST(result_id AS VARCHAR), 'UNKNOWN', 'UNKNOWN', 'UNKNOWN']) AS value, unnest(['', 'QUOTE_NOT_FOUND', 'NUMBER_NOT_IN_SOURCE', '']) AS reason FROM handler_results""",
    "quotes_exact": f"{_Q} SELECT quote_id, text_id, contains(lower({_C('text')}), lower({_C('quote')})) AS found FROM q",
    "number_support": f"{_Q} SELECT quote_id, len({_N('quote')}) AS numbers, len(list_filter({_N('quote')}, lambda n: NOT list_contains({_N('text')}, n))) AS unsupported FROM q",
}
