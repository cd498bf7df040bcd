"""Queries on documents: sentences, signals, fingerprints, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import NOT_DONE, OWN_WORK, REFERENCE_LIST, SIGNALS, STOP_WORDS, bounded, collapse, glued_share, sentences, signals_of, without_references, word_set
from docloom.operators.dedupe import classify_duplicates
from docloom.sources.payloads import abstract_of_index
from docloom.tables import materialize, table


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 20 to 400 characters with their position, those of a list of references left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(without_references(F.col("text")))).alias("pos", "sentence"))
    return docs.where(F.length("sentence").between(20, 400))


def doc_sentence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of each signal in which a document speaks of its own work."""
    own = doc_sentences(spark, sf_dir).where(F.lower("sentence").rlike(bounded(OWN_WORK)) & ~F.lower("sentence").rlike(bounded(NOT_DONE)))
    hits = own.select("doc_id", "pos", "sentence", F.explode(signals_of(F.col("sentence"), SIGNALS)).alias("signal"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "signal").orderBy("pos"))
    return hits.withColumn("rank", rank).where("rank <= 3").select("doc_id", "signal", F.col("rank").cast("long").alias("rank"), "sentence")


def doc_signal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of whole texts against those of own-work sentences: union, intersection and difference."""
    own = doc_sentence_signals(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("signal")).alias("own"))
    text = table(spark, sf_dir, "documents").select("doc_id", signals_of(collapse(F.col("text")), SIGNALS).alias("said"))
    both = text.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    names = lambda c: F.array_join(F.array_sort(c), ",")
    both = both.select("doc_id", names(F.array_union("said", "own")).alias("any_signal"), names(F.array_intersect("said", "own")).alias("own_signal"), names(F.array_except("said", "own")).alias("only_said"))
    return both.where("any_signal <> ''")


def doc_token_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", word_set(F.col("text")).alias("words"))
    return keyed.select("doc_id", F.sha2("words", 256).alias("fingerprint"), F.length("words").cast("long").alias("key_length"))


def doc_dedupe_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUPLICATE of the first document of the same words, VARIANT of the first with the same words once their digits are
    dropped, or NEW; the keys are made of the whole text."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", word_set(F.col("text")).alias("words"))
    core = F.trim(F.regexp_replace(F.regexp_replace("words", "[0-9]+", ""), " +", " "))
    docs = keyed.select("doc_id", F.sha2("words", 256).alias("full"), F.when(core != "", F.sha2(core, 256)).alias("core"))
    classes = classify_duplicates(materialize(docs), "doc_id", "full", "core")  # the keys are used three times
    return classes.select("doc_id", "class", F.coalesce("matched_id", F.lit(-1)).alias("matched_id"))


def doc_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier document came from the same source: the first id of each key instead of a self join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "source").select("doc_id", "first_id", (F.col("doc_id") > F.col("first_id")).alias("overlaps"))


def doc_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted counts of distinct indicators, timing words and thresholds, at most 100."""
    low = F.lower("text")
    kinds = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(momentum|volatility|volume|sentiment|carry|basis)"), 1)))
    timing = F.size(F.regexp_extract_all(low, F.lit(r"(monthly|weekly|daily|overnight|intraday)"), 1))
    bounds = F.size(F.regexp_extract_all(low, F.lit(r"(above|below|crosses|threshold)"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", kinds.cast("long").alias("indicators"), timing.cast("long").alias("timing"), bounds.cast("long").alias("thresholds"), F.least(F.lit(100), kinds * 12 + timing * 10 + bounds * 6).cast("long").alias("complexity"))


def doc_glued_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(glued_share(F.col("text")), 6).alias("glued_share"))


def doc_rebuilt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text from an inverted index of word positions, as catalogues ship abstracts. The texts move once, by document; both
    steps that build the index keep that partitioning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select("doc_id", F.posexplode(F.split(collapse(F.col("text")), " ")).alias("pos", "word"))
    places = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at"))
    index = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", F.sha2(abstract_of_index(F.col("index")), 256).alias("text_hash"))


def doc_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text."""
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return docs.where("copies > 1")


def doc_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each document and whether its annotators agree; unlabelled documents are kept."""
    labels = table(spark, sf_dir, "doc_labels").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.count_distinct("label").alias("kinds"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count("labels").alias("labelled"), F.count_if(F.col("kinds") > 1).alias("disputed"))


QUERIES = {q.__name__: q for q in (doc_sentences, doc_sentence_signals, doc_signal_sets, doc_token_fingerprint, doc_dedupe_class, doc_source_overlap, doc_complexity, doc_glued_share, doc_rebuilt_text, doc_exact_copies, doc_label_agreement)}

_COLLAPSED = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"
_BODY = f"regexp_split_to_array(text, '{REFERENCE_LIST}')[1],"
_SENTENCES = rf"""
sentences AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS sentence FROM (
  SELECT doc_id, string_split(regexp_replace({_COLLAPSED.replace("text,", _BODY)}, '([.!?]) +([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents)),
kept AS (SELECT * FROM sentences WHERE length(sentence) BETWEEN 20 AND 400)"""
_LEXICON = " UNION ALL ".join(f"SELECT '{n}' AS signal, '{rx}' AS rx" for n, rx in SIGNALS.items())
_HITS = rf"""{_SENTENCES},
lexicon AS ({_LEXICON}),
hits AS (SELECT doc_id, signal, sentence, row_number() OVER (PARTITION BY doc_id, signal ORDER BY pos) AS rank FROM kept, lexicon
  WHERE regexp_matches(lower(sentence), '{OWN_WORK}') AND NOT regexp_matches(lower(sentence), '{NOT_DONE}') AND regexp_matches(lower(sentence), rx))"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOPS})))), ' ')"
_COUNT = lambda rx: f"len(regexp_extract_all(lower(text), '{rx}'))"
SQL = {
    "doc_sentences": f"WITH {_SENTENCES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM kept",
    "doc_sentence_signals": f"WITH {_HITS} SELECT doc_id, signal, rank, sentence FROM hits WHERE rank <= 3",
    "doc_signal_sets": f"""WITH {_HITS},
own AS (SELECT doc_id, list(DISTINCT signal) AS own FROM hits WHERE rank <= 3 GROUP BY doc_id),
said AS (SELECT doc_id, list(signal) AS said FROM documents, lexicon WHERE regexp_matches(lower({_COLLAPSED}), rx) GROUP BY doc_id),
pair AS (SELECT doc_id, coalesce(said, []) AS said, coalesce(own, []) AS own FROM said FULL JOIN own USING (doc_id))
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(said, own))), ',') AS any_signal,
  array_to_string(list_sort(list_intersect(said, own)), ',') AS own_signal,
  array_to_string(list_sort(list_filter(said, lambda x: NOT list_contains(own, x))), ',') AS only_said FROM pair""",
    "doc_token_fingerprint": f"SELECT doc_id, sha256({_WORDS}) AS fingerprint, length({_WORDS}) AS key_length FROM documents",
    "doc_dedupe_class": f"""WITH k AS (SELECT doc_id, f, trim(regexp_replace(regexp_replace(f, '[0-9]+', '', 'g'), ' +', ' ', 'g')) AS c FROM (SELECT doc_id, {_WORDS} AS f FROM documents)),
w AS (SELECT doc_id, c, min(doc_id) OVER (PARTITION BY f) AS df, min(doc_id) OVER (PARTITION BY c) AS dc FROM k)
SELECT doc_id, CASE WHEN df < doc_id THEN 'DUPLICATE' WHEN c <> '' AND dc < doc_id THEN 'VARIANT' ELSE 'NEW' END AS class,
  CASE WHEN df < doc_id THEN df WHEN c <> '' AND dc < doc_id THEN dc ELSE -1 END AS matched_id FROM w""",
    "doc_source_overlap": "SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY source) AS overlaps FROM documents WHERE source IS NOT NULL",
    "doc_complexity": f"""SELECT doc_id, k AS indicators, t AS timing, b AS thresholds, least(100, k * 12 + t * 10 + b * 6) AS complexity FROM (
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), 'momentum|volatility|volume|sentiment|carry|basis'))) AS k,
  {_COUNT('monthly|weekly|daily|overnight|intraday')} AS t, {_COUNT('above|below|crosses|threshold')} AS b FROM documents)""",
    "doc_glued_share": """SELECT doc_id, round(CASE WHEN a > 0 THEN g / a ELSE 0.0 END, 6) AS glued_share FROM (
SELECT doc_id, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS a,
  coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) > 24), lambda x: length(x))), 0)::DOUBLE AS g
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents))""",
    "doc_rebuilt_text": f"SELECT doc_id, sha256({_COLLAPSED}) AS text_hash FROM documents",
    "doc_exact_copies": "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_label_agreement": """SELECT source, count(*) AS documents, count(labels) AS labelled, count(*) FILTER (WHERE kinds > 1) AS disputed FROM documents
LEFT JOIN (SELECT doc_id, count(label) AS labels, count(DISTINCT label) AS kinds FROM doc_labels GROUP BY doc_id) USING (doc_id) GROUP BY source""",
}
