"""Queries on searches and on what is written about records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.classify import ASSET_WORDS, FILLER, FINANCE_WORDS, MODES, RED_FLAGS, REGIME_WORDS, about_finance, official_api, red_flags, request_parts
from docloom.functions.url import host_of
from docloom.functions.web import access_barrier, markdown, query_hash, query_key, redacted, request_class, safe_name, title_of_url
from docloom.operators.search import follow_up_queries, reading_order, title_search
from docloom.tables import table

SEARCHES = ("overnight repo collar", "volatility notes", "hidden queue in freight derivatives", "momentum timing with thin orders")
TEMPLATES = ["{} evidence", "{} after costs", "{} out of sample", "{} replication", "{} survey"]


def title_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best sources of each search by matched title words (a top-k report)."""
    items = table(spark, sf_dir, "sources").select(F.col("source_id").alias("item_id"), "title")
    return title_search(items, spark.createDataFrame([(s,) for s in SEARCHES], "query string"), 10)


def next_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches to ask next, by the venues most found, without those asked already."""
    c = table(spark, sf_dir, "candidates").where("venue IS NOT NULL AND venue <> 'UNKNOWN'")
    families = c.groupBy(F.col("venue").alias("family")).agg(F.count_distinct("candidate_id").alias("n"), F.min("candidate_id").alias("first_seen"))
    asked = c.groupBy("venue").agg(F.count_distinct("candidate_id").alias("n")).where("n % 2 = 0").select(F.concat(F.lower("venue"), F.lit(" EVIDENCE")).alias("query"))
    return follow_up_queries(families, TEMPLATES, asked, 20).select("query")


def query_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as searches, the same words hashed alike whatever their case and punctuation."""
    c = table(spark, sf_dir, "candidates").where("title IS NOT NULL").select("connector", query_key(F.col("title")).alias("words"), query_hash(F.col("connector"), F.col("title")).alias("hash"))
    return c.groupBy("connector", "hash").agg(F.min("words").alias("words"), F.count("*").alias("asked"))


def reading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 sources to read first: those of refusing hosts last, free ones first, then relevance and tier."""
    s = table(spark, sf_dir, "sources").withColumn("host", host_of("canonical_url"))
    refused = s.groupBy("host").agg(F.count_if(F.col("access_status") == "ACCESS_RESTRICTED").alias("no"), F.count_if(F.col("access_status") == "OK").alias("yes")).where("no > yes")
    relevance = F.aggregate(F.array(*map(F.lit, ("volatility", "momentum", "carry", "costs", "spreads"))), F.lit(0), lambda a, t: a + F.lower("title").contains(t).cast("int"))
    free = F.col("license").rlike("^CC|public") | (F.col("format") == "pdf")
    return reading_order(s.select("source_id", "host", free.alias("free"), relevance.cast("long").alias("relevance"), F.coalesce("tier", F.lit(9)).alias("tier")), refused, 100)


def page_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barriers and request classes of sources, with a status made from their access."""
    s = table(spark, sf_dir, "sources")
    status = F.when(F.col("access_status") == "OK", 200).when(F.col("access_status") == "PAYWALLED", 402).when(F.col("access_status") == "ACCESS_RESTRICTED", 403).otherwise(500)
    barrier = access_barrier(status, F.col("url"), F.col("canonical_url"), F.col("title"))
    kind = request_class(F.col("url"), F.lit(None).cast("map<string,string>"), F.when(F.col("format") == "pdf", "application/pdf").when(F.col("format") == "html", "text/html").otherwise("image/png"))
    return s.groupBy(F.coalesce(barrier, F.lit("OPEN")).alias("barrier"), kind.alias("request_class")).agg(F.count("*").alias("n"))


def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").where("url IS NOT NULL").select("candidate_id", title_of_url(F.col("url")).alias("title")).distinct()


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped titles and file names of sources."""
    return table(spark, sf_dir, "sources").select("source_id", markdown(F.col("title")).alias("heading"), safe_name(F.col("title")).alias("file"), redacted(F.col("author")).alias("author"))


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the promises that they make, and whether they are about finance at all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(red_flags(F.col("text")), ",").alias("flags"), about_finance(F.col("text")).alias("finance"))
    return d.groupBy("flags", "finance").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def request_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of sources as requests: what they ask for, and what is left without filling words."""
    s = table(spark, sf_dir, "sources").where("title IS NOT NULL").select("source_id", request_parts(F.col("title")).alias("r"))
    return s.select("source_id", F.array_join("r.assets", ",").alias("assets"), F.array_join("r.regimes", ",").alias("regimes"), "r.mode", "r.core")


def listed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for candidates that go to listed addresses of the test sites."""
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    hit = official_api(host_of("url"), path, [("www.northbrief.invalid", "/")], [("www.riverbrief.example", "/abs/"), ("blog.meadowgazette.example", "/p/")])
    return table(spark, sf_dir, "candidates").groupBy(hit.alias("listed")).agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (document_flags, request_specs, listed_requests, title_search_top, next_searches, query_hashes, reading_list, page_access, url_titles, source_notes)}
_STOP = "'the','a','an','of','and','or','with','on','in','to','for','by','is','are','when','if','its','their','than','that','each','at','be'"
_W = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})))"
_ASKED = ", ".join(f"('{s}')" for s in SEARCHES)
_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim(canonical_url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.$', ''), '')"
_KEY = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
_TEMPLATES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEMPLATES))
_FLAGS = " UNION ALL ".join(f"SELECT '{n}' AS flag, '{rx}' AS rx" for n, rx in RED_FLAGS.items())
_LISTED = lambda words: "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(title), '{rx}') THEN '{n}' END" for n, rx in words.items()) + "] IF x IS NOT NULL], ',')"
_BARE = r"regexp_replace({0}, '(?i)([^\w-])(?:" + FILLER + r")([^\w-])', '\1 \2', 'g')"
SQL = {
    "document_flags": f"""WITH f AS ({_FLAGS}), h AS (SELECT doc_id, string_agg(flag, ',' ORDER BY flag) AS flags FROM documents, f WHERE regexp_matches(lower(coalesce(text, '')), rx) GROUP BY 1)
SELECT coalesce(flags, '') AS flags, regexp_matches(lower(coalesce(text, '')), '{FINANCE_WORDS}') AS finance, count(*) AS n, min(doc_id) AS first_id FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1, 2""",
    "request_specs": f"""SELECT source_id, {_LISTED(ASSET_WORDS)} AS assets, {_LISTED(REGIME_WORDS)} AS regimes, coalesce({", ".join(f"CASE WHEN regexp_matches(lower(title), '{rx}') THEN '{n}' END" for n, rx in MODES.items())}, 'QUICK_DISCOVERY') AS mode,
trim(regexp_replace({_BARE.format(_BARE.format("' ' || title || ' '"))}, '\\s+', ' ', 'g')) AS core FROM sources WHERE title IS NOT NULL""",
    "listed_requests": r"""WITH c AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM candidates)
SELECT coalesce((h = 'www.northbrief.invalid' AND p = '/') OR (h = 'www.riverbrief.example' AND starts_with(p, '/abs/')) OR (h = 'blog.meadowgazette.example' AND starts_with(p, '/p/')), false) AS listed, count(*) AS n FROM c GROUP BY 1""",
    "title_search_top": f"""WITH q AS (SELECT query, unnest({_W('query')}) AS word, len({_W('query')}) AS n FROM (VALUES {_ASKED}) v(query)), i AS (SELECT source_id AS item_id, unnest({_W('title')}) AS word FROM sources),
h AS (SELECT query, n, item_id, count(DISTINCT word) AS hits FROM q JOIN i USING (word) GROUP BY ALL HAVING count(DISTINCT word) >= least(2, n))
SELECT query, item_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, item_id) AS k FROM h) WHERE k <= 10""",
    "next_searches": f"""WITH f AS (SELECT venue, count(DISTINCT candidate_id) AS n, min(candidate_id) AS s FROM candidates WHERE venue IS NOT NULL AND venue <> 'UNKNOWN' GROUP BY venue),
b AS (SELECT venue, row_number() OVER (ORDER BY n DESC, s, venue) AS place FROM f QUALIFY place <= 20), m AS (SELECT place, t, replace(template, '{{}}', lower(venue)) AS query FROM b, (VALUES {_TEMPLATES}) v(t, template)),
o AS (SELECT {_KEY('query')} AS k, arg_min(query, (place, t)) AS query, min((place, t)) AS pos FROM m GROUP BY 1)
SELECT query FROM o WHERE k NOT IN (SELECT {_KEY("lower(venue) || ' evidence'")} FROM f WHERE n % 2 = 0) ORDER BY pos LIMIT 20""",
    "query_hashes": f"SELECT connector, sha256(connector || '|' || {_KEY('title')}) AS hash, min({_KEY('title')}) AS words, count(*) AS asked FROM candidates WHERE title IS NOT NULL GROUP BY 1, 2",
    "reading_list": f"""WITH s AS (SELECT *, {_HOST} AS host FROM sources), r AS (SELECT host FROM s WHERE host IS NOT NULL GROUP BY host HAVING count(*) FILTER (WHERE access_status = 'ACCESS_RESTRICTED') > count(*) FILTER (WHERE access_status = 'OK')),
k AS (SELECT source_id, CASE WHEN host IN (SELECT host FROM r) THEN 2 WHEN regexp_matches(license, '^CC|public') OR format = 'pdf' THEN 0 ELSE 1 END AS access,
 (contains(lower(title), 'volatility')::INT + contains(lower(title), 'momentum')::INT + contains(lower(title), 'carry')::INT + contains(lower(title), 'costs')::INT + contains(lower(title), 'spreads')::INT)::BIGINT AS relevance, tier FROM s)
SELECT source_id, access::BIGINT AS access, relevance, coalesce(tier, 9) AS tier FROM k ORDER BY k.access, relevance DESC, coalesce(k.tier, 9), source_id LIMIT 100""",
    "page_access": r"""SELECT barrier, request_class, count(*) AS n FROM (SELECT CASE WHEN access_status = 'PAYWALLED' THEN 'PAYWALLED' WHEN regexp_matches(title, '(?i)captcha|are you a robot|verify you are human|unusual traffic') THEN 'MANUAL_ACCESS_REQUIRED'
WHEN access_status = 'ACCESS_RESTRICTED' THEN 'ACCESS_RESTRICTED' WHEN url <> canonical_url AND regexp_matches(regexp_extract(canonical_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)/(?:login|signin|sign-in|sso|auth|account/login)(?:/|$)') THEN 'ACCESS_RESTRICTED'
WHEN regexp_matches(title, '(?i)subscribe to (?:continue|read)|this (?:article|content) is for subscribers|purchase access|paywall') THEN 'PAYWALLED' ELSE 'OPEN' END AS barrier,
CASE WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), 'graphql|/api/') THEN 'PUBLIC_API' WHEN format IN ('pdf', 'html') THEN 'PUBLIC_STATIC' ELSE 'UNKNOWN' END AS request_class FROM sources) GROUP BY ALL""",
    "url_titles": r"""SELECT DISTINCT candidate_id, nullif(trim(regexp_replace(regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]+?)(?:\.[A-Za-z]{2,5})?/?$', 1), '[-_+]+|%20', ' ', 'g')), '') AS title FROM candidates WHERE url IS NOT NULL""",
}
