"""Queries on how records relate: joins with conditions, overlaps, classifications, tallies and look-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import location_label
from docloom.functions.url import canonical_url, host_of
from docloom.tables import table


def parsed_as_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of sources of one campaign that state another size than the file has: an equi-join with an inequality."""
    r, s = table(spark, sf_dir, "handler_results").alias("r"), table(spark, sf_dir, "sources").alias("s")
    return r.join(s, (F.col("r.source_id") == F.col("s.source_id")) & (F.col("r.size") != F.col("s.file_size"))).select("r.result_id", "s.source_id", (F.col("r.size") - F.col("s.file_size")).alias("difference"))


def authors_seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier candidate has an author in common: the least id of each author instead of a join of all with all."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.explode("authors").alias("author")).where("author IS NOT NULL").distinct()
    first = c.groupBy("author").agg(F.min("candidate_id").alias("first_id"))
    return c.join(first, "author").groupBy("candidate_id").agg(F.bool_or(F.col("first_id") < F.col("candidate_id")).alias("seen"), F.count("*").alias("authors"))


def titles_kept_new_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a campaign's candidates against those of its sources: in both, only found, only stored."""
    names = lambda t: table(spark, sf_dir, t).where("campaign_id IS NOT NULL AND title IS NOT NULL").select("campaign_id", F.substring(F.lower("title"), 1, 500).alias("name")).distinct()
    found, stored = names("candidates").withColumn("f", F.lit(True)), names("sources").withColumn("s", F.lit(True))
    state = F.when(F.col("f") & F.col("s"), "matched").when(F.col("f"), "new").otherwise("unmatched")
    return found.join(stored, ["campaign_id", "name"], "full").groupBy("campaign_id", state.alias("state")).agg(F.count("*").alias("n"))


def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources of a campaign rest on another root than each source does: counts of both, without forming pairs."""
    s = table(spark, sf_dir, "sources").where("campaign_id IS NOT NULL").select("source_id", "campaign_id", F.coalesce(F.col("ids")["ref"], F.concat(F.lit("own:"), F.col("source_id").cast("string"))).alias("root"))
    same = s.groupBy("campaign_id", "root").agg(F.count("*").alias("same"))
    every = s.groupBy("campaign_id").agg(F.count("*").alias("every"))
    return s.join(same, ["campaign_id", "root"]).join(every, "campaign_id").select("source_id", (F.col("every") - F.col("same")).alias("independent"))


def pages_read_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that both readings of a file have: a semi join on the page number, inside each row."""
    r = table(spark, sf_dir, "handler_results")
    both = F.array_intersect(F.filter("blocks.page", lambda p: p.isNotNull()), F.filter("alt_blocks.page", lambda p: p.isNotNull()))
    return r.select("result_id", F.size(both).cast("long").alias("pages")).where("pages > 0")


def limitation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What limited the reading of files, numbers as #, the most frequent first."""
    said = table(spark, sf_dir, "handler_results").select(F.explode(F.transform("limitations", lambda l: F.regexp_replace(l, "[0-9]+", "#"))).alias("limitation"))
    return said.groupBy("limitation").agg(F.count("*").alias("n"))


def first_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct first authors of each campaign's candidates."""
    c = table(spark, sf_dir, "candidates").where("campaign_id IS NOT NULL")
    return c.groupBy("campaign_id").agg(F.count_distinct(F.get("authors", F.lit(0))).alias("first_authors"), F.count_distinct("candidate_id").alias("candidates"))


def access_by_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each campaign by how they could be read, as columns, merged with their number of parsed files."""
    s = table(spark, sf_dir, "sources").where("campaign_id IS NOT NULL")
    parsed = table(spark, sf_dir, "handler_results").groupBy("source_id").agg(F.count("*").alias("files"))
    one = lambda status: F.count_if(F.col("access_status") == status).alias(status.lower())
    return s.join(parsed, "source_id", "left").groupBy("campaign_id").agg(one("OK"), one("PAYWALLED"), one("ACCESS_RESTRICTED"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different contents of each tier; what was never fetched counts by itself."""
    key = F.coalesce("content_hash", F.concat(F.lit("source:"), F.col("source_id").cast("string")))
    return table(spark, sf_dir, "sources").groupBy(F.coalesce("tier", F.lit(0)).cast("long").alias("tier")).agg(F.count_distinct(key).alias("contents"), F.count("*").alias("sources"))


def kinds_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the kind of their address."""
    kind = F.when(F.col("url").isNull(), "none").when(F.lower("url").rlike(r"\.pdf($|[?#])"), "pdf").when(F.lower("url").startswith("https://"), "page").otherwise("other")
    return table(spark, sf_dir, "candidates").groupBy("connector", kind.alias("kind")).agg(F.count("*").alias("n"))


def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a connector delivered: new, again, late, without address, without date."""
    c = table(spark, sf_dir, "candidates")
    again = F.row_number().over(Window.partitionBy("candidate_id").orderBy("loaded_at", "connector")) > 1
    late = F.unix_timestamp("loaded_at") - F.unix_timestamp("found_at") > 7 * 86400
    return c.withColumn("again", again).groupBy("connector").agg(F.count_if(~F.col("again")).alias("new"), F.count_if("again").alias("again"), F.count_if(late).alias("late"), F.count_if(F.col("url").isNull()).alias("no_url"), F.count_if(F.col("publication_date").isNull()).alias("no_date"))


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by what a scan finds of them: read, fetched only, never fetched; and files whose hash is another than stated."""
    s = table(spark, sf_dir, "sources")
    r = table(spark, sf_dir, "handler_results").groupBy("source_id").agg(F.max("sha256").alias("sha256"))
    read = F.col("sha256").isNotNull()
    return s.join(r, "source_id", "left").groupBy("format").agg(F.count_if(read).alias("read"), F.count_if(~read & F.col("retrieved_at").isNotNull()).alias("fetched"), F.count_if(F.col("retrieved_at").isNull()).alias("missing"), F.count_if(read & (F.col("sha256") != F.col("content_hash"))).alias("changed"))


def known_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a file's reading warns of: the sorted union of its limitations and recorded phrases."""
    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("limitations", empty), F.coalesce("injection_phrases", empty)))
    return table(spark, sf_dir, "handler_results").select("result_id", F.array_join(both, " | ").alias("warnings"), F.size(both).cast("long").alias("n"))


def candidate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each connector's works by the best source of their host, else by the kind of work."""
    best = table(spark, sf_dir, "sources").where("tier IS NOT NULL").groupBy(host_of("canonical_url").alias("host")).agg(F.min("tier").cast("long").alias("host_tier"))
    c = table(spark, sf_dir, "candidates").select("connector", "work_type", host_of("url").alias("host")).join(best, "host", "left")
    scholarly = F.col("connector").isin("arxiv", "crossref", "openalex") & F.col("work_type").isin("journal-article", "preprint")
    return c.groupBy(F.coalesce("host_tier", F.when(scholarly, 1), F.lit(0)).cast("long").alias("tier")).agg(F.count("*").alias("n"))


def further_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different links of each file that lead to other hosts than its own."""
    links = F.array_distinct(F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda u: ~u.contains(F.concat(F.lit("//"), F.coalesce("host", F.lit("-"))))))
    return table(spark, sf_dir, "handler_results").select("result_id", F.array_join(F.slice(links, 1, 5), " ").alias("links"), F.size(links).cast("long").alias("n"))


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and slide read back from the location label of each block."""
    b = table(spark, sf_dir, "handler_results").select("result_id", F.posexplode("blocks").alias("block_index", "b"))
    none = F.lit(None).cast("string")
    label = location_label(F.col("b.page"), F.col("b.slide"), none, F.col("b.sheet"), none)
    number = lambda name: F.coalesce(F.regexp_extract(label, rf"(?:^|, ){name}([0-9]+)", 1).try_cast("long"), F.lit(-1))
    return b.select("result_id", F.col("block_index").cast("long").alias("block_index"), number(r"p\.").alias("page"), number("slide ").alias("slide"))


def spend_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each type as people read it, what it costs at a price a million, and a name for it."""
    cents = F.round(F.col("value") * 100).cast("long")
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))
    return g.select("event_type", F.format_number(F.col("cents") / 100, 2).alias("money"), F.round((F.col("n") * 3 + F.col("cents") * 15) / 1e6, 6).alias("cost"), F.format_string("L-%06d-%s", F.col("n"), F.substring(F.md5("event_type"), 1, 8)).alias("name"))


def seconds_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each user's last event to the next day, at least a minute."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.select("user_id", F.greatest(F.lit(60), 86400 - F.pmod(F.unix_timestamp("ts"), F.lit(86400))).cast("long").alias("seconds"))


def quote_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all that was chosen from a file, in the order of the choices."""
    s = table(spark, sf_dir, "selections").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("selection_id", "text"))).alias("chosen"))
    return s.select("result_id", F.size("chosen").cast("long").alias("n"), F.sha2(F.array_join(F.transform("chosen", lambda c: F.coalesce(c["text"], F.lit(""))), "\n"), 256).alias("digest"))


def bare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that someone named, as candidates with nothing else known; different writings of one address are one."""
    urls = table(spark, sf_dir, "sources").where("url IS NOT NULL").select(canonical_url("url").alias("address")).where("address IS NOT NULL")
    return urls.distinct().select(F.lit("user_urls").alias("connector"), F.col("address").alias("title"), F.col("address").alias("url"))


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of pages, keyed by the hash of the address, holds of each candidate: a fresh copy, a stale one or none."""
    kept = table(spark, sf_dir, "sources").where("retrieved_at IS NOT NULL").groupBy(F.sha2("canonical_url", 256).alias("key")).agg(F.max("retrieved_at").alias("at"))
    c = table(spark, sf_dir, "candidates").where("url IS NOT NULL").select("candidate_id", "found_at", F.sha2(canonical_url("url"), 256).alias("key")).join(kept, "key", "left")
    state = F.when(F.col("at").isNull(), "none").when(F.unix_timestamp("found_at") - F.unix_timestamp("at") > 30 * 86400, "stale").otherwise("fresh")
    return c.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def reread_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source is read again from: its parsed file if the hash is still that, else the stored copy, else its address."""
    parsed = table(spark, sf_dir, "handler_results").groupBy(F.col("source_id").alias("p_id"), F.col("sha256").alias("p_hash")).agg(F.max("result_id").alias("result_id"))
    s = table(spark, sf_dir, "sources").select("source_id", "content_hash", "retrieved_at", "url")
    j = s.join(parsed, (F.col("p_id") == F.col("source_id")) & (F.col("p_hash") == F.col("content_hash")), "left")
    where = F.when(F.col("result_id").isNotNull(), "file").when(F.col("content_hash").isNotNull(), "copy").when(F.col("url").isNotNull(), "address").otherwise("nowhere")
    return j.select("source_id", where.alias("place"))


QUERIES = {
    q.__name__: q
    for q in (
        parsed_as_other, authors_seen_before, titles_kept_new_gone, independent_sources, pages_read_twice, limitation_tally, first_authors, access_by_campaign, distinct_contents, kinds_of_addresses, discovery_counters,
        scan_counters, known_unknowns, candidate_tiers, further_links, label_places, spend_written, seconds_left, quote_digest, bare_candidates, cached_pages, reread_from,
    )
}
from docloom.plans.records import _HOST, _canon  # noqa: E402

SQL = {
    "parsed_as_other": "SELECT r.result_id, s.source_id, r.size - s.file_size AS difference FROM handler_results r JOIN sources s ON r.source_id = s.source_id AND r.size <> s.file_size",
    "authors_seen_before": """WITH c AS (SELECT DISTINCT candidate_id, author FROM (SELECT candidate_id, unnest(authors) AS author FROM candidates) WHERE author IS NOT NULL)
SELECT candidate_id, bool_or(first_id < candidate_id) AS seen, count(*) AS authors FROM (SELECT *, min(candidate_id) OVER (PARTITION BY author) AS first_id FROM c) GROUP BY 1""",
    "titles_kept_new_gone": """WITH f AS (SELECT DISTINCT campaign_id, left(lower(title), 500) AS name FROM candidates WHERE campaign_id IS NOT NULL AND title IS NOT NULL), s AS (SELECT DISTINCT campaign_id, left(lower(title), 500) AS name FROM sources WHERE campaign_id IS NOT NULL AND title IS NOT NULL)
SELECT campaign_id, state, count(*) AS n FROM (SELECT campaign_id, 'matched' AS state FROM (FROM f INTERSECT FROM s) UNION ALL SELECT campaign_id, 'new' FROM (FROM f EXCEPT FROM s) UNION ALL SELECT campaign_id, 'unmatched' FROM (FROM s EXCEPT FROM f)) GROUP BY 1, 2""",
    "independent_sources": """WITH s AS (SELECT source_id, campaign_id, coalesce(ids['ref'], 'own:' || source_id) AS root FROM sources WHERE campaign_id IS NOT NULL)
SELECT source_id, count(*) OVER (PARTITION BY campaign_id) - count(*) OVER (PARTITION BY campaign_id, root) AS independent FROM s""",
    "pages_read_twice": "SELECT * FROM (SELECT result_id, len(list_distinct(list_filter(list_transform(blocks, lambda b: b.page), lambda p: list_contains(list_transform(alt_blocks, lambda b: b.page), p)))) AS pages FROM handler_results) WHERE pages > 0",
    "limitation_tally": "SELECT regexp_replace(l, '[0-9]+', '#', 'g') AS limitation, count(*) AS n FROM (SELECT unnest(limitations) AS l FROM handler_results) GROUP BY 1",
    "first_authors": "SELECT campaign_id, count(DISTINCT authors[1]) AS first_authors, count(DISTINCT candidate_id) AS candidates FROM candidates WHERE campaign_id IS NOT NULL GROUP BY 1",
    "access_by_campaign": """SELECT campaign_id, count(*) FILTER (access_status = 'OK') AS ok, count(*) FILTER (access_status = 'PAYWALLED') AS paywalled, count(*) FILTER (access_status = 'ACCESS_RESTRICTED') AS access_restricted, coalesce(sum(files), 0)::BIGINT AS files
FROM sources LEFT JOIN (SELECT source_id, count(*) AS files FROM handler_results GROUP BY 1) USING (source_id) WHERE campaign_id IS NOT NULL GROUP BY 1""",
    "distinct_contents": "SELECT coalesce(tier, 0)::BIGINT AS tier, count(DISTINCT coalesce(content_hash, 'source:' || source_id)) AS contents, count(*) AS sources FROM sources GROUP BY 1",
    "kinds_of_addresses": r"SELECT connector, CASE WHEN url IS NULL THEN 'none' WHEN regexp_matches(lower(url), '\.pdf($|[?#])') THEN 'pdf' WHEN starts_with(lower(url), 'https://') THEN 'page' ELSE 'other' END AS kind, count(*) AS n FROM candidates GROUP BY 1, 2",
    "discovery_counters": """SELECT connector, count(*) FILTER (k = 1) AS new, count(*) FILTER (k > 1) AS again, count(*) FILTER (floor(epoch(loaded_at)) - floor(epoch(found_at)) > 604800) AS late, count(*) FILTER (url IS NULL) AS no_url, count(*) FILTER (publication_date IS NULL) AS no_date
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY loaded_at, connector) AS k FROM candidates) GROUP BY 1""",
    "scan_counters": """SELECT format, count(sha256) AS read, count(*) FILTER (sha256 IS NULL AND retrieved_at IS NOT NULL) AS fetched, count(*) FILTER (retrieved_at IS NULL) AS missing, count(*) FILTER (sha256 <> content_hash) AS changed
FROM sources LEFT JOIN (SELECT source_id, max(sha256) AS sha256 FROM handler_results GROUP BY 1) USING (source_id) GROUP BY 1""",
    "known_unknowns": "SELECT result_id, array_to_string(w, ' | ') AS warnings, len(w) AS n FROM (SELECT result_id, list_sort(list_distinct(list_concat(coalesce(limitations, []), coalesce(injection_phrases, [])))) AS w FROM handler_results)",
    "candidate_tiers": f"""WITH b AS (SELECT {_HOST.format('canonical_url')} AS host, min(tier) AS host_tier FROM sources WHERE tier IS NOT NULL GROUP BY 1), c AS (SELECT connector, work_type, {_HOST.format('url')} AS host FROM candidates)
SELECT coalesce(host_tier, CASE WHEN connector IN ('arxiv', 'crossref', 'openalex') AND work_type IN ('journal-article', 'preprint') THEN 1 END, 0)::BIGINT AS tier, count(*) AS n FROM c LEFT JOIN b USING (host) GROUP BY 1""",
    "further_links": """WITH u AS (SELECT result_id, unnest(links) AS u, unnest(range(len(links))) AS k, host FROM handler_results), f AS (SELECT result_id, u, min(k) AS k FROM u WHERE NOT contains(u, '//' || coalesce(host, '-')) GROUP BY 1, 2),
g AS (SELECT result_id, list(u ORDER BY k) AS l FROM f GROUP BY 1) SELECT result_id, array_to_string(coalesce(l, [])[1:5], ' ') AS links, coalesce(len(l), 0) AS n FROM handler_results LEFT JOIN g USING (result_id)""",
    "label_places": "SELECT result_id, i - 1 AS block_index, coalesce(blocks[i].page, -1)::BIGINT AS page, coalesce(blocks[i].slide, -1)::BIGINT AS slide FROM (SELECT result_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM handler_results)",
    "spend_written": "SELECT event_type, format('{:,.2f}', cents / 100) AS money, round((n * 3 + cents * 15) / 1e6, 6) AS cost, printf('L-%06d-%s', n, left(md5(event_type), 8)) AS name FROM (SELECT event_type, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM events GROUP BY 1)",
    "seconds_left": "SELECT user_id, greatest(60, 86400 - floor(epoch(max(ts)))::BIGINT % 86400) AS seconds FROM events GROUP BY 1",
    "quote_digest": "SELECT result_id, count(*) AS n, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY selection_id)) AS digest FROM selections GROUP BY 1",
    "bare_candidates": f"SELECT DISTINCT 'user_urls' AS connector, {_canon('url')} AS title, {_canon('url')} AS url FROM sources WHERE {_canon('url')} IS NOT NULL",
    "cached_pages": f"""WITH k AS (SELECT canonical_url AS u, max(retrieved_at) AS at FROM sources WHERE retrieved_at IS NOT NULL GROUP BY 1)
SELECT CASE WHEN k.at IS NULL THEN 'none' WHEN floor(epoch(found_at)) - floor(epoch(k.at)) > 2592000 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM (SELECT found_at, {_canon('url')} AS u FROM candidates WHERE url IS NOT NULL) LEFT JOIN k USING (u) GROUP BY 1""",
    "reread_from": """SELECT source_id, CASE WHEN EXISTS (SELECT 1 FROM handler_results r WHERE r.source_id = s.source_id AND r.sha256 = s.content_hash) THEN 'file' WHEN content_hash IS NOT NULL THEN 'copy' WHEN url IS NOT NULL THEN 'address' ELSE 'nowhere' END AS place FROM sources s""",
}
