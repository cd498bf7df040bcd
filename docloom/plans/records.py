"""Queries on candidates, sources, parsed results and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import INJECTIONS, collapse, injection_phrases, location_label
from docloom.functions.url import canonical_url, host_of, parent_domains, url_identifiers
from docloom.operators.dedupe import fill_unknown
from docloom.operators.selection import select_relevant
from docloom.tables import table

# Fixed values for the test hosts: tiers of domains.
TEST_TIERS = {"northbrief.invalid": 1, "carrypapers.invalid": 1, "granitepapers.example": 1, "meadowlab.invalid": 2, "tapelab.test": 2, "ledgerjournal.test": 2, "riverforum.test": 4, "basisforum.test": 4, "invalid": 5}
BARRIERS = {401: "ACCESS_RESTRICTED", 402: "PAYWALLED", 403: "ACCESS_RESTRICTED", 407: "ACCESS_RESTRICTED"}


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of each candidate: the maximum by load time, in one aggregation."""
    cands = table(spark, sf_dir, "candidates")
    keep = ["connector", "title", "url", "work_type", "campaign_id", "publication_date"]
    newest = cands.groupBy("candidate_id").agg(F.max_by(F.struct(*keep), F.col("loaded_at")).alias("r"), F.max("loaded_at").alias("loaded_at"), F.count("*").alias("deliveries"))
    return newest.select("candidate_id", "r.*", "loaded_at", "deliveries")


def candidate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).select("candidate_id", "connector", "title", F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id"), "deliveries")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct written urls with their canonical form and host."""
    urls = table(spark, sf_dir, "candidates").where("url IS NOT NULL").select("url").distinct()
    return urls.select("url", canonical_url("url").alias("canonical"), host_of("url").alias("host"))


def url_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical urls written in more than one way, across candidates and sources."""
    both = table(spark, sf_dir, "candidates").select("url").union(table(spark, sf_dir, "sources").select("url")).where("url IS NOT NULL")
    groups = both.distinct().groupBy(canonical_url("url").alias("canonical")).agg(F.count("*").alias("spellings"), F.min("url").alias("first_url"))
    return groups.where("spellings > 1")


def host_tier(spark: SparkSession, sf_dir: str, tiers: dict[str, int] = TEST_TIERS) -> DataFrame:
    """Tier of each host by its longest listed domain; hosts without one have tier 0."""
    hosts = table(spark, sf_dir, "candidates").select(host_of("url").alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("hits"))
    listed = spark.createDataFrame(list(tiers.items()), "domain string, tier long")
    parents = hosts.select("host", F.posexplode(parent_domains("host")).alias("depth", "domain")).join(F.broadcast(listed), "domain")
    best = parents.groupBy("host").agg(F.min_by("tier", "depth").alias("tier"), F.min_by("domain", "depth").alias("basis"))
    return hosts.join(best, "host", "left").select("host", "hits", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("basis", F.lit("UNKNOWN_DOMAIN")).alias("basis"))


def candidate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity a candidate: doi, else arXiv id without version, else canonical url, else pdf url."""
    c = table(spark, sf_dir, "candidates")
    doi, arxiv = F.lower(F.col("ids")["doi"]), F.regexp_replace(F.col("ids")["arxiv"], r"v[0-9]+$", "")
    who = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv), canonical_url("url"), F.col("pdf_url"))
    return c.select("candidate_id", who.alias("identity")).where("identity IS NOT NULL").groupBy("identity").agg(F.count_distinct("candidate_id").alias("candidates"), F.min("candidate_id").alias("first_id"))


def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers implied by urls made from the candidates' ids, as landing pages write them."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.explode(F.array(F.concat(F.lit("https://doi.org/"), F.col("ids")["doi"]), F.concat(F.lit("https://arxiv.org/abs/"), F.col("ids")["arxiv"]))).alias("page"))
    return c.where("page IS NOT NULL").distinct().select("candidate_id", "page", url_identifiers("page")["doi"].alias("doi"))


def source_fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose UNKNOWN organisation and licence are filled from other rows of the same work title, never overwritten."""
    s = table(spark, sf_dir, "sources").where("title <> 'UNKNOWN'").select(F.lower(collapse(F.col("title"))).alias("work"), "source_id", "organization", "license")
    first = s.groupBy("work").agg(F.min_by("organization", "source_id").alias("organization"), F.min_by("license", "source_id").alias("license"))
    return fill_unknown(first, s, "work", ["organization", "license"])


def unread_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a parsed result: an anti join."""
    done = table(spark, sf_dir, "handler_results").select("source_id")
    return table(spark, sf_dir, "sources").join(done, "source_id", "left_anti").select("source_id", F.coalesce("tier", F.lit(0)).alias("tier"), "format", "access_status")


def read_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns with at least one source that was parsed: a semi join, then counts with a predicate."""
    src = table(spark, sf_dir, "sources")
    read = src.join(table(spark, sf_dir, "handler_results").where("access_status = 'OK'"), "source_id", "left_semi").select(F.col("campaign_id").alias("read_id")).distinct()
    return src.join(read, F.col("campaign_id").eqNullSafe(F.col("read_id")), "left_semi").groupBy(F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id")).agg(F.count("*").alias("sources"), F.count_if(F.col("tier") <= 2).alias("good"), F.count("retrieved_at").alias("fetched"))


def refusing_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that refused at least once and never delivered, by conditional counts in one pass."""
    s = table(spark, sf_dir, "sources").select(host_of("canonical_url").alias("host"), "access_status").where("host IS NOT NULL")
    return s.groupBy("host").agg(F.count("*").alias("tries"), F.count_if(F.col("access_status") != "OK").alias("refused"), F.count_if(F.col("access_status") == "OK").alias("opened")).where("refused > 0").select("host", "tries", "refused", "opened", (F.col("opened") == 0).alias("only_refuses"))


def tier_counts_with_zeroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sources of every tier 1 to 5 and of none, zeroes included."""
    tiers = spark.range(0, 6).select(F.col("id").alias("tier"))
    n = table(spark, sf_dir, "sources").groupBy(F.coalesce("tier", F.lit(0)).cast("long").alias("tier")).agg(F.count("*").alias("n"))
    return tiers.join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("sources"))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest files, unknown sizes last, newest id first among equals (a top-k report)."""
    return table(spark, sf_dir, "sources").orderBy(F.desc_nulls_last("file_size"), F.desc("source_id")).limit(50).select("source_id", F.coalesce("file_size", F.lit(-1)).alias("file_size"), F.coalesce("tier", F.lit(0)).alias("tier"))


def filter_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files among the 200 newest sources: the filter follows the limit and must not move below it."""
    return table(spark, sf_dir, "sources").orderBy(F.desc("source_id")).limit(200).where("format = 'pdf'").select("source_id", "format")


def connector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries, candidates, hosts and late loads of each connector and kind of work."""
    c = table(spark, sf_dir, "candidates")
    late = F.unix_timestamp("loaded_at") - F.unix_timestamp("found_at") > 86400
    return c.groupBy("connector", "work_type").agg(F.count("*").alias("deliveries"), F.count_distinct("candidate_id").alias("candidates"), F.count_distinct(host_of("url")).alias("hosts"), F.count_if(late).alias("late"), F.count("campaign_id").alias("in_campaign"))


def connector_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each campaign by connector, as columns."""
    names = ["arxiv", "crossref", "openalex", "rss", "sites", "web_search"]
    return table(spark, sf_dir, "candidates").groupBy("campaign_id").pivot("connector", names).agg(F.count_distinct("candidate_id")).select(F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def id_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as a long table of facts, the first value of each scheme kept, then pivoted."""
    facts = table(spark, sf_dir, "candidates").select("candidate_id", "loaded_at", F.explode("ids").alias("scheme", "value"))
    first = facts.groupBy("candidate_id", "scheme").agg(F.min("value").alias("value"))
    return first.groupBy("candidate_id").pivot("scheme", ["arxiv", "doi", "openalex"]).agg(F.first("value"))


def campaign_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found, fetched and parsed of each campaign, with the rounded share that was read."""
    s = table(spark, sf_dir, "sources").where("campaign_id IS NOT NULL")
    read = table(spark, sf_dir, "handler_results").select("source_id").distinct().withColumn("read", F.lit(1))
    g = s.join(read, "source_id", "left").groupBy("campaign_id").agg(F.count("*").alias("found"), F.count("retrieved_at").alias("fetched"), F.count("read").alias("parsed"))
    return g.select("*", F.round(F.col("parsed") * 100.0 / F.col("found"), 1).alias("percent"))


def block_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their location label and the latest section above them."""
    b = table(spark, sf_dir, "handler_results").select("result_id", F.posexplode("blocks").alias("block_index", "b"))
    above = F.last("b.section", ignorenulls=True).over(Window.partitionBy("result_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0))
    label = location_label(F.col("b.page"), F.col("b.slide"), F.col("b.section"), F.col("b.sheet"), F.col("b.item"))
    return b.select("result_id", F.col("block_index").cast("long").alias("block_index"), label.alias("location"), above.alias("section_above"), F.length("b.text").cast("long").alias("chars"))


def result_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links and references of each parsed file, with the union of both as a sorted list."""
    r = table(spark, sf_dir, "handler_results")
    links, refs = F.array_distinct("links"), F.array_distinct("refs")
    return r.select("result_id", F.size(links).cast("long").alias("links"), F.size(refs).cast("long").alias("refs"), F.array_join(F.array_sort(F.array_union(links, refs)), " ").alias("all_references"))


def result_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in parsed files that address a model's instructions, beside those that the parser recorded."""
    r = table(spark, sf_dir, "handler_results").select("result_id", F.array_join("blocks.text", "\n").alias("text"), F.size("injection_phrases").cast("long").alias("recorded"))
    return r.select("result_id", F.array_join(injection_phrases(F.col("text")), "|").alias("phrases"), "recorded")


def handler_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and blocks by handler and access status."""
    r = table(spark, sf_dir, "handler_results")
    return r.groupBy("handler", "format", "access_status").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.size("blocks")).alias("blocks"), F.count_if(F.size("alt_blocks") > 0).alias("with_alternative"))


def reparsed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of each source that was parsed more than once."""
    r = table(spark, sf_dir, "handler_results").groupBy("source_id").agg(F.max_by("result_id", F.struct("parsed_at", "result_id")).alias("latest"), F.count("*").alias("parses"), F.count_distinct("sha256").alias("versions"))
    return r.where("parses > 1")


CHOSEN_BY = ["cost", "drawdown", "signal", "threshold", "holdout", "stop-loss", "turnover"]


def selection_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of each file's blocks under a budget of characters, by keyword density (a fold for each file)."""
    r = table(spark, sf_dir, "handler_results").select("result_id", F.col("blocks.text").alias("texts"))
    chosen = select_relevant(r, "result_id", "texts", CHOSEN_BY, 6000)
    return chosen.select("result_id", F.concat_ws(",", F.col("chosen").cast("array<string>")).alias("chosen"), F.col("n_blocks").cast("long").alias("n_blocks"), F.col("chars").cast("long").alias("chars"))


def selection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections against the files that they were chosen from."""
    s = table(spark, sf_dir, "selections").alias("s").join(table(spark, sf_dir, "handler_results").alias("r"), "result_id", "left")
    return s.groupBy("purpose", "r.format").agg(F.count("*").alias("selections"), F.count_if("truncated").alias("truncated"), F.sum("blocks_used").alias("used"), F.sum("blocks_total").alias("total"), F.max(F.length("s.text")).cast("long").alias("longest"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record a source with its parsed files, as hand-over packages are built; flat digests for comparison."""
    files = table(spark, sf_dir, "handler_results").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("result_id", "format", "size"))).alias("files"))
    p = table(spark, sf_dir, "sources").join(files, "source_id").select("source_id", "title", F.col("tier"), "files")
    return p.select("source_id", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("bytes"), F.array_join(F.transform("files", lambda f: f["format"]), ",").alias("formats"))


def same_root_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each root (reference, else own id) and the count of independent roots a campaign has."""
    s = table(spark, sf_dir, "sources").withColumn("root", F.coalesce(F.concat(F.lit("ref:"), F.col("ids")["ref"]), F.concat(F.lit("ssrn:"), F.col("ids")["ssrn"]), F.concat(F.lit("source:"), F.col("source_id").cast("string"))))
    return s.groupBy(F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id")).agg(F.count("*").alias("sources"), F.count_distinct("root").alias("independent_roots"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("candidates", "sources", "handler_results", "selections", "documents", "doc_labels", "feed_sites", "size_limits", "eval_items", "events")
    counts = [table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


QUERIES = {
    q.__name__: q
    for q in (
        candidate_latest, url_canonical, url_spellings, host_tier, candidate_identity, url_ids, source_fill_unknown, unread_sources, read_campaigns,
        refusing_hosts, tier_counts_with_zeroes, top_sources, filter_after_limit, connector_rollup, connector_pivot, id_facts, campaign_status, block_facts,
        result_references, result_injections, handler_status, reparsed_latest, selection_blocks, selection_coverage, packages, same_root_links, table_counts,
    )
}

_TRACK = r"utm_source|utm_medium|utm_campaign|utm_term|utm_content|utm_id|gclid|fbclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref_src|_hsenc|_hsmi|si"
_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim({0})), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.$', ''), '')"
_URL = r"regexp_extract(trim({0}), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {1})"
_AUTH = "lower(" + _URL.format("{0}", 2) + ")"
_CANON = f"""CASE WHEN lower({_URL.format('{0}', 1)}) IN ('http', 'https') AND {_AUTH} NOT LIKE '%@%' AND regexp_extract({_AUTH}, '^([^:]*)', 1) <> '' THEN
 lower({_URL.format('{0}', 1)}) || '://' || regexp_replace(regexp_extract({_AUTH}, '^([^:]*)', 1), '\\.$', '')
 || CASE WHEN regexp_extract({_AUTH}, ':([0-9]*)$', 1) = '' OR (lower({_URL.format('{0}', 1)}) = 'http' AND regexp_extract({_AUTH}, ':([0-9]*)$', 1) = '80') OR (lower({_URL.format('{0}', 1)}) = 'https' AND regexp_extract({_AUTH}, ':([0-9]*)$', 1) = '443') THEN '' ELSE ':' || regexp_extract({_AUTH}, ':([0-9]*)$', 1) END
 || CASE WHEN {_URL.format('{0}', 3)} = '' THEN '/' ELSE {_URL.format('{0}', 3)} END
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_URL.format('{0}', 4)}, '&'), lambda p: p <> '' AND NOT regexp_full_match(lower(string_split(p, '=')[1]), '{_TRACK}'))), '&'), ''), '') END"""
_canon = lambda c: _CANON.replace("{0}", c)
_INJ = "(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS)
_TIERS = ", ".join(f"('{d}', {t})" for d, t in TEST_TIERS.items())
SQL = {
    "selection_blocks": f"""WITH RECURSIVE b AS (SELECT result_id, i - 1 AS pos, blocks[i].text AS t FROM (SELECT result_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM handler_results)),
solid AS (SELECT result_id, pos, length(t) AS chars, len(regexp_extract_all(lower(t), '{"|".join(CHOSEN_BY)}')) AS hits, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS n FROM b WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY -hits * 2000 / (2000 + chars), pos) AS k FROM solid WHERE n > 2 AND hits > 0),
fold AS (SELECT r.result_id, 0 AS k, coalesce(sum(chars), 0)::BIGINT AS used, coalesce(list(pos) FILTER (WHERE pos IS NOT NULL), []) AS taken FROM handler_results r LEFT JOIN solid s ON s.result_id = r.result_id AND n <= 2 GROUP BY 1
  UNION ALL SELECT f.result_id, f.k + 1, CASE WHEN used + chars + 16 <= 6000 THEN used + chars + 16 ELSE used END, CASE WHEN used + chars + 16 <= 6000 THEN list_append(taken, pos) ELSE taken END FROM fold f JOIN ranked r ON r.result_id = f.result_id AND r.k = f.k + 1),
done AS (SELECT result_id, list_sort(arg_max(taken, k)) AS taken FROM fold GROUP BY 1)
SELECT result_id, array_to_string(taken, ',') AS chosen, coalesce(len(blocks), 0) AS n_blocks, coalesce(list_sum(list_transform(taken, lambda i: length(blocks[i + 1].text))), 0)::BIGINT AS chars FROM done JOIN handler_results USING (result_id)""",
    "candidate_latest": """SELECT candidate_id, connector, title, coalesce(campaign_id, -1) AS campaign_id, n AS deliveries FROM (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n,
row_number() OVER (PARTITION BY candidate_id ORDER BY loaded_at DESC) AS k FROM candidates) WHERE k = 1""",
    "url_canonical": f"SELECT url, {_canon('url')} AS canonical, {_HOST.format('url')} AS host FROM (SELECT DISTINCT url FROM candidates WHERE url IS NOT NULL)",
    "url_spellings": f"SELECT {_canon('url')} AS canonical, count(*) AS spellings, min(url) AS first_url FROM (SELECT url FROM candidates WHERE url IS NOT NULL UNION SELECT url FROM sources WHERE url IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "host_tier": f"""WITH h AS (SELECT {_HOST.format('url')} AS host, count(*) AS hits FROM candidates GROUP BY 1 HAVING host IS NOT NULL), t(domain, tier) AS (VALUES {_TIERS}),
m AS (SELECT host, arg_max(tier, length(domain)) AS tier, arg_max(domain, length(domain)) AS basis FROM h JOIN t ON domain LIKE '%.%' AND (host = domain OR host LIKE '%.' || domain) GROUP BY host)
SELECT host, hits, coalesce(CAST(tier AS BIGINT), 0) AS tier, coalesce(basis, 'UNKNOWN_DOMAIN') AS basis FROM h LEFT JOIN m USING (host)""",
    "candidate_identity": f"""SELECT identity, count(DISTINCT candidate_id) AS candidates, min(candidate_id) AS first_id FROM (SELECT candidate_id,
coalesce('doi:' || lower(ids['doi']), 'arxiv:' || regexp_replace(ids['arxiv'], 'v[0-9]+$', ''), {_canon('url')}, pdf_url) AS identity FROM candidates) WHERE identity IS NOT NULL GROUP BY 1""",
    "url_ids": """SELECT DISTINCT candidate_id, page, nullif(lower(regexp_replace(regexp_extract(page, '(?i)doi\\.org/(10\\.[^\\s?#]+)', 1), '\\.+$', '')), '') AS doi FROM (
SELECT candidate_id, 'https://doi.org/' || ids['doi'] AS page FROM candidates UNION ALL SELECT candidate_id, 'https://arxiv.org/abs/' || ids['arxiv'] FROM candidates) WHERE page IS NOT NULL""",
    "source_fill_unknown": """WITH s AS (SELECT lower(trim(regexp_replace(title, '[ \t\r\n]+', ' ', 'g'))) AS work, source_id, organization, license FROM sources WHERE title <> 'UNKNOWN'),
k AS (SELECT work, arg_min(organization, source_id) AS o, arg_min(license, source_id) AS l, min(nullif(nullif(organization, 'UNKNOWN'), '')) AS no, min(nullif(nullif(license, 'UNKNOWN'), '')) AS nl FROM s GROUP BY work)
SELECT work, coalesce(nullif(nullif(o, 'UNKNOWN'), ''), no, o, 'UNKNOWN') AS organization, coalesce(nullif(nullif(l, 'UNKNOWN'), ''), nl, l, 'UNKNOWN') AS license FROM k""",
    "unread_sources": "SELECT source_id, coalesce(tier, 0) AS tier, format, access_status FROM sources WHERE source_id NOT IN (SELECT source_id FROM handler_results)",
    "read_campaigns": """SELECT coalesce(s.campaign_id, -1) AS campaign_id, count(*) AS sources, count(*) FILTER (WHERE tier <= 2) AS good, count(retrieved_at) AS fetched FROM sources s
WHERE EXISTS (SELECT 1 FROM sources x JOIN handler_results r USING (source_id) WHERE r.access_status = 'OK' AND x.campaign_id IS NOT DISTINCT FROM s.campaign_id) GROUP BY s.campaign_id""",
    "refusing_hosts": f"""SELECT host, count(*) AS tries, count(*) FILTER (WHERE access_status <> 'OK') AS refused, count(*) FILTER (WHERE access_status = 'OK') AS opened,
count(*) FILTER (WHERE access_status = 'OK') = 0 AS only_refuses FROM (SELECT {_HOST.format('canonical_url')} AS host, access_status FROM sources) WHERE host IS NOT NULL GROUP BY host HAVING count(*) FILTER (WHERE access_status <> 'OK') > 0""",
    "tier_counts_with_zeroes": "SELECT t.tier, count(s.source_id) AS sources FROM range(0, 6) t(tier) LEFT JOIN sources s ON coalesce(s.tier, 0) = t.tier GROUP BY t.tier",
    "top_sources": "SELECT source_id, coalesce(file_size, -1) AS file_size, coalesce(tier, 0) AS tier FROM sources ORDER BY sources.file_size DESC NULLS LAST, source_id DESC LIMIT 50",
    "filter_after_limit": "SELECT source_id, format FROM (SELECT * FROM sources ORDER BY source_id DESC LIMIT 200) WHERE format = 'pdf'",
    "connector_rollup": f"""SELECT connector, work_type, count(*) AS deliveries, count(DISTINCT candidate_id) AS candidates, count(DISTINCT {_HOST.format('url')}) AS hosts,
count(*) FILTER (WHERE floor(epoch(loaded_at)) - floor(epoch(found_at)) > 86400) AS late, count(campaign_id) AS in_campaign FROM candidates GROUP BY ALL""",
    "connector_pivot": "SELECT coalesce(campaign_id, -1) AS campaign_id, " + ", ".join(f"count(DISTINCT candidate_id) FILTER (WHERE connector = '{n}') AS {n}" for n in ("arxiv", "crossref", "openalex", "rss", "sites", "web_search")) + " FROM candidates GROUP BY candidates.campaign_id",
    "id_facts": "SELECT candidate_id, min(ids['arxiv']) AS arxiv, min(ids['doi']) AS doi, min(ids['openalex']) AS openalex FROM candidates WHERE cardinality(ids) > 0 GROUP BY candidate_id",
    "campaign_status": """SELECT campaign_id, count(*) AS found, count(retrieved_at) AS fetched, count(r.source_id) AS parsed, round(count(r.source_id) * 100.0 / count(*), 1)::DOUBLE AS percent
FROM sources LEFT JOIN (SELECT DISTINCT source_id FROM handler_results) r USING (source_id) WHERE campaign_id IS NOT NULL GROUP BY campaign_id""",
    "block_facts": """WITH b AS (SELECT result_id, unnest(range(len(blocks))) AS block_index, unnest(blocks) AS b FROM handler_results)
SELECT result_id, block_index, coalesce(nullif(concat_ws(', ', 'p.' || b.page, 'slide ' || b.slide, '§ ' || nullif(b.section, ''), 'sheet ' || nullif(b.sheet, ''), nullif(b.item, '')), ''), 'document') AS location,
last_value(b.section IGNORE NULLS) OVER (PARTITION BY result_id ORDER BY block_index) AS section_above, length(b.text) AS chars FROM b""",
    "result_references": """SELECT result_id, len(list_distinct(links)) AS links, len(list_distinct(refs)) AS refs,
array_to_string(list_sort(list_distinct(list_concat(links, refs))), ' ') AS all_references FROM handler_results""",
    "result_injections": f"""SELECT result_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_INJ}'), lambda x: lower(trim(x))))), '|') AS phrases, recorded FROM (
SELECT result_id, array_to_string(list_transform(blocks, lambda b: b.text), chr(10)) AS t, len(injection_phrases) AS recorded FROM handler_results)""",
    "handler_status": """SELECT handler, format, access_status, count(*) AS files, sum(size)::BIGINT AS bytes, sum(len(blocks))::BIGINT AS blocks, count(*) FILTER (WHERE len(alt_blocks) > 0) AS with_alternative
FROM handler_results GROUP BY ALL""",
    "reparsed_latest": "SELECT source_id, arg_max(result_id, (parsed_at, result_id)) AS latest, count(*) AS parses, count(DISTINCT sha256) AS versions FROM handler_results GROUP BY source_id HAVING count(*) > 1",
    "selection_coverage": """SELECT purpose, format, count(*) AS selections, count(*) FILTER (WHERE truncated) AS truncated, sum(blocks_used)::BIGINT AS used, sum(blocks_total)::BIGINT AS total, max(length(text)) AS longest
FROM selections LEFT JOIN handler_results USING (result_id) GROUP BY ALL""",
    "packages": "SELECT source_id, count(*) AS n_files, sum(size)::BIGINT AS bytes, string_agg(format, ',' ORDER BY result_id) AS formats FROM handler_results SEMI JOIN sources USING (source_id) GROUP BY source_id",
    "same_root_links": """SELECT coalesce(s.campaign_id, -1) AS campaign_id, count(*) AS sources, count(DISTINCT coalesce('ref:' || ids['ref'], 'ssrn:' || ids['ssrn'], 'source:' || source_id)) AS independent_roots FROM sources s GROUP BY s.campaign_id""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("candidates", "sources", "handler_results", "selections", "documents", "doc_labels", "feed_sites", "size_limits", "eval_items", "events")),
}
