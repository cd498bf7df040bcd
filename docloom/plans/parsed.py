"""Queries that read what services and files say: their payloads are made from the tables, and the SQL states the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.columns import read_pages
from docloom.sources.captions import caption_lines, paragraphs
from docloom.sources.files import parse_files, parse_source_list
from docloom.sources.formats import detect_format
from docloom.sources.payloads import extend_feed, feed_entries, items, repositories, sitemap_urls, uploads_to_read, videos, web_results, works
from docloom.tables import table


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a title, each delivery once; their texts as services would send them."""
    return table(spark, sf_dir, "candidates").where("title IS NOT NULL")


def _xml(text: Column) -> Column:
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def parsed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates sent by a catalogue of works, abstracts as inverted indexes."""
    words = F.split(F.trim(F.regexp_replace("abstract", r"[ \t\r\n]+", " ")), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("value"))))
    who = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    work = F.struct(
        F.concat(F.lit("https://works.example/W"), "candidate_id").alias("id"), F.concat(F.lit("https://doi.org/"), F.col("ids")["doi"]).alias("doi"), F.col("title").alias("display_name"), F.col("publication_date"), F.col("work_type").alias("type"),
        who.alias("authorships"), F.struct(F.col("url").alias("landing_page_url"), "pdf_url", F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), index.alias("abstract_inverted_index"),
    )
    got = works(_titled(spark, sf_dir).select(F.to_json(F.struct(F.array(work).alias("results"))).alias("payload")))
    return got.select(F.col("ids")["openalex"].alias("work"), F.size(F.coalesce("authors", F.array().cast("array<string>"))).cast("long").alias("names"), F.coalesce("publication_date", F.lit("")).alias("stated"), F.col("url"), F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_hash"), F.col("ids")["doi"].alias("doi"))


def parsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates sent by a registry of identifiers, dates in parts."""
    day = F.col("publication_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.length("publication_date") == 10)
    item = F.struct(
        F.concat(F.lit("10.5/"), "candidate_id").alias("DOI"), F.array("title").alias("title"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"), F.col("url").alias("URL"), F.array("venue").alias("container-title"),
        F.struct(F.when(day, F.array(F.transform(F.split("publication_date", "-"), lambda p: p.cast("int")))).alias("date-parts")).alias("issued"), F.col("work_type").alias("type"),
    )
    got = items(_titled(spark, sf_dir).select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload")))
    return got.select(F.col("ids")["doi"].alias("doi"), F.array_join("authors", "; ").alias("names"), F.coalesce("publication_date", F.lit("")).alias("stated"), "url", "venue", "work_type")


def parsed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources sent as the repositories of a code host."""
    repo = F.struct(
        F.concat(F.lit("owner/"), "source_id").alias("full_name"), F.col("canonical_url").alias("html_url"), F.col("organization").alias("description"), F.col("format").alias("language"), F.col("tier").alias("stargazers_count"),
        F.struct(F.when(F.col("tier") == 1, "NOASSERTION").otherwise(F.col("license")).alias("spdx_id")).alias("license"), F.array("format", "access_status").alias("topics"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.lit("owner").alias("login")).alias("owner"),
    )
    got = repositories(table(spark, sf_dir, "sources").select(F.to_json(F.struct(F.array(repo).alias("items"))).alias("payload")))
    return got.select(F.col("title"), F.col("url"), "abstract", F.coalesce("publication_date", F.lit("")).alias("stated"))


def parsed_web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates sent by a web search; those without an address are no results."""
    got = web_results(table(spark, sf_dir, "candidates").select(F.to_json(F.struct(F.array(F.struct(F.lit("").alias("title"), "url", F.col("abstract").alias("content"), F.col("publication_date").alias("published_date"))).alias("results"))).alias("payload")))
    return got.groupBy("url").agg(F.max("title").alias("title"), F.count("*").alias("n"), F.count("publication_date").alias("dated"))


def _atom(c: DataFrame) -> Column:
    who = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><name>"), _xml(a), F.lit("</name></author>"))), "")
    return F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2001.'), F.col("candidate_id").cast("string"), F.lit("v2</id><published>2020-01-02T00:00:00Z</published><title>paper\n  "), F.col("candidate_id").cast("string"), F.lit("</title>"), who,
        F.lit('<link rel="alternate" href="'), F.coalesce(_xml(F.col("url")), F.lit("")), F.lit('"/></entry></feed>'),
    )


def parsed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates sent as entries of an Atom feed: identifiers without version, times cut to days, titles on one line."""
    got = feed_entries(_titled(spark, sf_dir).select(_atom(table(spark, sf_dir, "candidates")).alias("payload")), "arxiv")
    return got.select(F.col("ids")["arxiv"].alias("arxiv"), "title", F.size(F.filter("authors", lambda a: a != "")).cast("long").alias("names"), F.col("publication_date").alias("stated"), F.coalesce("url", F.lit("")).alias("url"), "work_type")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's sitemap, made of its sources' ids."""
    loc = F.concat(F.lit("<url><loc>https://"), F.regexp_extract("canonical_url", "^[a-z]+://([^/?#]+)", 1), F.lit("/notes/item-"), F.col("source_id").cast("string"), F.lit(".html</loc></url>"))
    urls = table(spark, sf_dir, "sources").select("source_id", F.regexp_extract("canonical_url", "^[a-z]+://([^/?#]+)", 1).alias("host"), loc.alias("loc"))
    return urls.groupBy("host", F.floor(F.col("source_id") / 1000).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("loc"), ""), F.lit("</urlset>")).alias("payload"))


def parsed_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of sitemaps with titles made of their last parts."""
    return sitemap_urls(_sites(spark, sf_dir)).select("url", "title", "nested")


def feed_and_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feeds name, and what sitemaps add to it: feeds hold every third source."""
    host = F.regexp_extract("canonical_url", "^[a-z]+://([^/?#]+)", 1)
    url = F.concat(F.lit("https://"), host, F.lit("/notes/item-"), F.col("source_id").cast("string"), F.lit(".html"))
    feed = table(spark, sf_dir, "sources").where("source_id % 3 = 0").select(url.alias("url"), F.concat(F.lit("fed "), F.col("source_id").cast("string")).alias("title"))
    return extend_feed(feed, sitemap_urls(_sites(spark, sf_dir)))


def _solid(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "")


def _parsed(rows: DataFrame, path: str, content: Column) -> DataFrame:
    files = rows.select(F.concat(F.lit("file/"), F.col("id").cast("string"), F.lit(path)).alias("path"), content.cast("binary").alias("content"))
    return parse_files(files).withColumn("id", F.regexp_extract("path", r"/([0-9]+)\.", 1).cast("long"))


def parsed_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed files written as pages with menus and footers around an article, and read again."""
    body = F.array_join(F.transform("blocks.text", lambda t: F.concat(F.lit("<p>"), _xml(F.coalesce(t, F.lit(""))), F.lit("</p>"))), "\n")
    page = F.concat(F.lit("<!doctype html><html><head><title>t</title><meta name='citation_title' content='page "), F.col("id").cast("string"), F.lit("'></head><body><nav><a href='/x'>menu</a></nav><article><h1>Head</h1>"), body, F.lit("<script>var a = 1</script></article><footer>all rights</footer></body></html>"))
    got = _parsed(table(spark, sf_dir, "handler_results").withColumnRenamed("result_id", "id"), ".html", page)
    said = F.filter("blocks", lambda b: b["text"] != "Head")
    return got.select(F.col("id").alias("result_id"), F.col("metadata")["title"].alias("title"), F.size("blocks").cast("long").alias("n_blocks"), F.size("links").cast("long").alias("n_links"), F.md5(F.array_join(F.transform(said, lambda b: _solid(b["text"])), "")).alias("text_hash"))


def parsed_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as notes with two headings, read as blocks with their sections."""
    text = F.concat(F.lit("intro\n# Source "), F.col("id").cast("string"), F.lit("\nsee https://doi.org/10.5555/"), F.col("id").cast("string"), F.lit("\n## "), F.col("format"), F.lit("\nlast"))
    got = _parsed(table(spark, sf_dir, "sources").withColumnRenamed("source_id", "id"), ".md", text)
    return got.select(F.col("id").alias("source_id"), F.col("metadata")["title"].alias("title"), F.array_join(F.transform("blocks", lambda b: F.coalesce(b["section"], F.lit("-"))), "/").alias("sections"), F.array_join("refs", " ").alias("refs"))


def parsed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer written as a table of numbers, read as one block a file."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    text = F.concat(F.lit("nr,key\n"), F.array_join(F.transform("keys", lambda k, i: F.concat(i.cast("string"), F.lit(","), k.cast("string"))), "\n"))
    got = _parsed(orders, ".csv", text)
    return got.select(F.col("id").alias("custkey"), F.col("blocks")[0]["text"].alias("said"), F.size(F.col("tables")[0]).cast("long").alias("n_rows"))


def _zip(members: pd.Series) -> pd.Series:
    def pack(m: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in dict(m).items():
                z.writestr(name, data)
        return out.getvalue()

    return members.map(pack)


def _packed(**members: Column) -> Column:
    return F.pandas_udf(_zip, "binary")(F.create_map(*[x for name, text in members.items() for x in (F.lit(name), text)]))


def parsed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as documents, workbooks, books and archives, and read again by their content alone."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    w, s = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    text = lambda before, after: F.concat(F.lit(before), "name", F.lit(after))
    docx = _packed(**{"word/document.xml": text(f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Land</w:t></w:r></w:p><w:p><w:r><w:t>', "</w:t></w:r></w:p></w:body></w:document>")})
    xlsx = _packed(**{
        "xl/workbook.xml": F.lit(f'<workbook {s}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>'), "xl/_rels/workbook.xml.rels": F.lit('<Relationships><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'),
        "xl/sharedStrings.xml": text(f"<sst {s}><si><t>", "</t></si></sst>"), "xl/worksheets/sheet1.xml": F.concat(F.lit(f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>'), F.col("id").cast("string"), F.lit("</v></c></row></sheetData></worksheet>")),
    })
    epub = _packed(**{
        "mimetype": F.lit("application/epub+zip"), "META-INF/container.xml": F.lit('<container xmlns="c"><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>'),
        "o/b.opf": F.lit('<package xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>'), "o/c.xhtml": text("<html><body><h1>One</h1><p>", "</p></body></html>"),
    })
    archive = _packed(**{"a.txt": text("land ", ""), "b/c.csv": text("x,y\n1,", "\n")})
    made = [_parsed(n, ".bin", content).withColumn("kind", F.lit(kind)) for kind, content in (("docx", docx), ("xlsx", xlsx), ("epub", epub), ("zip", archive))]
    got = made[0]
    for more in made[1:]:
        got = got.unionByName(more)
    return got.select("kind", F.col("id").alias("nation"), F.col("format"), F.array_join(F.transform("blocks", lambda b: b["text"]), " / ").alias("said"), F.array_join(F.transform("blocks", lambda b: F.coalesce(b["item"], b["sheet"], b["section"], F.lit("-"))), "/").alias("places"))


def _captions(raw: pd.Series) -> pd.DataFrame:
    lines = raw.map(caption_lines)
    return pd.DataFrame({"lines": lines, "paragraphs": lines.map(paragraphs)})


def parsed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer spoken as rolling captions: every cue says the last one again, and every third twice."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    said = lambda i: F.concat(F.lit("order number "), F.get("keys", i).cast("string"))
    clock = lambda i: F.concat(F.lit("00:"), F.lpad(F.floor(i / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(".000"))
    cue = lambda i: F.concat(clock(i), F.lit(" --> "), clock(i + 1), F.lit(" align:start\n"), F.when(i > 0, F.concat(said(i - 1), F.lit(" <c>"))).otherwise(F.lit("<c>")), said(i), F.lit("</c>\n\n"))
    again = lambda i: F.when(i % 3 == 0, F.concat(clock(i), F.lit(" --> "), clock(i + 1), F.lit("\n"), said(i), F.lit("\n\n"))).otherwise(F.lit(""))
    raw = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("keys", lambda k, i: F.concat(cue(i), again(i))), ""))
    got = orders.select("custkey", F.pandas_udf(_captions, "lines array<string>, paragraphs array<string>")(raw).alias("p"))
    return got.select("custkey", F.size("p.lines").cast("long").alias("n_lines"), F.md5(F.array_join("p.lines", "\n")).alias("lines_hash"), F.size("p.paragraphs").cast("long").alias("n_paragraphs"))


def _formats(name: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([detect_format(n, bytes(d)) for n, d in zip(name, data, strict=True)])


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of parsed files by name and content; what begins like another format is that format whatever its name."""
    r = table(spark, sf_dir, "handler_results").select("result_id", F.col("format"))
    head = F.when(F.col("result_id") % 5 == 0, F.lit("%PDF-1.7")).when(F.col("result_id") % 5 == 1, F.lit("  <!DOCTYPE html><p>")).when(F.col("result_id") % 5 == 2, F.lit("WEBVTT\n")).otherwise(F.lit("plain words"))
    name = F.concat(F.lit("a."), F.when(F.col("result_id") % 2 == 0, "CSV").otherwise("md"))
    return r.select("result_id", F.pandas_udf(_formats, "string")(name, head.cast("binary")).alias("detected"))


def parsed_source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources written as a list of lines with titles, comments between them, and read again."""
    lines = table(spark, sf_dir, "sources").select(F.col("source_id").alias("line"), F.explode(F.array(F.concat(F.col("canonical_url"), F.lit(" | source "), F.col("source_id").cast("string")), F.lit("# comment"), F.lit(""))).alias("value"))
    return parse_source_list(lines).select(F.col("line").alias("source_id"), "kind", "target", "title")


def parsed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources sent by a video service."""
    item = F.struct(F.concat(F.lit("v"), "source_id").alias("id"), F.struct(F.concat(F.lit(" Talk  "), "source_id").alias("title"), F.nullif("organization", F.lit("UNKNOWN")).alias("channelTitle"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("license").alias("description")).alias("snippet"), F.struct(F.lit("PT9M").alias("duration")).alias("contentDetails"))
    got = videos(table(spark, sf_dir, "sources").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")))
    return got.select("title", F.col("publication_date").alias("stated"), "url", F.col("ids")["youtube"].alias("video"), F.size("authors").cast("long").alias("names"))


def channel_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest uploads of each host that have no parsed result yet."""
    listed = table(spark, sf_dir, "sources").select(F.regexp_extract("canonical_url", "^[a-z]+://([^/?#]+)", 1).alias("channel"), F.col("source_id").alias("video"), (-F.col("source_id")).alias("place"))
    return uploads_to_read(listed, table(spark, sf_dir, "handler_results").select(F.col("source_id").alias("video")), 3).select("channel", "video", F.col("rank").cast("long").alias("rank"))


def columns_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer set in two columns of a page, and read one column after the other."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    # 20 times the keys in either column, so a line holds the same key on both sides. The words come line by line, as a page is
    # printed, and are put together from whole arrays: a function of each word would cost more than reading it.
    lines = 20 * F.size("keys")
    each = lambda a: F.flatten(F.array_repeat(a, lines))
    text = F.flatten(F.array_repeat(F.flatten(F.transform("keys", lambda k: F.array_repeat(k.cast("string"), 2))), 20))
    top = F.flatten(F.transform(F.sequence(F.lit(0), lines - 1), lambda i: F.array(10.0 * i, 10.0 * i + 1.0)))
    words = F.arrays_zip(text.alias("text"), each(F.array(F.lit(50.0), F.lit(320.0))).alias("x0"), each(F.array(F.lit(200.0), F.lit(470.0))).alias("x1"), top.alias("top"))
    got = read_pages(orders.select("page_id", F.lit(600.0).alias("width"), words.alias("words")))
    return got.select(F.col("page_id").alias("custkey"), "gutter", F.md5("text").alias("text_hash"))


QUERIES = {q.__name__: q for q in (parsed_videos, channel_uploads, columns_read, parsed_works, parsed_items, parsed_repositories, parsed_web_results, parsed_feed, parsed_sitemaps, feed_and_sitemap, parsed_html, parsed_markdown, parsed_csv, parsed_packages, parsed_captions, detected_formats, parsed_source_list)}
_HOST = "regexp_extract(canonical_url, '^[a-z]+://([^/?#]+)', 1)"
_LINES = "SELECT o_custkey AS custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1"
SQL = {
    "parsed_videos": "SELECT 'Talk ' || source_id AS title, coalesce(strftime(retrieved_at, '%Y-%m-%d'), 'UNKNOWN') AS stated, 'https://www.youtube.com/watch?v=v' || source_id AS url, 'v' || source_id AS video, CASE WHEN organization IS NULL OR trim(organization) IN ('', 'UNKNOWN') THEN 0 ELSE 1 END AS names FROM sources",
    "channel_uploads": f"""SELECT * FROM (SELECT {_HOST} AS channel, source_id AS video, row_number() OVER (PARTITION BY {_HOST} ORDER BY source_id DESC) AS rank FROM sources WHERE source_id NOT IN (SELECT source_id FROM handler_results)) WHERE rank <= 3""",
    "columns_read": f"SELECT custkey, 260.0 AS gutter, md5(array_to_string(flatten(list_transform(range(40), lambda i: keys)), chr(10))) AS text_hash FROM ({_LINES})",
    "parsed_works": r"""SELECT 'W' || candidate_id AS work, coalesce(len(list_filter(authors, lambda a: a IS NOT NULL)), 0) AS names, coalesce(publication_date, '') AS stated, coalesce(url, 'https://doi.org/' || ids['doi'], 'https://works.example/W' || candidate_id) AS url,
md5(coalesce(trim(regexp_replace(abstract, '[ \t\r\n]+', ' ', 'g')), '')) AS abstract_hash, lower(ids['doi']) AS doi FROM candidates WHERE title IS NOT NULL""",
    "parsed_items": """SELECT '10.5/' || candidate_id AS doi, array_to_string(authors, '; ') AS names, CASE WHEN regexp_matches(publication_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN publication_date ELSE '' END AS stated, url, venue, work_type FROM candidates WHERE title IS NOT NULL""",
    "parsed_repositories": """SELECT 'owner/' || source_id AS title, canonical_url AS url, concat_ws(' | ', organization, 'language: ' || format, 'stars: ' || tier, 'licence: ' || CASE WHEN tier = 1 THEN NULL ELSE license END, 'topics: ' || format || ', ' || access_status) AS abstract,
coalesce(strftime(retrieved_at, '%Y-%m-%d'), '') AS stated FROM sources""",
    "parsed_web_results": "SELECT url, url AS title, count(*) AS n, count(publication_date) AS dated FROM candidates WHERE url <> '' GROUP BY url",
    "parsed_feed": """SELECT '2001.' || candidate_id AS arxiv, 'paper ' || candidate_id AS title, coalesce(len(list_distinct(list_transform(list_filter(authors, lambda a: trim(a) <> ''), lambda a: trim(regexp_replace(a, '[ \\s\\x{a0}]+', ' ', 'g'))))), 0) AS names, '2020-01-02' AS stated, coalesce(url, 'http://arxiv.org/abs/2001.' || candidate_id || 'v2') AS url, 'preprint' AS work_type FROM candidates WHERE title IS NOT NULL""",
    "parsed_sitemaps": f"SELECT 'https://' || {_HOST} || '/notes/item-' || source_id || '.html' AS url, 'item ' || source_id AS title, false AS nested FROM sources",
    "feed_and_sitemap": f"SELECT 'https://' || {_HOST} || '/notes/item-' || source_id || '.html' AS url, CASE WHEN source_id % 3 = 0 THEN 'fed ' ELSE 'item ' END || source_id AS title FROM sources",
    "parsed_html": r"""WITH b AS (SELECT result_id, list_filter(list_transform(blocks, lambda b: regexp_replace(coalesce(b.text, ''), '[\s\p{Z}\x1c-\x1f\x{85}\x0b]+', '', 'g')), lambda t: t <> '') AS t FROM handler_results)
SELECT result_id, 'page ' || result_id AS title, coalesce(len(t), 0) + 1 AS n_blocks, 0 AS n_links, md5(array_to_string(coalesce(t, []), '')) AS text_hash FROM b""",
    "parsed_markdown": "SELECT source_id, 'Source ' || source_id AS title, '-/Source ' || source_id || '/' || format AS sections, 'doi:10.5555/' || source_id AS refs FROM sources",
    "parsed_csv": f"SELECT custkey, 'nr | key' || chr(10) || array_to_string(list_transform(keys, lambda k, i: (i - 1) || ' | ' || k), chr(10)) AS said, len(keys) + 1 AS n_rows FROM ({_LINES})",
    "parsed_packages": """SELECT unnest(['docx', 'xlsx', 'epub', 'zip']) AS kind, n_nationkey AS nation, unnest(['docx', 'xlsx', 'epub', 'zip']) AS format,
unnest(['Land / ' || n_name, n_name || ' | ' || n_nationkey, 'One / ' || n_name, 'land ' || n_name || ' / x | y' || chr(10) || '1 | ' || n_name]) AS said, unnest(['Land/Land', 'One', 'c.xhtml/c.xhtml', 'a.txt/b/c.csv']) AS places FROM nation""",
    "parsed_captions": f"""WITH k AS ({_LINES}), l AS (SELECT custkey, list_transform(keys, lambda k, i: '[t=00:' || lpad(CAST((i - 1) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0') || '] order number ' || k) AS lines FROM k)
SELECT custkey, len(lines) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_hash, ceil(len(lines) / ceil(1200 / (length(lines[1]) + 1.0)))::BIGINT AS n_paragraphs FROM l""",
    "detected_formats": "SELECT result_id, CASE result_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'vtt' ELSE CASE WHEN result_id % 2 = 0 THEN 'csv' ELSE 'md' END END AS detected FROM handler_results",
    "parsed_source_list": "SELECT source_id, 'url' AS kind, canonical_url AS target, 'source ' || source_id AS title FROM sources",
}
