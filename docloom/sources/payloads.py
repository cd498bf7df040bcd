"""Answers of search services as candidates: connector, title, authors, publication_date, url, pdf_url, abstract, venue,
work_type, ids. JSON is taken apart by built-in expressions; feeds, which mix namespaces, by an Arrow UDF."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = "title:string,authors:array<string>,publication_date:string,url:string,pdf_url:string,abstract:string,venue:string,work_type:string,ids:map<string,string>"


def clean(text: Column) -> Column:
    """Without tags, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def doi_of(text: Column) -> Column:
    """A bare DOI in lower case, null where the text is none."""
    d = F.lower(F.regexp_replace(F.trim(text), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(d.startswith("10."), d)


def abstract_of_index(index: Column) -> Column:
    """Text of an inverted index map<word, array<position>>, ordered by position and word."""
    spread = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(spread), lambda x: x["word"]), " ")


def partial_date(parts: Column) -> Column:
    """'YYYY', 'YYYY-MM' or 'YYYY-MM-DD' of date parts, zero-padded."""
    return F.array_join(F.transform(parts, lambda p, i: F.lpad(p.cast("string"), F.when(i == 0, 4).otherwise(2), F.lit("0"))), "-")


def _ids(**known: Column) -> Column:
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in known.items()]), lambda p: p["value"].isNotNull() & (p["value"] != ""))
    return F.map_from_entries(pairs)


def works(payloads: DataFrame) -> DataFrame:
    """Candidates of a catalogue of works (column payload: JSON with results[])."""
    schema = "results array<struct<id:string,doi:string,display_name:string,publication_date:string,type:string,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>,best_oa_location:struct<pdf_url:string>,abstract_inverted_index:map<string,array<int>>>>"
    w = payloads.select(F.explode(F.from_json("payload", schema)["results"]).alias("w"))
    who = F.filter(F.transform("w.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    return w.select(
        F.lit("openalex").alias("connector"), clean(F.col("w.display_name")).alias("title"), who.alias("authors"), F.col("w.publication_date"),
        F.coalesce("w.primary_location.landing_page_url", "w.doi", "w.id").alias("url"), F.coalesce("w.best_oa_location.pdf_url", "w.primary_location.pdf_url").alias("pdf_url"),
        abstract_of_index(F.col("w.abstract_inverted_index")).alias("abstract"), F.col("w.primary_location.source.display_name").alias("venue"), F.col("w.type").alias("work_type"),
        _ids(doi=doi_of(F.col("w.doi")), openalex=F.regexp_extract("w.id", r"(W\d+)$", 1)).alias("ids"),
    ).where("title <> ''")


def items(payloads: DataFrame) -> DataFrame:
    """Candidates of a registry of DOIs (column payload: JSON with message.items[])."""
    schema = "message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,URL:string,`container-title`:array<string>,abstract:string,type:string,link:array<struct<URL:string,`content-type`:string>>>>>"
    w = payloads.select(F.explode(F.from_json("payload", schema)["message"]["items"]).alias("w"))
    who = F.filter(F.transform("w.author", lambda a: F.coalesce(F.nullif(F.concat_ws(" ", a["given"], a["family"]), F.lit("")), a["name"])), lambda n: n.isNotNull())
    pdf = F.get(F.filter("w.link", lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    parts = F.filter(F.get(F.col("w.issued.`date-parts`"), F.lit(0)), lambda p: p.isNotNull())
    return w.select(
        F.lit("crossref").alias("connector"), clean(F.get("w.title", F.lit(0))).alias("title"), who.alias("authors"), F.nullif(partial_date(parts), F.lit("")).alias("publication_date"), F.col("w.URL").alias("url"),
        pdf.alias("pdf_url"), clean(F.col("w.abstract")).alias("abstract"), F.get(F.col("w.`container-title`"), F.lit(0)).alias("venue"), F.col("w.type").alias("work_type"), _ids(doi=doi_of(F.col("w.DOI"))).alias("ids"),
    ).where("title <> ''")


def repositories(payloads: DataFrame) -> DataFrame:
    """Candidates of a code host's search (column payload: JSON with items[]); what describes a repository is its abstract."""
    schema = "items array<struct<full_name:string,html_url:string,description:string,language:string,stargazers_count:int,license:struct<spdx_id:string>,topics:array<string>,created_at:string,pushed_at:string,owner:struct<login:string>>>"
    w = payloads.select(F.explode(F.from_json("payload", schema)["items"]).alias("w"))
    about = F.concat_ws(" | ", "w.description", F.concat(F.lit("language: "), "w.language"), F.concat(F.lit("stars: "), F.col("w.stargazers_count").cast("string")), F.concat(F.lit("licence: "), F.nullif("w.license.spdx_id", F.lit("NOASSERTION"))), F.concat(F.lit("topics: "), F.nullif(F.array_join("w.topics", ", "), F.lit(""))))
    none = lambda: F.lit(None).cast("string")
    return w.select(F.lit("github").alias("connector"), F.col("w.full_name").alias("title"), F.array_compact(F.array("w.owner.login")).alias("authors"), F.substring("w.created_at", 1, 10).alias("publication_date"), F.col("w.html_url").alias("url"), none().alias("pdf_url"), about.alias("abstract"), none().alias("venue"), F.lit("repository").alias("work_type"), _ids(github=F.col("w.full_name")).alias("ids"))


def web_results(payloads: DataFrame) -> DataFrame:
    """Candidates of a web search (column payload: JSON with results[]); rows without a url are dropped."""
    w = payloads.select(F.explode(F.from_json("payload", "results array<struct<title:string,url:string,content:string,published_date:string>>")["results"]).alias("w"))
    none = lambda kind: F.lit(None).cast(kind)
    return w.where("w.url IS NOT NULL AND w.url <> ''").select(F.lit("web_search").alias("connector"), F.coalesce(F.nullif(clean(F.col("w.title")), F.lit("")), F.col("w.url")).alias("title"), none("array<string>").alias("authors"), F.col("w.published_date").alias("publication_date"), F.col("w.url").alias("url"), none("string").alias("pdf_url"), clean(F.col("w.content")).alias("abstract"), none("string").alias("venue"), F.lit("web-page").alias("work_type"), F.create_map().cast("map<string,string>").alias("ids"))


def _name(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1].lower()


def _texts(el: ET.Element, *names: str) -> list[str]:
    for name in names:
        found = [" ".join("".join(c.itertext()).split()) for c in el if _name(c) == name]
        if any(found):
            return [f for f in found if f]
    return []


def _plain(text: str) -> str:
    return " ".join(re.sub(r"<[^>]*>", " ", html.unescape(text)).split())


def parse_feed(payload: str | None) -> list[dict]:
    """Entries of an RSS or Atom feed; unreadable feeds and feeds that declare entities have none."""
    if not payload or re.search(r"<!ENTITY", payload, re.I):
        return []
    try:
        root = ET.fromstring(payload.strip().encode())
    except ET.ParseError:
        return []
    out = []
    for e in [x for x in root.iter() if _name(x) == "item"] or [x for x in root.iter() if _name(x) == "entry"]:
        links = {(c.get("rel") or "alternate", c.get("title") or ""): c.get("href") for c in e if _name(c) == "link" and c.get("href")}
        url = next((c.text.strip() for c in e if _name(c) == "link" and c.text and c.text.strip()), None) or next((h for (rel, _), h in links.items() if rel == "alternate"), None)
        authors = [n for c in e if _name(c) == "author" for n in (_texts(c, "name") or _texts(e, "author"))] or _texts(e, "creator")
        key = (_texts(e, "id", "guid") or [""])[0]
        arxiv = re.search(r"arxiv\.org/abs/(.+?)(?:v\d+)?$", key)
        doi = next((d for d in _texts(e, "doi")), None)
        title = _plain((_texts(e, "title") or [""])[0])
        if title:
            out.append({"title": title, "authors": list(dict.fromkeys(authors)), "publication_date": (_texts(e, "published", "pubdate", "date", "updated") or [None])[0], "url": url or (key if key.startswith("http") else None), "pdf_url": next((h for (rel, t), h in links.items() if t == "pdf" or (h or "").endswith(".pdf")), None), "abstract": _plain((_texts(e, "summary", "description", "content", "encoded") or [""])[0]), "venue": None, "work_type": "preprint" if arxiv else "feed-item", "ids": {k: v for k, v in (("arxiv", arxiv and arxiv[1]), ("doi", doi and doi.lower())) if v}})
    return out


def _feed(payload: pd.Series) -> pd.Series:
    return payload.map(parse_feed)


def feed_entries(payloads: DataFrame, connector: str = "rss") -> DataFrame:
    """Candidates of RSS and Atom feeds (column payload: XML)."""
    e = payloads.select(F.explode(F.pandas_udf(_feed, f"array<struct<{CANDIDATE}>>")("payload")).alias("e"))
    date = F.when(F.col("e.publication_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("e.publication_date", 1, 10)).otherwise(F.col("e.publication_date"))
    return e.select(F.lit(connector).alias("connector"), "e.title", "e.authors", date.alias("publication_date"), "e.url", "e.pdf_url", "e.abstract", "e.venue", "e.work_type", "e.ids")


def _sitemap(payload: pd.Series) -> pd.Series:
    def read(text: str | None) -> list[dict]:
        if not text or re.search(r"<!ENTITY", text, re.I):
            return []
        try:
            root = ET.fromstring(text.strip().encode())
        except ET.ParseError:
            return []
        nested = _name(root) == "sitemapindex"
        return [{"url": u[0], "lastmod": (_texts(e, "lastmod") or [None])[0], "nested": nested} for e in root if (u := _texts(e, "loc"))]

    return payload.map(read)


def sitemap_urls(payloads: DataFrame, prefix: str = "") -> DataFrame:
    """(url, lastmod, nested, title) of sitemaps, those below ``prefix`` only; titles are made from the last path part."""
    u = payloads.select(F.explode(F.pandas_udf(_sitemap, "array<struct<url:string,lastmod:string,nested:boolean>>")("payload")).alias("u")).select("u.*").where(F.col("url").startswith(prefix))
    slug = F.regexp_extract("url", r"/([^/?#]+?)(?:\.\w{2,5})?/?(?:[?#].*)?$", 1)
    return u.withColumn("title", F.trim(F.regexp_replace(slug, r"[-_+]+", " ")))


def extend_feed(feed: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Feed urls, and those of the sitemap that the feed lacks and whose title has two words or more."""
    more = sitemap.where("NOT nested AND size(split(title, ' ')) >= 2").join(feed.select("url"), "url", "left_anti")
    return feed.select("url", "title").unionByName(more.select("url", "title"))


def videos(payloads: DataFrame) -> DataFrame:
    """Candidates of a video service (column payload: JSON with items[]); descriptions stay as written, so that links survive."""
    schema = "items array<struct<id:string,snippet:struct<title:string,channelTitle:string,publishedAt:string,description:string>,contentDetails:struct<duration:string>>>"
    w = payloads.select(F.explode(F.from_json("payload", schema)["items"]).alias("w")).where("w.id <> ''")
    channel, known = F.nullif(clean(F.col("w.snippet.channelTitle")), F.lit("")), lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN"))
    return w.select(
        F.lit("youtube").alias("connector"), known(clean(F.col("w.snippet.title"))).alias("title"), F.array_compact(F.array(channel)).alias("authors"), known(F.substring("w.snippet.publishedAt", 1, 10)).alias("publication_date"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), "w.id").alias("url"), F.lit(None).cast("string").alias("pdf_url"), F.nullif(F.trim("w.snippet.description"), F.lit("")).alias("abstract"), F.coalesce(F.concat(F.lit("YouTube: "), channel), F.lit("YouTube")).alias("venue"),
        F.lit("video").alias("work_type"), _ids(youtube=F.col("w.id"), duration=F.col("w.contentDetails.duration")).alias("ids"),
    )


def uploads_to_read(listed: DataFrame, read: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` uploads of each channel that were not read: listed (channel, video, place), read (video)."""
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("place"))
    first = listed.groupBy("channel", "video").agg(F.min("place").alias("place"))
    return first.join(read.select("video").distinct(), "video", "left_anti").withColumn("rank", rank).where(F.col("rank") <= n).select("channel", "video", "rank")
