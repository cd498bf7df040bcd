"""Main content of web pages that arrive as blocks of lines, without markup.

A page is read as a tree: the page, its regions (what no furniture line interrupts), their groups (runs of paragraphs, and
of short lines), lines. Each paragraph passes points for length and commas to its group, half of them to the region and a
quarter to the regions beside it; every container's points are discounted by its link density. The region with most
points is kept with those siblings that score well by themselves, and with the headings and lists between kept
paragraphs. What counts as link text is learned from the pages at hand, not listed: lines that recur over a site or over
many sites, and what stands behind those that introduce lists of links. Recurring headings are told from furniture by
what follows them, which is text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import written

SENTENCE_END = re.compile(r"[.!?…。！？][\"”’»)\]]*$")
SPLIT_PARTS = re.compile(r" ?[|/·>»›•] ?|\s{2,}")
BULLET = re.compile(r"^[\-–•*»>›→]+\s*")
EASTERN = re.compile(r"[぀-ヿ一-鿿]")
PAGE_SCHEMA = "result_id long, block_index int, line_index int, text string, main boolean"
SEEN_SCHEMA = "host string, page string, key string, n int, followed int, leads int"
LONGEST_LABEL, SHORT_COST = 8, 0.5


def line_key(line: str, site: str) -> str:
    """Form in which lines are compared: lower case, numbers as #, the site's name as <site>."""
    key = re.sub(r"\d+", "#", " ".join(line.split()).lower())
    return key.replace(site.lower(), "<site>") if site else key


def _site(host: str | None) -> str:
    parts = (host or "").split(".")
    return parts[-2] if len(parts) > 1 else parts[0]


def is_paragraph(text: str) -> bool:
    words = len(text.split())
    if SENTENCE_END.search(text) and (words >= 6 or len(EASTERN.findall(text)) >= 12):
        return not re.match(r"^[\-–•*] ", text) or words >= 12
    return len(text) >= 220


def points(text: str) -> float:
    """What a paragraph is worth: one for itself, its commas, and up to three for its length."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)


def body(texts: list[str], paras: list[bool]) -> tuple[int, int]:
    """[start, end) of the stretch with most points, where every line that is no paragraph costs SHORT_COST."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, (t, p) in enumerate(zip(texts, paras, strict=True)):
        if total <= 0:
            total, begin = 0.0, i
        total += points(t) if p else -SHORT_COST
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def key_forms(key: str) -> list[str]:
    """The forms under which a line may recur: whole, and as a lead before a colon."""
    forms = [BULLET.sub("", key) or key]
    head, colon, rest = key.partition(":")
    if colon and rest and len(head.split()) <= 4 and not re.search(r"[.!。！]$", key):
        forms.append(head.strip() + " :")
    return forms


def contexts(lines: list[str], host: str | None) -> dict[str, list[int]]:
    """For each key form of a page's non-blank lines: how often it occurs, how often text follows it (a paragraph or a list),
    and how often link-like lines do (two short ones without an end)."""
    site = _site(host)
    texts = [" ".join(line.split()) for line in lines]
    paras = [is_paragraph(t) for t in texts]
    out: dict[str, list[int]] = {}
    for i, (t, p) in enumerate(zip(texts, paras, strict=True)):
        text_next = i + 1 < len(texts) and (paras[i + 1] or texts[i + 1][:2] in ("- ", "• ", "* "))
        links = i + 1 < len(texts) and not any(SENTENCE_END.search(x) and not x.endswith("?") or len(x.split()) < 3 for x in texts[i + 1 : i + 3]) and not text_next and len(t.split()) <= LONGEST_LABEL
        for form in key_forms(line_key(t, site)):
            seen = out.setdefault(form, [0, 0, 0])
            for k, fact in enumerate((True, text_next, links)):
                seen[k] += fact
    return out


# How pages mark adverts. They stand anywhere between paragraphs, so their place does not tell them from headings.
ADVERTS = frozenset(("advertisement", "sponsored content", "continue after the advert", "anzeige", "werbung", "publicidad", "publicité"))


class Furniture:
    """What is known of a page's lines beforehand: keys that recur, and those of them that introduce lists of links."""

    def __init__(self, keys: frozenset[str] = frozenset(), labels: frozenset[str] = frozenset(), adverts: frozenset[str] = ADVERTS) -> None:
        self.keys, self.labels, self.adverts = keys, labels, adverts

    def made_of(self, key: str) -> bool:
        """Whether a line is several known ones beside each other."""
        words = re.sub(r"[|/·,>»›•]", " ", key).split()
        reach = {0}
        for end in range(1, len(words) + 1):
            if any(start in reach and " ".join(words[start:end]) in self.keys for start in range(max(0, end - 6), end)):
                reach.add(end)
        return len(words) in reach and len(words) > 1

    def kind(self, line: str, key: str) -> str:
        """'label' of a link list, 'nav' (the site's name or navigation), 'known', 'inline' (an advert's mark or a single link
        between paragraphs) or '' (perhaps content)."""
        bare, *parts = key_forms(key)
        if bare in self.labels:
            return "label"
        if bare == "<site>" or re.match(r"<site> [–—|-] ", bare):
            return "nav"
        if bare in self.adverts or any(p in self.keys for p in parts if p.endswith(" :")):
            return "inline"
        if bare in self.keys or any(p in self.keys for p in parts):
            return "known"
        if not SENTENCE_END.search(bare):
            pieces = [p for p in SPLIT_PARTS.split(line.strip().lower() if "  " in line.strip() else key) if p]
            if len(pieces) >= 3 and (" > " in key or max(len(p.split()) for p in pieces) <= 3):
                return "nav"
        return "known" if self.made_of(bare) else ""


def _same(a: str, b: str) -> bool:
    """Whether ``a`` is the title ``b``, perhaps cut short."""
    norm = lambda s: re.sub(r"[\W_]+", "", s.lower())
    a, b = norm(a), norm(b)
    return bool(a) and (a == b or (len(a) >= 20 and b.startswith(a)) or (len(b) >= 20 and a.startswith(b)))


def container_scores(texts: list[str], paras: list[bool], links: list[bool], region: list[int]) -> tuple[list[float], list[float]]:
    """(score of each line's group, score of each region). A group is a run of lines of one region that are alike in being
    paragraphs and in being links. It passes half of its points to its region and a quarter to the regions beside it;
    a region's points are discounted by its link density, and a group's score is its region's, discounted by its own."""
    count = region[-1] + 1 if region else 0
    own, chars, linked = [0.0] * count, [1e-9] * count, [0.0] * count
    density = [0.0] * len(texts)
    i = 0
    while i < len(texts):
        j = i
        while j < len(texts) and (region[j], paras[j], links[j]) == (region[i], paras[i], links[i]):
            j += 1
        size = sum(len(t) for t in texts[i:j])
        link_chars = sum(len(t) for t, k in zip(texts[i:j], links[i:j], strict=True) if k)
        density[i:j] = [link_chars / size if size else 0.0] * (j - i)
        own[region[i]] += sum(points(t) for t, p in zip(texts[i:j], paras[i:j], strict=True) if p) * (1 - density[i])
        chars[region[i]] += size
        linked[region[i]] += link_chars
        i = j
    own = [p / 2 for p in own]
    regions = [(p + sum(own[max(0, c - 1) : c] + own[c + 1 : c + 2]) / 2) * (1 - k / n) for c, (p, k, n) in enumerate(zip(own, linked, chars, strict=True))]
    return [regions[r] * (1 - d) for r, d in zip(region, density, strict=True)], regions


def main_lines(lines: list[str], host: str | None, title: str | None, furniture: Furniture, sibling_share: float = 0.1) -> list[bool]:
    """For each of a page's non-blank lines, in order, whether it is main content."""
    site, n = _site(host), len(lines)
    texts = [" ".join(line.split()) for line in lines]
    keys = [line_key(line, site) for line in lines]
    shaped = [is_paragraph(t) for t in texts]
    kinds = [furniture.kind(line, k) for line, k in zip(lines, keys, strict=True)]
    crumb = next((t.rsplit(" > ", 1)[1] for t, k in zip(texts, kinds, strict=True) if k == "nav" and " > " in t), None)
    start, end = body(texts, [p and not k for p, k in zip(shaped, kinds, strict=True)])

    # The title: the metadata's, else what the breadcrumb ends with.
    own = None
    for wanted in (title if title and title != "UNKNOWN" else None, crumb):
        if own is None and wanted:
            own = next((i for i in range(n) if kinds[i] != "nav" and _same(texts[i], wanted)), None)
    if own is None:
        own = next((i for i in range(start + 1 if end else n) if texts[i] == "UNKNOWN"), None)
    if own is not None:
        kinds[own] = ""
    paras = [p and not k for p, k in zip(shaped, kinds, strict=True)]
    first = next((i for i in range(n) if paras[i]), n)

    # Containers of links: a label and the short lines behind it, until a paragraph, the title or other furniture.
    box = [False] * n
    i = 0
    while i < n:
        if kinds[i] != "label":
            i += 1
            continue
        j = i + 1
        more = any(paras[j:])
        while j < n and not kinds[j] and not paras[j] and j != own:
            numbered = re.match(r"^\d+[.)] ", texts[j])
            if more and own is not None and i > own and not numbered and j > i + 2 and (len(texts[j].split()) <= 4 or texts[j][:2] == "- "):
                break
            box[j] = True
            j += 1
        if own is None and i < first and j > i + 2:
            # Before an unmarked title: the list's last long lines include the title itself.
            tail = [k for k in range(i + 1, j) if len(texts[k].split()) >= 4 or texts[k] == "UNKNOWN"]
            if tail:
                own = tail[-1]
                for k in range(own, j):
                    box[k] = False
        i = j
    if own is None:
        own = next((i for i in range(first) if not kinds[i] and not box[i] and len(texts[i].split()) >= 4), None)

    # Regions: cut where links begin or end, but for single ones between paragraphs, and at the title.
    links = [bool(k) or b for k, b in zip(kinds, box, strict=True)]
    region, count = [], 0
    for i in range(n):
        if i and ((links[i] and kinds[i] != "inline") != (links[i - 1] and kinds[i - 1] != "inline") or i == own):
            count += 1
        region.append(count)
    scores, regions = container_scores(texts, paras, links, region)
    best = max(regions, default=0.0)
    text = [False] * (count + 1)
    for i in range(n):
        text[region[i]] |= paras[i]
    kept = [i for i in range(n) if paras[i] and scores[i] >= sibling_share * best]
    if best <= 0 or not kept:  # no paragraph at all: the title, and what stands behind it in its own region
        return [own is not None and i >= own and region[i] == region[own] and not links[i] for i in range(n)]
    begin, last = own if own is not None and own <= kept[0] else kept[0], kept[-1]
    # The best region, siblings that score well themselves, and between them what has neither points nor links.
    keep = lambda i: scores[i] >= sibling_share * best and scores[i] > 0 and text[region[i]] or not text[region[i]] and not links[i] and i < last or i == own
    return [begin <= i and (i <= last or region[i] == region[last]) and keep(i) for i in range(n)]


def _pages_of(batch: pd.DataFrame) -> Iterator[tuple]:
    for r in batch.itertuples(index=False):
        place, lines = [], []
        for b, text in enumerate(r.texts if r.texts is not None else ()):
            for k, line in enumerate((text or "").split("\n")):
                if line.strip():
                    place.append((b, k))
                    lines.append(line)
        yield r, place, lines


PAGE_KEY = "\0page"  # stands once for each page, to count them


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r, _, lines in _pages_of(pdf):
            page = hashlib.md5("".join("".join(lines).split()).encode(), usedforsecurity=False).hexdigest()[:16]  # a page fetched twice is one
            rows.append((r.host or "", page, PAGE_KEY, 1, 0, 0))
            rows += [(r.host or "", page, key, *facts) for key, facts in contexts(lines, r.host).items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEEN_SCHEMA.split(", ")])


# Fixed values of the learned lists. A key recurs over sites from this many on and this share of all; within a site from this
# many pages on and this share of its pages. It is furniture where text follows less often than this (two occurrences of
# either kind are added, so that few prove nothing), or less often than that where it is on this share of a mean site's pages.
# A label is furniture that link-like lines follow this often.
LEAST_SITES, SITES_SHARE, LEAST_PAGES, SITE_SHARE, MOST_FOLLOWED, WIDE, WIDE_FOLLOWED, LEAST_LEADS = 3, 0.01, 2, 0.25, 0.35, 0.4, 0.85, 0.5


def known_furniture(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, labels) of what recurs over sites, one row, and (host, keys, labels) of what recurs within a site and not over
    sites, one row a host. Counted over all pages; pages of one text on one host count once.

    The first has at most 1 / SITES_SHARE times the keys of a mean site, whatever the number of sites, and a host's row in
    the second at most 1 / SITE_SHARE times the lines of its mean page, whatever the number of pages.
    """
    facts = ("n", "followed", "leads")
    seen = pages.mapInPandas(_seen, SEEN_SCHEMA).groupBy("host", "page", "key").agg(*[F.max(c).alias(c) for c in facts])
    by_host = written(seen.groupBy("host", "key").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in facts]))
    sizes = by_host.where(F.col("key") == PAGE_KEY).select("host", F.col("pages").alias("size"))
    keyed = by_host.where(F.col("key") != PAGE_KEY).join(sizes, "host")
    share = F.when(F.col("pages") > 1, F.col("pages") / F.col("size")).otherwise(0.0)
    over = written(keyed.groupBy("key").agg(F.count_if(F.col("host") != "").alias("sites"), F.avg(share).alias("wide"), *[F.sum(c).alias(c) for c in facts]))
    least = max(LEAST_SITES, SITES_SHARE * sizes.count())
    paragraph = F.col("key").rlike(r"[.!?…。！？][\"”’»)\]]*$") & ((F.size(F.split("key", " ")) >= 6) | (F.length(F.regexp_replace("key", r"[^\u3040-\u30ff\u4e00-\u9fff]", "")) >= 12))
    followed = (F.col("followed") + 2) / (F.col("n") + 4)

    def gathered(keys: DataFrame, *by: str) -> DataFrame:
        lead = F.col("key").endswith(" :")
        label = ~lead & (F.col("leads") / F.col("n") >= LEAST_LEADS)
        return keys.where(lead | paragraph | (followed < F.when(F.col("wide") >= WIDE, WIDE_FOLLOWED).otherwise(MOST_FOLLOWED))).groupBy(*by).agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(label, F.col("key"))).alias("labels"))

    common = over.where(F.col("sites") >= least)
    recurs = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("size") * SITE_SHARE) & (F.col("host") != "")
    own = keyed.where(recurs).withColumn("wide", F.when(F.col("pages") > 2, F.col("pages") / F.col("size")).otherwise(0.0)).join(common.select("key"), "key", "left_anti")
    return gathered(common), gathered(own, "host")


def page_lines(pages: DataFrame, adverts: frozenset[str] = ADVERTS) -> DataFrame:
    """Every non-blank line of web pages with ``main``: whether it belongs to the article.

    ``pages``: result_id, host, title, texts (array<string>, block texts in order). Columns out: result_id, block_index,
    line_index, text, main. Null hosts and titles are allowed; null or empty blocks give no lines, but count in the
    positions; a page given twice gives its lines twice; an empty table gives no rows; other columns are ignored. Very
    long pages are read whole. Each page is judged alone, with what is known of its site and of all sites.
    """
    pages = pages.select("result_id", "host", "title", "texts")
    common, own = known_furniture(pages)
    shared = common.toPandas()  # one row of bounded size
    keys, labels = (frozenset(shared[c][0]) if len(shared) else frozenset() for c in ("keys", "labels"))
    sent = pages.sparkSession.sparkContext.broadcast((keys, labels))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, labels = sent.value
        furniture: dict[str | None, Furniture] = {}
        for pdf in batches:
            rows = []
            for r, place, lines in _pages_of(pdf):
                if r.host not in furniture:
                    if len(furniture) > 1000:
                        furniture.clear()
                    own = r.keys is not None
                    furniture[r.host] = Furniture(keys.union(r.keys) if own else keys, labels.union(r.labels) if own else labels, adverts)
                rows += [(r.result_id, b, k, line, main) for (b, k), line, main in zip(place, lines, main_lines(lines, r.host, r.title, furniture[r.host]), strict=True)]
            yield pd.DataFrame(rows, columns=["result_id", "block_index", "line_index", "text", "main"])

    return pages.join(written(own), "host", "left").select("result_id", "host", "title", "texts", "keys", "labels").mapInPandas(judge, PAGE_SCHEMA)


def main_text(pages: DataFrame) -> DataFrame:
    """result_id and the article's own text, lines joined by newlines; pages without an article give no row."""
    kept = page_lines(pages).where("main").select("result_id", F.struct("block_index", "line_index", "text").alias("line"))
    lines = F.array_sort(F.collect_list("line"))
    return kept.groupBy("result_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("main_text"))
