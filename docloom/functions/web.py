"""Expressions on requests, answers and what is written for people; null gives null where nothing else is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, equal to those whose results are matched: headers that carry credentials, key shapes, wording of barriers,
# groups of exchangeable search terms.
CREDENTIALS = ["authorization", "proxy-authorization", "x-api-key", "x-auth-token"]
SECRETS = (r"(?i)(bearer\s+)[a-z0-9._\-]{8,}", r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s&\"']+", r"()\bsk-[A-Za-z0-9_\-]{10,}")
CAPTCHA, PAYWALL, LOGIN = r"(?i)captcha|are you a robot|verify you are human|unusual traffic", r"(?i)subscribe to (?:continue|read)|this (?:article|content) is for subscribers|purchase access|paywall", r"(?i)/(?:login|signin|sign-in|sso|auth|account/login)(?:/|$)"
TERMS = (
    ("momentum", "relative strength", "return continuation", "time-series momentum", "trend following"), ("mean reversion", "short-term reversal", "return reversal", "overreaction"), ("carry", "carry trade", "interest rate differential"),
    ("volatility risk premium", "variance risk premium", "implied minus realized volatility"), ("seasonality", "calendar anomaly", "intraday periodicity"), ("pairs trading", "statistical arbitrage", "cointegration trading"),
    ("breakout", "channel breakout", "range breakout"), ("funding rate", "perpetual funding", "funding premium"),
)


def access_barrier(status: Column, asked: Column, final: Column, head: Column) -> Column:
    """What stands between the reader and the content, the first that applies; null where it is open."""
    path = lambda u: F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    moved = (asked != final) & path(final).rlike(LOGIN) & ~path(asked).rlike(LOGIN)
    head = F.coalesce(head, F.lit(""))
    return (
        F.when(status.isin(401, 407), "ACCESS_RESTRICTED").when(status == 402, "PAYWALLED").when(head.rlike(CAPTCHA), "MANUAL_ACCESS_REQUIRED")
        .when(status == 403, "ACCESS_RESTRICTED").when(moved, "ACCESS_RESTRICTED").when(head.rlike(PAYWALL), "PAYWALLED")
    )


def request_class(url: Column, headers: Column, content_type: Column) -> Column:
    """SENSITIVE_AUTH, SESSION_PRIVATE, PUBLIC_API, PUBLIC_STATIC or UNKNOWN; ``headers`` is a map or null."""
    names = F.transform(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), lambda h: F.lower(h))
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    static = kind.rlike(r"^(?:text/|application/(?:pdf|xml|rss|atom|epub|vnd\.openxmlformats))") | (kind == "")
    return F.when(F.arrays_overlap(names, F.array(*map(F.lit, CREDENTIALS))), "SENSITIVE_AUTH").when(F.array_contains(names, "cookie"), "SESSION_PRIVATE").when(kind.contains("json") | path.contains("graphql") | path.contains("/api/"), "PUBLIC_API").when(static, "PUBLIC_STATIC").otherwise("UNKNOWN")


def redacted(text: Column) -> Column:
    """``text`` without what looks like a key, token or password."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]")
    return text


def redacted_headers(headers: Column) -> Column:
    """Header map with the values of credentials and cookies hidden."""
    hide = lambda k: F.lower(k).rlike(r"authorization|api-?key|token|secret|cookie")
    return F.transform_values(headers, lambda k, v: F.when(hide(k), F.lit("[REDACTED]")).otherwise(v))


def wrapped(text: Column, source: Column) -> Column:
    """``text`` between marks with a hash of itself, which it cannot contain and so cannot forge."""
    nonce = F.substring(F.sha2(F.concat(source, F.lit("\x00"), text), 256), 1, 16)
    return F.concat(F.lit("<<untrusted "), nonce, F.lit(">>\n"), text, F.lit("\n<<end "), nonce, F.lit(">>"))


def retry_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header, as a number or an HTTP date; never negative, null where unreadable."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(header, r"^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0), F.coalesce(F.trim(header).try_cast("long"), F.unix_timestamp(date) - F.unix_timestamp(now)))


def markdown(text: Column) -> Column:
    """``text`` on one line with everything escaped that Markdown or HTML would read."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(one, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), r"([\\`*_\[\]|#])", r"\\$1")


def safe_name(text: Column, longest: int = 80) -> Column:
    """A file name made of ``text``; 'untitled' where nothing is left."""
    bare = F.trim(F.substring(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " "), 1, longest))
    bare = F.regexp_replace(bare, r"^\.+|[. ]+$", "")
    return F.when(bare == "", "untitled").otherwise(bare)


def title_of_url(url: Column) -> Column:
    """Words of the last part of a url's path; null where it has none."""
    last = F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"([^/]+?)(?:\.[A-Za-z]{2,5})?/?$", 1)
    words = F.trim(F.regexp_replace(last, r"[-_+]+|%20", " "))
    return F.when(words != "", words)


def query_key(query: Column) -> Column:
    """Words of a search, case and punctuation ignored."""
    return F.array_join(F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9]+)"), 1), " ")


def query_hash(connector: Column, query: Column) -> Column:
    return F.sha2(F.concat(connector, F.lit("|"), query_key(query)), 256)


def query_variants(query: Column, most: int = 3) -> Column:
    """The query and at most ``most`` variants with a term replaced by others of its group."""

    def replaced(group: tuple) -> Column:
        hit = F.coalesce(*[F.when(F.lower(query).contains(t), F.lit(t)) for t in group])
        others = F.filter(F.array(*map(F.lit, group)), lambda t: t != hit)
        made = F.transform(others, lambda t: F.regexp_replace(query, F.concat(F.lit("(?i)\\Q"), hit, F.lit("\\E")), t))
        return F.when(hit.isNotNull(), made).otherwise(F.array().cast("array<string>"))

    return F.slice(F.concat(F.array(query), *map(replaced, TERMS)), 1, most + 1)


def answer_json(text: Column) -> Column:
    """The JSON object in a model's answer: inside a fence, else between the outer braces; stray backslashes doubled."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braced, F.lit("")))
    return F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
