"""URL expressions; every one maps null to null and never raises."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column | str) -> Column:
    """Host in lower case without credentials, port or trailing dot; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "_hsenc", "_hsmi", "si"]


def _unquoted(path: Column) -> Column:
    """Escapes in one form: hexadecimal digits in capitals, and signs that need no escape written plainly."""
    upper = F.regexp_replace(path, r"%([0-9A-Fa-f]{2})", "\x01$1\x02")
    pieces = F.split(upper, "\x01")

    def piece(p: Column) -> Column:
        code, rest = F.upper(F.substring_index(p, "\x02", 1)), F.substring(p, F.instr(p, "\x02") + 1, F.length(p))
        sign = F.chr(F.conv(code, 16, 10).cast("long"))
        return F.when(F.instr(p, "\x02") == 0, p).when(sign.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(sign, rest)).otherwise(F.concat(F.lit("%"), code, rest))

    return F.array_join(F.transform(pieces, piece), "")


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, without default port, fragment and tracking parameters, the query sorted, escapes of
    the path in one form.

    Null for other schemes than http and https, for URLs without a host and for those with credentials. Host names beyond
    ASCII are only lowered here; ``ascii_host`` gives their ASCII form.
    """
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    parts = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    get = lambda i: F.regexp_extract(url, parts, i)
    scheme, authority = F.lower(get(1)), F.lower(get(2))
    host = F.regexp_replace(F.regexp_extract(authority, r"^([^:]*)(?::(\d*))?$", 1), r"\.$", "")
    port = F.regexp_extract(authority, r"^([^:]*)(?::(\d*))?$", 2)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(get(3) == "", "/").otherwise(F.when(get(3).contains("%"), _unquoted(get(3))).otherwise(get(3)))
    kept = F.array_sort(F.filter(F.split(get(4), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~authority.contains("@"), out)


def _ascii(hosts: pd.Series) -> pd.Series:
    def of(host: str | None) -> str | None:
        try:
            return host if host is None or host.isascii() else host.encode("idna").decode()
        except UnicodeError:
            return None

    return hosts.map(of)


def ascii_host(host: Column) -> Column:
    """The ASCII form of a host name (IDNA), null where it has none; ASCII names never reach Python."""
    return F.when(host.rlike(r"^[\x00-\x7f]*$"), host).otherwise(F.pandas_udf(_ascii, "string")(host))


def parent_domains(host: Column | str) -> Column:
    """The host and every parent of at least two labels, the most specific first."""
    host = F.col(host) if isinstance(host, str) else host
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def url_identifiers(url: Column | str) -> Column:
    """struct(arxiv, doi) that a URL implies, versions stripped; null parts where it implies none.

    The host says whose identifier it is and the path holds it: of arXiv, behind 'abs' or 'pdf', four digits, a point and
    four or five digits, or an archive's name and seven digits; of a DOI resolver, all of the path from its '10.' on.
    """
    url = F.col(url) if isinstance(url, str) else url
    host, path = F.regexp_replace(host_of(url), r"^(?:www|dx)\.", ""), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/([^?#]*)", 1)
    parts = F.split(path, "/")
    kind, last = F.lower(F.get(parts, F.lit(0))), F.regexp_replace(F.array_join(F.slice(parts, 2, 9), "/"), r"(?:v[0-9]+)?(?:\.pdf)?/?$", "")
    known = last.rlike(r"^[0-9]{4}\.[0-9]{4,5}$") | last.rlike(r"^[A-Za-z.-]+/[0-9]{7}$")
    arxiv = F.when((host == "arxiv.org") & kind.isin("abs", "pdf") & known, last)
    doi = F.when((host == "doi.org") & path.startswith("10."), F.lower(F.rtrim(path, F.lit("."))))
    return F.struct(arxiv.alias("arxiv"), doi.alias("doi"))
