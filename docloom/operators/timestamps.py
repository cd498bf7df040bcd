"""Normalisation of date and time texts in mixed formats and zones.

An Arrow UDF takes the text apart into a date, an optional time of day and an optional zone; the rest is built-in
expressions.
Times without an offset become UTC through an as-of join of the local time to zone-offset intervals, exploded over
buckets of local time: two matching intervals mean an ambiguous local time, none (only the gap behind an interval)
a nonexistent one, one gives the offset directly.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by language; values are month numbers.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de_short": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr_short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es_short": "ene feb mar abr may jun jul ago sept oct nov dic",
}
# Minutes east of Greenwich of zone letters.
ZONE_LETTERS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AST": -240, "ADT": -180, "AKST": -540, "AKDT": -480, "HST": -600, "JST": 540, "AEST": 600,
    "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
}
BUCKET_S = 1 << 25
EPOCH_DAY = dt.date(1970, 1, 1)
FIRST_BUCKET = -5_364_662_400 // BUCKET_S + 1  # behind the start of 1800, so that every zone has it
INTERVAL_SCHEMA = "tz string, bucket long, local_start long, local_end long, next_start long, utc_start long, offset_s long"


PARSED_SCHEMA = "value string, day long, tod long, offset_s long, tz string, slashed boolean"
NAME = r"([^\W\d_]+)"
PREFIX = re.compile(r"^(?:first |last )?(?:published|posted|updated|modified|revised|released|created|issued|date)(?: on| at)?\s*:?\s+(?=\S)", re.I)
WEEKDAY = re.compile(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", re.I)
TIME = re.compile(r"^(.*?(?<=[Tt ,(])|.*?à )(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?!\d)(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?(.*)$")
PACKED_TIME = re.compile(r"^(\d{8})[T ](\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?(?!\d)(.*)$|^((?:19|20)\d{6})(\d{2})(\d{2})(\d{2})$")
OFFSET = re.compile(r"([+\-\u2212])(\d{2}):?(\d{2})?(?!\d)")
LETTERS = re.compile(r"(?:^|[\s(\[])([A-Z]{2,5}|[Zz])(?:$|[\s)\]])")
ZONE_NAME = r"([A-Z][A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+)"
TRAIL = r"[\s,.T(]*$"
YMD = re.compile(r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)|^(\d{4})年(\d{1,2})月(\d{1,2})日")
WEEK = re.compile(r"^(\d{4})-?W(\d{2})-?([1-7])(?!\d)")
ORDINAL = re.compile(r"^(\d{4})-(\d{3})(?!\d)")
PACKED = re.compile(r"^(\d{4})(\d{2})(\d{2})(?!\d)")
SLASH = re.compile(r"^(\d{1,2})([/\-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")
DOTS = re.compile(r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?!\d)")
DMY = re.compile(rf"^(\d{{1,2}})(?:st|nd|rd|th|er|º)?\.?[ \-](?:de )?{NAME}\.?,?[ \-](?:de )?(\d{{4}}|\d{{2}})(?![\d:])")
MDY = re.compile(rf"^{NAME}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)")
ASCTIME = re.compile(rf"^{NAME} (\d{{1,2}}) \d{{1,2}}:.* (\d{{4}})$")
MONTH_FORMS = (
    (re.compile(r"^(?P<m>\d{1,2})/(?P<y>\d{4})$")),
    (re.compile(r"^(?P<y>\d{4})[-/.](?P<m>\d{1,2})$")),
    (re.compile(r"^(?P<y>\d{4})年(?P<m>\d{1,2})月$")),
    (re.compile(rf"^(?P<m>[^\W\d_]+)\.?,? (?:de )?(?P<y>\d{{4}})$")),
)
EPOCH = re.compile(r"^(\d{10})(?:\d{3}|\d{6}|\d{9})?(?:\.\d+)?$")
MONTH_OF = {n: i + 1 for names in MONTHS.values() for i, n in enumerate(names.split())}
NOTHING = (None, None, None, None, None, None)


def _date(s: str, day_first: bool | None) -> tuple[dt.date | None, int, bool]:
    """The date that ``s`` begins with, where its text ends, and whether the row's own order of day and month decided."""
    try:
        if m := YMD.match(s):
            y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[5], m[6], m[7])
            return dt.date(int(y), int(mo), int(d)), m.end(), False
        if m := WEEK.match(s):
            return dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])), m.end(), False
        if m := ORDINAL.match(s):
            day = dt.date(int(m[1]), 1, 1) + dt.timedelta(int(m[2]) - 1)
            return (day if day.year == int(m[1]) and int(m[2]) else None), m.end(), False
        if m := PACKED.match(s) or re.match(r"^((?:19|20)\d{2})(\d{2})(\d{2})(?=\d{6}$)", s):
            return dt.date(int(m[1]), int(m[2]), int(m[3])), m.end(), False
        year = lambda t: int(t) + 2000 * (len(t) == 2)
        if m := SLASH.match(s):
            a, b = int(m[1]), int(m[3])
            first = day_first if day_first is not None else True if a > 12 else False if b > 12 else None
            return (None if first is None else dt.date(year(m[4]), *((b, a) if first else (a, b)))), m.end(), True
        if m := DOTS.match(s):
            return dt.date(year(m[3]), int(m[2]), int(m[1])), m.end(), False
        if m := DMY.match(s):
            return dt.date(year(m[3]), MONTH_OF[m[2].lower()], int(m[1])), m.end(), False
        if m := MDY.match(s):
            return dt.date(int(m[3]), MONTH_OF[m[1].lower()], int(m[2])), m.end(), False
        if m := ASCTIME.match(s):
            return dt.date(int(m[3]), MONTH_OF[m[1].lower()], int(m[2])), len(s), False
    except (ValueError, KeyError, OverflowError):
        pass
    return None, 0, False


def parse_date_text(text: str | None, day_first: bool | None) -> tuple:
    """(value, day, tod, offset_s, tz, slashed) of ``text``; all None where it states no possible date.

    value: a date without a time of day, at its own precision; day: days since 1970 of a local date with a time; tod:
    its second of the day; offset_s: the offset that the text states; tz: the zone that it names. Numeric dates with
    slashes and the year last follow ``day_first``; where that is None, only numbers above 12 decide.
    """
    if not text:
        return NOTHING
    s = WEEKDAY.sub("", PREFIX.sub("", " ".join(text.split())))
    if m := EPOCH.match(s):
        return None, int(m[1]) // 86400, int(m[1]) % 86400, 0, None, False
    packed = PACKED_TIME.match(s)
    if t := packed or TIME.match(s):
        if packed:
            (h, mi, se), half, rest = (t[2] or t[7], t[3] or t[8], t[4] or t[9]), None, t[5] or ""
        else:
            h, mi, se, half, rest = t[2], t[3], t[4], t[5], t[6]
        h, mi, se = int(h), int(mi), int(se or 0)
        if half:
            h = h % 12 + 12 * (half in "pP") if 1 <= h <= 12 else 99
        day, _, slashed = _date(s, day_first)
        if day is None or mi > 59 or se > 59 or h > 24 or (h == 24 and mi + se):
            return NOTHING
        zone, offset = re.search(ZONE_NAME, rest), None
        if not zone:
            if m := OFFSET.search(rest):
                offset = (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)
            elif (m := LETTERS.search(rest)) and m[1].upper() in ZONE_LETTERS:
                offset = ZONE_LETTERS[m[1].upper()] * 60
            elif rest[:1] in ("Z", "z") and len(rest.strip()) == 1:
                offset = 0
        return None, (day - EPOCH_DAY).days, h * 3600 + mi * 60 + se, offset, zone[1] if zone else None, slashed
    day, end, slashed = _date(s, day_first)
    if day is not None and re.match(TRAIL, s[end:]):
        return day.isoformat(), None, None, None, None, slashed
    if end == 0 or day is None:
        for form in MONTH_FORMS:
            if m := form.match(s):
                mo = int(m["m"]) if m["m"].isdigit() else MONTH_OF.get(m["m"].lower(), 0)
                return (f"{m['y']}-{mo:02d}", *NOTHING[1:]) if 1 <= mo <= 12 and m["y"] != "0000" else NOTHING
        if m := re.match(r"^(\d{4})年?$", s):
            return (m[1], *NOTHING[1:]) if m[1] != "0000" else NOTHING
    return NOTHING


def parsed_dates(text: pd.Series, day_first: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = []
    for t, d in zip(text, day_first, strict=True):
        key = (t, None if d is None or d != d else bool(d))
        if key not in known:
            known[key] = parse_date_text(*key)
        rows.append(known[key])
    out = pd.DataFrame(rows, columns=["value", "day", "tod", "offset_s", "tz", "slashed"], dtype=object)
    return out.astype({"day": "Int64", "tod": "Int64", "offset_s": "Int64", "slashed": "boolean"})


def _iso(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int")).cast("string")


FIRST_YEAR, LAST_YEAR = 1800, 2102
ALWAYS = -(1 << 40)  # before every date


def _zone_intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from zoneinfo import ZoneInfo

    utc = dt.timezone.utc
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
    for pdf in batches:
        rows = []
        for name in pdf["tz"].dropna().unique():
            try:
                zone = ZoneInfo(name)
            except Exception:  # a text that looks like a zone name but is none
                continue
            at = lambda t, z=zone: int(dt.datetime.fromtimestamp(t, utc).astimezone(z).utcoffset().total_seconds())
            cuts, t, o = [(lo, at(lo))], lo, at(lo)
            while t < hi:
                n = min(t + 14 * 86400, hi)
                if (o2 := at(n)) != o:
                    a, b = t, n
                    while b - a > 1:
                        m = (a + b) // 2
                        a, b = (m, b) if at(m) == o else (a, m)
                    o = at(b)
                    cuts.append((b, o))
                    n = b
                t = n
            for i, (u, off) in enumerate(cuts):
                end = cuts[i + 1][0] if i + 1 < len(cuts) else hi
                nxt = end + (cuts[i + 1][1] if i + 1 < len(cuts) else off)
                start, stop = u + off, end + off
                for k in range(start // BUCKET_S, max(stop, nxt) // BUCKET_S + 1):
                    rows.append((name, k, start if i else ALWAYS, stop, nxt, u, off))
        yield pd.DataFrame(rows, columns=["tz", "bucket", "local_start", "local_end", "next_start", "utc_start", "offset_s"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Zone-offset intervals of every distinct name in column ``tz``, exploded over buckets of local time.

    They reach from before every date, as no zone changed before FIRST_YEAR, to LAST_YEAR; ``in_known_years`` maps later
    dates into them. There are some 600 zone names in all, so the result is bounded by about 600 * 300 short arrays
    whatever the input.
    """
    rows = zones.select("tz").where("tz IS NOT NULL").distinct().mapInPandas(_zone_intervals, INTERVAL_SCHEMA)
    return rows.groupBy("tz", "bucket").agg(F.collect_list(F.struct("utc_start", "local_start", "local_end", "next_start", "offset_s")).alias("intervals"))


def in_known_years(day: Column) -> Column:
    """``day`` (days since 1970), from LAST_YEAR - 1 on moved to the year after 2050 that begins on the same weekday and has
    as many days: all zones repeat by weekday rules there, so its offset is the same."""
    date = F.date_from_unix_date(day.cast("int"))
    like: dict[tuple[int, bool], int] = {}
    for y in range(2050, 2090):
        like.setdefault((dt.date(y, 1, 1).isoweekday(), dt.date(y, 12, 31).timetuple().tm_yday == 366), y)
    first, last = F.make_date(F.year(date), F.lit(1), F.lit(1)), F.make_date(F.year(date), F.lit(12), F.lit(31))
    kind = F.weekday(first) * 2 + F.when(F.dayofyear(last) == 366, 1).otherwise(0)
    start = F.create_map(*[F.lit(x) for (weekday, leap), y in sorted(like.items()) for x in ((weekday - 1) * 2 + leap, (dt.date(y, 1, 1) - EPOCH_DAY).days)])
    return F.when(F.year(date) >= LAST_YEAR - 1, F.element_at(start, kind) + F.dayofyear(date) - 1).otherwise(day)


def normalize_timestamps(df: DataFrame, text: str, tz: str, day_first: str, out: str = "published_utc", zones: DataFrame | None = None) -> DataFrame:
    """Each row of ``df`` with ``out`` (text at its own precision, times in UTC) and ``<out>_status``.

    ``tz`` and ``day_first`` name the columns with the row's own zone and order of day and month; ``zones``, where at hand,
    is a small table whose column ``tz`` has every zone of ``df``, which then is not read for them. Texts of any length and
    dates of the years 1 to 9999 are read. Status: ``date``,
    ``exact`` (offset in the text), ``zone`` (one interval), ``ambiguous`` (two: the earlier instant), ``nonexistent``
    (moved forward by the gap), ``no_zone`` (time without any known zone: null) or ``unread`` (null text, relative
    wording, impossible dates: null). Rows are kept one for one, repeated rows too; an empty input gives no rows;
    columns of ``df`` named ``out`` are replaced and all others kept whatever their names.
    """
    packed = df.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(tz).alias("site_tz"), F.col(day_first).alias("site_df"))
    parsed = packed.withColumn("p", F.pandas_udf(parsed_dates, PARSED_SCHEMA)("text", "site_df"))
    local = F.col("p.day") * 86400 + F.col("p.tod")
    zone = F.coalesce(F.col("p.tz"), F.col("site_tz"))
    parsed = parsed.withColumns({"local": local, "zone": F.when(F.col("p.offset_s").isNull() & local.isNotNull(), zone)})
    known = F.when(F.col("zone").isNotNull(), in_known_years(F.col("p.day")) * 86400 + F.col("p.tod"))
    parsed = parsed.withColumn("known", known).withColumn("bucket", F.greatest(F.floor(F.col("known") / BUCKET_S), F.lit(FIRST_BUCKET)))
    named = df.select(F.regexp_extract(F.col(text), ZONE_NAME, 1).alias("tz")).where("tz <> ''")
    own = df.select(F.col(tz).alias("tz")) if zones is None else zones.select("tz")
    intervals = zone_intervals(named.unionByName(own).distinct())
    joined = parsed.join(F.broadcast(intervals.withColumnsRenamed({"tz": "zone"})), ["zone", "bucket"], "left")
    t, k = F.col("local"), F.col("known")
    inside = F.filter("intervals", lambda i: (i["local_start"] <= k) & (k < i["local_end"]))
    gap = F.filter("intervals", lambda i: (i["local_end"] <= k) & (k < i["next_start"]))
    best = F.coalesce(F.get(F.array_sort(inside), F.lit(0)), F.get(gap, F.lit(0)))
    joined = joined.withColumns({"n": F.size(inside), "best": best})
    utc = t - F.coalesce(F.col("p.offset_s"), F.col("best.offset_s"))
    day, tod = F.floor(utc / 86400), F.pmod(utc, F.lit(86400))
    stamp = F.concat(_iso(day), F.format_string("T%02d:%02d:%02dZ", (tod / 3600).cast("int"), (tod % 3600 / 60).cast("int"), (tod % 60).cast("int")))
    status = (
        F.when(F.col("p.value").isNull() & local.isNull(), "unread").when(F.col("p.value").isNotNull(), "date").when(F.col("p.offset_s").isNotNull(), "exact")
        .when(F.col("best").isNull(), "no_zone").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "zone").otherwise("nonexistent")
    )
    keep = [F.col("row")[c].alias(c) for c in df.columns if c not in (out, f"{out}_status")]
    return joined.select(*keep, F.coalesce(F.col("p.value"), F.when(utc.isNotNull(), stamp)).alias(out), status.alias(f"{out}_status"))
