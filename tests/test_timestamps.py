import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.timestamps import normalize_timestamps, parse_date_text

CASES = [  # text, zone, day first, expected
    ("2020-06-25", "Europe/Paris", True, "2020-06-25"), (" 2019 ", None, None, "2019"), ("Published: Jul 2014", None, None, "2014-07"), ("06/2015", None, None, "2015-06"), ("2014/06", None, None, "2014-06"),
    ("02/12/2014", "UTC", True, "2014-12-02"), ("02/12/2014", "UTC", False, "2014-02-12"), ("20.06.2013", None, False, "2013-06-20"), ("20150623", None, None, "2015-06-23"), ("2022-W38-4", None, None, "2022-09-22"),
    ("2015-178", None, None, "2015-06-27"), ("2013年7月20日", None, None, "2013-07-20"), ("Apr 22nd, 2023", None, None, "2023-04-22"), ("26 de diciembre de 2016", None, None, "2016-12-26"), ("30-AUG-2011", None, None, "2011-08-30"),
    ("Tue, 10 Apr 2018", None, None, "2018-04-10"), ("30. September 2020", None, None, "2020-09-30"),
    ("2021-11-04T01:44:48Z", "Europe/Paris", True, "2021-11-04T01:44:48Z"), ("2016-12-13T10:07[Asia/Tokyo]", "UTC", True, "2016-12-13T01:07:00Z"), ("2014-10-23 17:11:01 Europe/Berlin", "UTC", True, "2014-10-23T15:11:01Z"),
    ("15/09/2013 23:53", "America/New_York", True, "2013-09-16T03:53:00Z"), ("2020-06-23T23:20:30.773", "Europe/Paris", True, "2020-06-23T21:20:30Z"), ("20130808 135415", "UTC", True, "2013-08-08T13:54:15Z"),
    ("13 October 2013, 16:12 (Europe/Madrid)", None, None, "2013-10-13T14:12:00Z"), ("Wed, 10 Jan 2018 09:44:52 +1100", None, None, "2018-01-09T22:44:52Z"), ("1659757611.730", None, None, "2022-08-06T03:46:51Z"),
    ("1649925498420", None, None, "2022-04-14T08:38:18Z"), ("1389725920508198", None, None, "2014-01-14T18:58:40Z"), ("2018-04-01T03:17:24 UTC+10:00", None, None, "2018-03-31T17:17:24Z"), ("20170122T081641+0100", None, None, "2017-01-22T07:16:41Z"),
    ("2023-070T06:31:07Z", None, None, "2023-03-11T06:31:07Z"), ("October 31, 2010 6:08 pm", "Asia/Tokyo", True, "2010-10-31T09:08:00Z"), ("May 9th 2023 12:02:20 AM CEST", None, None, "2023-05-08T22:02:20Z"),
    ("Sat, 20 Aug 16 04:06:22 CEST", None, None, "2016-08-20T02:06:22Z"), ("Sun Oct 30 03:36:25 CET 2016", None, None, "2016-10-30T02:36:25Z"), ("17 avril 2018 à 09h39", "Europe/Paris", True, "2018-04-17T07:39:00Z"),
    ("15. April 2012, 11:12 Uhr", "Europe/Berlin", True, "2012-04-15T09:12:00Z"), ("2009-08-21 21:19:16 America/New_York", None, None, "2009-08-22T01:19:16Z"), ("2013-05-03t10:19:23z", None, None, "2013-05-03T10:19:23Z"),
    ("2020-01-01T24:00:00Z", None, None, "2020-01-02T00:00:00Z"), ("Jun 2017", None, None, "2017-06"),
    ("1895-07-01 12:00:00", "Europe/Paris", True, "1895-07-01T11:50:39Z"), ("1795-07-01 12:00:00", "Europe/Paris", True, "1795-07-01T11:50:39Z"), ("0001-01-01 00:30", "Asia/Tokyo", True, "0000-12-31T15:11:01Z"),
    ("2105-07-01 12:00:00", "Europe/Paris", True, "2105-07-01T10:00:00Z"), ("2101-12-31 23:30", "Australia/Sydney", True, "2101-12-31T12:30:00Z"), ("2401-03-25 02:30", "Europe/Paris", True, "2401-03-25T01:30:00Z"), ("9999-01-15 12:00", "America/New_York", True, "9999-01-15T17:00:00Z"),
    ("2020-06-25" + " " * 400 + "10:11:12 Europe/Paris", None, None, "2020-06-25T08:11:12Z"), ("Published: " + " " * 300 + "Jul 2014", None, None, "2014-07"),
    # twice, never
    ("2020-10-25T01:10:06", "Europe/London", True, "2020-10-25T00:10:06Z"), ("31/03/2013 02:37", "Europe/Paris", True, "2013-03-31T01:37:00Z"),
    # nothing to read
    ("yesterday", "UTC", True, None), ("3 days ago", "UTC", True, None), ("2019-02-30", "UTC", True, None), ("2021-13-04", None, None, None), ("31/04/2018", None, True, None), ("0000-00-00", None, None, None), ("UNKNOWN", None, None, None),
    ("", None, None, None), (None, "UTC", True, None), ("12:61", "UTC", True, None), ("2020-01-01 25:00", "UTC", True, None), ("2020-01-01 10:00", None, None, None), ("x" * 5000, None, None, None), ("2021-W54-1", None, None, None), ("2021-366", None, None, None),
]


def test_every_format(spark):
    df = spark.createDataFrame([(i, *c, "extra") for i, c in enumerate(CASES)], "id int, text string, tz string, df boolean, want string, published_utc string")
    rows = normalize_timestamps(df, "text", "tz", "df").collect()
    assert [(r.text, r.published_utc) for r in rows if r.published_utc != r.want] == []
    assert len(rows) == len(CASES)
    status = {r.text: r.published_utc_status for r in rows}
    assert status["2020-10-25T01:10:06"] == "ambiguous" and status["31/03/2013 02:37"] == "nonexistent" and status["2020-01-01 10:00"] == "no_zone" and status["yesterday"] == "unread"


def test_repeated_and_no_rows(spark):
    df = spark.createDataFrame([("2020",)] * 3, "text string").selectExpr("text", "cast(null as string) as tz", "cast(null as boolean) as df")
    assert normalize_timestamps(df, "text", "tz", "df").count() == 3
    assert normalize_timestamps(df.limit(0), "text", "tz", "df").count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney"])
def test_intervals_agree_with_the_library(spark, zone):
    start = dt.datetime(2019, 1, 1)
    texts = [(start + dt.timedelta(minutes=37 * k)).strftime("%Y-%m-%d %H:%M:%S") for k in range(0, 28000, 3)]
    df = spark.createDataFrame([(t, zone, True) for t in texts], "text string, tz string, df boolean")
    for r in normalize_timestamps(df, "text", "tz", "df").collect():
        local = dt.datetime.strptime(r.text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zone))
        assert r.published_utc == local.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), r.text


@settings(max_examples=200, deadline=None)
@given(st.dates(dt.date(1971, 1, 1), dt.date(2090, 12, 31)))
def test_dates_round_trip(day):
    for f in ("%Y-%m-%d", "%Y%m%d", "%d %B %Y", "%B %d, %Y", "%d.%m.%Y", "%a, %d %b %Y", "%G-W%V-%u", "%Y-%j"):
        assert parse_date_text(day.strftime(f), None)[0] == day.isoformat(), f


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_never_raises(text):
    parse_date_text(text, None)
    parse_date_text(text, True)
