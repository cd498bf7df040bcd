
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions.text import injection_phrases, location_label, sentences, word_set
from docloom.functions.url import canonical_url, host_of, parent_domains, url_identifiers
from docloom.operators.dedupe import classify_duplicates, fill_unknown
from docloom.operators.grounding import Page, common_order, ground_quotes
from docloom.operators.selection import select_relevant
from docloom.operators.state import budget_prefix, search_memory

URLS = {
    "HTTPS://Www.Site.Example:443/a?utm_source=x&b=2&a=1#top": "https://www.site.example/a?a=1&b=2", "http://site.example:80": "http://site.example/", "http://site.example.:8080/": "http://site.example:8080/",
    "https://site.example/?ref=x&ref_src=y": "https://site.example/?ref=x", "ftp://site.example/": None, "http:///x": None, "https://u:p@site.example/": None, "no url": None, None: None,
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", canonical_url("url").alias("c"), canonical_url(canonical_url("url")).alias("cc"), host_of("url").alias("h"))
    for r in df.collect():
        assert r.c == URLS[r.url] and r.cc == r.c
    assert df.where("h = 'www.site.example'").count() == 1
    one = spark.createDataFrame([("https://arxiv.org/pdf/2001.00001v3", "a.b.example")], "u string, h string").select(url_identifiers("u").alias("i"), parent_domains("h").alias("p")).first()
    assert one.i.arxiv == "2001.00001" and one.i.doi is None and list(one.p) == ["a.b.example", "b.example"]


def test_text(spark):
    df = spark.createDataFrame([("We test. Then (we) stop!  [Last] e.g. this",), (None,), ("",)], "t string")
    got = [r.s for r in df.select(sentences(F.col("t")).alias("s")).collect()]
    assert got == [["We test.", "Then (we) stop!", "[Last] e.g. this"], None, [""]]
    assert [r.w for r in df.select(word_set(F.lit("The beta of Beta, and alpha")).alias("w")).limit(1).collect()] == ["alpha beta"]
    assert df.select(injection_phrases(F.lit("Please IGNORE previous instructions now")).alias("p")).first().p == ["ignore previous instructions"]
    none = F.lit(None).cast("string")
    assert df.select(location_label(F.lit(3), none, F.lit("Results"), none, none).alias("l")).first().l == "p.3, § Results"
    assert df.select(location_label(none, none, none, none, none).alias("l")).first().l == "document"


def test_duplicates_do_not_depend_on_order(spark):
    rows = [(3, "k", "c"), (1, "k", "c"), (2, "x", "c"), (4, None, None), (5, "k", ""), (6, "y", "")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "other") for r in order], "id long, full string, core string, class string")
        got = {r.id: (r["class"], r.matched_id) for r in classify_duplicates(df, "id", "full", "core").collect()}
        assert got == {1: ("NEW", None), 2: ("VARIANT", 1), 3: ("DUPLICATE", 1), 4: ("NEW", None), 5: ("DUPLICATE", 1), 6: ("NEW", None)}
    assert classify_duplicates(df.limit(0), "id", "full", "core").count() == 0


def test_fill_unknown(spark):
    known = spark.createDataFrame([("a", "x", "UNKNOWN"), ("b", None, "")], "k string, p string, q string")
    new = spark.createDataFrame([("a", "y", "z"), ("b", "UNKNOWN", "w"), ("c", "n", None)], "k string, p string, q string")
    assert {tuple(r) for r in fill_unknown(known, new, "k", ["p", "q"]).collect()} == {("a", "x", "z"), ("b", "UNKNOWN", "w"), ("c", "n", "UNKNOWN")}


def test_budget_stops_at_the_first_rejection(spark):
    df = spark.createDataFrame([("u", 1, 6), ("u", 2, None), ("u", 3, 5), ("u", 4, 1), ("v", 1, 11)], "k string, o int, a int")
    assert [(r.k, r.o) for r in budget_prefix(df, "k", ["o"], "a", 10).orderBy("k", "o").collect()] == [("u", 1), ("u", 2)]


def test_search_memory_restarts_from_the_last_that_ran(spark):
    df = spark.createDataFrame([("q", s, s) for s in (0, 6, 9, 11, 19, 21, 30)] + [("q", None, 99)], "k string, s int, id int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in search_memory(df, ["k"], "ts", "id", 10).collect()) == [0, 11, 21]
    assert search_memory(df.limit(0), ["k"], "ts", "id", 10).count() == 0


def chosen(spark, rows, keywords, budget):
    df = spark.createDataFrame([(k, t, "e") for k, t in enumerate(rows)], "id long, texts array<string>, chosen string")
    return [list(r.chosen) for r in sorted(select_relevant(df, "id", "texts", keywords, budget).collect(), key=lambda r: r.id)]


def test_selection_skips_what_is_too_big(spark):
    texts = ["first", "", None, "second", "key " * 30, "key", "nothing here", "key " * 9 + "x" * 4000, "KEY"]
    assert chosen(spark, [texts, None, [], texts], ["key"], 100) == [[0, 3, 5, 8], [], [], [0, 3, 5, 8]]
    assert chosen(spark, [[None, " \n", "a", "b", "c (x", "d"]], ["(x"], 9) == [[2, 3]] and chosen(spark, [["a", "b", "c"]], [], 99) == [[0, 1]]


def test_selection_against_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    for _ in range(60):
        rows.append([rng.choice(["", "  ", None, "x" * rng.randrange(60), "key " * rng.randrange(9) + "y" * rng.randrange(90)]) for _ in range(rng.randrange(14))])
    want = []
    for texts in rows:
        solid = [i for i, t in enumerate(texts) if t and t.strip()]
        taken, used = solid[:2], sum(len(texts[i]) for i in solid[:2])
        score = {i: texts[i].count("key") / (1 + len(texts[i]) / 2000) for i in solid[2:] if "key" in texts[i]}
        for i in sorted(score, key=lambda i: (-score[i], i)):
            if used + len(texts[i]) + 16 <= 300:
                taken, used = [*taken, i], used + len(texts[i]) + 16
        want.append(sorted(taken))
    assert chosen(spark, rows, ["key"], 300) == want and any(len(w) > 3 for w in want)


SOURCE = "The strategy is re-\nbalanced monthly and holds 30 stocks from the upper decile of the sorted universe. Costs of 12 bps are deducted."


def test_grounding():
    look_up = Page(SOURCE).look_up
    assert look_up("rebalanced Monthly and holds 30 stocks")[0] == "exact"
    assert look_up("rebalancedmonthly and holds 30stocks")[0] == "spacing"
    how, found, share = look_up("The strategy is rebalanced monthly and holds 30 stocks of the upper decile of the sorted universe")
    assert how == "fuzzy" and found.startswith("The strategy") and share > 0.85
    assert look_up("The strategy is rebalanced monthly and holds 40 stocks from the upper decile of the sorted universe")[0] == "none"
    assert look_up("The strategy is … Costs of 12 bps")[0] == "exact" and look_up("The strategy is [...] Costs of 13 bps")[0] == "none"
    assert look_up("holds fifty bonds")[0] == "none" and look_up("") == look_up(None) == look_up(" … ") == ("none", None, 0.0) and Page(None).look_up("x")[0] == "none"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=12))
def test_common_order_is_longest(a, b):
    import itertools

    import numpy as np

    pairs = common_order(np.array(a, np.int64), np.array(b, np.int64))
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    assert len(pairs) == row[-1]


QUOTES = "text_id long, text string, quotes array<struct<quote_id: long, quote: string>>, how string"


def test_grounding_rows(spark):
    rows = [(1, SOURCE, [(1, "holds 30 stocks"), (2, None), (3, "  ")], "e"), (1, SOURCE, [(1, "holds 30 stocks")], "e"), (2, None, [(4, "holds")], "e"), (3, SOURCE, None, "e"), (4, SOURCE, [], "e")]
    df = spark.createDataFrame(rows, QUOTES)
    assert sorted((r.quote_id, r.how) for r in ground_quotes(df).collect()) == [(1, "exact"), (1, "exact"), (2, "none"), (3, "none"), (4, "none")]
    assert ground_quotes(df.limit(0)).count() == 0


def test_variants_by_the_whole_text(spark, tmp_path):
    from docloom.plans.texts import doc_dedupe_class

    opening = "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=- "
    texts = [opening + "Costs of 12 bps are deducted", "Monday 10:30: costs of 15 bps are deducted", "Good day. Costs of 12 bps are deducted", "Monday 11:45: costs of 15 bps are deducted", opening + "Nothing alike", opening + "12 BPS: deducted costs", "12 15", "30"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r["class"], r.matched_id) for r in doc_dedupe_class(spark, str(tmp_path)).collect()}
    assert got == {0: ("NEW", -1), 1: ("NEW", -1), 2: ("NEW", -1), 3: ("VARIANT", 1), 4: ("NEW", -1), 5: ("DUPLICATE", 0), 6: ("NEW", -1), 7: ("NEW", -1)}


def test_quotes_of_any_length(spark, tmp_path):
    from docloom.plans import quotes

    long = "A " + "very " * 80 + "long one with 7 parts."
    spark.createDataFrame([(1, [(f"Costs rise. {long}",), ("Up 3%.",)])], "result_id long, blocks array<struct<text:string>>").write.parquet(str(tmp_path / "handler_results.parquet"))
    spark.createDataFrame([(2, 1, f"[p.1] Costs rise. {long}\n[p.2] Up 4%. Costsrise. {long[:-1]}")], "selection_id long, result_id long, text string").write.parquet(str(tmp_path / "selections.parquet"))
    of = lambda q: [tuple(r)[1:] for r in sorted(q(spark, str(tmp_path)).collect())]
    assert [r[0] for r in of(quotes.quotes_grounded)] == ["exact", "exact", "none", "none", "exact"]
    assert [r[1] for r in of(quotes.quotes_exact)] == [True, True, False, False, True]
    assert of(quotes.number_support) == [(0, 0), (1, 0), (1, 1), (0, 0), (1, 0)]


def test_grounding_keeps_the_words_of_the_value(spark):
    quote = "The strategy is rebalanced annually and holds 30 stocks from the upper decile of the sorted universe"
    rows = [(1, SOURCE, [(1, quote, "annually"), (2, quote, "30 stocks"), (3, quote, None), (4, quote.replace("annually", "monthly"), "monthly")])]
    df = spark.createDataFrame(rows, "text_id long, text string, quotes array<struct<quote_id: long, quote: string, value: string>>")
    assert {r.quote_id: r.how for r in ground_quotes(df).collect()} == {1: "none", 2: "fuzzy", 3: "fuzzy", 4: "exact"}


def test_unseen_pairs_of_the_whole_time(spark, tmp_path):
    from docloom.plans.ledger import ledger_unseen_pairs

    rows = [(1, 7, "view", 0), (2, 7, "view", 10), (3, 7, "view", 21), (4, 7, "click", 21), (5, 8, "view", 99), (6, 8, "view", 99)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, day int").select("event_id", "user_id", "event_type", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.event_id for r in ledger_unseen_pairs(spark, str(tmp_path)).collect()) == [1, 3, 4, 5, 6]


def test_daily_ledger_is_whole_and_late_events_count(spark, tmp_path):
    """Every day, also the last, and events that arrive in a later file with an earlier time."""
    from docloom.streaming.ledger import daily_ledger, event_stream, settled

    (tmp_path / "events.parquet").mkdir()
    for part, days in enumerate([(0, 9, 9), (1, 0, 10)]):
        df = spark.createDataFrame([(k, 1, "view", d) for k, d in enumerate(days)], "event_id long, user_id long, event_type string, day int")
        df = df.select("event_id", F.timestamp_seconds(F.col("day") * 86400).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = event_stream(spark, str(tmp_path))
    got = settled(daily_ledger(stream), ["event_type", "day"])
    assert sorted((r.day.day, r.calls, r.cents) for r in got.collect()) == [(1, 2, 300), (2, 1, 150), (10, 2, 300), (11, 1, 150)]
