import random

from docloom.functions.classify import official_api, red_flags, request_parts
from docloom.operators.columns import read_pages

SCHEMA = "page_id long, width double, words array<struct<text:string,x0:double,x1:double,top:double>>, text string"


def words(lines, x0, x1, dy=10.0):
    return [(w, x0 + 30.0 * k, min(x0 + 30.0 * k + 25, x1), dy * i) for i, line in enumerate(lines) for k, w in enumerate(line.split())]


def test_columns_are_read_one_after_the_other(spark):
    left, right = [f"left {k} goes on here" for k in range(8)], [f"right {k} goes on there" for k in range(8)]
    page = words(left, 40.0, 260.0) + words(right, 320.0, 560.0)
    random.Random(1).shuffle(page)
    one = words([f"one column of text number {k} and more words follow to the end of it" for k in range(8)], 40.0, 560.0)
    crossing = page + [("https://x.example/a", 250.0, 330.0, 500.0)]
    rows = [(1, 600.0, page, "e"), (2, 600.0, one, "e"), (3, 600.0, page[:20], "e"), (4, 600.0, None, "e"), (5, None, [], "e"), (6, 600.0, crossing, "e"), (1, 600.0, page, "e")]
    got = sorted(((r.page_id, r.gutter, r.text) for r in read_pages(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got[0] == got[1] and got[0][2] == "\n".join(left + right) and 180 < got[0][1] < 320
    assert got[2][1] is None and got[2][2].count("\n") == 7 and got[3][1] is None and got[4][2] == got[5][2] == ""
    assert got[6][2] == "\n".join(left + right) + "\nhttps://x.example/a" and read_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes(spark):
    from pyspark.sql import functions as F

    texts = ["Guaranteed profit with our secret formula, 100% accurate", "Careful work", None, "Find me the best deep strategies for FX in a crisis"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r.f for r in df.select(red_flags(F.col("t")).alias("f")).collect()] == [["GUARANTEED_PROFIT", "PERFECT_ACCURACY", "SECRET_STRATEGY"], [], [], []]
    r = df.select(request_parts(F.col("t")).alias("r")).collect()
    assert (r[3].r.assets, r[3].r.regimes, r[3].r.mode, r[3].r.core) == (["FOREX"], ["CRASH"], "DEEP_RESEARCH", "deep FX crisis") and r[2].r.mode == "QUICK_DISCOVERY" and r[2].r.core == ""
    api = spark.createDataFrame([("a.example", "/works"), ("a.example", "/works/1"), ("b.example", "/repos/x"), (None, None)], "h string, p string").select(official_api(F.col("h"), F.col("p"), [("a.example", "/works")], [("b.example", "/repos/")]).alias("x"))
    assert [r.x for r in api.collect()] == [True, False, True, False]


def plain_reading(page):
    """A page read word by word."""
    import numpy as np

    from docloom.operators import columns as c

    known = [w for w in page if w is not None and None not in w]
    x0, x1 = (np.array([w[k] for w in known], float) for k in (1, 2))
    gutter = c.gutter_of(x0, x1, 600.0) if known else None
    part = lambda w: 0 if gutter is None or w[2] <= gutter else 1 if w[1] >= gutter else 2
    text, last = "", None
    for w in sorted(known, key=lambda w: (part(w), w[3], w[1])):
        text += ("" if last is None else " " if part(last) == part(w) and w[3] - last[3] <= c.LINE else "\n") + w[0]
        last = w
    return gutter, text


def test_whole_columns_of_pages_are_pages_word_by_word(spark, monkeypatch):
    """Pages of any number of words, with words unknown, in any order, in one portion and in many."""
    from docloom.operators import columns as c

    rng, pages = random.Random(7), []
    for k in range(120):
        n = rng.choice((0, 1, 39, 40, 60, 200))
        left = [rng.choice((40.0, 60.0, 330.0, 350.0)) + rng.choice((0.0, 80.0)) for _ in range(n)]
        page = [(f"w{k}.{i}", x, x + rng.choice((20.0, 60.0)), float(rng.randrange(0, 400))) for i, x in enumerate(left)]
        pages.append([*page, *rng.choice(([], [(None, 1.0, 2.0, 3.0), ("no place", 1.0, None, 3.0), None], [("crossing", 250.0, 340.0, 7.0)]))] if k % 10 else None)
    want = {k: plain_reading(p or []) for k, p in enumerate(pages)}
    assert 10 < sum(g is not None for g, _ in want.values()) < 110
    frame = spark.createDataFrame([(k, 600.0, p, "e") for k, p in enumerate(pages)], SCHEMA).coalesce(1)
    for portion in (500_000, 50):
        monkeypatch.setattr(c, "PORTION", portion)
        assert {r.page_id: (r.gutter, r.text) for r in read_pages(frame).collect()} == want


def test_pages_are_read_in_time(spark, tmp_path):
    """400,000 words in a few seconds; set and read one by one they took a multiple."""
    import time

    from docloom.plans.parsed import columns_read

    spark.range(10_000).selectExpr("id AS o_orderkey", "id % 1000 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    took = []
    for _ in range(2):  # the first compiles the code
        began = time.perf_counter()
        rows = columns_read(spark, str(tmp_path)).collect()
        took.append(time.perf_counter() - began)
    assert len(rows) == 1000 and {r.gutter for r in rows} == {260.0} and min(took) < 15, took
