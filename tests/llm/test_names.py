import random

from pyspark.sql import functions as F

from docloom.llm.names import author_clusters, bands_for, edit_distance, error_similarity, fold, jaro_winkler, monge_elkan, parse_name, qgrams, similar_words, spelling_pairs, star_clusters

SAME = [
    ["Jonathan Retran", "Retran, Jonathan", "JONATHAN RETRAN", "Retran, J.", "J. Retran", "Dr. Jonathan Retran, CFA", "Jonathan  Retran", "Jonathan Retran (Macro Analytics Partners)", "Jonathan Q. Retran", "Jonathn Retran"],
    ["Sofía Mülgrumarg", "Sofia Mulgrumarg", "Sofia Muelgrumarg", "s.mulgrumarg@mail.example (Sofía Mülgrumarg)"],
    ["Margaret Kites", "Peggy Kites"],
    ["Jean-Luc van der Zoteischek", "van der Zoteischek, J.-L.", "Jean-Luc vanderZoteischek"],
    ["Netgrewer Systematic Research Partners", "Netgrewer Syst. Res. Ptnrs", "Partners of Systematic Research, Netgrewer", "The Netgrewer Systematic Research Partners Ltd.", "Netgrewer SRP", "Netgreewer Systematic Research Partners"],
    ["Martha Retran"],
]
NOBODY = ["Staff", "Editorial desk", "admin", "", "  ", "--", None]


def test_clusters(spark):
    rows = [(t, "x") for group in SAME for t in group for _ in range(2)] + [(t, "x") for t in NOBODY]
    got = {r.text: r.author for r in author_clusters(spark.createDataFrame(rows, "text string, author string")).collect()}
    assert set(got) == {t for g in SAME for t in g}
    ids = [{got[t] for t in g} for g in SAME]
    assert [len(i) for i in ids] == [1] * len(SAME) and len(set.union(*ids)) == len(SAME)


def test_pairs_are_ordered_and_distinct(spark):
    df = author_clusters(spark.createDataFrame([("B Retran Ann",), ("Ann Retran",), ("Retran, Ann",), ("Ann Retran",)], "text string"))
    pairs = spelling_pairs(df).collect()
    assert all(r.name_a < r.name_b for r in pairs) and len(set(pairs)) == len(pairs) and ("Ann Retran", "Retran, Ann") in {tuple(r) for r in pairs}
    assert author_clusters(spark.createDataFrame([], "text string")).count() == 0


def test_ambiguous_initials_stay_alone(spark):
    texts = ["Anna Retran", "Arthur Retran", "Retran, A."]
    got = {r.text: r.author for r in author_clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(set(got.values())) == 3


def test_measures():
    assert edit_distance("james", "jmaes") == 1 and edit_distance("abc", "abc") == 0 and edit_distance("abcdef", "uvwxyz", 1) == 2
    assert jaro_winkler("martha", "marhta") > 0.95 and jaro_winkler("a", "b") == 0.0 and monge_elkan(["j", "retran"], ["jonathan", "retran"]) == 1.0 and monge_elkan([], ["a"]) == 0.0
    assert fold("Søren Ægir-Łukasz") == "sorenaegirlukasz" and parse_name("Getin AG")["kind"] == "person" and parse_name(None or "") is None
    assert bands_for(0.5, 0.99) == 35 and 0 < error_similarity(6) < error_similarity(12) < 1


def test_banding_recall(spark):
    """Recall of words one error apart against comparing all pairs; the collision curve promises 0.99."""
    rng = random.Random(5)
    base = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 6))) for _ in range(500)})
    typed = []
    for w in base:
        k = rng.randrange(1, len(w) - 1)
        typed.append(rng.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k:]]))
    words = [("w", w, 5) for w in base] + [("w", w, 1) for w in sorted(set(typed) - set(base))]
    df = spark.createDataFrame(words, "kind string, word string, weight long")
    got = {tuple(sorted((r.a, r.b))) for r in similar_words(df).collect()}
    every = sorted(w for _, w, _ in words)
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if abs(len(a) - len(b)) <= 1 and min(len(a), len(b)) >= 3 and edit_distance(a, b, 1) == 1}
    assert got <= want and len(got & want) >= 0.98 * len(want)
    tiny = {tuple(sorted((r.a, r.b))) for r in similar_words(df, largest=1).collect()}
    assert tiny == want  # oversized buckets are compared exactly
    assert qgrams("ab") == {"^a", "ab", "b$"}


def test_stars_of_a_long_chain(spark):
    """More rounds than any number set beforehand: each round ends one star of the chain."""
    n = 45
    nodes = spark.createDataFrame([(i, n - i) for i in range(n)], "node long, rank long")
    pairs = [(i, i + 1) for i in range(n - 1)]
    edges = spark.createDataFrame([(a, b, n - a, n - b) for a, b in pairs] + [(b, a, n - b, n - a) for a, b in pairs], "a long, b long, ra long, rb long")
    assert {r.node: r.center for r in star_clusters(nodes, edges).collect()} == {i: i - i % 2 for i in range(n)}


def test_errors_of_names_in_wide_use(spark):
    """An error of a common given name is linked however often it is made, and two common names never, whatever the scale."""
    for n in (6, 60):
        rng = random.Random(n)
        families = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(2 * n)]
        names = [f"Robert {f.title()}" for f in families[:n]] * 3 + [f"Robertt {f.title()}" for f in families[: n // 2]] + [f"Andrew {f.title()}" for f in families[:n]] + [f"Andre {f.title()}" for f in families[n:]] + [f"Andre {families[0].title()}"]
        got = {r.text: r.author for r in author_clusters(spark.createDataFrame([(t,) for t in names], "text string")).collect()}
        assert all(got[f"Robertt {f.title()}"] == got[f"Robert {f.title()}"] for f in families[: n // 2])
        assert got[f"Andre {families[0].title()}"] != got[f"Andrew {families[0].title()}"]


def test_recall_of_whole_spellings(spark, data):
    """Spellings made from the names of whole tables, each with one error, find their name."""
    from pyspark.sql import functions as F

    from docloom.tables import table

    rng = random.Random(11)
    plain = sorted({r.t for r in table(spark, data, "candidates").select(F.explode("authors").alias("t")).where(r"t RLIKE '^\\p{Lu}\\p{Ll}{2,} (\\p{Lu}[.] )?\\p{Lu}\\p{Ll}{5,}$'").distinct().collect()})
    typed = {}
    for t in plain:
        k = rng.randrange(t.rindex(" ") + 2, len(t) - 1)
        typed[rng.choice([t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[:k] + "x" + t[k + 1 :], t[:k] + t[k + 1 :], t[:k] + "q" + t[k:]])] = t
    rows = [(t,) for t in plain for _ in range(3)] + [(t,) for t in typed if t not in plain]
    got = {r.text: r.author for r in author_clusters(spark.createDataFrame(rows, "text string")).collect()}
    found = [got[a] == got[b] for a, b in typed.items() if a not in plain]
    lost = {a: b for a, b in typed.items() if a not in plain and got[a] != got[b]}
    assert len(found) > 20 and len(lost) <= 0.15 * len(found), lost  # errors of spellings that are errors themselves are two steps from their star


def test_stars(spark):
    nodes = spark.createDataFrame([(i, 10 - i) for i in range(6)], "node long, rank long")
    pairs = [(0, 1), (1, 2), (2, 3), (4, 4)]
    edges = spark.createDataFrame([(a, b, 10 - a, 10 - b) for a, b in pairs] + [(b, a, 10 - b, 10 - a) for a, b in pairs], "a long, b long, ra long, rb long").where(F.col("a") != F.col("b"))
    assert {r.node: r.center for r in star_clusters(nodes, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
