import random

from docloom.llm import boilerplate
from docloom.llm.boilerplate import Furniture, body, is_paragraph, key_forms, line_key, main_lines, main_text, page_lines
from docloom.llm.quality import Profiles, describe, divergence, lowered, repaired, text_statistics

PAGE = [
    ("We use cookies to measure traffic.", False), ("Accept all", False), ("Northbrief – Daily notes", False), ("Home | Research | Archive | Contact", False), ("Most read", False), ("1. Another story about old boats in town", False), ("A second story about the river", False),
    ("The slow ferry of the northern coast", True), ("Set-up", True), ("- wooden boats", True), ("Winter coats", True), ("The ferry crosses the bay each morning, weather permitting, and returns before noon.", True), ("Advertisement", False),
    ("Read also: Boats of the bay", False), ("We copied the privacy policy of nine ports, and none mentions the ferry at all.", True), ("Related articles", False), ("Quiet harbours and early trains", False), ("Print Copy link", False),
    ("© 2024 Northbrief", False), ("Nothing on this site is advice, and past results say little about future ones.", False), ("Sitemap", False),
]


LEARNED = Furniture(
    frozenset("we use cookies to measure traffic.|accept all|most read|related articles|print|copy link|© # <site>|nothing on this site is advice, and past results say little about future ones.|sitemap|read also :".split("|")),
    frozenset({"most read", "related articles"}),
)


def test_page():
    lines = [t for t, _ in PAGE]
    assert main_lines(lines, "www.northbrief.example", "The slow ferry of the northern coast", LEARNED) == [m for _, m in PAGE]
    assert main_lines(lines, "www.northbrief.example", None, LEARNED) == [m for _, m in PAGE]
    assert main_lines([], None, None, Furniture()) == [] and main_lines(["Accept all", "© 2024 X"], None, "UNKNOWN", LEARNED) == [False, False]
    assert line_key("  NORTHBRIEF  12 notes ", "northbrief") == "<site> # notes" and key_forms("» read also: the bay") == ["read also: the bay", "» read also :"]
    assert is_paragraph("One two three four five six.") and not is_paragraph("- One two three four five six.") and body(["a b c d e f.", "x"], [True, False]) == (0, 1)


def test_scores_decide(monkeypatch):
    """A single sentence far from the article is no part of it, though nothing is known of it; with equal scores it would be."""
    article = ["The ferry crosses the bay each morning, weather permitting, and returns before noon, late in the evening, or never." * 3] * 4
    lines = ["The slow ferry of the northern coast", *article, "Print", "Copy link", "Tickets are sold here in winter.", "Sitemap"]
    keep = main_lines(lines, None, lines[0], LEARNED)
    assert keep == [True] * 5 + [False] * 4
    monkeypatch.setattr(boilerplate, "container_scores", lambda t, p, k, r: ([1.0] * len(t), [1.0] * (r[-1] + 1)))
    assert main_lines(lines, None, lines[0], LEARNED)[7]


def site_pages(host, n):
    """Pages of one site: its own menu, buttons, boxes of links and footer about an article of their own."""
    rng, first = random.Random(host), []
    for k in range(n):
        a, b, c = ("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3))
        text = [
            (f"{host} pages", False), ("Home | Research | Archive | Contact", False), ("Take all crumbs", False), ("Often seen", False), (f"{k}. Another story about the {a} in {b}", False), (f"A second story about number {k} and the {c}", False),
            (f"The {a} of the {b} and story {k}", True), ("Findings", True), (f"- wooden {a}", True), (f"The {a} number {k} crosses the {b} each morning, weather permitting, and returns before noon.", True), (f"Look here: the {b} of {c} and {k}", False),
            ("Outlook", True), (f"Nobody knows when the {c} number {k} will return to the {a}, although the storm has passed.", True), ("Beam it", False), ("Often seen", False), (f"More about the {c} of year {k}", False), (f"The {a} seen from the {c}, take {k}", False),
            (f"Made in 2020 by {host}", False), ("Nothing here is advice, and past results say little about future ones.", False),
        ]
        first.append((f"www.{host}.example", f"The {a} of the {b} and story {k}", text))
    return first


def test_furniture_is_learned(spark):
    """Words that no list holds, on pages of four sites: found by recurring; headings recur too and stay."""
    pages = [p for host in ("northfold", "eastfold", "southfold", "westfold") for p in site_pages(host, 12)]
    rows = [(i, h, t, ["\n".join(x for x, _ in text)]) for i, (h, t, text) in enumerate(pages)]
    df = spark.createDataFrame(rows, "result_id long, host string, title string, texts array<string>")
    got = {(r.result_id, r.line_index): r.main for r in page_lines(df, frozenset()).collect()}
    wrong = [(pages[i][2][k], m) for (i, k), m in got.items() if m != pages[i][2][k][1]]
    assert len(got) == 48 * 19 and len(wrong) <= 0.02 * len(got), wrong[:9]


def test_lists_decide_little(spark, data):
    """Without the list of adverts nearly all furniture is found; without scores, much is lost."""
    import __spark_entry__ as entry
    from docloom.llm.queries import web_pages

    assert "p4_found" in entry.queries()
    pages = web_pages(spark, data)
    lines = lambda **how: {(r.result_id, r.block_index, r.line_index) for r in page_lines(pages, **how).where("NOT main").collect()}
    with_list, without = lines(), lines(adverts=frozenset())
    assert len(with_list) > 40 and len(with_list & without) >= 0.97 * len(with_list)


def test_pages(spark):
    text = ["\n".join(t for t, _ in PAGE[:7]), "", None, "\n".join(t for t, _ in PAGE[7:]) + "\n\n"]
    rows = [(1, "www.northbrief.example", "The slow ferry of the northern coast", text, "e"), (1, "www.northbrief.example", "The slow ferry of the northern coast", text, "e"), (2, None, None, None, "e"), (3, None, None, [], "e"), (4, None, None, ["  \n"], "e")]
    df = spark.createDataFrame(rows, "result_id long, host string, title string, texts array<string>, main string")
    got = page_lines(df).collect()
    assert len(got) == 2 * len(PAGE) and {(r.block_index, r.line_index) for r in got} == {(0, k) for k in range(7)} | {(3, k) for k in range(len(PAGE) - 7)}
    assert all(r.main for r in got if (r.block_index, r.line_index) in ((3, 0), (3, 4), (3, 7))) and [r.result_id for r in main_text(df.dropDuplicates(["result_id"])).collect()] == [1] and page_lines(df.limit(0)).count() == 0


def test_pages_of_any_length(spark):
    """Lines behind the old edges: templates longer than 40 characters on sites of fewer than six pages."""
    legal = "Every chart on these pages is meant for the readers of this northern harbour only."
    rows = [(k, f"www.h{k % 4}.example", None, [f"The {w} of the bay and its keepers\nThe {w} crosses the bay each morning, weather permitting.\n{legal}"]) for k, w in enumerate(("ferry", "gull", "crab", "seal", "boat", "moon", "tide", "rain"))]
    got = page_lines(spark.createDataFrame(rows, "result_id long, host string, title string, texts array<string>")).where("NOT main").collect()
    assert {(r.result_id, r.line_index) for r in got} == {(k, 2) for k in range(8)}


TEXTS = {
    "prose": ["The ship leaves the harbour before dawn, and nobody knows when it will return to the coast. We wait for news at the pier, although the storm has not passed.", "Das Schiff verlässt den Hafen vor dem Morgen, weil der Sturm noch nicht vorbei ist.", "so i was like really tired and then they said we have to go back to the station again",
              "THE SHIP LEAVES THE HARBOUR BEFORE DAWN AND NOBODY KNOWS WHEN IT WILL RETURN TO THE COAST.", "船在黎明前离开了港口，但是没有人知道它什么时候回来。"],
    "table": ["a;1;2;3;4\nb;5;6;7;8\nc;9;10;11;12\nd;1;2;3;4", "| name | x |\n| boat | 3 |\n| ship | 4 |\n| raft | -4 |"],
    "list": ["- red apples\n- green pears\n- old maps\n- blue stones", "Home\nContact\nGallery\nTickets\nArchive"],
    "code": ["def f(x, *args):\n    return x[1:]\nfor i in range(10):\n    y_z = g(i, n=3)"],
    "junk": ["#boats #ships #rafts\n#coast #pier", "aGVsbG8gd29ybGQhIHRoaXMgaXM+9sb25nZXIgdGV4dA\nbm90aGluZy9zZXJpb3VzK2p1c3QgZGF0YQ0KbW9yZQ", "", "  \n "],
}


def test_structures():
    p = Profiles()
    for want, texts in TEXTS.items():
        got = describe(texts, p)
        for t, s, share in zip(texts, got["structure"], got["prose_share"], strict=True):
            assert (s == "prose") == (want == "prose"), (want, s, t)
            assert (share >= 0.5) == (want == "prose")
    both = describe([TEXTS["prose"][0] + "\n\n" + TEXTS["table"][0] * 9, TEXTS["prose"][0] * 9 + "\n\n" + TEXTS["table"][0]], p)["prose_share"]
    assert both[0] < 0.5 < both[1]


def test_text_that_nobody_can_read_is_no_prose():
    """German with broken letters stays prose; Chinese that is nothing but broken letters is junk, sound Chinese prose."""
    chinese = "在扣除成本之后，模型降低了收益率曲线。对小账户而言，样本限制了估计的溢价，而且波动率限制了秋季的损失。"
    german = "Der Sturm schwächt die Schiffe, weil der Hafen über Nacht geschlossen ist und niemand die Küste erreicht."
    broken = lambda t: t.encode().decode("latin-1")
    shares = describe([chinese, german, broken(german), broken(chinese), german + "\n\n" + broken(chinese)], Profiles())["prose_share"]
    assert list(shares[:4] >= 0.5) == [True, True, True, False] and 0 < shares[4] < 1


def test_texts_in_a_chunk_do_not_touch_each_other():
    p, texts = Profiles(), [t for ts in TEXTS.values() for t in ts]
    alone = [describe([t], p) for t in texts]
    together = describe(texts, p)
    for k in together:
        for i, one in enumerate(alone):
            assert one[k][0] == together[k][i] or abs(one[k][0] - together[k][i]) < 1e-5, (k, texts[i])


def test_statistics(spark):
    rows = [(1, TEXTS["prose"][0], "e"), (1, TEXTS["prose"][0], "e"), (2, None, "e"), (3, "", "e"), (4, "word " * 60_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, structure string")
    got = sorted(text_statistics(df).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4] and got[0] == got[1] and got[2].structure == "junk" and got[4].n_words == 60_000
    words = TEXTS["prose"][0].split()
    assert got[0].n_words == len(words) and got[0].n_lines == 1 and got[0].end_punctuation_share == 1.0 and abs(got[0].mean_word_length - sum(c.isalpha() for c in TEXTS["prose"][0]) / len(words)) < 1e-6
    assert text_statistics(df.limit(0)).count() == 0


def test_helpers():
    import numpy as np

    p, q = np.array([[1.0, 0.0]], np.float32), np.array([[0.0, 1.0], [1.0, 0.0]], np.float32)
    assert np.allclose(divergence(p, q), [[1.0, 0.0]], atol=1e-5)
    assert repaired("schwÃ¤cht") == "schwächt" and repaired("schwächt") == "schwächt" and repaired("schwÃ¤cht\nå¯¹å°") == "schwächt\nå¯¹å°" and lowered("ONE TWO THREE FOUR FIVE\nAB") == "one two three four five\nAB"
