import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.leaks import align, find_leaks
from docloom.llm.words import WordIds, gram_hashes, ids, words

ITEM = "Smoothed borrowers that absorb the risk-adjusted beta should also avoid this cyclical crowded kernel, and seasonal estimates mirror this modest delayed network"


def test_words_ignore_looks():
    plain = words("The risk-adjusted beta doesn't fall 23.1 percent")
    for same in ("THE RISK‑ADJUSTED “beta”, doesn’t fall 23.1 percent!", "The risk-\n  > adjusted beta\ndoes­n't fall 23.1 percent", "Thе risk-аdjusted bеta doesn't fall 23.1 pеrcent", "T​he risk－adjusted beta doesn't fall 23.1 percent"):
        assert words(same) == plain, same
    assert words("") == [] and plain[1] == "riskadjusted"


def test_alignment_against_plain_dynamic_programming():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [np.array([rng.randrange(4) for _ in range(rng.randrange(1, 14))], np.uint64) for _ in "ab"]
        score, longest, end = align(a, b)
        h = [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
        run, top, most = [[0] * (len(a) + 1) for _ in range(len(b) + 1)], 0.0, 0
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                same = a[j - 1] == b[i - 1]
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if same else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                run[i][j] = run[i - 1][j - 1] + 1 if same else 0
                top, most = max(top, h[i][j]), max(most, run[i][j])
        assert (score, longest) == (top, most) and (not longest or list(a[end - longest : end]) in [list(b[k : k + longest]) for k in range(len(b))])


def test_every_shared_run_is_found(spark):
    w = ITEM.split()
    docs = [
        (1, "Noise before. " + ITEM + " noise after", "e"), (1, "Noise before. " + ITEM + " noise after", "e"), (2, "x y " + " ".join(w[3:15]) + " z", "e"), (3, "x y " + " ".join(w[3:14]) + " z", "e"),
        (4, "x " + " ".join(w[:12]).upper().replace(" ", "\n> ") + " other words", "e"), (5, None, "e"), (6, "", "e"), (7, ITEM.replace("kernel", "curve"), "e"), (8, "quite other text " * 3000 + ITEM, "e"), (9, ITEM + " and again " + ITEM, "e"),
    ]
    items = [(10, ITEM, "s"), (10, ITEM, "s"), (11, "too short to leak", "s"), (12, None, "s")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in find_leaks(d, i).where("longest_run >= 12").collect()}
    brute = set()
    target = words(ITEM)
    grams = {tuple(target[k : k + 12]) for k in range(len(target) - 11)}
    for doc, text, _ in docs:
        t = words(text or "")
        if any(tuple(t[k : k + 12]) in grams for k in range(len(t) - 11)):
            brute.add(doc)
    assert set(got) == brute == {1, 2, 4, 7, 8, 9} and got[1].item_share == 1.0 and got[2].longest_run == 12 and 0.5 < got[7].item_share < 1
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0
    assert {r.doc_id for r in find_leaks(d, i, filter_bits=64).where("longest_run >= 12").collect()} == brute  # a filter that lets nearly all through changes nothing


def test_edited_copies_are_found_by_alignment(spark):
    """An item of sixty words of which every tenth is another: no run of twelve, so that only the alignment tells."""
    rng = random.Random(7)
    made = lambda n: ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]
    item, noise = made(60), [made(80) for _ in range(30)]
    edited = [w if k % 10 != 4 else "other" for k, w in enumerate(item)]
    dropped = [w for k, w in enumerate(item) if k % 9 != 3]
    docs = [(k, " ".join(n)) for k, n in enumerate(noise)] + [(100, " ".join(noise[0][:40] + edited + noise[1])), (101, " ".join(dropped)), (102, " ".join(noise[2] + item[20:27] + noise[3]))]
    got = {r.doc_id: r for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {100, 101} and all(r.longest_run < 12 and r.item_share > 0.8 for r in got.values())


def test_the_corpus_stays_where_it_is(spark):
    """Only documents with seeds are exchanged."""
    texts = [(k, f"text {k} of no item at all and its many plain words") for k in range(500)] + [(900, "before " + ITEM)]
    out = find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert [r.doc_id for r in out.collect()] == [900] and "MapInArrow" in out._jdf.queryExecution().toString()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=40))
def test_gram_hashes(tokens):
    h = gram_hashes(ids(tokens, WordIds()), 3)
    grams = [tuple(tokens[k : k + 3]) for k in range(len(tokens) - 2)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
