from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.packing import pack, pack_documents, token_counts


def brute(sizes, capacity):
    """The same rule, stated plainly: try every level and keep the least sum of squares, the fullest level among equals."""
    counts, moves = defaultdict(int), []
    for s in sizes:
        while s > capacity:
            s -= capacity
        if s == 0:
            continue
        best = None
        for level in [0] + [h for h in range(1, capacity) if counts[h]]:
            if level + s <= capacity:
                after = dict(counts)
                if level:
                    after[level] -= 1
                if level + s < capacity:
                    after[level + s] = after.get(level + s, 0) + 1
                cost = (sum(v * v for v in after.values()), -level)
                best = min(best or (cost, level), (cost, level))
        level = best[1]
        if level:
            counts[level] -= 1
        if level + s < capacity:
            counts[level + s] += 1
        moves.append(level)
    return moves


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 12))
def test_against_brute_force(sizes, capacity):
    placed = pack(np.array(sizes, np.int64), capacity)
    fill, parts = defaultdict(int), defaultdict(list)
    for item, part, container, offset, size in placed:
        assert size == 0 or offset == fill[container]
        fill[container] += size
        parts[item].append((part, size))
    assert all(f <= capacity for f in fill.values()) and set(parts) == set(range(len(sizes)))
    for item, size in enumerate(sizes):
        assert sum(s for _, s in parts[item]) == size and [p for p, _ in parts[item]] == list(range(len(parts[item])))
        assert size > capacity or len(parts[item]) == 1  # only what exceeds a container is split
    whole = [offset for item, part, c, offset, s in placed if s and not (s == capacity and sizes[item] > capacity and part < len(parts[item]) - 1)]
    assert whole == brute(sizes, capacity)


def test_little_room_is_wasted():
    sizes = np.random.default_rng(1).lognormal(5.4, 0.8, 20_000).astype(np.int64) + 1
    for capacity in (512, 2048):
        containers = max(p[2] for p in pack(sizes, capacity)) + 1
        assert sizes.sum() / (containers * capacity) > 0.98


def test_documents(spark):
    rows = [(1, "alpha beta " * 40, "e"), (1, "alpha beta " * 40, "e"), (2, None, "e"), (3, "", "e"), (4, "word", "e"), (5, "gamma " * 700, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, container string")
    assert {(r.doc_id, r.n_tokens > 0) for r in token_counts(docs).collect()} == {(1, True), (2, False), (3, False), (4, True), (5, True)}
    got = pack_documents(docs, [("pack_a", 64), ("pack_b", 512)], shard_docs=2).collect()
    used = defaultdict(int)
    for r in got:
        used[r.used_for, r.container] += r.n_tokens
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and all(v <= {"pack_a": 64, "pack_b": 512}[k[0]] for k, v in used.items())
    assert sum(r.n_tokens for r in got if r.used_for == "pack_a") == sum(r.n_tokens for r in token_counts(docs).collect())
    assert pack_documents(docs.limit(0), [("pack_a", 64)]).count() == 0
