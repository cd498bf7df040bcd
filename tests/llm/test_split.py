import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm.split import split_oversized, split_text


def joined(text, spans):
    out, last = "", 0
    for a, b in spans:
        out += text[max(a, last) : b]
        last = b
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab ,.;\n\r。 é́‍😀", max_size=400), st.integers(1, 70), st.integers(0, 90))
def test_round_trip_and_limits(text, size, overlap):
    spans = split_text(text, size, overlap)
    allowed = overlap if overlap < size else size // 2
    assert joined(text, spans) == text and all(0 < b - a <= size for a, b in spans)
    assert all(c <= b and b - c <= allowed and c > a and d > b for (a, b), (c, d) in zip(spans, spans[1:], strict=False))


def test_cuts_at_natural_boundaries():
    text = "\n\n".join("Sentence number one is here. Another follows it." for _ in range(40))
    spans = split_text(text, 500, 0)
    assert len(spans) == -(-len(text) // 500) or len(spans) == -(-len(text) // 500) + 1
    assert all(text[:b].endswith("\n\n") for _, b in spans[:-1])
    lengths = [b - a for a, b in spans]
    assert max(lengths) - min(lengths) < 200  # balanced
    assert split_text("", 5, 1) == [] and split_text("abc", 5, 1) == [(0, 3)]
    assert [b - a for a, b in split_text("x" * 100, 30, 5)] and joined("x" * 100, split_text("x" * 100, 30, 5)) == "x" * 100
    with pytest.raises(ValueError):
        split_text("a", 0, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a, ", "end. ", "x" * 9, "\n", "\n\n"]), min_size=60, max_size=400))
def test_overlap_is_near_what_was_asked(parts):
    text, size, overlap = "".join(parts), 100, 20
    spans = split_text(text, size, overlap)
    assert all(0.75 * overlap <= b - c <= overlap for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_rows(spark):
    rows = [("block", 1, 0, "word " * 50, 100, 10, "e"), ("block", 1, 0, "word " * 50, 100, 10, "e"), ("block", 2, 0, "x" * 100, 100, 10, "e"), ("block", 3, 0, None, 100, 10, "e"), ("block", 4, 0, "", 100, None, "e"), ("selection", 5, -1, "y" * 101, 100, None, "e"), ("other", 6, -1, "y" * 101, None, 1, "e")]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, block_index long, text string, max_size long, overlap long, pieces string")
    got = split_oversized(df).collect()
    assert {r.item_id for r in got} == {1, 5} and sum(r.item_id == 1 for r in got) == 2 * max(r.pieces for r in got if r.item_id == 1)
    assert split_oversized(df.limit(0)).count() == 0
