import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakevec.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary here")
PIECES = ["'ll", "'re", "'s", " the", "ing", "\n", "\r\n", " ", "  ", "\t", " ", "　", "a", "é", "漢", "字", "ك", "𠮷", "👩🏽‍🚀", "12", ".", "!", "<|endoftext|>", "́", "\x1c", "\x85", "ß"]


@pytest.fixture(scope="module")
def enc():
    return encode.encoder(encode.read_ranks())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.text(st.characters(exclude_categories=["Cs"]), max_size=15))
def test_fragments_encode_as_the_whole(pieces, other):
    e = encode.encoder(encode.read_ranks())
    text = "".join(pieces) + other + "".join(pieces[::-1])
    want = e._bpe.encode_ordinary(text)
    assert list(e.encode(text)) == want and e.decode(want).decode() == text
    parts = e.fragments(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in e._bpe.encode_ordinary(p)] == want


def test_long_lines_are_cut(enc):
    r = random.Random(2)
    text = "".join(r.choice("漢字の東西南北山川ж") for _ in range(60_000)) + "x" * 9000 + "word " * 5000
    parts = enc.fragments(text)
    assert max(map(len, parts)) <= 35_000 and len(parts) > 3000
    assert [i for p in parts for i in enc._bpe.encode_ordinary(p)] == enc._bpe.encode_ordinary(text)


def test_short_lines_are_cut_like_long_ones(enc):
    """The cuts depend on the byte pairs only."""
    long = "漢字の東西南北山川ж" * 2000
    at = {len("".join(enc.fragments(long)[:i])) for i in range(1, 400)}
    short = long[:40]
    mine, n = set(), 0
    for p in enc.fragments(short)[:-1]:
        n += len(p)
        mine.add(n)
    assert mine == {x for x in at if x < 40}


def test_memory_is_bounded(enc, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 100)
    for i in range(200):
        enc.encode(f"line number {i}\nanother {i}")
    assert sum(map(len, enc._known)) < 300


def test_empty_null_and_ordinary_texts(spark):
    ranks = encode.read_ranks()
    rows = [(1, ""), (2, None), (3, "a<|endoftext|>b"), (4, " "), (5, "a" * 300_000), (5, "퟿")]
    df = spark.createDataFrame(rows, "ids long, text string")
    out = [r for r in df.select("ids", encode.token_ids("text", ranks).alias("out"), encode.token_counts("text", ranks).alias("n")).collect()]
    assert out[0]["out"] == [] and out[1]["out"] == [] and [r.n for r in out] == [len(r.out) for r in out]
    assert 50256 not in out[2]["out"] and out[3]["n"] == 1
    back = df.select("text", encode.token_ids("text", ranks).alias("i")).select(encode.byte_lengths("i", "text", ranks).alias("n")).collect()
    assert [r.n for r in back] == [0, 0, 15, 1, 300_000, 3]
    assert df.limit(0).select(encode.token_ids("text", ranks)).count() == 0


def test_table_of_pairs():
    inside = encode.inside_pairs({b"ab": 0, b"c": 1, b"bcd": 2})
    assert inside[ord("a"), ord("b")] and inside[ord("c"), ord("d")] and not inside[ord("b"), ord("a")] and inside.sum() == 3
