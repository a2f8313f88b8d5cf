import random
import re

import pytest
from pyspark.sql import functions as F

from lakevec.llm import truncation as T

DONE = [
    "The mill was built in 1630.",
    'They said "so it was."',
    "橋は1720年に建てられた。",
    "Text.\n\n== See also ==\n\n[[Category:Mills]]",
    "#REDIRECT [[Town (place)]]",
    "A thing.<ref>{{cite book|title=X|page=3}}</ref>",
    '{| class="wikitable"\n! a\n|-\n| b\n|}',
    "Prose.\n\n(The list is complete as of 1998)",
    "Prose.\nCoordinates: 41°39′N 7°21′W",
    "x {{#if:{{{seat|}}}|{{{seat}}}|—}} done.",
    "",
    "  \n ",
]
CUT = [
    "The mill was built in 16",
    "The mill was bui\r\n",
    "The mill.\n\nThe road to [[Har",
    "The mill.<ref>{{cite book|title=X|pa",
    "The mill.<ref>{{cite book|title=X}}</re",
    '{| class="wikitable"\n! a\n|-\n| b',
    "The mill.\n\n== Later ye",
    "The foundry divided th...",
    "The foundry divided th…",
    "年に礼拝堂は閉鎖されたが、1883年に[[池石月]]の支援で再開した。1595…",
    "The mill was closed after a disp\n\n[[Category:Imported pages]]",
    "The mill was closed �",
    "* [[A]]\n* ''Bridg",
    "built in 1760.&l",
]


FINISHED = re.compile(T.FINISHED)


@pytest.mark.parametrize("text", DONE)
def test_finished_shapes(text):
    tail, shape = T.shape(text)
    assert FINISHED.match(shape) or shape.endswith(("place", "closer, 5-12", "closer, 2-4")), shape


@pytest.mark.parametrize("text", CUT)
def test_shapes_of_cuts_are_not_finished(text):
    assert not FINISHED.match(T.shape(text)[1])


def test_tails_are_told_apart():
    assert [T.shape(t)[0] for t in ("Done.", "The di...", "To be continued ...", "x �", "A di\n\n[[Category:B]]", "")] == ["none", "dots", "spaced dots", "broken character", "added", "none"]
    assert T.shape("The foundry di...")[1] == T.shape("The foundry di")[1] == T.shape("The foundry di\n\n{{stub}}")[1]


def test_random_cuts_are_inside_and_repeatable():
    for t in ("ab", "The mill was built in 1630.", "漢" * 50):
        assert 1 <= T._cut_at(t) <= len(t) - 1 and T._cut_at(t) == T._cut_at(t)


def corpus(n=1200):
    """Documents of which those of source a longer than 500 characters, and of c longer than 400 bytes, are cut."""
    r, rows, cut = random.Random(4), [], set()
    for i in range(n):
        source = r.choice(["a", "b", "c", None])
        word = "ж" if source == "c" else "o"
        text = " ".join(f"Story {r.randrange(10**6)} t{word * r.randrange(1, 9)}ld {word}nce." for _ in range(r.randrange(2, 60)))
        whole = text
        if source == "a":
            text = text[:500]
        elif source == "c":
            text = text.encode()[:400].decode(errors="ignore")
        if text != whole and not text.rstrip().endswith("."):
            cut.add(i)
        rows.append((i, text, source))
    return rows, cut


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"state": F.lit(1), "lengths": F.lit(2), "same": F.lit(3), "doc": F.lit(4), "shape": F.lit(5), "n": F.lit(6)})
    shaped = T.shapes(df, "doc_id", "text", "source")
    found = T.limits(shaped)
    return shaped, found, T.truncated(shaped, found)


def test_limits_are_found_in_their_unit(spark):
    rows, cut = corpus()
    shaped, found, result = run(spark, rows)
    lengths = {(r.source, r.unit, r.length) for r in found.collect()}
    assert ("a", "chars", 500) in lengths and ("c", "bytes", 400) in lengths
    assert not any(s in ("b", None) for s, _, _ in lengths)
    got = {r.doc: r.cause for r in result.collect()}
    assert cut == set(got) and set(got.values()) == {"limit"}
    rates = {r.source: r for r in T.rates(shaped, result).collect()}
    assert set(rates) == {"a", "b", "c", None} and rates["b"].rate == 0 and rates["a"].n_cut == sum(rows[i][2] == "a" for i in cut)


def test_list_items_count_only_at_a_limit(spark):
    """Whole texts of both sources end with list items; one that ends at the limit of a is cut."""
    rows, _ = corpus()
    item = "x.\n* " + "y" * 495
    rows += [(6000 + i, f"Story {i}.\n* item {'z' * (i % 90)}", "a" if i % 2 else "b") for i in range(300)]
    rows += [(5000, item, "a"), (5001, item, "b"), (5002, "Story 7 told once. Cut in the mid of a longer senten", "b")]
    got = {r.doc: r.cause for r in run(spark, rows)[2].collect()}
    assert got[5000] == "limit" and 5001 not in got and got[5002] == "transfer"
    assert not any(d >= 6000 for d in got)


def test_a_source_whose_texts_end_without_marks_is_not_cut(spark):
    """Titles, names and addresses: nothing in them tells a cut but that other sources' texts don't end so."""
    rows, cut = corpus()
    r = random.Random(9)
    words = ["See also", "Category: people", "Main Street 5\n\nJohn Smith", "He said hello", "The old mill of the town"]
    rows += [(7000 + i, f"{r.choice(words)} {r.choice('abcdefgh')}{'x' * r.randrange(9)}", "titles") for i in range(600)]
    found = {r.doc for r in run(spark, rows)[2].collect()}
    assert not any(d >= 7000 for d in found) and len(cut - found) <= 0.02 * len(cut)


def test_transfer_cuts_are_found_by_the_share_of_their_source(spark):
    r = random.Random(6)
    rows, cut = [], set()
    for i in range(2000):
        text = " ".join(f"Story {r.randrange(10**6)} was told {'o' * r.randrange(1, 9)}nce." for _ in range(r.randrange(2, 40)))
        if i % 25 == 0:
            text = text[: r.randrange(10, len(text) - 2)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, text, r.choice(["a", "b"])))
    got = {x.doc: x.cause for x in run(spark, rows)[2].collect()}
    assert len(cut - set(got)) <= 0.05 * len(cut) and len(set(got) - cut) <= 0.05 * len(cut) and set(got.values()) == {"transfer"}


def test_copies_make_no_limit(spark):
    rows = [(i, "* a list of one thing", "s") for i in range(200)] + [(1000 + i, "A short text. " * (i % 40) + "End.", "s") for i in range(300)]
    assert run(spark, rows)[1].count() == 0


def test_edges(spark):
    _, found, result = run(spark, [])
    assert found.count() == 0 and result.count() == 0
    long = " ".join(f"w{i}" for i in range(300_000)) + " brok"
    alone = [(-1, None, None), (-2, "", "s"), (-3, long, "s"), (-3, long, "s")]
    shaped, _, result = run(spark, alone)
    # one text alone says nothing about how whole ones end
    assert result.count() == 0 and {r.source: r.n_docs for r in T.rates(shaped, result).collect()} == {None: 1, "s": 3}
    rows, cut = corpus(300)
    assert {r.doc for r in run(spark, rows + [(d, t, s and "a") for d, t, s in alone])[2].collect()} - cut == {-3}
