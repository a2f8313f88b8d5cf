import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakevec.llm import mixture

KIND = "doc_id long, source string, n long, copies int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), min_size=1, max_size=60), st.integers(0, 99))
def test_rounding_keeps_the_total(rows, seed):
    size, f = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    g = mixture.settle(np.arange(len(rows)), size, f, seed)
    assert ((g > 0) & (g < 1)).sum() <= 1 and (g >= 0).all() and (g <= 1).all()
    assert np.isclose((g * size).sum(), (f * size).sum(), atol=1e-6 * max(1, size.sum()))
    assert (g[(f == 0) & (size > 0)] == 0).all() and (g[(f == 1) & (size > 0)] == 1).all()


def test_rounding_has_no_bias():
    r = np.random.default_rng(0)
    size, f = r.integers(0, 300, 80), r.random(80)
    mean = np.mean([mixture.settle(np.arange(80), size, f, s) for s in range(3000)], axis=0)
    assert np.abs(mean - f).max() < 0.04


def run(spark, docs, weights, **k):
    d = spark.createDataFrame(docs, KIND).repartition(3)
    w = spark.createDataFrame(weights, "source string, target_share double, max_repeats int")
    chosen, report = mixture.mix(d, "doc_id", "source", "n", w, **k)
    return {r.doc: r for r in chosen.collect()}, {r.source: r for r in report.collect()}


def docs(n=900):
    r = np.random.default_rng(3)
    sources = ["big"] * (n * 2 // 3) + ["mid"] * (n // 4) + ["tiny"] * (n - n * 2 // 3 - n // 4)
    return [(i, s, int(x), 1) for i, (s, x) in enumerate(zip(sources, r.integers(0, 400, n)))]


WEIGHTS = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 5), (None, 0.1, 1)]


@pytest.mark.parametrize("fan_in", [2, 32])
def test_shares_are_reached(spark, monkeypatch, fan_in):
    monkeypatch.setattr(mixture, "FAN_IN", fan_in)
    monkeypatch.setattr(mixture, "BLOCK", 64)
    rows = docs()
    chosen, report = run(spark, rows, WEIGHTS)
    assert sorted(chosen) == [r[0] for r in rows] and set(report) == {"big", "mid", "tiny", "none"}
    total = sum(r.tokens for r in report.values())
    for s, cap in (("big", 1), ("mid", 2), ("tiny", 3)):
        mine = [r for r in chosen.values() if r.source == s]
        assert max(r.copies for r in mine) <= cap
        assert report[s].tokens == sum(r.size * r.copies for r in mine)
        assert abs(report[s].tokens - report[s].goal_share * total) <= 3 * 400
    assert report["none"].actual_share == 0 and report["none"].n_docs == 0
    # all three can't be full at once: one source bounds the mixture and uses its cap
    assert any(all(r.copies == cap for r in chosen.values() if r.source == s and r.size) for s, cap in (("big", 1), ("mid", 2), ("tiny", 3)))
    assert {k: v.copies for k, v in run(spark, rows, WEIGHTS)[0].items()}.keys() == chosen.keys()


def test_the_mixture_does_not_depend_on_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 64)
    w = spark.createDataFrame(WEIGHTS, "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs(400), KIND)
    one, two = ({(r.doc, r.copies) for r in mixture.mix(x, "doc_id", "source", "n", w)[0].collect()} for x in (d.repartition(2), d.repartition(5, "n")))
    assert one == two


def test_a_larger_total_leaves_capped_sources_short(spark):
    _, report = run(spark, docs(), WEIGHTS, total=10**6)
    assert report["big"].n_copies == report["big"].n_docs and report["big"].actual_share < report["big"].goal_share


def test_edges(spark):
    chosen, report = run(spark, [], WEIGHTS)
    assert chosen == {} and report["big"].tokens == 0
    rows = [(1, None, 10, 0), (2, "odd", 10, 0), (3, "big", None, 0), (4, "big", 0, 0), (5, "big", 7, 0), (6, "big", -4, 0)]
    chosen, report = run(spark, rows, WEIGHTS)
    assert sorted(chosen) == [1, 2, 3, 4, 5, 6] and chosen[1].copies == chosen[2].copies == 0
    assert report["big"].tokens == 7 and report["big"].actual_share == 1
    _, report = run(spark, rows, [("big", None, 1), ("odd", 0.5, None)])
    assert report["big"].tokens == 0 and report["odd"].tokens == 0
