"""Mixes: caps are kept, shares are reached where they can be, deficits are told."""

import random

import pytest

from quillspark.llm.mixing import mix_sources

DOCS = "doc_id bigint, source string, text string, n_tokens bigint, copies int"
WEIGHTS = "mix_name string, source string, target_weight double, max_repeats int"


def docs(spark, **sizes):
    random.seed(2)
    rows = [(source, " ".join(["word"] * random.randint(1, 60))) for source, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame([(k, s, t, 1, 1) for k, (s, t) in enumerate(rows)] + [(9001, None, "no source", 1, 1), (9002, "a", None, 1, 1), (9003, "a", "", 1, 1)], DOCS)


def test_shares_and_caps(spark):
    weights = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "c", 0.2, 2), ("n", "a", 0.9, 1), ("n", "b", 0.1, 1), ("n", "none", 0.2, 3), ("m", "a", 0.5, 1)], WEIGHTS)
    mix = mix_sources(docs(spark, a=900, b=120, c=300, unweighted=50), weights)
    rows = {(r.mix_name, r.source): r for r in mix.shares(weights).collect()}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(rows["m", source].share - share) < 0.003
    assert abs(rows["n", "a"].share - 0.9) < 0.003 and rows["n", "none"].share == 0 and rows["n", "none"].deficit > 0.16
    copies = mix.copies().collect()
    caps = {("m", "a"): 1, ("m", "b"): 4, ("m", "c"): 2, ("n", "a"): 1, ("n", "b"): 1}
    assert all(1 <= r.copies <= caps[r.mix_name, r.source] for r in copies)
    assert len({(r.mix_name, r.doc_id) for r in copies}) == len(copies) and not {r.doc_id for r in copies} & {9001, 9002, 9003}


def test_long_documents_are_tilted_away_when_a_source_shrinks(spark):
    weights = spark.createDataFrame([("m", "a", 0.1, 1), ("m", "b", 0.9, 1)], WEIGHTS)
    mix = mix_sources(docs(spark, a=1000, b=400), weights)
    rates = {(r[0], r[1]): r[2] for r in mix.tilts}
    assert rates["m", "a"] < 0


def test_a_total_that_is_too_large_shows_deficits(spark):
    weights = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 2)], WEIGHTS)
    mix = mix_sources(docs(spark, a=500, b=20), weights, total_tokens=10_000)
    rows = {r.source: r for r in mix.shares(weights).collect()}
    assert rows["b"].tokens == 2 * rows["b"].source_tokens and rows["b"].deficit > 0 and abs(rows["a"].tokens - 5000) < 60


def test_empty(spark):
    weights = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", None, None)], WEIGHTS)
    assert mix_sources(docs(spark).where("doc_id = 9001"), weights).copies().count() == 0
    assert [r.share for r in mix_sources(docs(spark).where("doc_id = 9001"), weights).shares(weights).collect()] == [0.0, 0.0]
    assert mix_sources(docs(spark, a=5), weights.limit(0)).copies().count() == 0


def test_too_many_weights_are_refused(spark, monkeypatch):
    from quillspark.llm import mixing

    monkeypatch.setattr(mixing, "MOST_WEIGHTS", 1)
    with pytest.raises(ValueError):
        mix_sources(docs(spark, a=5), spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], WEIGHTS))
