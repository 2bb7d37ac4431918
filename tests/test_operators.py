"""Operators on literal tables: edges, ties and invariance under order and partitions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import scores as V
from quillspark.functions import text as X
from quillspark.operators import metrics as M
from quillspark.operators import preference as P
from quillspark.operators import relational as R
from quillspark.operators import sampling as SA
from quillspark.operators import series as S
from quillspark.operators.skew import lookup_join
from quillspark.sources import files, series_source
from quillspark.sources.judged import judged


def frame(spark, values, name="s"):
    start = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(name, start + datetime.timedelta(days=i), v) for i, v in enumerate(values)], "series string, d date, value double")


@pytest.mark.parametrize("n", [0, 1, 9, 10, 19, 20, 49, 50, 99, 100, 200, 201, 1001])
def test_series_of_every_length(spark, n):
    random = np.random.default_rng(n)
    values = [float(v) for v in 100 + random.normal(0, 1, n).cumsum()]
    df = frame(spark, values)
    for op in (S.statistics, S.profile, S.rolling, S.change_points, S.rolling_volatility, S.volatility_regimes, S.max_drawdown, S.losing_streak, S.uniform_segments, S.frequency, S.thinned, S.peaks_and_troughs):
        op(df).count()
    if n > 50:
        w = min(30, n // 10)
        means = {r.i: r.mean for r in S.rolling(df).collect()}
        assert len(means) == n - w + 1
        assert all(math.isclose(m, np.mean(values[i - w + 1 : i + 1]), rel_tol=1e-9) for i, m in means.items())
        got = S.max_drawdown(df).first()
        top = np.maximum.accumulate(values)
        assert math.isclose(got.drawdown, ((np.array(values) - top) / top).min(), rel_tol=1e-9)
        vol = {r.i: r.vol for r in S.rolling_volatility(df).collect()}
        v = min(60, n // 5)
        returns = lambda i: np.diff(values[i - v : i]) / np.array(values[i - v : i - 1])
        assert all(math.isclose(x, returns(i).std() * math.sqrt(252) * 100, rel_tol=1e-7) for i, x in vol.items())


def test_nulls_are_left_out_before_numbering(spark):
    df = frame(spark, [1.0, None, 2.0, float("nan"), 4.0])
    assert [r.r for r in S.with_returns(df).orderBy("d").collect()] == [None, 1.0, 1.0]
    assert S.percent_change(frame(spark, [0.0, 5.0]), 1).count() == 0


def test_plateau_peak_and_distance(spark):
    values = [0.0, 1.0, 5.0, 5.0, 5.0, 1.0, 0.0] + [0.0] * 20
    rows = [r for r in S.peaks_and_troughs(frame(spark, values)).collect() if r.kind == "peak"]
    assert [r.d.day for r in rows] == [4]


def test_piecewise_segments_find_the_bends(spark):
    values = [float(i) for i in range(50)] + [50.0 - 2 * i for i in range(50)]
    rows = S.piecewise_segments(frame(spark, values)).orderBy("segment").collect()
    assert rows[0].trend == "up" and rows[-1].trend == "down" and sum(r.segment >= 0 for r in rows) == 4


def test_lookup_join_keeps_every_row(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else f"k{k}") for k in range(300)], "n bigint, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("unused", 3)], "key string, v int")
    for share in (0.001, 0.5, 2.0):
        rows = {r.n: r.v for r in lookup_join(left, right, "key", share).collect()}
        assert len(rows) == 300 and rows[1] == 1 and rows[0] == 2 and rows[6] is None and rows[3] is None


def test_best_and_worst_keep_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 9), (1, 3, 5), (2, 0, 7), (2, 1, 7), (3, 0, 0), (3, 1, -1), (3, 2, 4)], "item int, i int, score int")
    rows = {r.item: (r.best, r.worst, r.delta) for r in P.best_and_worst(df, "item", "i", "score").collect()}
    assert rows == {1: (1, 0, 4)}


def test_results_do_not_depend_on_order_and_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("kind"))
    targets = spark.createDataFrame([("0", 5), ("1", 100), ("9", 3)], "kind string, target int")
    for op in (lambda d: SA.split(d, "id", 0.3), lambda d: SA.stratified(d, "id", "kind", targets), lambda d: SA.uniform(d, "id", 40)):
        a, b = op(df), op(df.orderBy(F.rand(1)).repartition(11))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert SA.stratified(df, "id", "kind", targets).groupBy("kind").count().orderBy("kind").collect() == [("0", 5), ("1", 72)]


def test_stratified_with_repeated_keys(spark):
    df = spark.range(1000).selectExpr("if(id < 990, 7, id) id", "'a' kind")
    targets = spark.createDataFrame([("a", 30)], "kind string, target int")
    assert [SA.stratified(df, "id", "kind", targets, seed).count() for seed in range(6)] == [30] * 6


def test_ordinals_are_gapless(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.v == r.ordinal for r in R.ordinals(df, "v").collect())


def test_format_score_cases(spark):
    heads = ["One", "Two", "Three", "Four"]
    texts = [None, "  ", "one two three four", "one " + "x" * 600, "ONE two THREE four " + "x" * 600, "one two " + "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.format_score(F.col("t"), heads).alias("s"))
    assert [round(r.s, 2) for r in df.collect()] == [0.0, 0.0, 1.0, 0.35, 1.0, 0.2]


def test_values_close(spark):
    cases = [(103.0, 100.0, True), (103.01, 100.0, False), (0.0005, 0.0, True), (0.01, 0.0, False), (-97.0, -100.0, True), (None, 1.0, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double").select(V.close(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [c for *_, c in cases]


def test_rouge_l_and_bleu_of_equal_and_different_texts(spark):
    pairs = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c d", "a x c y"), (3, None, "a"), (4, "", "")], "pair int, prediction string, reference string")
    f = {r.pair: round(r.f, 4) for r in M.rouge_l(pairs).collect()}
    assert f == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}
    assert round(M.corpus_bleu(pairs.where("pair = 1")).first().bleu, 6) == 1.0
    assert M.corpus_bleu(pairs.where("pair = 4")).first().bleu == 0.0
    assert round(M.meteor_exact(pairs.where("pair = 1")).first().meteor, 3) == round(1 - 0.5 / 6**3, 3)


def test_unknown_sources_and_failing_codes(spark):
    with pytest.raises(ValueError, match="unknown source"):
        series_source.resolve("nowhere")
    rows = series_source.fetch(spark, "Synthetic", ["a", "bad"], "2024-01-01", "2024-01-03").collect()
    assert sum(r.error is None for r in rows) == 3 and [r.series for r in rows if r.error] == ["bad"]


def test_roles_and_canonical_value(spark):
    df = spark.createDataFrame([("2024-01-01", 1.5, "x")], "when string, Close double, note string")
    assert series_source.roles(df) == ("when", ["Close"])
    assert series_source.canonical_value(df).first().value == 1.5


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a/chart.png").write_bytes(b"1"), (tmp_path / "a/analysis.txt").write_text(" text \n"), (tmp_path / "b/other.png").write_bytes(b"2"), (tmp_path / "b/empty.txt").write_text("  ")
    listed = files.list_files(spark, str(tmp_path))
    assert [r.folder for r in files.folders_with(listed, ["chart.png", "analysis.txt"]).collect()] == ["a"]
    assert {r.folder: r.path.rsplit("/", 1)[1] for r in files.first_match(listed, ["chart.png"]).collect()} == {"a": "chart.png", "b": "empty.txt"}
    assert [r.text for r in files.read_texts(spark, f"{tmp_path}/*/*.txt").collect()] == ["text"]
    (tmp_path / "x.json").write_text('{"a": 1, "b": {"c": 2}}'), (tmp_path / "y.json").write_text('{"a": 3}')
    assert {r.key: r.value for r in files.read_settings(spark, [f"{tmp_path}/x.json", f"{tmp_path}/y.json"]).collect()} == {"a": "3", "b": '{"c": 2}'}
    files.write_manifest(spark, f"{tmp_path}/m", "1.0", {"n": 2}, spark.range(2))
    version, config, tasks = files.read_manifest(spark, f"{tmp_path}/m", "id bigint")
    assert (version, config, tasks.count()) == ("1.0", {"n": 2}, 2)
    files.write_lines(spark.range(3), f"{tmp_path}/s1"), files.write_lines(spark.range(3, 5), f"{tmp_path}/s2")
    files.merge_shards(spark, [f"{tmp_path}/s1", f"{tmp_path}/s2", f"{tmp_path}/none"], "id bigint", "id", f"{tmp_path}/merged")
    assert files.read_lines(spark, f"{tmp_path}/merged", "id bigint").count() == 5


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path), "a int").collect()
    assert files.read_lines(spark, str(tmp_path), "a int", strict=False).collect() == [(1,)]


def test_judges_are_retried_and_recorded(spark):
    def judge(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    rows = judged(spark.createDataFrame([("a",), ("b",)], "t string"), "t", judge, parallel=1, wait=0.01).collect()
    assert sorted(r.reply for r in rows) == ["A", "B"]
    failed = judged(spark.createDataFrame([("bad",)], "t string"), "t", judge, parallel=1, wait=0.01).first()
    assert failed.reply is None and failed.error == "RuntimeError: no"


def test_large_cross_products_are_refused(spark):
    with pytest.raises(ValueError):
        R.cross(spark.range(20), spark.range(3).toDF("b"), most=10)


def test_sqlite_tables(spark, tmp_path):
    import sqlite3

    from quillspark.sources.sqlite_source import read_sqlite

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table images (id text primary key, n integer, v real)")
        db.execute("create table none (id integer)")
        db.executemany("insert into images values (?, ?, ?)", [(f"i{k}", k, None if k % 2 else k / 2) for k in range(50)])
    df = read_sqlite(spark, path, "images", 3)
    assert df.dtypes == [("id", "string"), ("n", "bigint"), ("v", "double")]
    assert df.count() == 50 and df.where("v is null").count() == 25 and df.agg(F.sum("n")).first()[0] == 1225
    assert read_sqlite(spark, path, "none").count() == 0


def test_streams(spark, tmp_path):
    from quillspark.streaming import steps

    log = f"{tmp_path}/log"
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:05", 2), ("b", "2024-01-01 00:20:00", 3)], "k string, ts string, n int").write.json(log)
    stream = lambda: steps.log_stream(spark, log, "k string, ts string, n int")
    steps.drain(steps.only_new(stream(), "k", "1 hour"), f"{tmp_path}/c1", f"{tmp_path}/o1")
    assert spark.read.parquet(f"{tmp_path}/o1").select("k").count() == 2
    steps.drain(steps.counted_windows(stream(), "k", "10 minutes", "1 minute"), f"{tmp_path}/c2", f"{tmp_path}/o2", "complete")
    assert sorted(r.rows for r in spark.read.parquet(f"{tmp_path}/o2").collect()) == [1, 2]
    steps.drain(steps.latest_state(stream().select("k", "n"), "k", "n"), f"{tmp_path}/c3", f"{tmp_path}/o3", "complete")
    spark.createDataFrame([("a", "2024-01-01 00:30:00", 9)], "k string, ts string, n int").write.mode("append").json(log)
    steps.drain(steps.latest_state(stream().select("k", "n"), "k", "n"), f"{tmp_path}/c3", f"{tmp_path}/o3", "complete")
    assert {r.k: r.n for r in spark.read.parquet(f"{tmp_path}/o3").collect()} == {"a": 9, "b": 3}
