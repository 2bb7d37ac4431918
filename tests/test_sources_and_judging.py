"""Sources, sinks, skewed joins, samples and metrics against plain computations."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import records as N
from quillspark.functions import text as X
from quillspark.operators import aggregates as A
from quillspark.operators import evaluators as E
from quillspark.operators import metrics as M
from quillspark.operators import relational as R
from quillspark.operators import sampling as S
from quillspark.operators.skew import hot_keys, lookup_join, matched
from quillspark.plans import catalogue
from quillspark.sources import files, judged, quotes, series_source, sqlite_source


@pytest.mark.parametrize("share", [0.001, 0.1, 2.0])
def test_matched_is_an_inner_join(spark, share):
    random.seed(1)
    left = [(random.choice(["hot", "hot", "a", "b", None]), k) for k in range(60)]
    right = [(random.choice(["hot", "hot", "hot", "b", "c", None]), k % 40, k % 3 == 0) for k in range(300)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int, z boolean")
    want = Counter((k, x, y, z) for k, x in left for j, y, z in right if k is not None and k == j)
    assert Counter(tuple(r) for r in matched(a, b, "k", share).select("k", "x", "y", "z").collect()) == want
    assert matched(a, b.limit(0), "k", share).count() == 0


def test_hot_keys_are_few_and_costly_sides_are_written_once(spark):
    df = spark.range(2000).selectExpr("case when id < 700 then 'a' else cast(id as string) end as k", "id as x")
    assert [(r.k, r.rows) for r in hot_keys(df, "k", 0.01).collect()] == [("a", 700)]
    grouped = df.groupBy("k").agg(F.max("x").alias("x"))
    plan = lookup_join(grouped, df.select("k", F.col("x").alias("y")).dropDuplicates(["k"]).where("k = 'a'"), "k")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [k" not in plan.split("LeftAnti")[0].split("Join")[0]


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from quillspark import session

    conf = SimpleNamespace(get=lambda key: None)
    for master, fails in (("spark://host:7077", True), ("local-cluster[3,2,3000]", True), ("yarn", True), ("local[8]", False), ("local", False)):
        made = []
        context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=made.append)
        if fails:
            with pytest.raises(ValueError):
                session.shared_folder(SimpleNamespace(sparkContext=context))
        else:
            assert session.shared_folder(SimpleNamespace(sparkContext=context)) == made[0]


def test_json_arrays_of_every_size(spark, tmp_path):
    for n in (0, 1, 2, 12_000):
        files.write_json_array(spark.range(n).selectExpr("id", "concat('ü\"', id) as t"), f"{tmp_path}/{n}", 1)
        parts = [p for p in (tmp_path / str(n)).iterdir() if p.name.startswith("part-")]
        rows = [r for p in parts for r in json.loads(p.read_text() or "[]")]
        assert sorted(r["id"] for r in rows) == list(range(n)) and all(r["t"] == f'ü"{r["id"]}' for r in rows)


def test_steps_go_on_where_they_ended(spark, tmp_path):
    calls = []

    def work(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df

    df = spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(RuntimeError):
        files.write_in_steps(df, f"{tmp_path}/out", "k", 3, work)
    assert (tmp_path / "out-parts").exists()
    assert files.write_in_steps(df, f"{tmp_path}/out", "k", 3, work).count() == 50
    assert len(calls) == 4 and not (tmp_path / "out-parts").exists()


def test_whole_files_keep_their_lines_together(spark, tmp_path):
    for folder, text in (("a", " one\ntwo \n"), ("b", " \n "), ("c", "three")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(text)
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"one\ntwo", "three"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "lines.json").write_text('{"n": 5}\n\n{"n": 3}\n')
    assert [(r.place, r.n) for r in files.in_file_order(spark, f"{tmp_path}/l", "n int").orderBy("place").collect()] == [(0, 5), (2, 3)]


def test_predicates_reach_the_database(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (k INTEGER, v TEXT)")
        db.executemany("insert into t values (?, ?)", [(k, None if k % 4 == 0 else f"v{k}") for k in range(30)])
    read = lambda where: {r.k for r in sqlite_source.read_sqlite(spark, path, "t", 3, where).collect()}
    assert read([["v", "is null"]]) == set(range(0, 30, 4)) and read([["k", "<", 9], ["v", "like", "v%"]]) == {1, 2, 3, 5, 6, 7}
    with pytest.raises(ValueError):
        sqlite_source.read_sqlite(spark, path, "t", 3, [["k", "; drop table t", 1]])


def test_one_bad_item_costs_no_other_its_reply(spark):
    def call(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bad", "b", None, "a"])], "k int, t string")
    got = {r.k: (r.reply, r.error) for r in judged.judged(rows, "t", judged.one_by_one(lambda t: None if t is None else call(t)), 1, 2, 0.01).collect()}
    assert got == {0: ("A", None), 1: (None, "ValueError: no"), 2: ("B", None), 3: (None, None), 4: ("A", None)}


def test_sources_refuse_what_they_do_not_know(spark):
    with pytest.raises(ValueError):
        quotes.raw_quotes(spark, "bonds", ["a"], "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        quotes.cross_section(spark, "nothing")
    raw = quotes.raw_quotes(spark, "equity", ["bad1", "ok1"], "2024-01-01", "2024-01-02").collect()
    assert sum(r.error is not None for r in raw) == 1 and len(raw) == 3


def test_offline_series_are_those_of_their_transport(spark, data):
    rows = catalogue.queries()["s11_series"](spark, data).collect()
    for code in {r.series for r in rows} - {"bad_one"}:
        assert [(r.d, r.value) for r in sorted((r for r in rows if r.series == code), key=lambda r: r.d)] == [(d, round(float(v), 4)) for d, v in series_source.walk(code, "2024-01-01", "2024-03-31")]
    assert [r.error for r in rows if r.series == "bad_one"] == ["ValueError: no series bad_one"]


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x]}"}], "c": "d\\" {"}', '[{"k": "v"}, {"k": [1, 2, [3]]}]', '{"a": {"b": {"c": [[]]}}}'])
def test_json_cut_anywhere_is_closed(spark, text):
    cuts = spark.createDataFrame([(k, text[:k]) for k in range(1, len(text) + 1)], "k int, t string").select("k", X.fenced_json(F.col("t")).alias("j"), "t")
    for r in cuts.collect():
        body = r.t.rstrip(", ")
        open_, quoted, escaped = [], False, False
        for c in body:
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]":
                open_.pop()
        assert r.j == body + ('"' if quoted else "") + "".join(reversed(open_)), r.t
    assert json.loads([r.j for r in cuts.collect()][-1]) == json.loads(text)


def test_nested_values_are_keys_and_not_texts(spark):
    cases = {'{"t": "the \\"score\\": 3 of", "a": {"score": 7}}': "7", '{"score": {"score": "x, y"}}': "x, y", '{"a": [1, {"score": null}]}': "null", '{"a": "score"}': None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", N.nested_value(F.col("t"), "score").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_scores_that_are_no_numbers_get_the_default(spark):
    df = spark.createDataFrame([("7.9",), ("-3",), ("1000",), ("x",), (None,), ("",)], "t string").select(X.bounded_score(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [7, 1, 100, 50, 50, 50]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1001])
def test_spread_quantiles(spark, n):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=n).round(2), "b": np.full(n // 2, 3.0), None: rng.integers(0, 4, n).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, some in values.items() for v in some] + [("a", None)], "g string, v double")
    got = {r.g: r.q for r in A.spread_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    assert set(got) == {g for g, some in values.items() if len(some)}
    for g, q in got.items():
        assert np.allclose(q, np.quantile(values[g], [0.0, 0.25, 0.5, 0.99, 1.0]))


def test_histories_in_chunks(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(95)] + [("b", 7), (None, 1)], "key string, n int")
    got = R.chunked_history(spark.createDataFrame([("hot",), ("b",), ("none",)], "key string"), rows, "key", ["n"], ["n"], 10).collect()
    assert max(len(r.history) for r in got) == 10 and {r.key: 0 for r in got} == {"hot": 0, "b": 0, "none": 0}
    assert [h.n for r in sorted((r for r in got if r.key == "hot"), key=lambda r: r.chunk) for h in r.history] == list(range(95))
    assert [len(r.history) for r in got if r.key != "hot"] in ([1, 0], [0, 1])


def test_splits_and_strata_are_exact(spark):
    df = spark.range(5000).selectExpr("id as k", "case when id < 4000 then 'hot' when id % 3 = 0 then null else 'b' end as s")
    order = sorted(range(5000), key=lambda k: __import__("hashlib").md5(f"7:{k}".encode()).hexdigest())
    for ratio in (0.0, 0.37, 1.0):
        train = {r.k for r in S.split(df, "k", ratio, 7).where("split = 'train'").collect()}
        assert train == set(order[: int(5000 * ratio)])
    got = S.stratified(df, "k", "s", spark.createDataFrame([("hot", 123), ("b", 10_000), ("none", 5)], "s string, target int"), 7).collect()
    hot = {r.k for r in got if r.s == "hot"}
    assert hot == set([k for k in order if k < 4000][:123]) and sum(r.s == "b" for r in got) == df.where("s = 'b'").count()


def test_picks_follow_their_chances(spark):
    chances = spark.createDataFrame([("a", "x", 0.2), ("a", "y", 0.8), ("b", "x", 1.0), ("b", "z", 0.0)], "g string, item string, chance double")
    rows = spark.range(4000).selectExpr("id as k", "case when id % 2 = 0 then 'a' when id % 4 = 1 then 'b' else 'none' end as g")
    got = Counter((r.g, r.item) for r in S.grouped_pick(rows, "k", "g", chances, "item", 3).collect())
    assert got["b", "x"] == 1000 and got["none", None] == 1000 and abs(got["a", "x"] - 400) < 60 and got["a", "x"] + got["a", "y"] == 2000


STEMS = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis formality:formal electricity:electr hopeful:hope goodness:good revival:reviv allowance:allow adjustable:adjust replacement:replac adoption:adopt homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"


def test_stems_are_those_of_the_published_rules():
    pairs = [p.split(":") for p in STEMS.split()]
    assert [M.stem(a) for a, _ in pairs] == [b for _, b in pairs] and M.stem("价格") == "价格" and M.stem("b2b") == "b2b"


def test_smoothed_bleu(spark):
    df = spark.createDataFrame([(1, "the cat, sat on 3.5 mats.", "a cat sat, on 3.5 mats."), (2, "", "x")], "pair int, prediction string, reference string")
    assert spark.createDataFrame([("It's 3.5-4,000 (so-so), e.g. x.",)], "t string").select(X.tokens_13a(F.col("t")).alias("w")).first().w == ["It's", "3.5", "-", "4,000", "(", "so-so", ")", ",", "e", ".", "g", ".", "x", "."]
    row = M.corpus_bleu(df, X.tokens_13a, True).first()
    p, r = ["the", "cat", ",", "sat", "on", "3.5", "mats", "."], ["a", "cat", "sat", ",", "on", "3.5", "mats", "."]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = [sum((grams(p, n) & grams(r, n)).values()) / (len(p) - n + 1) for n in range(1, 5)]
    assert [row[f"p{n}"] for n in range(1, 5)] == pytest.approx(want)
    none = M.corpus_bleu(spark.createDataFrame([(1, "a b c d e", "a c e b d")], "pair int, prediction string, reference string"), smooth=True).first()
    assert [none.p2, none.p3, none.p4] == pytest.approx([1 / 2 / 4, 1 / 4 / 3, 1 / 8 / 2]) and none.bleu > 0
    assert M.corpus_bleu(df.limit(0), smooth=True).first().bleu == 0


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for k, b in enumerate(y):
            before, row[k + 1] = row[k + 1], before + 1 if a == b else max(row[k + 1], row[k])
    return row[-1]


def meteor(x, y, stem=None):
    free, at = list(range(len(y))), []
    for w in x:
        k = next((k for k in free if y[k] == w), -1)
        at.append(k)
        if k >= 0:
            free.remove(k)
    if stem:
        for i, w in enumerate(x):
            if at[i] < 0:
                k = next((k for k in free if stem(y[k]) == stem(w)), -1)
                if k >= 0:
                    at[i] = k
                    free.remove(k)
    hits = [(i, k) for i, k in enumerate(at) if k >= 0]
    if not hits:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(hits, hits[1:]))
    p, r = len(hits) / len(x), len(hits) / len(y)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(hits)) ** 3)


def test_text_metrics_against_plain_ones_on_the_tables(spark, data):
    import re

    from quillspark.plans.texts import pairs

    words = lambda t: re.findall("[a-z0-9]+|[一-鿿]", (t or "").lower())
    rows = {r.pair: (words(r.prediction), words(r.reference)) for r in pairs(spark, data).collect()}
    q = catalogue.queries()
    for name, column, want in (
        ("a24_rouge_l", "f", lambda x, y: 2 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0),
        ("a25_meteor", "meteor", meteor),
        ("a25_meteor_stemmed", "meteor", lambda x, y: meteor(x, y, M.stem)),
    ):
        got = {r.pair: r[column] for r in q[name](spark, data).collect()}
        assert set(got) == set(rows) and all(math.isclose(got[k], want(*rows[k]), abs_tol=1e-5) for k in rows), name
    stemmed = {(r.pair, r.n): r.f for r in q["a24_rouge_stemmed"](spark, data).collect()}
    for k, (x, y) in rows.items():
        a, b = Counter(map(M.stem, x)), Counter(map(M.stem, y))
        want = 2 * sum((a & b).values()) / (len(x) + len(y)) if x and y else 0.0
        assert math.isclose(stemmed.get((k, 1), 0.0), want, abs_tol=1e-5)


def test_peaks_and_lines_against_plain_ones_on_the_tables(spark, data):
    """Every peak is a local extreme that stands out by half a deviation; every line is the least squares one of its rows."""
    q = catalogue.queries()
    peaks, lines = q["w09_peaks"](spark, data).collect(), q["w10_piecewise_segments"](spark, data).collect()
    assert peaks and lines and all(r.prominence > 0 for r in peaks)
    by = {}
    for r in lines:
        by.setdefault(r.series, []).append(r)
    for some in by.values():
        some.sort(key=lambda r: r.segment)
        assert [r.segment for r in some] == list(range(len(some))) and all(a.stop < b.start or a.stop <= b.start for a, b in zip(some, some[1:]))
        assert all((r.trend == "up") == (r.slope > 0) or r.trend == "flat" for r in some)


def test_facts_zips_and_preferences(spark):
    rows = spark.createDataFrame([(1, [(1, 2, 5.0), (2, 9, 6.0)], [(2, 1.0), (2, 3.0)]), (2, [], [(1, 1.0)]), (3, None, None)], "k int, p array<struct<id: int, ref_id: int, value: double>>, r array<struct<id: int, value: double>>")
    assert sorted(map(tuple, N.matched_facts(rows, "k", "p", "r").collect())) == [(1, 1, 2, 5.0, 1.0), (1, 2, 9, 6.0, None)]
    lists = spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, [], ["b"]), (3, None, ["c"])], "k int, a array<int>, b array<string>")
    assert [tuple(r) for r in N.zipped_lists(lists, "k", "a", "b").collect()] == [(1, 0, 1, "a")]
    kept, counts = N.with_preferences(spark.range(4).toDF("k"), spark.createDataFrame([(0, "success"), (1, "failed")], "k long, status string"), "k")
    assert [r.k for r in kept.collect()] == [0] and tuple(counts.first()) == (1, 2, 1)


def test_evaluators_share_one_interface(spark):
    pairs = spark.createDataFrame([(1, "Layout: 10.1 up", "10"), (2, None, "7"), (3, "7", "8")], "pair int, prediction string, reference string")
    got = {r.pair: r for r in E.evaluated(pairs, [E.Sections(["Layout", "Figures"]), E.Values(), E.Overlap(1)]).collect()}
    assert (got[1].sections, got[1]["values"], got[2]["values"], got[3]["values"], got[3].overlap) == (0.5, 1.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        E.compute_score("nothing", F.lit("a"), F.lit("b"), F.lit("c"))
    with pytest.raises(TypeError):
        E.Overlap().evaluate(F.lit("a"), F.lit("b"))


def test_the_rest_passes_without_the_subpackage_on_disk(tmp_path):
    """The folder is left out, and the package imports, lists its queries and runs one."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and not any(n.startswith(('p1_', 'p3_')) for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_rolling_windows_of_long_series(spark):
    """Places times a width don't fit into an integer from row 2148 on."""
    from quillspark.operators import series as W

    n = 5000
    v = np.random.default_rng(4).normal(size=n).cumsum() + 100
    df = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(v)], "series string, d int, value double")
    got = W.rolling(df).orderBy("i").collect()
    assert [r.i for r in got] == list(range(29, n))
    assert np.allclose([r["mean"] for r in got], np.lib.stride_tricks.sliding_window_view(v, 30).mean(axis=1))
    assert np.allclose([r["std"] for r in got], np.lib.stride_tricks.sliding_window_view(v, 30).std(axis=1, ddof=1))
    vol = {r.i: r.vol for r in W.rolling_volatility(df).collect()}
    returns = np.diff(v) / v[:-1]
    assert set(vol) == set(range(60, n)) and all(math.isclose(vol[i] / vol[100], returns[i - 60 : i - 1].std() / returns[40:99].std(), rel_tol=1e-9) for i in (60, 61, 3000, n - 1))
