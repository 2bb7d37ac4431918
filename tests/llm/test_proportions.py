"""Samples against brute force."""

import math
import random

from quillspark.llm.proportions import proportion_sample

TARGETS = "target_id int, config_name string, chart_type string, theme string, ratio double, min_rows int, total_samples int"
TASKS = "task_id string, chart_type string, theme string, target_id int, draw double"


def plain(v):
    return None if v is None else v.strip().lower().replace("-", "_")


def brute(tasks, targets):
    out = {}
    for tid, _, c, t, ratio, least, total in targets:
        need = max((ratio or 0.0) * (total or 0) if ratio is not None and total is not None else 0.0, float(least or 0))
        have = {k for k, kc, kt, *_ in tasks if k is not None and (c is None or plain(kc) == plain(c)) and (t is None or plain(kt) == plain(t))}
        out[tid] = (need, have)
    return out


def check(spark, tasks, targets):
    p = proportion_sample(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(targets, TARGETS))
    expected = brute(tasks, targets)
    assert {r.target_id for r in p.unmet().collect()} == {t for t, (need, have) in expected.items() if len(have) < need}
    drawn: dict = {}
    for r in p.sample().collect():
        assert r.task_id not in drawn.setdefault(r.target_id, set())
        drawn[r.target_id].add(r.task_id)
    for t, (need, have) in expected.items():
        got = drawn.get(t, set())
        assert got <= have and len(got) == min(math.ceil(need), len(have))
    return p


def test_dirty_tables(spark):
    random.seed(5)
    kinds, themes = ["bar", " BAR ", "Line-Band", "line_band", None, ""], ["bonds", "BONDS", "fund-flows", "fund_flows", None]
    tasks = [(f"t{k}", random.choice(kinds), random.choice(themes), 9, 0.5) for k in range(3000)]
    tasks += tasks[:100] + [(None, "bar", "bonds", 1, 0.1)]
    targets = [(1, "a", "bar", None, 0.2, 10, 1000), (2, "a", "LINE_BAND", None, 0.9, 1, 5000), (3, "b", None, "bonds", 0.001, 40, 1000), (4, "b", None, None, 0.5, 0, 1000), (5, "b", "bar", "fund_flows", None, None, None), (6, "b", "none", None, 0.1, 1, 10), (7, "a", "bar", "bonds", 0.1, 3, None)]
    p = check(spark, tasks, [*targets, targets[0]])
    report = {r.target_id: r for r in p.report().collect()}
    assert len(report) == 7 and report[6].deficit == 1.0 and report[5].drawn == 0
    assert abs(sum(r.share for r in report.values() if r.config_name == "a") - 1) < 1e-9


def test_one_category_holds_nearly_all(spark):
    tasks = [(f"t{k}", "line" if k % 50 else "pie", "x", 1, 0.0) for k in range(20_000)]
    check(spark, tasks, [(1, "a", "line", None, 0.5, 0, 20_000), (2, "a", "pie", None, 0.02, 0, 20_000), (3, "a", "line", "x", 1.0, 0, 19_600)])


def test_empty(spark):
    check(spark, [], [(1, "a", "line", None, 0.5, 0, 10), (2, "a", None, None, 0.0, 0, 10)])
    check(spark, [("t", "line", "x", 1, 0.0)], [])


def test_many_targets_draw_the_same(spark, monkeypatch):
    """Above BROADCAST_TARGETS the lookup is a shuffle whose hot key, all tasks under "any", is cut into parts."""
    from quillspark.llm import proportions

    random.seed(9)
    tasks = [(f"t{k}", random.choice(["bar", "Line", None]), random.choice(["fx", None]), 1, 0.5) for k in range(400)]
    targets = [(1, "a", None, None, 0.5, 1, 100), (2, "a", "bar", None, 0.3, 1, 100), (3, "a", "line", "fx", 0.2, 1, 1000), (4, "a", "pie", None, 0.1, 1, 10)]
    draw = lambda: sorted(map(tuple, proportion_sample(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(targets, TARGETS)).sample().collect()))
    want = draw()
    monkeypatch.setattr(proportions, "BROADCAST_TARGETS", 2)
    assert want == draw() and len(want) > 80
