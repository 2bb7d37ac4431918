"""Orphan references against brute force, with nulls, blanks, ties, repeats, hot keys and clashing columns."""

import random

from quillspark.operators.references import orphan_references, references_of

IMAGES = "id string, status string, created_at bigint, key string, rec_id bigint"
REFS = "id bigint, image_id string, at double, key string, alive boolean"


def brute(refs, images):
    norm = lambda s: s.strip().lower() if s is not None and s.strip() else None
    ms = lambda t: None if t is None else t * 1000 if abs(t) < 1e11 else t
    out = set()
    for rid, image, at, *_ in refs:
        k = norm(image)
        if k is None:
            continue
        rows = [r for r in images if norm(r[0]) == k]
        alive = any((r[1] or "").strip().lower() != "deleted" for r in rows)
        late = at is not None and rows and all(r[2] is not None and ms(r[2]) > ms(at) for r in rows)
        if not rows or not alive or late:
            out.add(("a", rid))
    return out


def run(spark, refs, images, **more):
    check = orphan_references([references_of(spark.createDataFrame(refs, REFS), "a", "id", "image_id", "at")], spark.createDataFrame(images, IMAGES), **more)
    rows = [(r.tab, r.rec_id) for r in check.orphans().select("tab", "rec_id").distinct().collect()]
    assert len(rows) == len(set(rows))
    periods = [tuple(r) for r in check.orphans().collect()]
    assert len(periods) == len(set(periods))
    return set(rows), check


def test_random_tables_against_brute_force(spark):
    random.seed(3)
    t = 1_700_000_000_000
    ids = [f"im_{k}" for k in range(30)]
    write = lambda s: random.choice([s, s.upper(), f" {s}", f"{s} \t"])
    images = [(write(random.choice(ids[:22])), random.choice(["annotated", "deleted", "DELETED", None]), random.choice([t + random.randint(-9, 9), t // 1000, None]), "x", 1) for _ in range(60)]
    refs = [(k, random.choice([None, "", "  ", write("im_0"), write(random.choice(ids))]), random.choice([None, float(t + random.randint(-9, 9)), float(t // 1000)]), "clash", True) for k in range(400)]
    refs += refs[:50]
    for share in (0.001, 0.2, 2.0):
        found, check = run(spark, refs, images, heavy_share=share)
        assert found == brute(refs, images)
    report = check.report().collect()
    assert sum(r.missing + r.deleted + r.late for r in report) == len(found)
    assert sum(r.references for r in report) == len({r[0] for r in refs if r[1] and r[1].strip()})


def test_same_time_is_not_late_and_seconds_are_milliseconds(spark):
    images = [("a", "ok", 1_700_000_000_000, None, None)]
    found, _ = run(spark, [(1, "a", 1_700_000_000_000.0, "", True), (2, "A ", 1_700_000_000.0, "", True), (3, "a", 1_699_999_999.0, "", True), (4, "a", None, "", True)], images)
    assert found == {("a", 3)}


def test_empty_tables(spark):
    assert run(spark, [], [("a", "ok", 1, None, None)])[0] == set()
    assert run(spark, [(1, "a", None, None, None), (2, None, None, None, None)], [])[0] == {("a", 1)}


def test_an_id_with_two_keys_counts_for_both_periods(spark):
    day = 86_400_000
    found, check = run(spark, [(1, "x", 40.0 * day, "", True), (1, "y", 80.0 * day * 1000 / 1000, "", True)], [("z", "ok", 1, None, None)])
    assert found == {("a", 1)} and check.orphans().count() == 2
    assert sum(r.missing for r in check.report().collect()) == 2


def test_missing_references_are_found_by_an_anti_join(spark):
    refs, images = spark.createDataFrame([(1, "a", None, None, None)], REFS), spark.createDataFrame([("b", "ok", 1, None, None)], IMAGES)
    plan = orphan_references([references_of(refs, "a", "id", "image_id", "at")], images).groups._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftOuter" not in plan
