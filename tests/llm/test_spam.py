"""Spam of every kind, pages that only look like it, and the trees themselves."""

import random

import numpy as np
import pytest

from quillspark.llm import trees
from quillspark.llm.spam import describe, spam_pages

NAMES = ["grain price", "credit spread", "share index", "wage index", "ore price"]


def spam(kind):
    pick = lambda: random.choice(NAMES)
    host = lambda: random.choice(["deal-x.test", "www.shopzone.invalid"])
    if kind == "words":
        return " ".join(random.choice(["free", "best", "online", "cheap", pick()]) for _ in range(120)) + "."
    if kind == "links":
        return "\n".join(f"* {pick()} https://{host()}/p/{random.randint(1, 9**9)}" for _ in range(25))
    if kind == "products":
        return "\n".join(f"SKU-{random.randint(1, 99999)} | {pick()} | {random.randint(1, 99)}.99 | in stock" for _ in range(25))
    return " ".join("#" + random.choice(["Free", "Best"]) + pick().title().replace(" ", "") for _ in range(50))


def ham(kind):
    say = lambda: random.choice([f"The {random.choice(NAMES)} rose from {random.randint(1, 99)} to {random.randint(1, 999)} after the summer, and it then fell by degrees.", f"Nothing in the picture explains why the {random.choice(NAMES)} moved in {random.randint(1990, 2020)}.", f"It is the {random.randint(1, 60)}th rise, although the increments shrink."])
    if kind == "prose":
        return " ".join(say() for _ in range(8))
    if kind == "linked":
        return " ".join(say() + random.choice(["", f" (https://notes{random.randint(1, 99)}.example/c/1)"]) for _ in range(8))
    if kind == "table":
        return say() + "\n" + "\n".join(f"{2000 + k} | {random.randint(1, 9999)}.{k} million crowns | {random.random():.2f}" for k in range(25))
    if kind == "loose":
        # rows that don't follow each other
        return say() + "\n" + "\n".join(f"{random.randint(1000, 9999)}  {random.randint(1, 9999)}.{k} {random.choice(['points', 'tonnes'])}  {random.random():.2f}" for k in range(20))
    if kind == "json":
        return '{"subject": "ore price", "facts": [' + ", ".join(f'{{"id": {k}, "type": "value", "value": {random.random()}}}' for k in range(9)) + "]}"
    return "\n".join("- " + say() for _ in range(6))


@pytest.fixture(scope="module")
def found(spark):
    random.seed(8)
    rows = [(k, random.choice(["open", "desk", None]), spam(random.choice(["words", "links", "products", "tags"]))) for k in range(120)]
    rows += [(1000 + k, random.choice(["open", "desk"]), ham(random.choice(["prose", "linked", "table", "loose", "json", "list"]))) for k in range(500)]
    rows += [(5000, "open", None), (5001, None, ""), (5002, "open", " \n\t"), (5003, "open", "x"), (5004, "open", ham("prose") * 500), (0, "open", rows[0][2])]
    return spam_pages(spark.createDataFrame([(*r, 1.0, ["h"]) for r in rows], "doc_id bigint, source string, text string, own double, hosts array<string>"))


def test_kinds(found):
    ids = [r.doc_id for r in found.found().collect()]
    assert len(ids) == len(set(ids)) and set(ids) == set(range(120))


def test_chinese_keywords_without_blanks(spark):
    random.seed(9)
    goods, said = ["手机壳", "充电器", "数据线", "耳机", "钢化膜"], ["这一年的粮食价格在夏天之后有所回升", "图中没有信息可以解释矿石价格为何下滑", "工资指数已经连续三十次上升", "需要留意去年出现的异常值"]
    stuffed = ["手机壳批发" * 2000, "手机壳批发" * 40 + "。", "，".join(random.choice(goods) + "批发" for _ in range(60)), " ".join(g + "批发" for g in goods) * 9, "".join(random.choice(goods) + "批发" for _ in range(80))]
    rows = [(k, "open", spam(random.choice(["words", "links", "products", "tags"]))) for k in range(60)] + [(100 + k, "desk", t) for k, t in enumerate(stuffed)]
    rows += [(1000 + k, "desk", ham(random.choice(["prose", "linked", "table", "json", "list"]))) for k in range(200)]
    rows += [(2000 + k, "desk", "。".join(random.sample(said, 1 + k % 4)) + "。") for k in range(40)]
    got = {r.doc_id for r in spam_pages(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).found().collect()}
    assert got == set(range(60)) | set(range(100, 105))


def test_probabilities(found):
    rows = found.scores().collect()
    assert all(0 <= r.spam <= 1 for r in rows) and not {r.doc_id for r in rows} & {5000, 5001, 5002}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id bigint, source string, text string")
    assert spam_pages(df).found().count() == 0 and spam_pages(df.limit(0)).scores().count() == 0
    assert spam_pages(df.selectExpr("doc_id", "source", "'hm' as text")).found().count() == 0


def test_hosts():
    assert describe("see https://www.a.example/x and b.c.test/y, <a href=\"http://d.invalid/z\">k</a>")[1] == ["a.example", "c.test", "d.invalid"]


def test_trees_learn_a_rule_and_its_exception():
    random = np.random.default_rng(1)
    x = random.random((4000, 5))
    y = ((x[:, 0] > 0.5) & ~((x[:, 1] > 0.7) & (x[:, 2] < 0.4))).astype(float)
    model = trees.fit(x[:3000], y[:3000])
    assert ((trees.predict(model, x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.97
    assert trees.predict([], x).sum() == 0


def test_long_runs_take_no_long_time():
    import time

    began = time.time()
    for r in (" ", "\n", ".", "#", "a", "a.", "a-", "一", "<a ", "http://", "| ", '"k":', "a.b/"):
        describe(f"Some words here{r * 60_000}and so on it goes.")
    assert time.time() - began < 30
