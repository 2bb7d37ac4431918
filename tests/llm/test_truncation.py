"""Endings of every kind, and spikes."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import truncation
from quillspark.llm.truncation import length_histogram, length_spikes, measured, rates, truncated, unterminated

WHOLE = [
    None, "", "  \n", "12.5% → 13.1% (4711)", "35,268 / 957.22", "All is well.", "All is well.\nUnits: index points", "All is well. #weekly12", "All is well.\n— Desk 12", "All is well. (end)",
    "All is well.\n[chart note 4]", "“All is well.”", "(All of this is well known here and everywhere.)", "**All is well.**", "一切都很好。", "一切都很好。\n单位：点", "一切都很好。\n【图注3】", "一切都很好．", "Alles ist gut.\n(Werte gerundet)",
    "Es sind 7,6 Mio.", "All is well.\n— " + "a desk of many names, " * 9 + "12", "All is well. (" + "as far as anybody could see then " * 4 + ")", "All is well.\nUnits: " + "points and " * 20 + "tonnes", "All is well." + " #weekly12" * 900 + " (end)" * 900,
    "Wait for it...ok then!", "Is it so?", "FINE AS IT IS.", "All is well." + "\n" * 700, "All is well. \n \n\nUnits: index points  \n",
]
CUT = [
    "All is we", "All is well. And then the", "All is well. And then the [more]", "All is well. And then…", "All is well. And then...", "All is well. And th\nUnits: index points", "All is well. And the #weekly3",
    "一切都很好。然后", "一切都很好。然后……", "一切都很好。右侧28根柱子合计占总量的1.", "一切都很好。然后\n（数据已取整）", "一切都很好。�", "“All is well. And then", "the index (core", "ALL IS WELL. AND TH", "一切都很好。右侧28根柱子合计占总量的" + "1" * 40 + ".", "All is well. And th" + " #weekly3" * 900,
]


@pytest.mark.parametrize("texts,expected", [(WHOLE, False), (CUT, True)])
def test_endings(spark, texts, expected):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", unterminated(F.col("t")).alias("u"))
    assert [texts[r.k] for r in df.collect() if r.u != expected] == []


def texts(spark):
    words = "The series rose and then it fell again over time. "
    rows = [(k, "a", (words * 9)[: 200 + k % 150].rsplit(". ", 1)[0] + ".") for k in range(300)]
    rows += [(1000 + k, "a", f"{k:05d} " + (words * 9)[:240]) for k in range(40)]
    rows += [(2000, None, "The series ro"), (2001, None, None), (2002, "b", "")]
    return spark.createDataFrame([("t", k, s, t, True, 1) for k, s, t in rows] + [("t", 2000, None, "The series ro", True, 1)], "tab string, rec_id bigint, source string, text string, cut boolean, chars int")


def test_spikes_and_rates(spark):
    marked = truncated(texts(spark))
    assert {(r.source, r.unit, r.length) for r in length_spikes(length_histogram(measured(texts(spark)))).collect()} == {("a", "chars", 246), ("a", "bytes", 246)}
    rows = {r.source: r for r in rates(marked).collect()}
    assert rows["a"].cut == 40 and rows["a"].cut_at_limit == 40 and rows["a"].cut_in_transfer == 0 and rows[""].cut == 0 and rows[""].texts == 1 and rows["b"].share == 0
    assert marked.count() == texts(spark).count()


def captions(spark):
    """Captions without full stops, of which those of 60 characters were cut, some behind a short form; and a source of
    sentences, of which two were cut in transfer."""
    words = "rise of the grain price and of the ore price in the summer of that year or the next one ca. "
    rows = [(k, "captions", words[k % 9 : 25 + k % 47].strip()) for k in range(400)]
    rows = [r for r in rows if len(r[2]) != 60]
    rows += [(1000 + k, "captions", f"{k:03d} {words}"[:60]) for k in range(30)] + [(1100 + k, "captions", f"{words[:49]} {k:02d} ca 7 ca."[:60]) for k in range(10, 18)]
    rows += [(2000 + k, "sentences", f"The price rose {'very ' * (k % 40)}much in {1900 + k % 90}.") for k in range(300)] + [(3000, "sentences", "The price rose very mu"), (3001, "sentences", "It fell then. The price, which")]
    return spark.createDataFrame([("t", *r) for r in rows], "tab string, rec_id bigint, source string, text string")


def test_spikes_decide_and_transfer_is_told_apart(spark, monkeypatch):
    found = {(r.rec_id, r.evidence) for r in truncated(captions(spark)).where("cut").collect()}
    assert found == {(k, "limit") for k in [*range(1000, 1030), *range(1110, 1118)]} | {(3000, "transfer"), (3001, "transfer")}
    monkeypatch.setattr(truncation, "SPIKE_TEXTS", 10**9)
    assert {r.rec_id for r in truncated(captions(spark)).where("cut").collect()} == {3000, 3001}


def test_a_source_mostly_cut_at_its_limit_still_ends_in_stops(spark, monkeypatch):
    """Most texts are cut at the limit, so only the spikes tell that the source ends its texts in stops."""
    rows = [(k, "s", f"{k:03d} The price rose and then it fell again."[: 40 + k % 2] if k < 60 else f"The price rose {'on ' * (k % 30)}and fell.") for k in range(100)]
    rows = [(k, s, t[:30] if k < 60 else t) for k, s, t in rows] + [(200, "s", "The price rose and fell so that by")]
    df = spark.createDataFrame([("t", *r) for r in rows], "tab string, rec_id bigint, source string, text string")
    assert {r.rec_id for r in truncated(df).where("cut").collect()} == set(range(60)) | {200}
    monkeypatch.setattr(truncation, "SPIKE_TEXTS", 10**9)
    assert truncated(df).where("cut").count() == 0


def test_empty(spark):
    assert truncated(texts(spark).limit(0)).count() == 0 and rates(truncated(texts(spark).limit(0))).count() == 0


def test_long_runs_take_no_long_time(spark):
    import time

    runs = [" ", "\n", ".", "*", "a", "一", "\"", "\n- x", "(", " #a", "\n ", "9", "…"]
    rows = [(k, f"Some words here{r * 20_000}{end}") for k, r in enumerate(runs) for end in ("", "and so", ".")]
    began = time.time()
    df = spark.createDataFrame(rows, "k int, t string").select("k", unterminated(F.col("t")).alias("u"))
    assert df.count() == len(df.collect()) == len(rows)
    assert time.time() - began < 30
