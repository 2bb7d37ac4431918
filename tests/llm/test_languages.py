"""Held-out accuracy, mixed texts, labels."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import languages as L

LINES = {
    "en": "The committee met on Tuesday and agreed that the plan was sound. Most people in the town had heard of it before. It rained for three days and the river rose above the bridge. She said that nothing would change until the end of the year. Their house stands on the hill behind the old school.",
    "de": "Der Ausschuss traf sich am Dienstag und fand den Plan vernünftig. Die meisten Leute in der Stadt hatten schon davon gehört. Es regnete drei Tage lang, und der Fluss stieg über die Brücke. Sie sagte, dass sich bis zum Ende des Jahres nichts ändern werde. Ihr Haus steht auf dem Hügel hinter der alten Schule.",
    "fr": "Le comité s'est réuni mardi et a trouvé que le plan était bon. La plupart des gens de la ville en avaient déjà entendu parler. Il a plu pendant trois jours et la rivière est montée au-dessus du pont. Elle a dit que rien ne changerait avant la fin de l'année. Leur maison se trouve sur la colline derrière la vieille école.",
    "es": "El comité se reunió el martes y acordó que el plan era bueno. La mayoría de la gente del pueblo ya había oído hablar de ello. Llovió durante tres días y el río subió por encima del puente. Ella dijo que nada cambiaría hasta el final del año. Su casa está en la colina detrás de la vieja escuela.",
    "zh": "委员会星期二开会并认为这个计划可行。镇上的大多数人以前都听说过这件事。连续下了三天雨，河水漫过了桥面。她说到年底之前什么都不会改变。他们的房子在老学校后面的山上。",
}
HELD = {
    "en": "Nobody knew why the lights had gone out that evening.",
    "de": "Niemand wusste, warum an jenem Abend die Lichter ausgegangen waren.",
    "fr": "Personne ne savait pourquoi les lumières s'étaient éteintes ce soir-là.",
    "es": "Los niños del pueblo no querían volver a la escuela hasta el lunes.",
    "zh": "没有人知道那天晚上灯为什么灭了。",
}


@pytest.fixture(scope="module")
def profiles():
    texts = [t for t in LINES.values() for _ in range(4)]
    labels = [k for k in LINES for _ in range(4)]
    labels[0] = "de"  # a wrong label
    return L.train(texts, labels)


def test_held_out_sentences(profiles):
    for language, text in HELD.items():
        assert [s[0] for s in L.languages_of([text], profiles)[0]] == [language]
        assert [s[0] for s in L.languages_of([text.upper()], profiles)[0]] == [language]


def test_mixed_texts_have_segments(profiles):
    for a in HELD:
        for b in HELD:
            if a != b:
                got = L.languages_of([f"{HELD[a]} {HELD[b]}"], profiles)[0]
                assert [s[0] for s in got] == [a, b] and all(0 <= s[1] <= 1 and s[2] == 1 for s in got)


def test_cosines_of_runs_are_those_of_bundles(profiles):
    segments = [L.letters_only(t) for t in [*HELD.values(), *LINES.values(), "x", "ab", HELD["en"] * 50]]
    exact, fast = profiles.cosines(L.bundle(segments)), profiles.cosines_of(segments)
    assert abs(exact[:-3] - fast[:-3]).max() < 0.1 and (exact[:-3].argmax(axis=1) == fast[:-3].argmax(axis=1)).all()


def test_confidence_is_that_of_the_labels():
    """Where half of the labels are arbitrary between two languages, no confidence is near one."""
    import random

    random.seed(3)
    halves = [(" ".join(random.sample(LINES[k].split(". "), 3)), random.choice(["en", "de"]) if k == "en" else k) for k in ("en", "de", "fr") for _ in range(40)]
    loose = L.train([t for t, _ in halves], [k for _, k in halves])
    sure = L.train([t for t in LINES.values() for _ in range(9)], [k for k in LINES for _ in range(9)])
    assert loose.sharpness < sure.sharpness


def test_what_makes_no_language(profiles):
    for text in (None, "", "  \n ", "12.5 / 13", "VWAP", "🙂🙂"):
        assert not [s for s in L.languages_of([text], profiles)[0] if s[2]]
    assert {s[0] for s in L.languages_of(["镇上的大多数人以前都听说过这件事。编号7020D8E23785445A3B。"], profiles)[0] if s[2]} == {"zh"}
    got = L.languages_of(["镇上的大多数人（Orvane Composite Index）以前都听说过这件事。\nFocus: Kestrel Bay credit spread"], profiles)[0]
    assert {s[0] for s in got if s[2]} == {"zh"}


def test_very_long_text(profiles):
    got = L.languages_of([HELD["en"] + (" " + HELD["en"]) * 20_000 + " " + HELD["de"]], profiles)[0]
    assert [s[0] for s in got] == ["en", "de"]


def test_labels_and_file_names(spark):
    cases = [("zh-CN", "zh"), (" ZH_cn ", "zh"), ("Chinese", "zh"), ("English (UK)", "en"), ("deu", "de"), ("Français", "fr"), ("es_MX", "es"), ("unknown", None), ("", None), (None, None), ("und", None), ("eng", "en")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "l string").select(L.language_of_label(F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == [b for _, b in cases]
    files = [("fg_0001_bar_zh-CN.png", "zh"), ("FG_0001_BAR_EN-US.png", "en"), ("fg%2000001%20line%20de-de .png", "de"), ("fg_0001_bar.png", None), ("ws_0001.png", None), (None, None), ("lm_1_line_fr-FR (1).JPG", "fr")]
    df = spark.createDataFrame([(a,) for a, _ in files], "l string").select(L.language_of_file(F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == [b for _, b in files]


def checked(df, *more):
    """Each row is its own key."""
    keyed = df.withColumn("key", F.md5(F.to_json(F.struct(*df.columns)))).drop("declared", "lang")
    labels = df.select(F.md5(F.to_json(F.struct(*df.columns))).alias("key"), "declared").distinct()
    return L.check_languages(keyed, labels, *more)


def test_mismatches(spark):
    rows, k = [], 0
    for language, text in LINES.items():
        for _ in range(6):
            rows.append((k, text, language, "x"))
            k += 1
    rows += [(100, HELD["en"], "de", "x"), (101, HELD["en"] + " " + HELD["fr"], "en", "x"), (102, HELD["es"], None, "x"), (103, None, "en", "x"), (104, "12", "en", "x"), (105, HELD["zh"], "zh", "x"), (100, HELD["en"], "de", "x")]
    df = spark.createDataFrame(rows, "rec_id bigint, text string, declared string, lang string")
    check = checked(df)
    assert sorted(map(tuple, check.mismatches().collect())) == [(100, "en"), (101, "en"), (101, "fr"), (102, "es")]
    assert checked(df.limit(0)).mismatches().count() == 0


def test_sample_reads_six_thousand_texts(spark, monkeypatch):
    seen, train = [], L.train
    monkeypatch.setattr(L, "train", lambda texts, labels: seen.append(len(texts)) or train(texts, labels))
    df = spark.range(7_000).selectExpr("id rec_id", "concat('Most people in town ', id, ' had heard of it before.') text", "'en' declared")
    checked(df)
    assert seen == [6_000]


def test_copies_and_rare_languages_in_the_sample(spark, monkeypatch):
    seen, train = [], L.train
    monkeypatch.setattr(L, "train", lambda texts, labels: seen.extend(zip(texts, labels)) or train(texts, labels))
    df = spark.range(400).selectExpr("id rec_id", "concat('Most people in town ', id, ' had heard of it before.') text", "'en' declared")
    lowest = df.orderBy(F.xxhash64("text")).first().text
    copies = spark.range(1000, 1900).select(F.col("id").alias("rec_id"), F.lit(lowest).alias("text"), F.lit("en").alias("declared"))
    highest = sorted((r.text for r in spark.range(500).select(F.concat(F.lit("Die meisten Leute hatten schon davon gehört: "), "id", F.lit(".")).alias("text")).orderBy(F.xxhash64("text").desc()).limit(2).collect()))
    rare = spark.createDataFrame([(5000 + k, t, "de") for k, t in enumerate(highest)], "rec_id bigint, text string, declared string")
    check = checked(df.unionByName(copies).unionByName(rare), 60)
    assert len(seen) == len(set(seen)) == 60 and {t for t, k in seen if k == "de"} == set(highest)
    assert check.profiles.known[L.LANGUAGES.index("de")]


def test_declared_languages(spark):
    images = spark.createDataFrame([("a", "t1", "s1", "x_de-DE.png"), ("b", None, "s1", "x_de-DE.png"), ("c", "t2", "s2", "x_de-DE.png"), ("d", None, None, "x_de-DE.png"), ("a", "t1", "s1", "x_de-DE.png")], "id string, task_id string, source string, filename string")
    tasks = spark.createDataFrame([("t1", "English"), ("t2", "auto"), ("t2", "auto")], "task_id string, language string")
    sources = spark.createDataFrame([("s1", "dirname"), ("s2", "fixed_zh")], "name string, lang_detect string")
    notes = spark.createDataFrame([(1, " A ", "x"), (2, "b", "x"), (3, "C", "x"), (4, "d", "x"), (5, "none", "x"), (6, None, "x"), (1, " A ", "x")], "id bigint, image_id string, summary string")
    got = {r.key: r.declared for r in L.declared_languages(images, tasks, sources).collect()}
    assert got == {"a": "en", "b": "de", "c": "zh"}
    assert {(r.rec_id, r.key) for r in L.annotation_texts(notes).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "none"), (6, None)}


def test_long_runs_take_no_long_time(profiles):
    import time

    began = time.time()
    for r in (" ", "\n", ".", "*", "a", "一", "\"", "\n- x", "(", " / ", ":", "A"):
        L.languages_of([f"Some words here{r * 60_000}and so on it goes."], profiles)
    assert time.time() - began < 30
