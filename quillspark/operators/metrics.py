"""Text metrics of predictions against references, and summaries of judged facts and answers.

A pair frame has the columns ``pair``, ``prediction`` and ``reference``. n-grams are counted for each pair before any
other shuffle; null texts count as empty.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.skew import lookup_join
from quillspark.session import cut_lineage, ship_package

WORD = "[a-z0-9]+|[一-鿿]"


def tokens(text):
    """Small letters and digits as words, each Chinese character as one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def grams(words, n: int):
    """Hashes of all runs of n words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))


def stem(word: str) -> str:
    """The stem of an English word by Porter's published rules; short and other words stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    vowel = lambda s, i: s[i] in "aeiou" or (s[i] == "y" and i > 0 and not vowel(s, i - 1))
    shape = lambda s: "".join("v" if vowel(s, i) else "c" for i in range(len(s)))
    measure = lambda s: len(re.findall("v+c", shape(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and not vowel(s, len(s) - 1)
    short = lambda s: len(s) > 2 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swapped(s: str, rules: str, least: int) -> str:
        for rule in rules.split():
            old, _, new = rule.partition(">")
            if s.endswith(old):
                return s[: -len(old)] + new if measure(s[: -len(old)]) > least else s
        return s

    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                w = w + "e" if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and short(w)) else w[:-1] if double(w) and w[-1] not in "lsz" else w
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = swapped(w, "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble", 0)
    w = swapped(w, "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", 0)
    if w.endswith("ion"):
        w = w[:-3] if w[:-3].endswith(("s", "t")) and measure(w[:-3]) > 1 else w
    else:
        w = swapped(w, "ement> ance> ence> able> ible> ment> ant> ent> ism> ate> iti> ous> ive> ize> al> er> ic> ou>", 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    return stem(word)


def stems(text):
    """The words of a text as stems."""

    @F.pandas_udf("array<string>")
    def stemmed(words):
        import pandas as pd

        return pd.Series([[_stem(w) for w in row] for row in words], dtype=object)

    return stemmed(tokens(text))


def gram_counts(pairs: DataFrame, most: int = 4, cut=tokens) -> DataFrame:
    """pair, n, gram, p, r: how often each n-gram stands in the prediction and in the reference.

    n-grams are 64-bit hashes. The texts are brought together by pair once, so that neither these counts nor sums by
    pair shuffle the n-grams, of which there are some hundred times as many bytes.
    """
    words = pairs.select("pair", "prediction", "reference").repartition("pair").select("pair", cut(F.col("prediction")).alias("p"), cut(F.col("reference")).alias("r"))
    sides = [F.struct(F.lit(n).alias("n"), F.lit(c == "p").alias("side"), grams(F.col(c), n).alias("g")) for n in range(1, most + 1) for c in ("p", "r")]
    each = words.select("pair", F.inline(F.array(*sides))).select("pair", "n", "side", F.explode("g").alias("gram"))
    return each.groupBy("pair", "n", "gram").agg(F.count_if("side").alias("p"), F.count_if(~F.col("side")).alias("r"))


def corpus_bleu(pairs: DataFrame, cut=tokens, smooth: bool = False) -> DataFrame:
    """One row: precision of 1- to 4-grams, brevity penalty and BLEU over all pairs together; 0 if a precision is 0.

    ``cut`` makes words of a text; tokens_13a is the usual tokeniser. With ``smooth`` the first precision without a hit
    counts half of one, the second a quarter, and so on.
    """
    by = gram_counts(pairs, cut=cut).groupBy("n").agg(F.sum(F.least("p", "r")).alias("hit"), F.sum("p").alias("all"), F.sum("r").alias("ref"))
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    g = by.groupBy().agg(*[pick("hit", n).alias(f"_h{n}") for n in range(1, 5)], *[pick("all", n).alias(f"_a{n}") for n in range(1, 5)], pick("all", 1).alias("_c"), pick("ref", 1).alias("_r"))
    ps, zeros = [], F.lit(0)
    for n in range(1, 5):
        hit, every = F.col(f"_h{n}").cast("double"), F.col(f"_a{n}")
        missed = (F.coalesce(hit, F.lit(0.0)) == 0) & (F.coalesce(every, F.lit(0)) > 0)
        zeros = zeros + missed.cast("int")
        hit = F.when(missed, F.pow(F.lit(0.5), zeros)).otherwise(hit) if smooth else hit
        ps.append(F.coalesce(F.try_divide(hit, every), F.lit(0.0)).alias(f"p{n}"))
    penalty = F.when(F.coalesce(F.col("_c"), F.lit(0)) == 0, 0.0).when(F.col("_c") >= F.col("_r"), 1.0).otherwise(F.exp(1 - F.col("_r") / F.col("_c")))
    g = g.select(*ps, penalty.alias("brevity"))
    ps = [F.col(f"p{n}") for n in range(1, 5)]
    mean = F.when(F.least(*ps) > 0, F.exp(sum(F.log(F.when(p > 0, p)) for p in ps) / 4)).otherwise(0.0)
    return g.select("p1", "p2", "p3", "p4", "brevity", (F.col("brevity") * mean).alias("bleu"))


def rouge_n(pairs: DataFrame, most: int = 2, cut=tokens) -> DataFrame:
    """pair, n, precision, recall, f of the shared n-grams; 0 where a side has none. With ``cut=stems`` words count as
    their stems."""
    g = gram_counts(pairs, most, cut).groupBy("pair", "n").agg(F.sum(F.least("p", "r")).alias("hit"), F.sum("p").alias("_p"), F.sum("r").alias("_r"))
    p, r = (F.coalesce(F.try_divide(F.col("hit").cast("double"), c), F.lit(0.0)) for c in ("_p", "_r"))
    return g.select("pair", "n", p.alias("precision"), r.alias("recall")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def cider(pairs: DataFrame) -> DataFrame:
    """pair, cider: 10 x the mean cosine, over n = 1 to 4, of n-gram counts weighted by log(pairs / references with it). The
    counts are written once."""
    counts = cut_lineage(gram_counts(pairs).withColumn("_g", F.struct("n", "gram")))
    df = counts.where("r > 0").groupBy("_g").agg(F.count(F.lit(1)).alias("df"))
    total = pairs.agg(F.count(F.lit(1)).alias("_all"))
    idf = F.log(F.col("_all") / F.greatest(F.coalesce(F.col("df"), F.lit(0)), F.lit(1)))
    # frequent words are hot keys
    weighed = lookup_join(counts, df, "_g").crossJoin(F.broadcast(total)).withColumn("w", idf)
    by = weighed.groupBy("pair", "n").agg(F.sum(F.col("p") * F.col("r") * F.col("w") * F.col("w")).alias("dot"), F.sum(F.col("p") * F.col("p") * F.col("w") * F.col("w")).alias("pp"), F.sum(F.col("r") * F.col("r") * F.col("w") * F.col("w")).alias("rr"))
    cosine = F.coalesce(F.try_divide(F.col("dot"), F.sqrt("pp") * F.sqrt("rr")), F.lit(0.0))
    return by.groupBy("pair").agg((10 * F.sum(cosine) / 4).alias("cider"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """pair, f: the longest common subsequence of words against both lengths."""
    import pandas as pd

    ship_package(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(a, b):
        import numpy as np

        def one(x, y):
            if len(x) == 0 or len(y) == 0:
                return 0.0
            codes = {w: k for k, w in enumerate(dict.fromkeys([*x, *y]))}
            u, v = np.array([codes[w] for w in x]), np.array([codes[w] for w in y])
            row = np.zeros(len(v) + 1, dtype=np.int64)
            for w in u:
                # the best of a diagonal step and of what lies above, then the running maximum to the right
                step = np.maximum(row[1:], np.where(v == w, row[:-1] + 1, 0))
                row[1:] = np.maximum.accumulate(step)
            common = float(row[-1])
            return 2 * common / (len(u) + len(v))

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    return pairs.select("pair", score(tokens(F.col("prediction")), tokens(F.col("reference"))).alias("f"))


def meteor_exact(pairs: DataFrame, stemmed: bool = False) -> DataFrame:
    """pair, meteor: word matches in order of occurrence, harmonic mean 9:1 for recall, less a penalty for the number of
    contiguous chunks. With ``stemmed`` words without an equal one are matched by their stems; synonyms would need word
    lists. A pair that can't be scored counts 0."""
    import pandas as pd

    ship_package(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(a, b):
        def one(x, y):
            free: dict = {}
            for k, w in enumerate(y):
                free.setdefault(w, []).append(k)
            at = [free[w].pop(0) if free.get(w) else -1 for w in x]
            if stemmed:
                alike: dict = {}
                for k in sorted(k for some in free.values() for k in some):
                    alike.setdefault(_stem(y[k]), []).append(k)
                at = [k if k >= 0 else alike[s].pop(0) if alike.get(s := _stem(w)) else -1 for w, k in zip(x, at)]
            hits = [(i, k) for i, k in enumerate(at) if k >= 0]
            if not hits:
                return 0.0
            chunks = 1 + sum(1 for (i, k), (j, n) in zip(hits, hits[1:]) if j != i + 1 or n != k + 1)
            p, r = len(hits) / len(x), len(hits) / len(y)
            return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(hits)) ** 3)

        return pd.Series([one(list(x), list(y)) for x, y in zip(a, b)], dtype=float)

    return pairs.select("pair", score(tokens(F.col("prediction")), tokens(F.col("reference"))).alias("meteor"))


def fact_summary(judged: DataFrame, group: str) -> DataFrame:
    """Per group: facts, correct ones, precision, and counts by the way of matching; null precision without facts."""
    n, ok = F.count(F.lit(1)), F.count_if("correct")
    return judged.groupBy(group).agg(n.alias("facts"), ok.alias("correct"), F.try_divide(ok.cast("double"), n).alias("precision"), *[F.count_if(F.col("how") == h).alias(f"by_{h}") for h in ("keyword", "reference", "chart", "reference_chart", "none")])


def answer_summary(scored: DataFrame, kind: str, score: str) -> DataFrame:
    """Per kind of question: answers, mean score, share of full scores, mean of 1 - score."""
    return scored.groupBy(kind).agg(F.count(F.lit(1)).alias("answers"), F.avg(score).alias("mean"), F.avg((F.col(score) >= 1).cast("double")).alias("full"), F.avg(1 - F.col(score)).alias("miss"))


def mean_or_zero(df: DataFrame, score: str, failed) -> DataFrame:
    """One row: the mean score of rows that didn't fail, 0 if there are none, and how many there are."""
    return df.agg(F.coalesce(F.avg(F.when(~failed, F.col(score))), F.lit(0.0)).alias("mean"), F.count_if(~failed).alias("n"))


def value_f1(pairs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """pair, f: of the numbers in prediction and reference, those with a partner within the relative tolerance."""
    numbers = lambda c: F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    near = lambda x, y: F.abs(x - y) <= tolerance * F.abs(y)
    rows = pairs.select("pair", numbers("prediction").alias("a"), numbers("reference").alias("b"))
    p = F.try_divide(F.size(F.filter("a", lambda x: F.exists("b", lambda y: near(x, y)))).cast("double"), F.size("a"))
    r = F.try_divide(F.size(F.filter("b", lambda y: F.exists("a", lambda x: near(x, y)))).cast("double"), F.size("b"))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select("pair", f.alias("f"), (f >= 0.8).alias("enough"))


def by_section(pairs: DataFrame, sections: dict[str, list[str]], section) -> DataFrame:
    """section, pairs, valid, f1, f2, precision, recall: mean ROUGE-1 and -2 of each named section, over the pairs that have
    it on both sides. ``section`` takes the part of a text with one of some headers."""
    parts = [F.struct(F.lit(name).alias("section"), section(F.col("prediction"), heads).alias("p"), section(F.col("reference"), heads).alias("r")) for name, heads in sections.items()]
    long = pairs.select("pair", F.inline(F.array(*parts)))
    valid = long.where("p is not null and r is not null").select(F.struct("pair", "section").alias("pair"), F.col("p").alias("prediction"), F.col("r").alias("reference"))
    one = F.col("n") == 1
    means = rouge_n(valid, 2).groupBy(F.col("pair.section").alias("section")).agg(
        F.avg(F.when(one, F.col("f"))).alias("f1"), F.avg(F.when(~one, F.col("f"))).alias("f2"), F.avg(F.when(one, F.col("precision"))).alias("precision"), F.avg(F.when(one, F.col("recall"))).alias("recall")
    )
    counts = long.groupBy("section").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("valid"))
    return counts.join(means, "section", "left")


#: Least values of a good text: shares of right numbers, grounded claims and right names, and a grade of structure.
LEAST = {"numeric": 0.80, "grounding": 0.85, "entity": 0.90, "structure": 4.5}


def quality_flags(**values):
    """Whether each given value reaches its least one, and whether all do; null values don't."""
    flags = {name: F.coalesce(value >= LEAST[name], F.lit(False)) for name, value in values.items()}
    every = F.lit(True)
    for flag in flags.values():
        every = every & flag
    return F.struct(*[flag.alias(name) for name, flag in flags.items()], every.alias("all"))
