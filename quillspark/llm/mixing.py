"""Mixing sources to target shares of all tokens, by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.proportions import unit_draw
from quillspark.llm.tokens import VOCABULARY, token_counts
from quillspark.session import cut_lineage

#: Weights are a parameter table that the driver holds; more rows than this are refused.
MOST_WEIGHTS = 20_000

#: Parts of the rounding order in each of two passes; PARTS * PARTS tells documents apart.
PARTS = 4096


class Mixture:
    """Token counts of the documents and, for each mix and source, the tilt that reaches its target."""

    def __init__(self, documents: DataFrame, weights: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY, seed: int = 0):
        self.spark, self.seed = documents.sparkSession, seed
        rows = self._weights(weights)
        part = documents.select("doc_id", "source", "text").where("source is not null and text is not null and text != ''")
        used = self.spark.createDataFrame([(source,) for source in sorted({r[1] for r in rows})], "source string")
        self.counts = cut_lineage(token_counts(part.join(F.broadcast(used), "source", "left_semi"), vocabulary=vocabulary, keep=["doc_id", "source"]))
        # documents of one source and length have one rate, so sums run over lengths
        self.lengths = cut_lineage(self.counts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
        self.tilts = self._solve(rows, total_tokens)

    def _weights(self, weights: DataFrame) -> list:
        rows = weights.select("mix_name", "source", F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("cap")).where("mix_name is not null and source is not null").dropDuplicates(["mix_name", "source"]).limit(MOST_WEIGHTS + 1).collect()
        if len(rows) > MOST_WEIGHTS:
            raise ValueError(f"more than {MOST_WEIGHTS} weights")
        return [(r.mix_name, r.source, max(0.0, r.w or 0.0), max(0, r.cap if r.cap is not None else 1)) for r in rows]

    def _sums(self, tilts: dict, scale: float) -> dict:
        """One distributed pass: tokens and their derivative by the tilt, for each mix and source."""
        if not tilts:
            return {}
        trial = self.spark.createDataFrame([(m, s, float(mu), int(cap)) for (m, s), (mu, cap) in tilts.items()], "mix_name string, source string, mu double, cap int")
        x = F.col("n_tokens") / F.lit(scale)
        exponent = F.col("mu") * x
        free = exponent < F.log(F.col("cap").cast("double"))
        rate = F.when(free, F.exp(F.least(exponent, F.lit(700.0)))).otherwise(F.col("cap").cast("double"))
        tokens = F.col("n") * F.col("n_tokens") * rate
        rows = self.lengths.join(F.broadcast(trial), "source").groupBy("mix_name", "source").agg(F.sum(tokens).alias("f"), F.sum(F.when(free, tokens * x).otherwise(0.0)).alias("d")).collect()
        return {(r.mix_name, r.source): (r.f, r.d) for r in rows}

    def _solve(self, rows: list, total_tokens: float | None) -> list:
        sizes = {r.source: (float(r.t), r.n) for r in self.lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
        scale = (sum(t for t, _ in sizes.values()) / max(1, sum(n for _, n in sizes.values()))) or 1.0
        target, cap, totals = {}, {}, {}
        for mix in sorted({r[0] for r in rows}):
            live = {s: (w, c) for m, s, w, c in rows if m == mix and w > 0 and c > 0 and s in sizes}
            whole = sum(w for w, _ in live.values())
            if not whole:
                continue
            share = {s: w / whole for s, (w, _) in live.items()}
            most = min(live[s][1] * sizes[s][0] / share[s] for s in live)
            cap |= {(mix, s): live[s][1] for s in live}
            target |= {(mix, s): share[s] for s in live}
            totals[mix] = (min(most, sum(sizes[s][0] for s in live)), most)
        mu = {k: 0.0 for k in target}
        if total_tokens is None:
            self._free_totals(target, cap, totals, mu, scale)
        else:
            totals = {m: (float(total_tokens), most) for m, (_, most) in totals.items()}
        goal = {k: min(w * totals[k[0]][0], cap[k] * sizes[k[1]][0]) for k, w in target.items()}
        full = {k for k in goal if goal[k] >= cap[k] * sizes[k[1]][0] * (1 - 1e-9)}
        self._fixed_totals({k: g for k, g in goal.items() if k not in full}, cap, mu, scale)
        self.scale = scale
        return [(m, s, math.inf if (m, s) in full else mu[m, s], cap[m, s], goal[m, s]) for m, s in goal]

    def _free_totals(self, target, cap, totals, mu, scale, rounds: int = 12) -> None:
        """Newton's method on all tilts of a mix and the log of its total at once.

        The total is not given, so the dual has one more condition: the tilts, weighted by the targets, sum to zero.
        That is the mix nearest to the documents as they are, in relative entropy. It is bounded by the largest total
        that every source can fill. The later step holds the total and solves each tilt to the end, so this one may
        stop early.
        """
        log_total = {m: math.log(t) for m, (t, _) in totals.items()}
        for _ in range(rounds):
            sums, moved = self._sums({k: (mu[k], cap[k]) for k in target}, scale), 0.0
            for mix in totals:
                keys = [k for k in target if k[0] == mix]
                miss = {k: math.log(sums[k][0]) - math.log(target[k]) - log_total[mix] for k in keys}
                slope = {k: max(sums[k][1] / sums[k][0], 1e-3) for k in keys}
                drift = sum(target[k] * mu[k] for k in keys)
                step = (sum(target[k] * miss[k] / slope[k] for k in keys) - drift) / sum(target[k] / slope[k] for k in keys)
                new = min(log_total[mix] + max(-1.0, min(1.0, step)), math.log(totals[mix][1]))
                moved = max(moved, abs(new - log_total[mix]))
                for k in keys:
                    mu[k] += max(-1.0, min(1.0, (new - log_total[mix] - miss[k]) / slope[k]))
                log_total[mix] = new
            if moved < 1e-4:
                break
        for mix in totals:
            totals[mix] = (math.exp(log_total[mix]), totals[mix][1])

    def _fixed_totals(self, goal, cap, mu, scale, rounds: int = 60) -> None:
        """Newton's method for each tilt, kept between the bounds found so far; where it leaves them, halve instead."""
        low, high, open_ = dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.inf), set(goal)
        for _ in range(rounds):
            if not open_:
                return
            sums = self._sums({k: (mu[k], cap[k]) for k in open_}, scale)
            for k in list(open_):
                f, d = sums[k]
                if abs(f - goal[k]) <= 1e-9 * goal[k]:
                    open_.discard(k)
                    continue
                low[k], high[k] = (mu[k], high[k]) if f < goal[k] else (low[k], mu[k])
                step = (math.log(goal[k]) - math.log(f)) / (d / f) if d > 0 and f > 0 else math.nan
                new = mu[k] + max(-3.0, min(3.0, step)) if step == step else math.nan
                if not low[k] < new < high[k]:
                    new = (low[k] + high[k]) / 2 if math.isfinite(low[k] + high[k]) else (low[k] + 2 * abs(low[k]) + 1 if high[k] == math.inf else high[k] - 2 * abs(high[k]) - 1)
                mu[k] = new

    def _params(self) -> DataFrame:
        """One row for each mix and source; weights are a parameter table of at most MOST_WEIGHTS rows."""
        return self.spark.createDataFrame([(m, s, float(mu) if math.isfinite(mu) else None, int(c), float(g)) for m, s, mu, c, g in self.tilts], "mix_name string, source string, mu double, cap int, goal double")

    def _rated(self) -> DataFrame:
        """Each document of each mix: the whole copies of its rate, and the rank of its rest in the rounding order."""
        exponent = F.col("mu") * F.col("n_tokens") / F.lit(self.scale)
        cap = F.col("cap").cast("double")
        rate = F.when(F.col("mu").isNull() | (exponent >= F.log(cap)), cap).otherwise(F.exp(F.least(exponent, F.lit(700.0))))
        rated = self.counts.join(F.broadcast(self._params()), "source").withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
        # one more copy goes to those with the least draw - rest; (draw - rest + 1) / 2 lies in [0, 1)
        place = (unit_draw(self.seed, F.col("mix_name"), F.col("doc_id")) - (F.col("rate") - F.col("whole")) + 1) / 2
        return rated.withColumn("place", F.when(F.col("whole") < F.col("cap"), place)).withColumns({"part": F.floor(F.col("place") * PARTS).cast("int"), "fine": F.floor(F.col("place") * PARTS * PARTS).cast("long")})

    def _edges(self, rated: DataFrame) -> DataFrame:
        """mix_name, source, edge: how far into the rounding order one more copy is given, so that tokens come nearest to
        the goal. At most PARTS rows for each mix and source are ordered, coarse parts first, then the parts of the one
        in which the goal is passed; all in Spark."""
        on = ["mix_name", "source"]
        order = Window.partitionBy(*on)
        goals = self._params().select(*on, "goal")
        base = rated.groupBy(*on).agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("base"))
        coarse = rated.where("part is not null").groupBy(*on, "part").agg(F.sum("n_tokens").alias("t"))
        until = F.col("base") + F.sum("t").over(order.orderBy("part"))
        placed = coarse.join(F.broadcast(base), on).join(F.broadcast(goals), on).withColumn("until", until)
        # of each mix and source the first part that passes the goal, and the tokens before it
        passed = cut_lineage(placed.where(F.col("until") > F.col("goal")).groupBy(*on).agg(F.min("part").alias("part"), F.min(F.col("until") - F.col("t")).alias("before"), F.first("goal").alias("goal")))
        fine = rated.select(*on, "part", "fine", "n_tokens").join(F.broadcast(passed), [*on, "part"]).groupBy(*on, "fine", "before", "goal").agg(F.sum("n_tokens").alias("t"))
        have = F.col("before") + F.sum("t").over(order.orderBy("fine"))
        # sums only grow, so those that come nearer to the goal are the first ones
        nearer = fine.withColumn("have", have).where(F.abs(F.col("have") - F.col("goal")) <= F.abs(F.col("have") - F.col("t") - F.col("goal"))).groupBy(*on).agg((F.max("fine") + 1).alias("edge"))
        edge = F.coalesce(F.col("edge"), F.col("part").cast("long") * PARTS, F.lit(PARTS * PARTS))
        return goals.select(*on).join(passed.select(*on, "part"), on, "left").join(nearer, on, "left").select(*on, edge.alias("edge"))

    def copies(self) -> DataFrame:
        """mix_name, doc_id, source, n_tokens, copies: every document used, and how often."""
        rated = self._rated()
        edges = self._edges(rated)
        more = (F.col("fine").isNotNull() & (F.col("fine") < F.col("edge"))).cast("int")
        return rated.join(F.broadcast(edges), ["mix_name", "source"]).select("mix_name", "doc_id", "source", "n_tokens", (F.col("whole") + more).alias("copies")).where("copies > 0")

    def shares(self, weights: DataFrame) -> DataFrame:
        """For each mix and source: the target share, what there was, what was taken, the share reached, the deficit."""
        taken = self.copies().groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies"))
        there = self.lengths.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("source_tokens"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        whole = Window.partitionBy("mix_name")
        base = weights.select("mix_name", "source", F.col("target_weight").cast("double").alias("target_weight"), F.col("max_repeats").cast("int").alias("max_repeats")).dropDuplicates(["mix_name", "source"])
        joined = base.join(there, "source", "left").join(taken, ["mix_name", "source"], "left").select("mix_name", "source", "target_weight", "max_repeats", *map(zero, ("documents", "source_tokens", "used", "copies", "most_copies", "tokens")))
        share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(whole)), F.lit(0.0))
        target = F.coalesce(F.try_divide(F.col("target_weight"), F.sum("target_weight").over(whole)), F.lit(0.0))
        return joined.withColumn("share", F.round(share, 9)).withColumn("deficit", F.round(F.greatest(F.lit(0.0), target - share), 9))


def mix_sources(documents: DataFrame, weights: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY, seed: int = 0) -> Mixture:
    """Combine documents (doc_id, source, text) so that each source of a mix holds its target_weight of all tokens.

    A document's rate is exp(tilt x tokens), at most max_repeats; the tilts solve the dual of "as near as possible to
    using each document once, with these token sums" by Newton steps whose sums are distributed over document lengths.
    Rates become copies by rounding up those with the least draw, as far as the token sum needs it. Without
    total_tokens the total is that of the nearest mix, at most what every source can fill without breaking its
    max_repeats; with it, sources that can't fill their part give all they may and show a deficit.

    Rows with null source, null text or empty text take no part, nor do sources without a weight. Sources with a weight
    but no documents get nothing and a deficit; the others then share the whole. Null weight counts as 0, null
    max_repeats as 1. Ties of draws are told apart by 2^24 parts only, documents in one part go together. Repeated rows
    are documents of their own. Empty tables give empty results. Other columns are not read.
    """
    return Mixture(documents, weights, total_tokens, vocabulary, seed)
