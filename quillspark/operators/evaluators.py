"""Evaluators behind one interface, and reward functions behind one signature.

An evaluator gives a column for one row (``evaluate``) or a frame for many pairs (``evaluate_batch``); a reward takes the
data source, the solution, the truth and extra fields, and gives a number. Both are expressions that Spark compiles, not
functions called for each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores, text
from quillspark.operators import metrics


class Evaluator:
    """The score of a prediction against a reference; the image's id is at hand for those that look things up by it."""

    name = "evaluator"

    def evaluate(self, prediction: Column, reference: Column, image: Column | None = None) -> Column:
        raise TypeError(f"{self.name} compares whole batches only")

    def evaluate_batch(self, pairs: DataFrame) -> DataFrame:
        """pair, score of (pair, prediction, reference); null where a pair can't be scored."""
        image = F.col("image") if "image" in pairs.columns else None
        return pairs.select("pair", self.evaluate(F.col("prediction"), F.col("reference"), image).alias("score"))


class Sections(Evaluator):
    """Which sections the prediction has, and its length; the reference isn't looked at."""

    name = "sections"

    def __init__(self, sections: list[str]):
        self.sections = sections

    def evaluate(self, prediction, reference, image=None):
        return text.format_score(prediction, self.sections)


class Values(Evaluator):
    """Whether the first numbers of both are close."""

    name = "values"

    def __init__(self, tolerance: float = 0.03):
        self.tolerance = tolerance

    def evaluate(self, prediction, reference, image=None):
        return F.coalesce(scores.close(text.first_number(prediction), text.first_number(reference), self.tolerance).cast("double"), F.lit(0.0))


class Overlap(Evaluator):
    """ROUGE of n-grams, which needs counts and thus whole batches."""

    name = "overlap"

    def __init__(self, n: int = 1):
        self.n = n

    def evaluate_batch(self, pairs):
        found = metrics.rouge_n(pairs.select("pair", "prediction", "reference"), self.n).where(F.col("n") == self.n)
        return pairs.select("pair").distinct().join(found, "pair", "left").select("pair", F.coalesce("f", F.lit(0.0)).alias("score"))


def evaluated(pairs: DataFrame, evaluators: list[Evaluator]) -> DataFrame:
    """pair and one column for each evaluator."""
    out = pairs.select("pair").distinct()
    for one in evaluators:
        out = out.join(one.evaluate_batch(pairs).withColumnRenamed("score", one.name), "pair", "left")
    return out


Reward = Callable[[Column, Column, Column, Column], Column]

#: Rewards by name: (source, solution, truth, extra) to a number from 0 to 1.
REWARDS: dict[str, Reward] = {
    "format": lambda source, solution, truth, extra: text.format_score(solution, ["Layout", "Figures", "Shape", "Reading"]),
    "answer": lambda source, solution, truth, extra: F.coalesce((F.lower(text.plain_answer(text.answer(solution))) == F.lower(truth)).cast("double"), F.lit(0.0)),
    "number": lambda source, solution, truth, extra: F.coalesce(scores.close(text.first_number(solution), text.first_number(truth)).cast("double"), F.lit(0.0)),
}


def compute_score(name: str, source: Column, solution: Column, truth: Column, extra: Column | None = None) -> Column:
    """The reward of a solution; an unknown name is an error."""
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name}; known: {', '.join(sorted(REWARDS))}")
    return REWARDS[name](source, solution, truth, F.lit(None) if extra is None else extra)
