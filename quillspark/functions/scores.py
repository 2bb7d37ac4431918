"""Column expressions that judge values, facts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F


def close(value, target, tolerance: float = 0.03, at_zero: float = 0.001):
    """Whether a value is within the relative tolerance of its target; of zero, within ``at_zero``. Null if either is."""
    return F.when(target == 0, F.abs(value) < at_zero).otherwise(F.abs(value - target) <= F.abs(target) * tolerance)


def verdict(value, reference, chart, keyword=None):
    """How a value fact is judged, as (correct, how): by the keyword of a judge if it has one, against the reference,
    against the chart, or by the reference against the chart if there is no value; else not correct by "none"."""
    says = F.lower(F.trim(keyword)) if keyword is not None else F.lit(None).cast("string")
    tests = [
        (says.isin("correct", "match", "matched") & reference.isNotNull(), F.lit(True), "keyword"),
        (says.isin("incorrect", "no_match", "mismatch"), F.lit(False), "keyword"),
        (F.coalesce(close(value, reference), F.lit(False)), F.lit(True), "reference"),
        (F.coalesce(close(value, chart), F.lit(False)), F.lit(True), "chart"),
        (value.isNull() & F.coalesce(close(chart, reference), F.lit(False)), F.lit(True), "reference_chart"),
    ]
    correct, how = F.lit(False), F.lit("none")
    for test, result, name in reversed(tests):
        correct, how = F.when(test, result).otherwise(correct), F.when(test, name).otherwise(how)
    return F.struct(correct.alias("correct"), how.alias("how"))


def range_verdict(low, high, reference_low, reference_high):
    """A range is correct if both ends are close to the reference's."""
    return F.coalesce(close(low, reference_low) & close(high, reference_high), F.lit(False))


def rank_verdict(rank, reference):
    return F.coalesce(F.lower(F.trim(rank)) == F.lower(F.trim(reference)), F.lit(False))


def single_choice(chosen, right):
    """1 if exactly the right letter was chosen."""
    return F.when((F.size(chosen) == 1) & (F.size(F.array_except(chosen, right)) == 0) & (F.size(right) == 1), 1.0).otherwise(0.0)


def multiple_choice(chosen, right):
    """max(0, right ones / all right ones - wrong ones / chosen ones); 0 if none was chosen."""
    hit, wrong, n = F.size(F.array_intersect(chosen, right)), F.size(F.array_except(chosen, right)), F.size(chosen)
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(hit.cast("double"), F.size(right)), F.lit(0.0)) - wrong / F.greatest(n, F.lit(1)))


def numeric_answer(value, right, tolerance):
    """1 if the number is within the absolute tolerance (1e-6 if null) of the right one."""
    return F.coalesce(F.when(F.abs(value - right) <= F.coalesce(tolerance, F.lit(1e-6)), 1.0), F.lit(0.0))


def weighted(scores: dict, weights: dict[str, float], missing: float = 3.0, most: float = 5.0):
    """The weighted sum of rubric scores with a default for missing ones, on a scale to 1. Weights must sum to 1."""
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    return sum(F.coalesce(scores[k], F.lit(missing)) * w for k, w in weights.items()) / most


def margin(delta, gamma):
    """max(0, gamma x delta), to four digits."""
    return F.round(F.greatest(F.lit(0.0), gamma * delta), 4)


def adaptive_margin(fact_delta, quality_delta, claims, tier):
    """a x fact delta + (1 - a) x quality delta with a = 0.5 x min(claims / 10, 1) x 1, 0.6 or 0 by tier 1, 2 or 3."""
    factor = F.when(tier == 1, 1.0).when(tier == 2, 0.6).otherwise(0.0)
    a = 0.5 * F.least(claims / 10.0, F.lit(1.0)) * factor
    return a * fact_delta + (1 - a) * quality_delta
