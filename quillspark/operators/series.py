"""Time series: numbered rows, returns, rolling figures, change points, regimes, drawdown, segments.

A series frame has the columns ``series``, ``d`` (a date) and ``value``. All windows are partitioned by ``series``, so
many series run side by side; one series is one task, which is why it should be brought to its grain (a day, a month)
first. Rows with a null value or date are left out before rows are numbered, so dates and values can't drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import ship_package

YEAR_DAYS = 252.0


def by_series(*order: str):
    w = Window.partitionBy("series")
    return w.orderBy(*order) if order else w


def resample(df: DataFrame, series: str, time: str, value: str, grain: str = "day", how=F.sum) -> DataFrame:
    """series, d, value: one row for each series and day, month or year, rounded to cents."""
    return df.groupBy(F.col(series).cast("string").alias("series"), F.trunc(F.col(time).cast("date"), grain).alias("d") if grain != "day" else F.col(time).cast("date").alias("d")).agg(F.round(how(value), 2).alias("value"))


def numbered(df: DataFrame) -> DataFrame:
    """Add ``i`` (from 0, by date) and ``n`` (rows of the series)."""
    kept = df.where("value is not null and d is not null and not isnan(value)")
    return kept.withColumns({"i": F.row_number().over(by_series("d")) - 1, "n": F.count(F.lit(1)).over(by_series())})


def percent_change(df: DataFrame, k: int) -> DataFrame:
    """(v / v k rows ago - 1) x 100; the first k rows and rows after a zero are dropped."""
    before = F.lag("value", k).over(by_series("d"))
    return numbered(df).withColumn("change", (F.try_divide("value", before) - 1) * 100).where("change is not null").select("series", "d", "change")


def with_returns(df: DataFrame) -> DataFrame:
    """Numbered rows with the simple return ``r``; null for the first row and after a zero."""
    before = F.lag("value").over(by_series("d"))
    return numbered(df).withColumn("r", F.try_divide(F.col("value") - before, before))


def statistics(df: DataFrame) -> DataFrame:
    """First, last, extremes, mean, median, population deviation, change, mean return, volatility, skew, kurtosis.

    Skew and kurtosis of the returns are corrected for bias; with fewer than 3 or 4 returns they are null.
    """
    g = with_returns(df).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "d").alias("first"),
        F.max_by("value", "d").alias("last"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_pop("value").alias("std"),
        F.avg("r").alias("mean_return"),
        (F.stddev_pop("r") * F.sqrt(F.lit(YEAR_DAYS))).alias("volatility"),
        F.count("r").alias("m"),
        F.skewness("r").alias("g1"),
        F.kurtosis("r").alias("g2"),
    )
    m = F.col("m").cast("double")
    skew = F.when(m > 2, F.col("g1") * F.sqrt(m * (m - 1)) / (m - 2))
    kurtosis = F.when(m > 3, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.col("g2") + 6))
    return g.withColumns({"change": F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, "skew": skew, "kurtosis": kurtosis}).drop("m", "g1", "g2")


def profile(df: DataFrame) -> DataFrame:
    """Extremes with their first dates, last value, mean, sample deviation, count."""
    return numbered(df).groupBy("series").agg(
        F.max("value").alias("max"),
        F.min_by("d", F.struct(-F.col("value"), "i")).alias("max_date"),
        F.min("value").alias("min"),
        F.min_by("d", F.struct("value", "i")).alias("min_date"),
        F.max_by("value", "i").alias("last"),
        F.max("d").alias("last_date"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


#: One width of a rolling window, as a range of places.
WIDTH = 1_000_000


def last_rows(most: int, own: bool = True):
    """A frame of each series' last w rows, w being a column of at most ``most``; ``own`` is whether the row itself is among
    them, else only the w - 1 rows before it are. Rows are placed w to a WIDTH, so one range fits every series."""
    frame = Window.partitionBy("series").orderBy(F.expr(f"(cast(i as bigint) * {WIDTH}) div w"))
    return frame.rangeBetween(-(WIDTH - WIDTH // (2 * most)), 0 if own else -1)


def rolling(df: DataFrame, most: int = 30) -> DataFrame:
    """Mean and sample deviation over the last w = min(most, n // 10) rows, full windows only; short series have none."""
    rows = numbered(df).withColumn("w", F.least(F.lit(most), F.floor(F.col("n") / 10)).cast("int")).where("w > 0")
    frame = last_rows(most)
    told = rows.withColumns({"mean": F.avg("value").over(frame), "std": F.stddev_samp("value").over(frame)})
    return told.where("i >= w - 1").select("series", "d", "i", "n", "w", "mean", F.when(F.col("w") > 1, F.col("std")).alias("std"))


def change_points(df: DataFrame, least: int = 100, keep: int = 5) -> DataFrame:
    """Where the rolling mean jumps: steps above their 90th percentile, more than w rows after the last one kept.

    The row before each jump is reported; of the kept ones the ``keep`` strongest, by strength = step / threshold.
    """
    steps = rolling(df).where(F.col("n") >= least).withColumn("step", F.abs(F.lead("mean").over(by_series("i")) - F.col("mean")))
    steps = steps.where("step is not null and i >= w")
    limit = steps.groupBy("series").agg(F.percentile("step", F.lit(0.9)).alias("limit"), F.first("w").alias("gap"))
    over = steps.join(limit, "series").where("step > limit").groupBy("series").agg(F.array_sort(F.collect_list("i")).alias("all"), F.first("gap").alias("gap"))
    far = lambda kept, x: (F.size(kept) == 0) | (x - F.element_at(kept, -1) > F.col("gap"))
    kept = F.aggregate("all", F.expr("cast(array() as array<int>)"), lambda a, x: F.when((F.size(a) == 0), F.array(x)).otherwise(F.when(far(a, x), F.concat(a, F.array(x))).otherwise(a)))
    chosen = over.select("series", F.explode(kept).alias("i")).join(steps, ["series", "i"]).join(limit, "series").withColumn("strength", F.col("step") / F.col("limit"))
    place = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("strength"), "i"))
    return chosen.withColumn("place", place).where(F.col("place") <= keep).select("series", "d", "i", "strength")


def rolling_volatility(df: DataFrame, most: int = 60) -> DataFrame:
    """Volatility in percent of the w = min(most, n // 5) values before each row, from their w - 1 returns."""
    rows = with_returns(df).withColumn("w", F.least(F.lit(most), F.floor(F.col("n") / 5)).cast("int")).where("w > 1")
    deviation = F.stddev_pop("r").over(last_rows(most, own=False))
    return rows.withColumn("vol", deviation * F.sqrt(F.lit(YEAR_DAYS)) * 100).where("i >= w and vol is not null").select("series", "d", "i", "vol")


def volatility_regimes(df: DataFrame) -> DataFrame:
    """Runs of low, medium and high volatility, split at the 33rd and 66th percentile: first and last date, mean."""
    vol = rolling_volatility(df)
    bounds = vol.groupBy("series").agg(F.percentile("vol", F.array(F.lit(0.33), F.lit(0.66))).alias("q"))
    level = F.when(F.col("vol") < F.col("q")[0], "low").when(F.col("vol") < F.col("q")[1], "medium").otherwise("high")
    rows = vol.join(bounds, "series").withColumn("level", level)
    turned = rows.withColumn("turn", (F.lag("level").over(by_series("i")) != F.col("level")).cast("int"))
    runs = turned.withColumn("run", F.coalesce(F.sum("turn").over(by_series("i")), F.lit(0)))
    return runs.groupBy("series", "run", "level").agg(F.min("d").alias("start"), F.max("d").alias("stop"), F.count(F.lit(1)).alias("rows"), F.avg("vol").alias("mean_vol"))


def max_drawdown(df: DataFrame) -> DataFrame:
    """The deepest fall below the highest value so far, from where and to where, and how many rows it took."""
    top = F.max("value").over(by_series("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = numbered(df).withColumn("top", top).withColumn("fall", F.try_divide(F.col("value") - F.col("top"), "top"))
    trough = rows.groupBy("series").agg(F.min("fall").alias("drawdown"), F.min_by(F.struct("i", "d", "top"), F.struct("fall", "i")).alias("t"))
    start = rows.join(trough, "series").where((F.col("i") <= F.col("t.i")) & (F.col("value") == F.col("t.top"))).groupBy("series").agg(F.min_by(F.struct("i", "d"), "i").alias("s"))
    return trough.join(start, "series").select("series", "drawdown", F.col("s.d").alias("start"), F.col("t.d").alias("trough"), (F.col("t.i") - F.col("s.i")).alias("rows"))


def losing_streak(df: DataFrame) -> DataFrame:
    """The first of the longest runs of negative returns: its length and last date; no row without a loss."""
    rows = with_returns(df).where("i > 0").withColumn("neg", F.coalesce(F.col("r") < 0, F.lit(False)).cast("int"))
    runs = rows.withColumn("run", F.sum(1 - F.col("neg")).over(by_series("i"))).where("neg = 1")
    lengths = runs.groupBy("series", "run").agg(F.count(F.lit(1)).alias("length"), F.max("d").alias("stop"))
    return lengths.groupBy("series").agg(F.max("length").alias("length"), F.min_by("stop", F.struct(-F.col("length"), "stop")).alias("stop"))


def uniform_segments(df: DataFrame, most: int = 5, size: int = 100, flat: float = 0.001) -> DataFrame:
    """min(most, n // size) blocks of equal length, the last with the rest: slope by least squares, trend, change."""
    rows = numbered(df).withColumn("k", F.least(F.lit(most), F.floor(F.col("n") / size)).cast("int")).where("k > 0")
    rows = rows.withColumn("block", F.least(F.floor(F.col("i") / F.floor(F.col("n") / F.col("k"))), F.col("k") - 1).cast("int"))
    g = rows.groupBy("series", "block").agg(
        F.min("d").alias("start"), F.max("d").alias("stop"), F.count(F.lit(1)).alias("rows"), F.regr_slope("value", F.col("i").cast("double")).alias("slope"),
        F.avg("value").alias("mean"), F.min_by("value", "i").alias("_a"), F.max_by("value", "i").alias("_b"),
    )
    relative = F.try_divide("slope", "mean")
    trend = F.when(relative > flat, "up").when(relative < -flat, "down").otherwise("flat")
    return g.select("series", "block", "start", "stop", "rows", "slope", trend.alias("trend"), (F.try_divide(F.col("_b") - F.col("_a"), "_a") * 100).alias("change"))


def frequency(df: DataFrame) -> DataFrame:
    """daily, weekly, monthly, quarterly or yearly, from the mean gap between dates; null for one row."""
    g = df.where("d is not null").groupBy("series").agg(F.date_diff(F.max("d"), F.min("d")).alias("days"), F.count(F.lit(1)).alias("n"))
    gap = F.try_divide(F.col("days").cast("double"), F.col("n") - 1)
    name = F.when(gap < 2, "daily").when(gap < 10, "weekly").when(gap < 45, "monthly").when(gap < 120, "quarterly").when(gap.isNotNull(), "yearly")
    return g.select("series", "n", "days", name.alias("frequency"))


def recent(df: DataFrame, days: int) -> DataFrame:
    """The rows of the last ``days`` days before each series' latest date."""
    last = F.max("d").over(by_series())
    return df.withColumn("_last", last).where(F.col("d") >= F.date_sub("_last", days)).drop("_last")


def head_tail(df: DataFrame, count: int) -> DataFrame:
    """The first rows, and the last ones if there are more than twice as many."""
    rows = numbered(df)
    part = F.when(F.col("i") < count, "head").when((F.col("n") > 2 * count) & (F.col("i") >= F.col("n") - count), "tail")
    return rows.withColumn("part", part).where("part is not null").select("series", "part", "d", "value")


def thinned(df: DataFrame, most: int = 500) -> DataFrame:
    """Every (n // most)-th row, the first most - 1 of them, and the last row; short series stay whole."""
    rows = numbered(df).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / most)).cast("int"))
    kept = (F.col("i") % F.col("step") == 0) & (F.floor(F.col("i") / F.col("step")) < most - 1)
    return rows.where((F.col("n") <= most) | kept | (F.col("i") == F.col("n") - 1)).select("series", "d", "value")


def transforms(df: DataFrame, window: int = 5) -> DataFrame:
    """Returns, moving average, running sum and z-score of each row."""
    rows = with_returns(df)
    return rows.select(
        "series", "d", "r", F.avg("value").over(by_series("i").rowsBetween(-(window - 1), 0)).alias("moving"),
        F.sum("value").over(by_series("i").rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
        F.try_divide(F.col("value") - F.avg("value").over(by_series()), F.stddev_samp("value").over(by_series())).alias("z"),
    )


def span(df: DataFrame) -> DataFrame:
    """Days between the first and the last date; rows x 30 where there are no dates."""
    g = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.date_diff(F.max("d"), F.min("d")).alias("days"))
    return g.select("series", "n", F.coalesce(F.col("days").cast("long"), F.col("n") * 30).alias("span_days"))


def reduction(df: DataFrame, rows: int = 200, days: int = 1825) -> DataFrame:
    """Whether a series is shown raw or as profile plus recent rows: too many rows or too long a span."""
    return span(df).withColumn("reduced", (F.col("n") > rows) | (F.col("span_days") > days))


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """Full outer alignment by date: one column for each named series, null where it has no row."""
    return df.groupBy("d").pivot("series", names).agg(F.first("value"))


def date_range(df: DataFrame, start=None, stop=None) -> DataFrame:
    """Rows from start to stop, both included; a bound that is None is open."""
    if start is not None:
        df = df.where(F.col("d") >= F.lit(start).cast("date"))
    return df if stop is None else df.where(F.col("d") <= F.lit(stop).cast("date"))


def _peaks_of(v, prominence: float, distance: int) -> list:
    """Positions and prominences of local maxima (middle of plateaus), the higher first where they stand too close."""
    import numpy as np

    n, found, at = len(v), [], 1
    while at < n - 1:
        if v[at - 1] < v[at]:
            end = at
            while end + 1 < n and v[end + 1] == v[at]:
                end += 1
            if end + 1 < n and v[end + 1] < v[at]:
                found.append((at + end) // 2)
            at = end + 1
        else:
            at += 1
    alive = set(found)
    for p in sorted(found, key=lambda q: (-v[q], -q)):
        if p in alive:
            alive -= {q for q in alive if q != p and abs(q - p) < distance}
    out = []
    for p in sorted(alive):
        higher_left = np.nonzero(v[:p] > v[p])[0]
        higher_right = np.nonzero(v[p + 1 :] > v[p])[0]
        left = v[(higher_left[-1] + 1 if len(higher_left) else 0) : p + 1].min()
        right = v[p : (p + 1 + higher_right[0] if len(higher_right) else n)].min()
        size = v[p] - max(left, right)
        if size >= prominence:
            out.append((p, float(size)))
    return out


def peaks_and_troughs(df: DataFrame, least: int = 20) -> DataFrame:
    """Peaks and troughs of at least half a deviation's prominence, max(1, int(0.02 n)) rows apart."""
    import pandas as pd

    ship_package(df.sparkSession)

    def run(key, pdf):
        pdf = pdf.sort_values("d")
        v = pdf["value"].to_numpy(dtype=float)
        rows = []
        if len(v) >= least:
            gap = max(1, int(0.02 * len(v)))
            for kind, y in (("peak", v), ("trough", -v)):
                rows += [(key[0], kind, pdf["d"].iloc[p], float(v[p]), size) for p, size in _peaks_of(y, 0.5 * float(v.std()), gap)]
        return pd.DataFrame(rows, columns=["series", "kind", "d", "value", "prominence"])

    return df.where("value is not null and d is not null").groupBy("series").applyInPandas(run, "series string, kind string, d date, value double, prominence double")


def local_maxima(df: DataFrame) -> DataFrame:
    """Rows higher than both neighbours, by window functions alone."""
    w = by_series("d")
    return df.withColumns({"_a": F.lag("value").over(w), "_b": F.lead("value").over(w)}).where("value > _a and value > _b").select("series", "d", "value")


def _cuts(x, y, k: int) -> list:
    """The k segments with the least squared error of their lines, by dynamic programming over prefix sums."""
    import numpy as np

    n = len(y)
    p = [np.concatenate([[0.0], np.cumsum(a)]) for a in (x, y, x * x, x * y, y * y)]

    def cost(i, j):  # rows i to j - 1, arrays of i
        m = j - i
        sx, sy, sxx, sxy, syy = (q[j] - q[i] for q in p)
        vx, vy, c = sxx - sx * sx / m, syy - sy * sy / m, sxy - sx * sy / m
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.maximum(0.0, vy - np.where(vx > 0, c * c / vx, 0.0))

    best = np.full((k + 1, n + 1), np.inf)
    back = np.zeros((k + 1, n + 1), dtype=int)
    best[0, 0] = 0.0
    for s in range(1, k + 1):
        for j in range(2 * s, n + 1):
            i = np.arange(2 * (s - 1), j - 1)
            total = best[s - 1, i] + cost(i, j)
            at = int(total.argmin())
            best[s, j], back[s, j] = total[at], i[at]
    out, j = [], n
    for s in range(k, 0, -1):
        out.append((int(back[s, j]), j))
        j = back[s, j]
    return out[::-1]


def piecewise_segments(df: DataFrame, flat: float = 0.01) -> DataFrame:
    """min(15, max(3, n // 25)) lines fitted to the thinned series: dates, slope, trend by slope / deviation, change."""
    import numpy as np
    import pandas as pd

    ship_package(df.sparkSession)

    def run(key, pdf):
        pdf = pdf.sort_values("d")
        v, rows = pdf["value"].to_numpy(dtype=float), []
        if len(v) >= 10:
            step = max(1, len(v) // 500) if len(v) > 1000 else 1
            x, y = np.arange(len(v), dtype=float)[::step], v[::step]
            k = min(15, max(3, len(v) // 25), len(y) // 2)
            for number, (i, j) in enumerate(_cuts(x, y, k)):
                slope = float(np.polyfit(x[i:j], y[i:j], 1)[0])
                relative = slope / v.std() if v.std() > 0 else 0.0
                trend = "up" if relative > flat else "down" if relative < -flat else "flat"
                a, b = int(x[i]), int(x[j - 1])
                rows.append((key[0], number, pdf["d"].iloc[a], pdf["d"].iloc[b], slope, trend, (v[b] - v[a]) / v[a] * 100 if v[a] else None))
        return pd.DataFrame(rows, columns=["series", "segment", "start", "stop", "slope", "trend", "change"])

    return df.where("value is not null and d is not null").groupBy("series").applyInPandas(run, "series string, segment int, start date, stop date, slope double, trend string, change double")
