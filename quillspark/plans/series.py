"""Queries on time series, and their SQL. The series are the orders of each priority, by day or month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import series as S
from quillspark.plans.rounding import rounded
from quillspark.sources.tables import table


def daily(spark: SparkSession, d: str) -> DataFrame:
    return S.resample(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return S.resample(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "month")


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    return S.resample(table(spark, d, "events"), "event_type", "ts", "value")


_DAILY = """with s as (
  select o_orderpriority as series, cast(o_orderdate as date) as d, round(sum(o_totalprice), 2) as value
  from orders group by all),
r as (select *, row_number() over (partition by series order by d) - 1 as i, count(*) over (partition by series) as n from s)"""
_MONTHLY = _DAILY.replace("cast(o_orderdate as date)", "cast(date_trunc('month', o_orderdate) as date)")
_EVENTS = """with s as (
  select event_type as series, cast(ts as date) as d, round(sum(value), 2) as value from events group by all),
r as (select *, row_number() over (partition by series order by d) - 1 as i, count(*) over (partition by series) as n from s)"""
_RETURNS = _DAILY + """,
t as (select *, (value - lag(value) over w) / nullif(lag(value) over w, 0) as r from r window w as (partition by series order by d))"""
_ROLLING = _DAILY + """,
w as (select *, least(30, n // 10) as w from r),
m as (
  select a.series, a.d, a.i, a.n, a.w, avg(b.value) as mean, stddev_samp(b.value) as std
  from w a join w b on a.series = b.series and b.i > a.i - a.w and b.i <= a.i
  where a.w > 0 and a.i >= a.w - 1 group by all)"""
_VOL = _RETURNS + """,
w as (select *, least(60, n // 5) as w from t),
v as (
  select a.series, a.d, a.i, stddev_pop(b.r) * sqrt(252.0) * 100 as vol
  from w a join w b on a.series = b.series and b.i > a.i - a.w and b.i < a.i
  where a.w > 1 and a.i >= a.w and b.r is not null group by all)"""


def a01_series_stats(spark, d):
    return rounded(S.statistics(daily(spark, d)))


def a02_profile(spark, d):
    return rounded(S.profile(events_daily(spark, d)))


def w01_change_12(spark, d):
    return rounded(S.percent_change(monthly(spark, d), 12))


def w01_change_1(spark, d):
    return rounded(S.percent_change(monthly(spark, d), 1))


def w02_returns(spark, d):
    return rounded(S.with_returns(daily(spark, d)).where("r is not null").select("series", "d", "r"))


def w03_rolling(spark, d):
    return rounded(S.rolling(daily(spark, d)).select("series", "d", "mean", "std"))


def w04_change_points(spark, d):
    return rounded(S.change_points(daily(spark, d)).select("series", "d", "strength"))


def w05_rolling_volatility(spark, d):
    return rounded(S.rolling_volatility(daily(spark, d)).select("series", "d", "vol"))


def w06_volatility_regimes(spark, d):
    return rounded(S.volatility_regimes(daily(spark, d)))


def w07_max_drawdown(spark, d):
    return rounded(S.max_drawdown(daily(spark, d)))


def w08_losing_streak(spark, d):
    return rounded(S.losing_streak(daily(spark, d)))


def w09_peaks(spark, d):
    return rounded(S.peaks_and_troughs(daily(spark, d)))


def w09_local_maxima(spark, d):
    return rounded(S.local_maxima(daily(spark, d)))


def w10_piecewise_segments(spark, d):
    return rounded(S.piecewise_segments(daily(spark, d)))


def w11_uniform_segments(spark, d):
    return rounded(S.uniform_segments(daily(spark, d)))


def w12_frequency(spark, d):
    return rounded(S.frequency(daily(spark, d).unionByName(monthly(spark, d).withColumn("series", F.concat("series", F.lit(" by month"))))))


def w13_head_tail(spark, d):
    return rounded(S.head_tail(daily(spark, d), 10))


def w14_recent(spark, d):
    return rounded(S.recent(events_daily(spark, d), 7))


def w22_transforms(spark, d):
    return rounded(S.transforms(monthly(spark, d)), 2)


def w23_span(spark, d):
    return rounded(S.span(monthly(spark, d)))


def w24_reduction(spark, d):
    return rounded(S.reduction(monthly(spark, d)))


def w26_thinned(spark, d):
    return rounded(S.thinned(daily(spark, d)))


def j12_aligned(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    return rounded(S.aligned(events_daily(spark, d), names))


def f01_date_range(spark, d):
    return rounded(S.date_range(events_daily(spark, d), "2024-01-05", "2024-01-20"))


QUERIES = {
    f.__name__: f
    for f in (
        a01_series_stats, a02_profile, w01_change_12, w01_change_1, w02_returns, w03_rolling, w04_change_points, w05_rolling_volatility, w06_volatility_regimes,
        w07_max_drawdown, w08_losing_streak, w09_peaks, w09_local_maxima, w10_piecewise_segments, w11_uniform_segments, w12_frequency, w13_head_tail, w14_recent,
        w22_transforms, w23_span, w24_reduction, w26_thinned, j12_aligned, f01_date_range,
    )
}

_CHANGE = """ select series, cast(d as varchar) as d, round(change, 4) as change from (
  select series, d, (value / nullif(lag(value, {k}) over (partition by series order by d), 0) - 1) * 100 as change from r)
where change is not null"""

SQL = {
    "a01_series_stats": _RETURNS
    + """ select series, count(*) as n, min_by(value, d) as first, max_by(value, d) as last, min(value) as low, max(value) as high,
  round(avg(value), 4) as mean, round(median(value), 4) as median, round(stddev_pop(value), 4) as std, round(avg(r), 4) as mean_return,
  round(stddev_pop(r) * sqrt(252.0), 4) as volatility, round((max_by(value, d) - min_by(value, d)) / min_by(value, d) * 100, 4) as change,
  round(skewness(r), 4) as skew, round(kurtosis(r), 4) as kurtosis from t group by series""",
    "a02_profile": _EVENTS
    + """ select series, max(value) as max, cast(arg_min(d, {'a': -value, 'b': i}) as varchar) as max_date, min(value) as min,
  cast(arg_min(d, {'a': value, 'b': i}) as varchar) as min_date, arg_max(value, i) as last, cast(max(d) as varchar) as last_date,
  round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, count(*) as n from r group by series""",
    "w01_change_12": _MONTHLY + _CHANGE.format(k=12),
    "w01_change_1": _MONTHLY + _CHANGE.format(k=1),
    "w02_returns": _RETURNS + " select series, cast(d as varchar) as d, round(r, 4) as r from t where r is not null",
    "w03_rolling": _ROLLING + " select series, cast(d as varchar) as d, round(mean, 4) as mean, round(std, 4) as std from m",
    "w04_change_points": _ROLLING.replace("with s", "with recursive s")
    + """,
st as (select * from (select *, abs(lead(mean) over (partition by series order by i) - mean) as step from m where n >= 100) where step is not null and i >= w),
lim as (select series, quantile_cont(step, 0.9) as lim, any_value(w) as gap from st group by series),
ov as (select st.*, lim, gap from st join lim using (series) where step > lim),
kept as (
  select series, min(i) as i, any_value(gap) as gap from ov group by series
  union all
  select k.series, min(o.i), any_value(k.gap) from kept k join ov o on o.series = k.series and o.i - k.i > k.gap group by k.series, k.i)
select series, cast(d as varchar) as d, round(strength, 4) as strength from (
  select o.series, o.d, o.step / o.lim as strength, row_number() over (partition by o.series order by o.step / o.lim desc, o.i) as place
  from ov o join (select distinct series, i from kept) k using (series, i)) where place <= 5""",
    "w05_rolling_volatility": _VOL + " select series, cast(d as varchar) as d, round(vol, 4) as vol from v",
    "w06_volatility_regimes": _VOL
    + """,
q as (select series, quantile_cont(vol, 0.33) as a, quantile_cont(vol, 0.66) as b from v group by series),
l as (select v.*, case when vol < a then 'low' when vol < b then 'medium' else 'high' end as level from v join q using (series)),
c as (select *, case when lag(level) over (partition by series order by i) <> level then 1 else 0 end as turn from l),
u as (select *, sum(turn) over (partition by series order by i) as run from c)
select series, cast(run as bigint) as run, level, cast(min(d) as varchar) as start, cast(max(d) as varchar) as stop, count(*) as rows,
  round(avg(vol), 4) as mean_vol from u group by series, run, level""",
    "w07_max_drawdown": _DAILY
    + """,
t as (select *, max(value) over (partition by series order by i) as top from r),
f as (select *, (value - top) / nullif(top, 0) as fall from t),
g as (select series, min(fall) as drawdown, arg_min({'i': i, 'd': d, 'top': top}, {'f': fall, 'i': i}) as t from f group by series)
select g.series, round(drawdown, 4) as drawdown, cast(min(f.d) as varchar) as start, cast(any_value(g.t.d) as varchar) as trough,
  any_value(g.t.i) - min(f.i) as rows
from g join f on f.series = g.series and f.i <= g.t.i and f.value = g.t.top group by g.series, drawdown""",
    "w08_losing_streak": _RETURNS
    + """,
g as (select series, d, i, r < 0 as neg, sum(case when r < 0 then 0 else 1 end) over (partition by series order by i) as run from t where i > 0),
l as (select series, run, count(*) as length, max(d) as stop from g where neg group by series, run)
select series, max(length) as length, cast(arg_min(stop, {'l': -length, 's': stop}) as varchar) as stop from l group by series""",
    "w09_local_maxima": _DAILY
    + """ select series, cast(d as varchar) as d, value from (
  select *, lag(value) over w as a, lead(value) over w as b from r window w as (partition by series order by d)) where value > a and value > b""",
    "w11_uniform_segments": _DAILY
    + """,
k as (select *, least(5, n // 100) as k from r),
b as (select *, least(i // (n // k), k - 1) as block from k where k > 0),
g as (select series, block, min(d) as start, max(d) as stop, count(*) as rows, regr_slope(value, i) as slope, avg(value) as mean,
  arg_min(value, i) as a, arg_max(value, i) as z from b group by series, block)
select series, block, cast(start as varchar) as start, cast(stop as varchar) as stop, rows, round(slope, 4) as slope,
  case when slope / nullif(mean, 0) > 0.001 then 'up' when slope / nullif(mean, 0) < -0.001 then 'down' else 'flat' end as trend,
  round((z - a) / nullif(a, 0) * 100, 4) as change from g""",
    "w12_frequency": _DAILY
    + """,
al as (select series, d from s union all select o_orderpriority || ' by month', cast(date_trunc('month', o_orderdate) as date) from orders group by all),
g as (select series, count(*) as n, date_diff('day', min(d), max(d)) as days from al group by series)
select series, n, days, case when days / nullif(n - 1.0, 0) < 2 then 'daily' when days / nullif(n - 1.0, 0) < 10 then 'weekly'
  when days / nullif(n - 1.0, 0) < 45 then 'monthly' when days / nullif(n - 1.0, 0) < 120 then 'quarterly'
  when n > 1 then 'yearly' end as frequency from g""",
    "w13_head_tail": _DAILY
    + """ select series, case when i < 10 then 'head' else 'tail' end as part, cast(d as varchar) as d, value from r
where i < 10 or (n > 20 and i >= n - 10)""",
    "w14_recent": _EVENTS + " select series, cast(d as varchar) as d, value from (select *, max(d) over (partition by series) as z from s) where d >= z - 7",
    "w22_transforms": _MONTHLY
    + """ select series, cast(d as varchar) as d, round((value - lag(value) over w) / nullif(lag(value) over w, 0), 2) as r,
  round(avg(value) over (partition by series order by d rows 4 preceding), 2) as moving,
  round(sum(value) over (partition by series order by d), 2) as running,
  round((value - avg(value) over (partition by series)) / stddev_samp(value) over (partition by series), 2) as z
from r window w as (partition by series order by d)""",
    "w23_span": _MONTHLY + " select series, count(*) as n, date_diff('day', min(d), max(d)) as span_days from s group by series",
    "w24_reduction": _MONTHLY
    + """ select series, count(*) as n, date_diff('day', min(d), max(d)) as span_days,
  count(*) > 200 or date_diff('day', min(d), max(d)) > 1825 as reduced from s group by series""",
    "w26_thinned": _DAILY
    + """ select series, cast(d as varchar) as d, value from (select *, greatest(1, n // 500) as step from r)
where n <= 500 or (i % step = 0 and i // step < 499) or i = n - 1""",
    "j12_aligned": _EVENTS
    + """ select cast(d as varchar) as d, any_value(value) filter (series = 'click') as click, any_value(value) filter (series = 'error') as error,
  any_value(value) filter (series = 'purchase') as purchase, any_value(value) filter (series = 'signup') as signup,
  any_value(value) filter (series = 'view') as "view" from s group by d""",
    "f01_date_range": _EVENTS + " select series, cast(d as varchar) as d, value from s where d between date '2024-01-05' and date '2024-01-20'",
}
