"""Column expressions and small frames for nested records: whitelists, predicates on lists, defaults, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept_fields(facts, fields: list[str], digits: int = 4):
    """A map of structs with only these number fields, rounded, as a map of maps; null numbers and empty maps dropped."""
    inner = lambda v: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.round(v[f], digits) for f in fields])), lambda _, x: x.isNotNull())
    return F.map_filter(F.transform_values(facts, lambda _, v: inner(v)), lambda _, m: F.size(m) > 0)


def has_both(kinds, first: str, second: str, least: int = 2):
    """Whether a list of kinds is long enough and holds both."""
    return (F.size(kinds) >= least) & F.array_contains(kinds, first) & F.array_contains(kinds, second)


def skip_reason(prediction, reference, least: int = 10):
    """Why a pair can't be judged, or null."""
    return F.when(F.trim(F.coalesce(reference, F.lit(""))) == "", "no reference").when(F.length(F.trim(F.coalesce(prediction, F.lit("")))) < least, "short prediction")


def translated(value, names: dict[str, str]):
    """The value's translation, or the value itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


#: The tokens of JSON.
_JSON = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null|[{}\[\]:,])'


def nested_value(text, key: str):
    """The first plain value of the key in a JSON text, at any depth; null without one. The text is read token by token,
    so what looks like the key inside a string is none."""
    tokens = F.regexp_extract_all(text, F.lit(_JSON), F.lit(1))
    values = F.transform(tokens, lambda t, i: F.when((t == f'"{key}"') & (F.get(tokens, i + 1) == ":"), F.get(tokens, i + 2)))
    plain = F.filter(values, lambda v: v.isNotNull() & ~v.isin("{", "["))
    return F.regexp_replace(F.get(plain, F.lit(0)), '^"|"$', "")


def type_or_text(text):
    """A JSON object's ``type``, or the text itself."""
    return F.coalesce(F.get_json_object(text, "$.type"), text)


def scaled_size(width, height, most: int):
    """Width and height brought to at most ``most`` pixels with their proportion."""
    factor = F.least(F.lit(1.0), F.sqrt(F.try_divide(F.lit(float(most)), (width * height).cast("double"))))
    return F.struct(F.floor(width * factor).cast("bigint").alias("width"), F.floor(height * factor).cast("bigint").alias("height"))


def years_before(day, years):
    return F.add_months(day, -12 * years)


def not_negative(value, kind, kinds: list[str]):
    """The absolute value for kinds that can't show negative ones."""
    return F.when(kind.isin(kinds), F.abs(value)).otherwise(value)


def summary_line(name, low, high, mean):
    return F.concat(name, F.lit(": "), F.format_number(low, 2), F.lit(" to "), F.format_number(high, 2), F.lit(", mean "), F.format_number(mean, 2))


def preview_rows(df: DataFrame, count: int, *order: str) -> DataFrame:
    """The first rows as JSON texts, with their ordinal as text."""
    rows = df.orderBy(*order).limit(count)
    return rows.select(F.row_number().over(Window.orderBy(*order)).cast("string").alias("row"), F.to_json(F.struct(*df.columns)).alias("json"))


def first_with_total(df: DataFrame, count: int, *order: str) -> DataFrame:
    """Up to ``count`` rows and, in each, how many there are in all."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(count).crossJoin(F.broadcast(total))


def last_in_order(df: DataFrame, count: int, order: str) -> DataFrame:
    """The last rows of an order, in that order."""
    return df.orderBy(F.desc(order)).limit(count).orderBy(order)


def first_wins(df: DataFrame, keys: list[str], value: str, best: str, *ties: str) -> DataFrame:
    """keys, value of the row with the highest ``best``; of equals the first by ``ties``."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(best), *ties)).alias(value))


def prefix_fallback(codes: DataFrame, known: DataFrame, seed: int = 0) -> DataFrame:
    """code, chosen: the code if it is known, else a known one with the same first two letters, drawn by hash: the one at
    place md5(seed:code) in the order of md5(seed:other). Known codes are numbered once, so no code meets all of its
    prefix."""
    order = Window.partitionBy("p").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "chosen")), "chosen")
    pool = known.select(F.col("code").alias("chosen"), F.substring("code", 1, 2).alias("p")).distinct().withColumn("k", F.row_number().over(order) - 1)
    sizes = pool.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "code")), 1, 8), 16, 10).cast("long")
    asked = codes.select("code", F.substring("code", 1, 2).alias("p")).distinct().join(sizes, "p", "left").withColumn("k", F.pmod(draw, F.col("size")).cast("int"))
    own = known.select("code", F.lit(True).alias("_own")).distinct()
    drawn = asked.join(pool, ["p", "k"], "left").join(own, "code", "left")
    return drawn.select("code", F.when(F.col("_own"), F.col("code")).otherwise(F.col("chosen")).alias("chosen"))


def matched_facts(rows: DataFrame, key: str, predicted: str, reference: str) -> DataFrame:
    """key, id, ref_id, value, reference: each predicted fact (id, ref_id, value) with the value of the record's own
    reference fact (id, value) that its ref_id names; null where there is none. Of references with one id the first
    counts."""
    own = F.transform(F.col(predicted), lambda p: F.struct(p["id"].alias("id"), p["ref_id"].alias("ref_id"), p["value"].alias("value"), F.get(F.filter(F.col(reference), lambda r: r["id"] == p["ref_id"]), F.lit(0))["value"].alias("reference")))
    return rows.select(key, F.inline(own))


def zipped_lists(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """key, place, first, second: two lists of a row side by side, as far as the shorter one goes."""
    pairs = F.slice(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b")), F.lit(1), F.least(F.size(first), F.size(second)))
    return rows.select(key, F.posexplode(pairs).alias("place", "_p")).select(key, "place", F.col("_p.a").alias(first), F.col("_p.b").alias(second))


def zipped(first: DataFrame, second: DataFrame, first_order: str, second_order: str) -> DataFrame:
    """Two frames side by side by their rows' places in each one's order, as far as the shorter one goes."""
    from quillspark.operators.relational import ordinals

    return ordinals(first, first_order).join(ordinals(second, second_order), "ordinal")


def with_preferences(sampled: DataFrame, preferences: DataFrame, key: str, status: str = "success") -> tuple[DataFrame, DataFrame]:
    """The sampled rows whose preference has the status, and one row of counts: kept, without a preference, of another
    status. Preferences have one row for a key; the result is ordered by its key only where it is written."""
    joined = sampled.join(preferences, key, "left")
    there = F.col("status").isNotNull()
    counts = joined.agg(F.count_if(F.col("status") == status).alias("kept"), F.count_if(~there).alias("absent"), F.count_if(there & (F.col("status") != status)).alias("other"))
    return joined.where(F.col("status") == status), counts


def raw_or_summary(df: DataFrame, key: str, value: str, order: str, most: int = 200) -> DataFrame:
    """key, form, payload: groups of up to ``most`` rows as an ordered JSON list, larger ones as a JSON summary, whose rows
    are never gathered."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"))
    small = df.join(sizes.where(F.col("n") <= most).select(key), key, "left_semi").groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda r: r["v"])).alias("payload"))
    large = sizes.where(F.col("n") > most).select(key, F.to_json(F.struct("n", "min", "max", "mean")).alias("payload"))
    return small.select(key, F.lit("raw").alias("form"), "payload").unionByName(large.select(key, F.lit("summary").alias("form"), "payload"))


def with_fallbacks(fields: dict[str, object], source):
    """A struct of a JSON object's fields, each with its default where it is absent."""
    return F.struct(*[F.coalesce(F.get_json_object(source, f"$.{name}"), F.lit(default)).alias(name) for name, default in fields.items()])
