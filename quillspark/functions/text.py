"""Column expressions on texts: sections, answers, numbers, scores, names. All are built-in functions, without Python."""

from __future__ import annotations

from pyspark.sql import functions as F


def text_or_empty(c):
    return F.coalesce(c, F.lit(""))


def section(text, names: list[str]):
    """The text after the first header in 【】 or [] that contains one of the names, up to the next bracket; else after
    a header between double asterisks. Null if there is none."""
    some = "|".join(names)
    by_bracket = F.regexp_extract(text, rf"(?is)[【\[][^】\]]*(?:{some})[^】\]]*[】\]]([^【\[]*)", 1)
    by_stars = F.regexp_extract(text, rf"(?is)\*\*[^*]*(?:{some})[^*]*\*\*([^*]*)", 1)
    found = F.when(F.trim(by_bracket) != "", by_bracket).when(F.trim(by_stars) != "", by_stars)
    return F.trim(F.regexp_replace(found, r"^\s+|\s+$", ""))


def without_thoughts(text):
    """Each <think> block removed."""
    return F.regexp_replace(text, r"(?is)<think>.*?</think>", "")


def after_thoughts(text):
    """Everything up to the last </think> removed."""
    return F.trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def answer(text):
    """The word after ``Answer:``, outside of think blocks; null without one."""
    found = F.regexp_extract(without_thoughts(text), r"(?i)answer\s*:\s*(\S+)", 1)
    return F.when(found != "", found)


def plain_answer(text):
    """An answer without emphasis, box and math marks."""
    bare = F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), r"\\boxed\{([^}]*)\}", "$1")
    return F.trim(F.replace(F.replace(bare, F.lit("\\$"), F.lit("")), F.lit("$"), F.lit("")))


def choice_letters(text):
    """The distinct letters A to N in a text, as capitals, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text_or_empty(text)), F.lit("([A-N])"), F.lit(1))))


def first_number(text):
    """The first number once commas and percent signs are taken out; null without one."""
    return F.regexp_extract(F.translate(text, ",%", ""), r"(-?\d+\.?\d*)", 1).try_cast("double")


def format_score(text, sections: list[str]):
    """The share of sections that the text has, a tenth more between 500 and 3000 characters, 0.3 less above 5000,
    within [0, 1]; 0 for null and blank."""
    have = sum((F.regexp_count(text, F.lit(rf"(?i){s}")) > 0).cast("int") for s in sections) / float(len(sections))
    n = F.length(text)
    scored = F.when((n >= 500) & (n <= 3000), F.least(have + 0.1, F.lit(1.0))).when(n > 5000, F.greatest(have - 0.3, F.lit(0.0))).otherwise(have)
    return F.when(text.isNull() | (F.trim(text) == ""), 0.0).otherwise(scored)


def closing(text):
    """What a cut JSON text lacks: a quotation mark, and the brackets that are still open, the inner ones first. Brackets
    inside strings don't count."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s, c):
        ends = s["quoted"] & ~s["escaped"] & (c == '"')
        opened = F.when(~s["quoted"] & (c == "{"), F.concat(F.lit("}"), s["open"])).when(~s["quoted"] & (c == "["), F.concat(F.lit("]"), s["open"]))
        closed = F.when(~s["quoted"] & c.isin("}", "]"), F.substring(s["open"], 2, 1_000_000))
        return F.struct(
            F.coalesce(opened, closed, s["open"]).alias("open"),
            F.when(ends, False).when(~s["quoted"] & (c == '"'), True).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
        )

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(F.when(s["quoted"], '"').otherwise(""), s["open"]))


def fenced_json(text):
    """The content of the first fenced block, closed or not, or else all from the first brace or bracket on; what a cut
    text lacks is added."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*+(.*?)(?:```|$)", 1)
    braces = F.regexp_extract(text, r"(?s)([{\[].*)", 1)
    body = F.regexp_replace(F.trim(F.when(fenced != "", fenced).otherwise(braces)), r"(?<![,:\s])[,\s]++$", "")
    return F.when(body != "", F.concat(body, closing(body)))


def bounded_score(text, low: int = 1, high: int = 100, default: int = 50):
    """A score cast to a whole number within bounds; the default where it is no number."""
    whole = F.floor(text.try_cast("double")).cast("int")
    return F.when(whole.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), whole)))


def stem(path):
    """The file name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def media_type(path):
    """The media type by extension; image/png if unknown."""
    e = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(e.isin("jpg", "jpeg"), "image/jpeg").when(e == "webp", "image/webp").when(e == "gif", "image/gif").otherwise("image/png")


def folder_parts(name):
    """chart, locale and theme of ``date_time_chart_locale_theme_hash``, in which chart and theme may hold ``_``."""
    shape = r"^(\d{8})_(\d{6})_(.+?)_([a-z]{2}-[A-Z]{2})_(.+)_([^_]+)$"
    part = lambda k: F.when(name.rlike(shape), F.regexp_extract(name, shape, k)).otherwise("unknown")
    return F.struct(part(3).alias("chart"), part(4).alias("locale"), part(5).alias("theme"))


def preview(text, size: int = 50):
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def unescaped(text):
    """Without a byte order mark, with doubled escapes of line ends, tabs and quotes made single."""
    bare = F.regexp_replace(text, "^\ufeff", "")
    for a, b in (("\\\\n", "\n"), ("\\\\t", "\t"), ('\\\\"', '"')):
        bare = F.replace(bare, F.lit(a[1:]), F.lit(b))
    return bare


def comma_list(text):
    """The trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(text_or_empty(text), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def stars(strength, most: int = 5):
    return F.repeat(F.lit("★"), F.least(F.lit(most), F.floor(strength).cast("int")))


def progress(done, total, width: int = 20):
    """A bar of full and light blocks."""
    full = F.coalesce(F.floor(F.try_divide(done * width, total)), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def lookback_days(text):
    """Days of ``20Y``, ``5M``, ``30D`` (365 and 30 each); 30 for anything else."""
    n = F.regexp_extract(text, r"^(\d+)[YyMmDd]$", 1).try_cast("int")
    unit = F.upper(F.substring(text, -1, 1))
    return F.coalesce(F.when(unit == "Y", n * 365).when(unit == "M", n * 30).when(unit == "D", n), F.lit(30))


def prefix_category(path, rules: list[tuple[str, str]], other: str):
    """The category of the first prefix that the file name has; rules are tried in order."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    out = F.lit(None)
    for prefix, category in reversed(rules):
        out = F.when(F.startswith(name, F.lit(prefix)), category).otherwise(out)
    return F.coalesce(out, F.lit(other))


def rewritten_path(path, rules: list[tuple[str, str]]):
    """The path with the first matching prefix replaced; unchanged if none matches."""
    out = path
    for old, new in reversed(rules):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1_000_000))).otherwise(out)
    return out


def declared_language(name):
    """zh, en, ... if the name contains the code with its country, else en."""
    found = F.regexp_extract(name, r"(zh|en|de|fr|es)-[A-Z]{2}", 1)
    return F.when(found != "", found).otherwise("en")


def tokens_13a(text):
    """Words as the usual BLEU tokeniser cuts them: punctuation set off, points and commas not within numbers."""
    t = F.coalesce(text, F.lit(""))
    for find, put in ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, find, put)
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def trend(change, flat: float = 1.0, strong: float = 10.0):
    """A label for a change in percent."""
    return F.when(change.isNull(), "unknown").when(F.abs(change) < flat, "flat").when(change >= strong, "strong rise").when(change > 0, "rise").when(change <= -strong, "strong fall").otherwise("fall")


def scaled_reward(score, full: int):
    """A score out of ``full`` (10 or 100) as a share, to four places."""
    return F.round(score / F.lit(float(full)), 4)
