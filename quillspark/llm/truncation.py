"""Texts that were cut by a field limit or in transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.skew import lookup_join
from quillspark.session import cut_lineage
from quillspark.sources.tables import image_key

#: Last characters after which nothing is to be taken off.
STOPS = (".", "。", "．", "!", "?", "！", "？")

#: What may follow a text's last sentence, or the place of a cut, read backwards from the text's end: one last line that
#: begins with a dash, or one "label: a few words" without a stop; then, in any number, white space, quotation marks and
#: emphasis, ellipses, tags, bracketed notes without a sentence, closing brackets. Being read from the end, it takes one
#: pass over what it takes off and needs no limits.
TAIL = (
    r"^\s*+(?:[^\n]*[—–―-][^\S\n]*+\n|[^\n.。!?！？:：]++[:：][^\n:：.。!?！？]++\n|\.{2}(?!\.))?+"
    r"(?:\s++"
    r"|[\"'’”“»«›‹」』*_`~|]++"
    r"|[…⋯]++|\.{3,}+|\.++(?=[。．！？])"
    r"|[\p{L}\p{N}_-]++\#(?=\s)"
    r"|[)\]）】］〕}>](?![.。．!?！？])[^()\[\]（）【】［］〔〕{}<>\n]++[(\[（【［〔{<]"
    r"|[)\]）】］〕}>]++"
    r")*+"
)

#: A point read backwards that ends no sentence: that of a number after a Chinese word.
DECIMAL = r"^\.[\d,]*+(?<=[\d])\s?\p{IsHan}"

#: A point read backwards that may end a sentence or an abbreviation; only a length at a limit can tell.
SHORT_FORM = r"^\.(?:oiM|drM|ac|wzb|sv|xorppa|rN|oN|tS|cte)(?:\s|\d)"

#: Prose has at least two words or four Chinese characters.
PROSE = r"(?s)(?:(?<!\p{L})\p{L}{2,}+[^\p{L}]++\p{L}{2}|(?:\p{IsHan}[^\p{IsHan}]*+){4})"

#: A length is a spike if it has this many texts, and this many times the mean of the lengths up to NEAR away.
SPIKE_TEXTS, SPIKE_TIMES, NEAR = 8, 4.0, 12

#: Of a spike's texts at least this share must be open, else it is a length that whole texts often have.
SPIKE_OPEN = 1 / 3

#: A source ends its texts in stops if at least this share of its prose, away from limits, does. In others a missing
#: stop tells of a cut at a limit only.
STOPS_SHARE = 0.5


def _backwards(text):
    """The text read backwards, without what may follow its last sentence. Most texts end in a stop and are left as they
    are."""
    bare = F.regexp_replace(F.reverse(text), r"^\s++", "")
    dots = F.startswith(bare, F.lit("..")) | F.startswith(bare, F.lit(".。")) | F.startswith(bare, F.lit(".．"))
    return F.when(F.left(bare, F.lit(1)).isin(*STOPS) & ~dots, bare).otherwise(F.regexp_replace(bare, TAIL, ""))


def body(text):
    """The text without what may follow its last sentence or a cut."""
    return F.reverse(_backwards(text))


def ending(text):
    """How a text ends: ``ended`` or ``open`` (prose whose last sentence doesn't end), ``short`` (ends in what may be an
    abbreviation's point), or null without prose, which null, blank and texts of figures are."""
    back = _backwards(text)
    stops = F.left(back, F.lit(1)).isin(*STOPS, "｡", "‽")
    how = F.when(stops & back.rlike(SHORT_FORM), "short").when(stops & ~back.rlike(DECIMAL), "ended").otherwise("open")
    return F.when(back.rlike(PROSE), how)


def unterminated(text):
    """Whether a text has prose whose last sentence doesn't end; false for null, blank and figures only."""
    return F.coalesce(ending(text) == "open", F.lit(False))


def measured(texts: DataFrame) -> DataFrame:
    """tab, rec_id, source, chars, bytes, blank and ending of each text; the texts aren't carried on."""
    return texts.select(
        "tab", "rec_id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
        F.coalesce(~F.col("text").rlike(r"(?U)\S"), F.lit(True)).alias("blank"), ending(F.col("text")).alias("ending"),
    )


def length_histogram(rows: DataFrame) -> DataFrame:
    """tab, source, chars, bytes, texts, open, ended: one row for each pair of lengths of a source."""
    some = rows.where("chars > 0 and not blank")
    return some.groupBy("tab", "source", "chars", "bytes").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("ending") == "open").alias("open"), F.count_if(F.col("ending") == "ended").alias("ended"))


def length_peaks(histogram: DataFrame) -> DataFrame:
    """tab, source, unit (chars or bytes), length, texts, open: the lengths at which a source has far too many texts."""
    units = F.inline(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    counts = histogram.select("tab", "source", "texts", "open", units).groupBy("tab", "source", "unit", "length").agg(F.sum("texts").alias("texts"), F.sum("open").alias("open"))
    near = Window.partitionBy("tab", "source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    others = (F.sum("texts").over(near) - F.col("texts")) / (2.0 * NEAR)
    return counts.withColumn("others", others).where((F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") >= SPIKE_TIMES * F.greatest(F.col("others"), F.lit(0.5)))).drop("others")


def length_spikes(histogram: DataFrame) -> DataFrame:
    """The peaks at which enough texts are open: the work of a limit."""
    return length_peaks(histogram).where(F.col("open") >= SPIKE_OPEN * F.col("texts"))


def _at(chars, size, char_limits, byte_limits):
    return F.coalesce(F.array_contains(char_limits, chars) | F.exists(byte_limits, lambda n: (size == n) | ((size < n) & (size > n - 4) & (size > chars))), F.lit(False))


def limits(histogram: DataFrame) -> DataFrame:
    """tab, source, char_limits, byte_limits, stops: of each source its spike lengths, and whether its texts end in stops
    away from them. Works on the histogram alone."""
    spikes = length_spikes(histogram).groupBy("tab", "source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("char_limits"),
        F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("byte_limits"),
    )
    away = F.when(_at(F.col("chars"), F.col("bytes"), F.col("char_limits"), F.col("byte_limits")), 0).otherwise(1)
    joined = histogram.join(spikes, ["tab", "source"], "left").withColumn("_away", away)
    return joined.groupBy("tab", "source").agg(
        F.first("char_limits").alias("char_limits"),
        F.first("byte_limits").alias("byte_limits"),
        (F.sum(F.col("ended") * F.col("_away")) >= STOPS_SHARE * F.sum((F.col("ended") + F.col("open")) * F.col("_away"))).alias("stops"),
    )


def truncated(texts: DataFrame) -> DataFrame:
    """Mark the texts (tab, rec_id, source, text) that lost their end: tab, rec_id, source, chars, bytes, blank, ending,
    at_limit, evidence and cut. The texts themselves are read once and not carried on.

    Per table and source, the histograms of lengths in characters and in bytes are searched for spikes. ``at_limit``
    tells that a text's length is such a spike (or up to 3 bytes below one in bytes, where a character of several bytes didn't fit).
    ``evidence`` is "limit" for a text of such a length without terminal punctuation, a point that may be an
    abbreviation's being none; and "transfer" for a text of any other length whose prose stops inside a sentence, in a
    source whose texts otherwise end in stops (STOPS_SHARE); else null. ``cut`` is whether there is one. What follows
    the cut, a mark, note or footer, doesn't matter. A Latin text cut right behind a decimal point ("from 26.") is
    missed, as complete texts end so at such lengths too.

    Null and blank texts and texts of figures are never cut; a null text has null chars. Null sources form one source of
    their own. Rows are kept as they are, repeated ones too. An empty table gives an empty result. Other columns are
    not read.
    """
    rows = cut_lineage(measured(texts))
    # one row for each source: its spike lengths, of which there are far fewer than lengths
    by_source = limits(cut_lineage(length_histogram(rows))).select(F.struct("tab", "source").alias("_s"), "char_limits", "byte_limits", "stops")
    marked = lookup_join(rows.withColumn("_s", F.struct("tab", "source")), by_source, "_s").drop("_s")
    at = _at(F.col("chars"), F.col("bytes"), F.col("char_limits"), F.col("byte_limits"))
    evidence = F.when(F.col("at_limit") & F.col("ending").isin("open", "short"), "limit").when(~F.col("at_limit") & (F.col("ending") == "open") & F.col("stops"), "transfer")
    return marked.withColumn("at_limit", at).withColumn("evidence", evidence).withColumn("cut", F.col("evidence").isNotNull()).drop("char_limits", "byte_limits", "stops")


def rates(marked: DataFrame) -> DataFrame:
    """Per table and source: texts with prose or not, those cut at a limit, those cut in transfer, all, and their share.

    Rows with one rec_id count once.
    """
    once = marked.dropDuplicates(["tab", "rec_id"])
    return once.groupBy("tab", "source").agg(
        F.count("chars").alias("texts"),
        F.count_if("cut").alias("cut"),
        F.count_if(F.col("evidence") == "limit").alias("cut_at_limit"),
        F.count_if(F.col("evidence") == "transfer").alias("cut_in_transfer"),
        F.round(F.coalesce(F.try_divide(F.count_if("cut").cast("double"), F.count("chars")), F.lit(0.0)), 6).alias("share"),
    )


def summaries_and_answers(annotations: DataFrame, images: DataFrame, messages: DataFrame) -> DataFrame:
    """The texts of annotations.summary (source from the image) and of messages.content of role gpt."""
    sources = images.select(image_key(F.col("id")).alias("key"), "source").where("key is not null").groupBy("key").agg(F.min("source").alias("source"))
    own = annotations.select(F.lit("annotations").alias("tab"), F.col("id").cast("long").alias("rec_id"), image_key(F.col("image_id")).alias("key"), F.col("summary").alias("text"))
    first = lookup_join(own, sources, "key").select("tab", "rec_id", "source", "text")
    second = messages.where(F.lower(F.trim("role")) == "gpt").select(F.lit("messages").alias("tab"), F.col("message_id").cast("long").alias("rec_id"), "source", F.col("content").alias("text"))
    return first.unionByName(second)
