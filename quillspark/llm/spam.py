"""Pages of repeated keywords, links, products or tags instead of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import trees
from quillspark.operators.skew import lookup_join
from quillspark.session import cut_lineage, spread

#: Labelled rows that the trees are fitted on, at most; chosen by the hash of doc_id over all documents.
SAMPLE_ROWS = 20_000

#: Trees, and the share of the features that each of them sees.
TREES, SEEN = 61, 0.7

#: A page is read as if it began with so many characters of prose, so that a few words by themselves prove nothing.
GIVEN = 20

#: Pages with this smoothed probability are spam. Lies where the scores have a gap: pages that mix spam with sentences get
#: 0.4 to 0.6, since trees that see few of the telling features call them fine.
LIMIT = 0.4

#: How much a host's spam rate counts against the page's own evidence (in log odds), and how many average pages a host
#: is given beforehand.
HOST_PULL, HOST_PRIOR = 0.4, 10.0

#: Shares of a page's characters, but for "repeated", "function" and "words".
FEATURES = ("prose", "links", "tags", "keywords", "again", "repeated", "digits", "figures", "quoted", "function", "bars", "products", "series", "forms", "words")

#: Function words of en, de, fr, es and frequent function characters of zh.
FUNCTION_WORDS = frozenset(
    "the a an of to in and or that is are was were be been by with for from on at as it its this these those not no than about after before "
    "while when which who what why has have had does did will would could can may under over into between per if but so such they their "
    "der die das ein eine einen einem einer dem den des und oder von zu zum zur im in ist sind war bei mit auf für nach vor wird wurde sich "
    "nicht als über unter um bis ab je solange bevor aus durch noch nur auch "
    "le la les un une des du de et ou à au aux en est sont était par pour dans sur avec que qui ne pas se ce cette dont plus soit tant avant "
    "el los las una uno y o del al es son fue por para con su lo como más no desde hasta mientras sin entre sobre se".split()
)
#: Those that names and shop words hold as well; alone they make no sentence.
IN_NAMES = frozenset("de des du del d l la le les in of to en a add y e".split())
FUNCTION_HAN = frozenset("的了在是和与以后为将之到于从被所这该其有而但也都就若等及或由约并且已未至同比不没把让使对最")

_LINK = re.compile(r"<a\s[^<>]*>|</a>|(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s<>\"')\]]*", re.I)
_HOST = re.compile(r"^(?:<a[^>]*?href=[\"']?)?(?:https?://)?(?:www\.)?([a-z0-9.-]+\.[a-z]{2,})", re.I)
_TAG = re.compile(r"(?<!\S)[#＃][^\s#＃]+")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_HAN_RUN = re.compile(r"[㐀-鿿]+")
_HAN_PAIR = re.compile(r"[㐀-鿿]{1,2}")
#: Chinese has no blanks, so a word of it is two characters, as in llm/overlap.py.
_COUNTED = re.compile(r"[㐀-鿿]{1,2}|[^\W\d_㐀-鿿]+")
_STOP = re.compile(r"(?<=[.!?])(?<!Mio\.)(?<!Mrd\.)\s+|(?<=[。！？．])")
_ENDS = re.compile(r"[.。．!?！？;；:：…][\"'”»」』)\]）】*_\s]*$")
_BARS = re.compile(r"(?<=\S\s)[|·>»•→](?=\s|$)")
_KEY = re.compile(r"\"\w+\"\s*:")
_GAP = re.compile(r"[㐀-鿿][ 　]+[㐀-鿿]")
#: A symbol many times over is a rule or damage, and no content.
_RULED = re.compile(r"([^\w\s])\1{7,}")
#: The number or date that a line begins with, but for a bullet.
_LEADING = re.compile(r"\W*(\d{1,4})(?:[-/年](\d{1,2}))?(?!\d)")
#: A price with cents, or an article's code of three figures or more at one end of the line and a plain count at the
#: other.
_PRICE = re.compile(r"(?<![\d.,])\d{1,5}[.,]\d{2}(?![\d.,%])")
_CODE = re.compile(r"(?<![\d.,])\d{3,}(?![\d.,%])")
_NUMBERS = re.compile(r"\d[\d.,]*")
_DIGIT = re.compile("[0-9]")
_DIGITS = "0123456789"
#: How the numbers that two lines of a table begin with differ, year and month or day.
_STEPS = frozenset([(1, 0), (-1, 0), (0, 1), (0, -1), (1, -11), (-1, 11), (1, -9), (1, -3), (0, 3)])


def _solid(text: str) -> int:
    return len("".join(text.split()))


def _digits(text: str) -> int:
    return sum(map(text.count, _DIGITS))


def _bars(text: str) -> int:
    """Marks that set off entries; not a bullet at the beginning, nor quotation marks."""
    return len(_BARS.findall(text)) - (text.count(" »") if "«" in text else 0)


def _is_sentence(unit: str, words: list[str], bars: int, has_han: bool) -> bool:
    """Whether a piece, with its words in small letters, reads as a sentence: words joined by function words, not a row
    of names."""
    if bars > 1:
        return False
    if has_han:
        han = _HAN.findall(unit)
        if han:
            words = [w for w in words if not _HAN.match(w)]
            if len(han) >= 6 and len(han) >= 2 * len(words):
                joined = sum(c in FUNCTION_HAN for c in han)
                stopped = unit.rstrip()[-1:] in "。！？．" or "，" in unit or ", " in unit
                if not stopped and joined < 2:
                    return False
                pairs = _HAN_PAIR.findall(unit)
                return len(_GAP.findall(unit)) * 3 <= (joined + 1 if stopped else 0) and len(han) / max(1, len(_HAN_RUN.findall(unit))) >= 2 and len(set(pairs)) / len(pairs) >= 0.5
    if len(words) < 4 or len(set(words)) * 2 < len(words):
        return False
    bound = [w for w in words if w in FUNCTION_WORDS]
    if not bound or len(bound) / len(words) < 0.13:
        return False
    ended = bool(_ENDS.search(unit))
    if not ended and len(words) < 10:
        return False
    return not IN_NAMES.issuperset(bound) or (ended and len(bound) >= 3 and _digits(unit) > 0)


def _form(line: str) -> str:
    """A line's outline: letters and figures left out."""
    return "".join(_NUMBERS.sub("0", _WORD.sub("", line)).split())


def describe(text: str) -> tuple[list[float], list[str]]:
    """The FEATURES of a whole text, and the hosts that it links to."""
    text = _RULED.sub(" ", text)
    has_link = "<" in text or "/" in text or "www." in text
    links = _LINK.findall(text) if has_link else []
    hosts = sorted({".".join(m.group(1).lower().split(".")[-2:]) for m in map(_HOST.match, links) if m})
    size = _solid(text) + GIVEN
    bare = _LINK.sub(" ", text) if links else text
    tags = _TAG.findall(bare) if "#" in bare or "＃" in bare else []
    if tags:
        bare = _TAG.sub(" ", bare)
    prose = GIVEN
    keyword = again = figures = bound_all = barred = products = series = 0
    has_han = bool(_HAN.search(bare))
    every: list[str] = []
    seen: set[str] = set()
    forms: dict[str, list[int]] = {}
    before: tuple[int, int] | None = None
    for line in bare.splitlines():
        whole = _solid(line)
        if not whole:
            continue
        bars = _bars(line) if " " in line else 0
        if bars > 2:
            barred += whole
        stepped = sold = False
        if _DIGIT.search(line):
            first = _LEADING.match(line)
            at = (int(first.group(1)), int(first.group(2) or 0)) if first else None
            stepped = bool(at and before) and (at[0] - before[0], at[1] - before[1]) in _STEPS
            before = at
            sold = not stepped and len(_NUMBERS.findall(line)) <= 4 and bool(_CODE.search(line)) and (line[-1:].isdigit() or bars > 2 or bool(_PRICE.search(line)))
        series += whole if stepped else 0
        told = prose
        form = _form(line)
        if 1 < len(form) < 40:
            forms.setdefault(form, []).append(whole)
        units = _STOP.split(line)
        for unit in units:
            solid = whole if len(units) == 1 else _solid(unit)
            if not solid:
                continue
            words = _WORD.findall(unit.lower())
            every += words
            bound_all += sum(map(FUNCTION_WORDS.__contains__, words))
            if has_han:
                bound_all += sum(map(FUNCTION_HAN.__contains__, unit)) / 2
            letters = sum(map(len, words))
            if _is_sentence(unit, words, bars if len(units) == 1 or not bars else _bars(unit), has_han):
                prose += solid
            elif letters * 2 > solid and "\":" not in unit and "\": " not in unit:
                keyword += solid
            elif _digits(unit) * 4 >= solid:
                figures += solid
            shape = " ".join(sorted(set(words)))
            if len(shape) > 3 and shape in seen and letters * 3 > solid:
                again += solid
            seen.add(shape)
        products += whole if sold and prose == told else 0
    counted = _COUNTED.findall(bare.lower()) if has_han else every
    return [
        prose / size,
        sum(map(len, links)) / size,
        sum(map(len, tags)) / size,
        keyword / size,
        again / size,
        1 - len(set(counted)) / len(counted) if counted else 0.0,
        _digits(bare) / size,
        figures / size,
        len(_KEY.findall(text)) * 10 / size,
        bound_all / max(1, len(every)),
        barred / size,
        products / size,
        series / size,
        sum(sum(n) for n in forms.values() if len(n) > 2) / size,
        float(len(counted)),
    ], hosts


def weak_label(x: dict[str, np.ndarray]) -> np.ndarray:
    """1 for pages that one strict rule calls spam and none calls fine, 0 for the contrary, -1 for all others.

    The rules are few and look at two or three features each; the trees learn from all features what such pages are like,
    and decide the rest.
    """
    quiet, bare, junk = x["links"] + x["tags"] == 0, x["prose"] < 0.4, x["links"] + x["tags"]
    stuffed = bare & (x["repeated"] > 0.5) & (x["keywords"] > 0.6) & (x["words"] >= 30) & (x["series"] < 0.05)
    listed = bare & (junk > 0.5)
    sold = bare & (x["products"] > 0.8) & (x["series"] < 0.05) & (x["forms"] > 0.5) & (x["digits"] < 0.36)
    barred = bare & (x["bars"] > 0.6) & (x["figures"] < 0.1) & (x["digits"] < 0.1)
    told = (junk < 0.05) & (x["prose"] > 0.97) & (x["words"] >= 60)
    said = quiet & (x["prose"] > 0.99) & (x["words"] < 20)
    tabled = quiet & (((x["series"] > 0.5) & (x["products"] < 0.1)) | ((x["digits"] > 0.38) & (x["repeated"] < 0.7)))
    coded = quiet & (x["quoted"] > 0.1)
    short = quiet & (x["words"] < 6) & (x["digits"] < 0.3)
    spam, fine = stuffed | listed | sold | barred, told | said | tabled | coded | short
    return np.where(spam & ~fine, 1, np.where(fine & ~spam, 0, -1))


def learned(matrix: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Trees fitted on those pages of a sample that have a weak label."""
    y = weak_label({f: matrix[:, i] for i, f in enumerate(FEATURES)})
    return trees.fit(matrix[y >= 0], y[y >= 0].astype(float), TREES, seed, SEEN) if (y >= 0).any() else []


def page_features(documents: DataFrame) -> DataFrame:
    """doc_id, source, hosts and FEATURES of every page that isn't null or blank."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("hosts", T.ArrayType(T.StringType())), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [describe(text) for text in batch.column(2).to_pylist()]
            columns = [pa.array([m[0][i] for m in made], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([m[1] for m in made], pa.list_(pa.string())), *columns], names=schema.names)

    return spread(documents.select("doc_id", "source", "text").where("text rlike '(?U)\\\\S'")).mapInArrow(run, schema)


class SpamModel:
    """Features of all pages, trees fitted on weak labels, and probabilities smoothed by hosts."""

    def __init__(self, documents: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 0):
        self.features = cut_lineage(page_features(documents))
        sample = self.features.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows).toPandas()
        matrix = np.stack([sample[f].to_numpy() for f in FEATURES], axis=1) if len(sample) else np.zeros((0, len(FEATURES)))
        self.trees = learned(matrix, seed)

    def scores(self) -> DataFrame:
        """doc_id, source, own (by the trees alone) and spam (smoothed): the probabilities of every page."""
        model = self.trees
        schema = T.StructType([*self.features.schema.fields[:3], T.StructField("own", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = {f: np.asarray(batch.column(3 + i)) for i, f in enumerate(FEATURES)}
                own = trees.predict(model, np.stack([x[f] for f in FEATURES], axis=1)) if model and batch.num_rows else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own)], names=schema.names)

        scored = cut_lineage(self.features.mapInArrow(run, schema))
        # a page belongs to the hosts it links to, or else to its source
        home = F.when(F.size("hosts") > 0, F.transform("hosts", lambda h: F.concat(F.lit("host:"), h))).otherwise(F.array(F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))))
        homes = scored.select("doc_id", "own", F.explode(home).alias("home"))
        rates = cut_lineage(homes.groupBy("home").agg(F.sum("own").alias("own_sum"), F.count(F.lit(1)).alias("pages")))
        mean = scored.agg(F.avg("own")).first()[0] or 0.0
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        # the page itself doesn't count for its host
        rate = (F.col("own_sum") - F.col("own") + HOST_PRIOR * mean) / (F.col("pages") - 1 + HOST_PRIOR)
        pull = lookup_join(homes, rates, "home").groupBy("doc_id").agg(F.avg(rate).alias("rate"))
        odds = lambda p: F.log(p / (1 - p))
        clipped = lambda p: F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
        shifted = odds(clipped(F.col("own"))) + HOST_PULL * (odds(clipped(F.col("rate"))) - odds(F.lit(mean)))
        return scored.join(pull, "doc_id").select("doc_id", "source", "own", (1 / (1 + F.exp(-shifted))).alias("spam"))

    def found(self) -> DataFrame:
        """doc_id of spam pages."""
        return self.scores().where(F.col("spam") >= LIMIT).select("doc_id").distinct()


def spam_pages(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> SpamModel:
    """Find pages that consist mostly of repeated keywords, links, products, tags or navigation words.

    Every whole text is described by content and link features. Bagged decision trees are fitted on at most
    ``sample_rows`` pages, of which those with a weak label count, and give every page a probability, which is then moved
    towards the spam rate of the other pages of the hosts it links to (or of its source, if it has no links).

    Null and blank texts are never spam. Null sources form one source. Repeated doc_ids give one result row. Without
    a plain label in the sample (an empty table as well) nothing is spam. Other columns are not read.
    """
    return SpamModel(documents, sample_rows, seed)
