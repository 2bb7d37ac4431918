"""Languages of texts and of their segments by hyperdimensional letter profiles.

Every letter has a fixed random vector of +1 and -1. A run of three letters is bound into one vector: the first rotated
twice, the second once, all three multiplied. The vectors of a segment's runs are added up (bundled), and the segment
gets the language whose prototype, a bundle of many such segments, has the greatest cosine with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.truncation import body
from quillspark.operators.skew import lookup_join
from quillspark.session import cut_lineage, spread
from quillspark.sources.tables import image_key

LANGUAGES = ("zh", "en", "de", "fr", "es")

#: Length of the vectors.
DIMENSIONS = 1024

#: Labelled texts that the prototypes are made of, at most; chosen by the hash of the text over all rows. Chosen by the
#: accuracy on labelled texts outside the sample, see the README; more texts don't raise it.
SAMPLE_ROWS = 6_000

#: One in so many of these is kept for each declared language, or all its texts if it has fewer; the rest of the sample
#: goes by hash alone.
LANGUAGE_SHARE = 20

#: Copies of a text that are trained on, at most, and only in the room that distinct texts leave.
COPIES = 8

#: Texts longer than this aren't taken for training (they are classified as a whole all the same), which bounds the
#: sample's size.
SAMPLE_LENGTH = 10_000

#: Runs whose products with the prototypes a worker keeps at most; then it begins anew (results don't change).
KEPT_RUNS = 1_000_000

#: How far the best language must lead the second (in cosine) for a sentence to count by itself.
LEAST_LEAD = 0.03

#: Names of the languages in labels, after case, blanks and country were taken off. Fixed values.
NAMES = {
    "zh": "zh zho chi cmn cn chinese mandarin 中文 汉语 漢語 chinesisch chinois chino",
    "en": "en eng english 英文 英语 englisch anglais inglés ingles",
    "de": "de deu ger german deutsch 德语 allemand alemán aleman",
    "fr": "fr fra fre french français francais 法语 französisch francés frances",
    "es": "es spa spanish español espanol 西班牙语 spanisch espagnol castellano",
}

_STOP = re.compile(r"(?<=[.!?])(?<!Mio\.)(?<!Mrd\.)[\"'”’»」』)\]）】*_]*(?:\s+|$)|(?<=[。！？．])[\"'”’»」』)\]）】*_]*\s*|[\r\n  \x0b\x0c]+|(?<!\s)\s++[/|]\s+")
_ENDED = re.compile(r"[.。．!！?？;；][\"'”’»」』)\]）】*_\s]*$")
_LABEL = re.compile(r"^\W*[^\s:：]{1,20}\s?[:：]\s*\S.{0,80}$")
_HAN = re.compile(r"[㐀-鿿]")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Names in brackets or quotation marks and words of capitals and figures say nothing about the language around them.
_BRACKETS = re.compile(r"[(（\[【][^()（）\[\]【】]{0,30}[)）\]】]")
_CAPITALS = re.compile(r"(?<![A-Za-zÀ-ÿ])[A-Z0-9][A-Z0-9-]+(?![A-Za-zÀ-ÿ])")
_SMALL = re.compile(r"[a-zß-öø-ÿ]{2}")


def language_of_label(label):
    """The language that a label names, in any spelling, with or without a country; else null."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    stem = F.regexp_extract(plain, r"^([^-_\s(/.]+)", 1)
    pairs = [(name, code) for code, names in NAMES.items() for name in names.split()]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, stem))


def language_of_file(filename):
    """The language code in a file name: the last of two letters set off by marks, with or without a country."""
    codes = F.regexp_extract_all(F.lower(filename), F.lit(r"(?<![a-z])(zh|en|de|fr|es)(?:[-_ %20]*(?:cn|tw|hk|us|gb|uk|de|at|ch|fr|es|mx))?(?![a-z])"), F.lit(1))
    return F.when(F.size(codes) > 0, F.element_at(codes, -1))


def _letter(code: int) -> np.ndarray:
    return np.random.default_rng([1009, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class _Letters:
    """Letter vectors, made when first met; there are only as many as there are letters."""

    def __init__(self) -> None:
        self._at: dict[int, int] = {}
        self._rows: list[np.ndarray] = []

    def of(self, codes: np.ndarray) -> np.ndarray:
        for code in np.unique(codes).tolist():
            if code not in self._at:
                self._at[code] = len(self._rows)
                self._rows.append(_letter(code))
        table = np.stack(self._rows)
        return table[np.fromiter((self._at[c] for c in codes.tolist()), np.int64, len(codes))]


_letters = _Letters()


def _without_asides(segment: str) -> str:
    bare = _BRACKETS.sub(" ", segment)
    return _CAPITALS.sub(" ", bare) if _SMALL.search(bare) or _HAN.search(bare) else bare


def letters_only(segment: str) -> str:
    """What a segment's vector is made of: small letters, everything between them one blank."""
    plain = _NOT_LETTERS.sub(" ", _without_asides(segment).lower()).strip()
    return f" {plain} " if plain else ""


def _runs(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of three letters of all segments (already letters_only) as numbers, and how many each segment has."""
    arrays = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for s in segments]
    # scripts of thousands of letters would leave most runs unseen: from U+2E80 on, a block of 4096 is one letter
    arrays = [np.where(a >= 0x2E80, (a >> 12) + 0x110000, a) for a in arrays]
    keys = [a[:-2] << 42 | a[1:-1] << 21 | a[2:] if len(a) > 2 else a[:0] for a in arrays]
    return np.concatenate(keys) if keys else np.zeros(0, np.int64), np.fromiter(map(len, keys), np.int64, len(keys))


def _bound(runs: np.ndarray) -> np.ndarray:
    """The bound vector of each run: the first letter's rotated twice, the second's once, multiplied."""
    mask = (1 << 21) - 1
    out = np.empty((len(runs), DIMENSIONS), dtype=np.int8)
    for low in range(0, len(runs), 4096):
        part = runs[low : low + 4096]
        out[low : low + 4096] = np.roll(_letters.of(part >> 42), 2, axis=1) * np.roll(_letters.of(part >> 21 & mask), 1, axis=1) * _letters.of(part & mask)
    return out


def bundle(segments: list[str]) -> np.ndarray:
    """The vector of each segment (already letters_only): the sum of its bound runs of three letters."""
    out = np.zeros((len(segments), DIMENSIONS), dtype=np.float32)
    for start in range(0, len(segments), 2000):
        flat, sizes = _runs(segments[start : start + 2000])
        if not len(flat):
            continue
        runs, place = np.unique(flat, return_inverse=True)
        bound, at = _bound(runs), 0
        for i, size in enumerate(sizes.tolist()):
            if size:
                out[start + i] = bound[place[at : at + size]].sum(axis=0, dtype=np.int32)
                at += size
    return out


class Profiles:
    """Prototypes of the languages, and how sharply confidence follows the cosines."""

    def __init__(self, prototypes: np.ndarray, known: np.ndarray, sharpness: float = 20.0):
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        self.prototypes, self.known, self.sharpness = prototypes / np.maximum(norms, 1e-9), known, sharpness
        self._keys, self._products = np.zeros(0, np.int64), np.zeros((0, len(LANGUAGES)), np.float32)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        return np.where(self.known, vectors @ self.prototypes.T / norms, -1.0)

    def _of_runs(self, runs: np.ndarray) -> np.ndarray:
        """Each run's products with the prototypes, kept for later batches; there are as many as runs of letters."""
        new = np.setdiff1d(runs, self._keys, assume_unique=True)
        if len(new):
            made = np.concatenate([_bound(new[k : k + 4096]).astype(np.float32) @ self.prototypes.T for k in range(0, len(new), 4096)])
            keys, products = np.concatenate([self._keys, new]), np.concatenate([self._products, made])
            order = np.argsort(keys)
            self._keys, self._products = keys[order], products[order]
        found = self._products[np.searchsorted(self._keys, runs)]
        if len(self._keys) > KEPT_RUNS:
            self._keys, self._products = self._keys[:0], self._products[:0]
        return found

    def cosines_of(self, segments: list[str]) -> np.ndarray:
        """The cosines of segments (already letters_only). A bundle is a sum, so its product with a prototype is the sum of
        its runs' products, and no bundle needs to be formed. Its length is taken as that of as many independent vectors,
        sqrt(DIMENSIONS x the sum of squared counts), which it meets within a few hundredths; a segment's languages are
        ranked alike by either."""
        out = np.full((len(segments), len(LANGUAGES)), -1.0)
        for start in range(0, len(segments), 4000):
            flat, sizes = _runs(segments[start : start + 4000])
            if not len(flat):
                continue
            runs, place = np.unique(flat, return_inverse=True)
            products = self._of_runs(runs)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs, counts = np.unique(owner * len(runs) + place, return_counts=True)
            owner, place = pairs // len(runs), pairs % len(runs)
            squares = np.bincount(owner, weights=counts.astype(float) ** 2, minlength=len(sizes))
            sums = np.stack([np.bincount(owner, weights=counts * products[place, k], minlength=len(sizes)) for k in range(len(LANGUAGES))], axis=1)
            some = sizes > 0
            out[start : start + len(sizes)][some] = np.where(self.known, sums[some] / np.sqrt(DIMENSIONS * squares[some])[:, None], -1.0)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_keys": self._keys[:0], "_products": self._products[:0]}


def _sharpness(near: np.ndarray, labels: np.ndarray, known: np.ndarray) -> float:
    """The factor that makes the labels likeliest, if a twentieth of them is arbitrary."""
    own = near[np.arange(len(labels)), labels][:, None]
    best = (-np.inf, 20.0)
    for factor in (5.0, 7.0, 10.0, 14.0, 20.0, 28.0, 40.0, 56.0, 80.0):
        share = 1 / np.exp(np.clip(factor * (near[:, known] - own), None, 50)).sum(axis=1)
        best = max(best, (float(np.log(0.95 * share + 0.05 / len(LANGUAGES)).mean()), factor))
    return best[1]


def train(texts: list[str], labels: list[str], rounds: int = 3) -> Profiles:
    """Prototypes from labelled texts of which some are labelled wrongly or mixed.

    The first prototypes bundle all segments under their text's label. Then every segment that is clearly nearer to
    another prototype goes there, and the prototypes are bundled anew.
    """
    segments, owner = [], []
    for text, label in zip(texts, labels):
        for segment in split(text):
            plain = letters_only(segment)
            if len(plain) > 12:
                segments.append(plain)
                owner.append(LANGUAGES.index(label))
    if not segments:
        return Profiles(np.zeros((len(LANGUAGES), DIMENSIONS), np.float32), np.zeros(len(LANGUAGES), bool))
    vectors = bundle(segments)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    chosen = np.array(owner)
    for step in range(rounds):
        sums = np.stack([vectors[chosen == k].sum(axis=0) for k in range(len(LANGUAGES))])
        profiles = Profiles(sums, np.array([(chosen == k).any() for k in range(len(LANGUAGES))]))
        if step < rounds - 1:
            near = profiles.cosines(vectors)
            own = near[np.arange(len(chosen)), chosen]
            chosen = np.where(near.max(axis=1) - own > 2 * LEAST_LEAD, near.argmax(axis=1), chosen)
    profiles.sharpness = _sharpness(profiles.cosines(vectors), np.array(owner), profiles.known)
    return profiles


def split(text: str) -> list[str]:
    """Pieces that may be sentences: cut after sentence ends and at line ends."""
    out, at = [], 0
    for m in _STOP.finditer(text):
        if text[at : m.end()].strip():
            out.append(text[at : m.end()])
        at = m.end()
    if text[at:].strip():
        out.append(text[at:])
    return out


def is_sentence(segment: str) -> bool:
    """Whether a piece is a sentence and not only names, a unit, a figure, a footer or a stump of a few words."""
    bare = _without_asides(segment)
    han, words = len(_HAN.findall(bare)), len(_LATIN.findall(bare))
    ended = bool(_ENDED.search(segment))
    if not ended and _LABEL.match(segment.strip()):
        return False
    return han >= (5 if ended else 10) or words >= (4 if ended else 7)


def languages_of(texts: list[str | None], profiles: Profiles) -> list[list[tuple]]:
    """For each text its segments: (language, confidence, sentences, letters), neighbours of one language merged.

    A piece that is no sentence, or that isn't clearly nearer to one language, goes with its neighbours.
    """
    pieces, where = [], []
    for i, text in enumerate(texts):
        for piece in split(text or ""):
            pieces.append(piece)
            where.append(i)
    plain = [letters_only(p) for p in pieces]
    distinct = {p: k for k, p in enumerate(dict.fromkeys(plain))}
    near = profiles.cosines_of(list(distinct)) if distinct else np.zeros((0, len(LANGUAGES)))
    near = near[[distinct[p] for p in plain]] if plain else near
    order = np.sort(near, axis=1) if len(near) else near
    out: list[list[tuple]] = [[] for _ in texts]
    for k, i in enumerate(where):
        if not plain[k] or order[k, -1] <= 0:
            continue
        best = int(near[k].argmax())
        exact = 1.0 / float(np.exp(profiles.sharpness * (near[k] - near[k, best])).sum())
        alone = is_sentence(pieces[k]) and order[k, -1] - order[k, -2] >= LEAST_LEAD
        out[i].append((LANGUAGES[best], exact, int(alone), len(plain[k]) - 2))
    return [_merge(row) for row in out]


def _merge(row: list[tuple]) -> list[tuple]:
    merged: list[list] = []
    for language, confidence, sentence, size in row:
        if merged and (merged[-1][0] == language or not sentence):
            last = merged[-1]
            weight = last[3] + size
            last[1] = (last[1] * last[3] + (confidence if last[0] == language else 1 - confidence) * size) / weight
            last[2], last[3] = last[2] + sentence, weight
        elif merged and not merged[-1][2] and len(merged) == 1:
            first = merged[-1]
            merged[-1] = [language, (confidence * size + (1 - first[1]) * first[3]) / (size + first[3]), sentence, size + first[3]]
        else:
            merged.append([language, confidence, sentence, size])
    return [tuple(m) for m in merged]


class LanguageCheck:
    """Segments of texts with their languages, beside the declared ones.

    Texts go from the scan to Python and no further: what is shuffled is one small row for each segment, and keys, hashes
    and labels for the training sample.
    """

    def __init__(self, texts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
        self.texts = texts.select(F.col("rec_id").cast("long").alias("rec_id"), "key", "text", F.xxhash64("text").alias("_h")).where("text is not null")
        self.labels = labels.select("key", "declared").where("key is not null and declared is not null")
        told = self.texts.where((F.length("text") <= SAMPLE_LENGTH) & F.col("key").isNotNull()).select("key", "_h")
        usable = lookup_join(told, self.labels, "key").where("declared is not null").select("declared", "_h")
        # only hashes are shuffled; of each language a task keeps sample_rows at most
        rank = F.row_number().over(Window.partitionBy("declared").orderBy("_h"))
        ranked = usable.groupBy("declared", "_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", rank).where(F.col("_k") <= sample_rows)
        chosen = cut_lineage(ranked.orderBy(F.col("_k") > max(1, sample_rows // LANGUAGE_SHARE), "_h", "declared").limit(sample_rows).drop("_k"))
        sample = self.texts.where(F.length("text") <= SAMPLE_LENGTH).join(F.broadcast(chosen.select("_h").distinct()), "_h", "left_semi").select("text", "_h").distinct()
        distinct = sample.join(F.broadcast(chosen), "_h").orderBy("_h", "text", "declared").limit(sample_rows).collect()
        labelled = [r for copy in range(COPIES) for r in distinct if r["_n"] > copy][:sample_rows]
        self.profiles = train([r.text for r in labelled], [r.declared for r in labelled])

    def segments(self) -> DataFrame:
        """rec_id, declared, segment (from 1), lang, confidence, sentences, letters: one row for each segment."""
        profiles = self.profiles
        schema = T.StructType(
            [
                T.StructField("rec_id", T.LongType()),
                T.StructField("key", T.StringType()),
                T.StructField("_h", T.LongType()),
                T.StructField("segment", T.IntegerType()),
                T.StructField("lang", T.StringType()),
                T.StructField("confidence", T.DoubleType()),
                T.StructField("sentences", T.IntegerType()),
                T.StructField("letters", T.IntegerType()),
            ]
        )
        kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 2000):
                    part = batch.slice(start, 2000)
                    found = languages_of(part.column(3).to_pylist(), profiles)
                    owner = pa.array([i for i, row in enumerate(found) for _ in row], pa.int64())
                    columns = list(zip(*[(k + 1, *s) for row in found for k, s in enumerate(row)])) or [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([*[part.column(k).take(owner) for k in range(3)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

        # footers, notes and tags after the last sentence have no language of their own
        made = spread(self.texts.select("rec_id", "key", "_h", body(F.col("text")).alias("text"))).mapInArrow(run, schema)
        told = lookup_join(cut_lineage(made.dropDuplicates(["rec_id", "_h", "segment"])), self.labels, "key")
        return told.select("rec_id", "declared", "segment", "lang", "confidence", "sentences", "letters")

    def documents(self) -> DataFrame:
        """rec_id, declared, langs (of which there is a sentence), lang (of most letters), confidence."""
        by = self.segments().groupBy("rec_id", "lang").agg(F.first("declared", ignorenulls=True).alias("declared"), F.sum("sentences").alias("sentences"), F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
        return by.groupBy("rec_id").agg(
            F.first("declared", ignorenulls=True).alias("declared"),
            F.array_sort(F.collect_set(F.when(F.col("sentences") > 0, F.col("lang")))).alias("langs"),
            F.max_by("lang", F.struct("letters", "lang")).alias("lang"),
            F.max_by("confidence", F.struct("letters", "lang")).alias("confidence"),
        )

    def mismatches(self) -> DataFrame:
        """rec_id, lang: the languages of those texts that have sentences, but not of the declared language alone."""
        documents = self.documents().where("size(langs) > 0")
        differs = (F.size("langs") > 1) | F.col("declared").isNull() | (F.col("langs")[0] != F.col("declared"))
        return documents.where(differs).select("rec_id", F.explode("langs").alias("lang"))


def declared_languages(images: DataFrame, tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """key, declared: the language that is declared for each image id.

    Declared is the language of the image's task, else by lang_detect of the image's source: fixed_xx gives xx, dirname
    the code in the image's file name. Images without any of these are left out.
    """
    task = tasks.select("task_id", language_of_label(F.col("language")).alias("by_task")).where("by_task is not null").groupBy("task_id").agg(F.min("by_task").alias("by_task"))
    rule = sources.select(F.col("name").alias("source"), F.lower(F.trim("lang_detect")).alias("rule")).where("source is not null").dropDuplicates(["source"])
    # of an image's rows the one with a task, a source and a file name counts, if they differ the least
    image = images.select(image_key(F.col("id")).alias("key"), "task_id", "source", "filename").where("key is not null").groupBy("key").agg(F.min("task_id").alias("task_id"), F.min("source").alias("source"), F.min("filename").alias("filename"))
    # source rules are a table of a few rows, which Spark sends to all tasks by its size; tasks may have a hot id
    known = lookup_join(image.join(rule, "source", "left"), task, "task_id")
    by_rule = F.when(F.col("rule").startswith("fixed"), language_of_label(F.regexp_extract("rule", r"^fixed[-_ ]*(.+)$", 1))).when(F.col("rule") == "dirname", language_of_file(F.col("filename")))
    return cut_lineage(known.select("key", F.coalesce("by_task", by_rule).alias("declared")).where("declared is not null"))


def annotation_texts(annotations: DataFrame) -> DataFrame:
    """rec_id, key, text of annotations (id, image_id, summary)."""
    return annotations.select(F.col("id").alias("rec_id"), image_key(F.col("image_id")).alias("key"), F.col("summary").alias("text"))


def check_languages(texts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageCheck:
    """Find the languages of texts (rec_id, key, text) and of their segments, each with a confidence, beside the language
    that labels (key, declared) declare for their key; labels have one row for a key.

    Prototypes are trained on at most ``sample_rows`` distinct texts with a declared language, wrong and mixed ones
    included, and none longer than SAMPLE_LENGTH; each declared language has one in LANGUAGE_SHARE of them, or all its
    texts if it has fewer. Copies are trained on only if there are fewer distinct texts than that.
    Languages without any such text can't be found. Null, blank and empty texts and texts without a letter have no
    segment; names, tickers, units, footers and stumps make no language. Whole texts are read, however long. Texts with
    the same rec_id are taken as one, exact copies count once. Without a key nothing is declared. An empty table gives
    empty results. Other columns are not read.
    """
    return LanguageCheck(texts, labels, sample_rows)
