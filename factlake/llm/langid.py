"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its training text. A text belongs to the
language whose dictionary encodes it in the fewest bytes; where the runner-up needs hardly more, the
text is rejected. Where the margin is under NARROW, the same dictionaries encode the text at further levels
too and the bytes of all levels are summed: other searches find other matches, which tells texts of few bytes apart.

The dictionaries are fitted on a bounded sample of labelled rows: per language the training document with the
smallest hash of doc_id in each of SAMPLE_ROWS classes of hashes, of each at most SAMPLE_CHARS characters around
its middle, distinct ones only, until DICTIONARY_BYTES are full. One pass over doc_id and lang chooses them for
all languages, one more reads their texts. Prediction reads every text whole, in pieces of PIECE_BYTES, and
looks at nothing but the text.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; a row with a
null lang or doc_id is never learned from but is predicted like any other; of rows that repeat a chosen doc_id
and lang one is learned from; ties go to the language with most training rows, then the one that sorts first;
without any learned language every text is `und`; repeated rows each get their row; further columns, whatever
their names, are ignored by predictions and kept by identified().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ready, trimmed

SAMPLE_ROWS = 200
SAMPLE_CHARS = 2048
DICTIONARY_BYTES = 24 << 10
PIECE_BYTES = 2048
LEVEL = 6
#: further levels, and the margin under which they are asked
FURTHER_LEVELS = (9, 12)
NARROW = 0.05
#: a text is rejected where the runner-up needs less than this share more bytes than the best
MIN_MARGIN = 0.002
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
#: code points of a text that are lower-cased and encoded to bytes at once
CHUNK_CHARS = 1 << 20


def letters(text: str) -> bytes:
    """What is encoded: the lower-cased words, each run of anything else as one space."""
    return f" {_OTHER.sub(' ', text.lower())} ".encode("utf-8", "replace")


def held_out() -> Column:
    """The documents never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame) -> dict[str, bytes]:
    """Language → raw dictionary, from the training rows, the language with most of them first.

    The driver gets at most SAMPLE_ROWS texts a language, of at most SAMPLE_CHARS characters.
    """
    train = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    h = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = train.groupBy("lang", F.pmod(h, F.lit(SAMPLE_ROWS)).alias("part")).agg(F.min(h).alias("h"), F.count("*").alias("n")).collect()
    rows: dict[str, int] = {}
    for r in chosen:
        rows[r.lang] = rows.get(r.lang, 0) + r.n
    if not chosen:
        return {}
    middle = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARS) / 2).cast("int") + 1)
    given = train.withColumn("h", h).filter(F.col("h").isin([r.h for r in chosen]))
    wanted = given.groupBy("lang", "h").agg(F.min(F.substring(F.col("text").cast("string"), middle, F.lit(SAMPLE_CHARS))).alias("text")).filter("text is not null")
    texts: dict[str, list] = {lang: [] for lang in rows}
    for r in wanted.collect():
        texts[r.lang].append((r.h, r.text))
    out = {}
    for lang in sorted(texts, key=lambda x: (-rows[x], x)):
        parts, size = [], 0
        for raw in dict.fromkeys(letters(t) for _, t in sorted(texts[lang])):
            raw = raw[: DICTIONARY_BYTES - size]
            parts.append(raw)
            size += len(raw)
            if size >= DICTIONARY_BYTES:
                break
        if size:
            out[lang] = b" ".join(reversed(parts))  # zstandard reaches the end of a dictionary most cheaply
    return out


class Classifier:
    """The dictionaries, ready to encode; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries
        self.coders = self._coders(LEVEL)
        self.further: list = []

    def _coders(self, level: int) -> list:
        import zstandard as z

        out = []
        for lang, raw in self.dictionaries.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append((lang, z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is the runner-up's extra share of bytes."""
        if not text or not self.coders or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        sizes, rounds = self._sizes(text, self.coders), 1
        best, *others = sorted(sizes)
        if others and others[0] - best < NARROW * best:
            self.further = self.further or [self._coders(level) for level in FURTHER_LEVELS]
            for coders in self.further:
                sizes = [x + y for x, y in zip(sizes, self._sizes(text, coders))]
                rounds += 1
            best, *others = sorted(sizes)
        margin = (others[0] - best) / best if others else 1.0
        scale = 0.02 * best / rounds + 1.0
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / rounds / scale)) for s in sizes)
        return self.coders[sizes.index(best)][0], score, margin

    @staticmethod
    def _sizes(text: str, coders: list) -> list[int]:
        out = [0] * len(coders)
        for a in range(0, len(text), CHUNK_CHARS):
            raw = letters(text[a : a + CHUNK_CHARS])
            for i in range(0, len(raw), PIECE_BYTES):
                piece = raw[i : i + PIECE_BYTES]
                for k, (_, c) in enumerate(coders):
                    out[k] += len(c.compress(piece))
        return out


def told(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct(lang_pred, score, margin, rejected) of each text; only texts are sent to Python, and only this comes back."""

    @trimmed
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(dictionaries)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch]
            bad = [lang == UNDETERMINED or margin < MIN_MARGIN for lang, _, margin in found]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array(bad, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "margin", "rejected"])

    return F.arrow_udf(scan, "lang_pred string, score double, margin double, rejected boolean")(text.cast("string"))


def identify(documents: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """`keep` columns, lang_pred, score, margin and rejected of every document."""
    ready(documents.sparkSession)
    return documents.select(*[F.col(f"`{c}`") for c in keep], told(F.col("text"), dictionaries).alias("_told")).select(*[F.col(f"`{c}`") for c in keep], "_told.*")


def identified(documents: DataFrame) -> DataFrame:
    """The documents in a language that is told with a margin, with their own columns, whatever those are called."""
    ready(documents.sparkSession)
    own = kept(documents)
    found = own.table.withColumn("told", told(own["text"], learn(documents)))
    return own.back(found.filter(~F.col("told.rejected")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents, learn(documents), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
