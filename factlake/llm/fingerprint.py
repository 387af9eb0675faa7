"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases' names into phrases of phrases, and so on. Runs of one name become
one symbol; deterministic coin tossing then labels each symbol by the lowest bit in which its name differs
from its left neighbour's, four times over, until labels are below 6 and neighbours' labels differ; local
maxima of labels start phrases, which so have between 2 and a dozen symbols. A phrase is named by a hash of
its symbols. Where a phrase starts depends on a few neighbours only, so equal substrings have the same
phrases inside, at whatever offset.

The fingerprint is the SKETCH smallest 32-bit hashes of the names of all levels as hexadecimal text;
likeness() estimates from two of them which share of all names both texts have. Texts of every length are told
by the same levels, so that any two fingerprints can be compared.

Defined results: a null text is the empty one, whose fingerprint is empty; the empty fingerprint is like
itself (1) and unlike any other (0); doc_ids that are no whole numbers are ordered as strings, null ones come after all
others, rows of equal doc_id are ordered by a hash of their text, so that many of them can be dealt to several tasks;
a lone document is its own next; an empty table gives no rows; further columns, whatever their names, are ignored
by edited_fingerprints() and kept by fingerprints().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas import types as pa_types

from .common import kept, ready, trimmed
from .words import mix

SKETCH = 64
MAX_LEVELS = 40
#: code points parsed at once, beyond one longer text
CHUNK = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        del _powers[:]
        for base in (int(_P), pow(int(_P), -1, 1 << 64)):
            p = np.full(max(n, CHUNK + 1), base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 k + b, where k is the lowest bit in which a symbol differs from its left neighbour, and b is its bit there."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    d = x ^ left
    low = d & (~d + x.dtype.type(1))
    k = np.bitwise_count(low - x.dtype.type(1))
    return (k << np.uint8(1)) | ((x & low) != 0).view(np.uint8)


def _phrases(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names and text numbers of the phrases. text has the number of each symbol's text, ascending."""
    n = len(names)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(text[1:], text[:-1], out=start[1:])
    fresh = start.copy()
    fresh[1:] |= names[1:] != names[:-1]
    if not fresh.all():  # each run as one symbol
        at = np.flatnonzero(fresh)
        length = np.diff(np.append(at, n)).astype(np.uint64)
        names = np.where(length > 1, mix(names[at] + length * _P), names[at])
        text, start, n = text[at], start[at], len(at)
    first = np.flatnonzero(start)
    label = names
    for _ in range(4):
        label = _toss(label, first)
    begins = start
    inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~start[2:]
    begins[1:-1] |= inner
    at = np.flatnonzero(begins)
    end = np.append(at[1:], n) - 1
    power, inverse = _power_tables(n)
    term = mix(names + _P) * power[:n]
    total = np.cumsum(term, dtype=np.uint64)
    h = (total[end] - total[at] + term[at]) * inverse[at]
    return mix(h + (end - at).astype(np.uint64)), text[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted sketch of each text, as 32-bit numbers."""
    out: list[np.ndarray] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        out += _sketches(texts[a:b])
        a = b
    return out


def _sketches(texts: list[str]) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), lengths)
    held_names, held_text = [], []
    level = 0
    while len(names) and level < MAX_LEVELS:
        names, text = _phrases(names, text)
        level += 1
        held_names.append((mix(names ^ np.uint64(level)) >> np.uint64(32)).astype(np.uint32))
        held_text.append(text)
        alone = np.bincount(text, minlength=len(texts)) == 1  # these are one symbol, and end here
        if alone.any():
            more = ~alone[text]
            names, text = names[more], text[more]
    if not held_names:
        return [np.zeros(0, np.uint32) for _ in texts]
    names, text = np.concatenate(held_names), np.concatenate(held_text)
    both = np.unique((text.astype(np.uint64) << np.uint64(32)) | names)
    bounds = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return [both[x : min(y, x + SKETCH)].astype(np.uint32) for x, y in zip(bounds[:-1], bounds[1:])]


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smallest hashes of both sketches together that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        union = union[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b), assume_unique=True).mean())


def printed(text: Column) -> Column:
    """The fingerprint of each text; only texts are sent to Python, and only fingerprints come back."""

    @trimmed
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([written(s) for s in sketches([t or "" for t in batch.to_pylist()])], pa.string())

    return F.arrow_udf(scan, "string")(text.cast("string"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """All columns of documents and the fingerprint of the text, as a last column `fingerprint`: one narrow pass, no shuffle."""
    ready(documents.sparkSession)
    own = kept(documents)
    return own.table.withColumn("fingerprint", printed(own["text"])).toDF(*own.names, "fingerprint")


#: ranges of documents for each shuffle partition
RANGES = 8
_LOWEST = -(1 << 63)


def _key(documents: DataFrame) -> Column:
    whole = documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _range_of(keys: np.ndarray, hashes: np.ndarray, key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By row, the range whose largest (key, hash) is the first not below its own."""
    dest, end = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
    tied = np.flatnonzero(dest < end)
    for k in set(key[tied].tolist()):
        rows = tied[key[tied] == k]
        a, b = dest[rows[0]], end[rows[0]]
        dest[rows] = a + np.searchsorted(hashes[a:b], h[rows])
    return dest


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (dest, extra, doc_id, text), dealt into partitions and sorted so that each row of a dest but its extra ones has
    its successor, by descending doc_id, right behind it.

    Spark's range partitioning of the ids (and text hashes) alone gives the ranges. The first row of each
    range is sent to the range before it too, and the first of all follows the last. Only the largest id of each
    range reaches the driver.
    """
    spark = documents.sparkSession
    given = documents.select(_key(documents).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("h"), "doc_id", F.col("text").cast("string").alias("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = given.select("key", "h").repartitionByRange(ranges, "key", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("key", "h")).alias("head"))
    largest = sorted((r.head.key, r.head.h) for r in heads.select("head").collect())
    whole = not largest or isinstance(largest[0][0], int)
    keys = np.array([k for k, _ in largest], np.int64 if whole else object)
    hashes = np.array([h for _, h in largest], np.int64)
    #: each range's first row also ends the range before it, in descending order
    before = {x: (i + 1) % len(largest) for i, x in enumerate(largest)}

    @trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        names = ["dest", "extra", "key", "h", "doc_id", "text"]
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            h = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(keys, hashes, key, h)), pa.array(np.zeros(len(h), bool)), *batch.columns], names=names)
            first = [i for i in np.flatnonzero(np.isin(h, hashes)) if (x := (key[i], h[i])) in before and x not in sent and not sent.add(x)]
            if first:
                copies = batch.take(pa.array(first))
                to = pa.array([before[key[i], h[i]] for i in first], pa.int64())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(first), bool)), *copies.columns], names=names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    dealt = given.mapInArrow(deal, f"dest long, extra boolean, {fields}")
    return dealt.repartition("dest").sortWithinPartitions("dest", "extra", F.desc("key"), F.desc("h")).select("dest", "extra", "doc_id", "text")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has the first floor(n_chars / 3) code points of the next document, by descending doc_id, in
    place of its last ones. Each text crosses the network once.
    """
    ready(documents.sparkSession)
    rows = with_next(documents)
    id_type = pa_types.to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def told(run: list[tuple]) -> pa.RecordBatch:
        """run: (dest, extra, doc_id, text) rows; all but extra ones and the last get a row."""
        texts = [r[3] for r in run]
        edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for x, y in zip(texts, texts[1:])]
        own, new = sketches(texts), sketches(edited)
        out: list[tuple] = []
        for i, r in enumerate(run[:-1]):
            if not r[1]:
                digest = hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest()
                out.append((r[2], len(texts[i]), digest, written(own[i]), written(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1])))
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=names)

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        size = 0
        for batch in batches:
            for dest, extra, doc_id, text in zip(*(batch.column(n) for n in ("dest", "extra", "doc_id", "text"))):
                text = text.as_py() or ""
                run.append((dest.as_py(), extra.as_py(), doc_id.as_py(), text))
                size += len(text)
                if size > 1 << 20 and len(run) > 1:
                    yield told(run)
                    run, size = run[-1:], len(text)
        if len(run) > 1:
            yield told(run)

    return rows.mapInArrow(
        scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op6_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
