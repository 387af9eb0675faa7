"""Best-fit packing of tokenised documents into fixed-length sequences, bulk-synchronously.

Documents become pieces of at most `max_tokens` ids. The pieces are sorted into ranges by length, long
lengths first, and ranked within their length; what remains open is kept as gaps, in runs of equal size.
Each superstep takes all pieces of the next length at once: a sweep over the gaps finds each piece's
successor (the smallest gap that holds it), conflicts go by rank (the k-th piece gets the k-th gap of that
size), the gaps are updated, and what found no gap opens new sequences. That is exactly best-fit
decreasing. As lengths and gaps are at most max_tokens, the supersteps need only the number of pieces per
length, which is all the driver gets; ranks and places of pieces are found where the pieces are.

Defined results: a null or empty text is its end id alone; a document longer than max_tokens is cut, and
only that one; repeated rows and null doc_ids each get their own place; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ready, trimmed
from .words import LOWER, chunks, span_hashes

MAX_TOKENS = 2048
END_ID = 0
#: ids held by a worker's cache of segments before it starts afresh
CACHE_IDS = 1 << 20
#: pieces of one length beyond which they are split by hash into several ranges
RANGE_ROWS = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: classes of bytes: white space, letters, digits, other signs, and bytes whose words are encoded whole: contractions'
#: apostrophes, the signs of special tokens, control characters and what is not ASCII
_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[ord(c) for c in "'<|"]] = _WHOLE


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of each text that are encoded apart, whether one is a whole word of several classes,
    and per text the index of its first one (one more entry at the end).

    Texts are split at white space, and words of ASCII and Latin-1 letters, digits and signs also where the
    tokenizer's own pattern splits them: between classes, and around each digit.
    """
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters but the two signs among them
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    inside = kind != _SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    opens[edge] = inside[edge]
    word = np.flatnonzero(opens)
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), np.zeros(len(off), np.int64)
    whole = np.add.reduceat((kind == _WHOLE).astype(np.int64), word) > 0
    split = inside & (kind == _DIGIT)
    split[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    owner = np.cumsum(opens) - 1
    split &= ~whole[np.maximum(owner, 0)]
    opens |= split
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    end = np.flatnonzero(closes) + 1
    return start, end, whole[owner[start]], np.searchsorted(start, off)


class WordEncoder:
    """Ids of whole texts, put together from the ids of their segments; each distinct segment is encoded once and remembered.

    Right for tokenizers that drop white space, split letters, single digits and signs apart and mark the
    last id of each stretch with `</w>`. Segments are known by a 64-bit hash of their lower-cased bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes, ascending, and their segments' numbers
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.total = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, new: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments and the number of each one's. Simple segments are one stretch, so that many are encoded as one text."""
        ids: list = [None] * len(new)
        simple = np.flatnonzero(~whole)
        runs = [simple[i : i + 512] for i in range(0, len(simple), 512)]
        apart = list(np.flatnonzero(whole))
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(new[i] for i in run) for run in runs], add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(run) or (len(ends) and ends[-1] != len(got)):
                apart += list(run)
                continue
            for i, part in zip(run, np.split(got, ends[:-1])):
                ids[i] = part
        for i, e in zip(apart, self.tokenizer.encode_batch_fast([new[i] for i in apart], add_special_tokens=False)):
            ids[i] = np.array(e.ids, np.uint32)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, hashes: np.ndarray, new: list[str], whole: np.ndarray) -> None:
        ids, count = self._encoded(new, whole)
        while self.total + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.total : self.total + len(ids)] = ids
        slot = np.arange(len(new)) + len(self.count)
        self.begin = np.concatenate((self.begin, self.total + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.total += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slot)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text and END_ID behind them, as little-endian unsigned 32-bit numbers."""
        start, end, whole, at = segments(data, off)
        if self.total > CACHE_IDS:
            self._reset()
        # special tokens are known by their very letters; all else is lower-cased by the tokenizer
        h = span_hashes(data if whole.any() and b"<|" in data.tobytes() else LOWER[data], start, end)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inner = place < len(self.known)
        fresh[inner] = self.known[place[inner]] != distinct[inner]
        if fresh.any():
            raw, which = data.tobytes(), first[fresh]
            self._learn(distinct[fresh], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[which], end[which])], whole[which])
            place = np.searchsorted(self.known, distinct)
        slot = self.slot[place][inverse] if len(distinct) else np.zeros(0, np.int64)
        n = self.count[slot]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.begin[slot] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[at]
        for a, b in zip(bounds[:-1], bounds[1:]):
            out = np.empty(b - a + 1, "<u4")
            out[:-1] = flat[a:b]
            out[-1] = END_ID
            yield out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


def pieces(documents: DataFrame, path: str, max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    ready(documents.sparkSession)
    kind = documents.select("doc_id").schema.fields[0].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for first, data, off in chunks(batch.column(1)):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, ids in enumerate(encode(data, off)):
                    for k, s in enumerate(range(0, len(ids), max_tokens)):
                        own = ids[s : s + max_tokens]
                        row.append(first + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            held.append(own.astype(np.int64))
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(held, pa.list_(pa.int64()))] * keep_ids
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, schema)


class Run(NamedTuple):
    """`count` pieces of one length from rank `rank` on: `per` in each sequence from `sequence` on, after `offset`."""

    length: int
    rank: int
    count: int
    sequence: int
    per: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Supersteps over lengths, longest first; counts has the number of pieces of each length."""
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size → runs of (first sequence, sequences)
    sizes: list[int] = []
    opened = 0

    def add(size: int, sequence: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((sequence, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                continue
            size = sizes[i]
            sequence, count = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[i]
            per = size // length
            full = min(count, left // per)
            if full:
                runs.append(Run(length, rank, full * per, sequence, per, capacity - size))
                add(size - per * length, sequence, full)
                rank, left = rank + full * per, left - full * per
            if full < count and left:  # fewer pieces are left than this gap takes
                runs.append(Run(length, rank, left, sequence + full, left, capacity - size))
                add(size - left * length, sequence + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(size, sequence + full, count - full)
    return runs


def pack(documents: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Only piece rows are shuffled, never text. Ranges are (length, hash bucket), so that a length which
    many pieces share is ranked in as many tasks as it needs; with P shuffle partitions there are at
    most 4 P + max_tokens of them, and their counts are what the driver sums up to first ranks.
    """
    spark = documents.sparkSession
    cuts = cut(pieces(documents, path or tokenizer_path(), max_tokens, keep_ids), "pieces")
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rows = min(RANGE_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1)
    splits = spark.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()], "length long, parts long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    ranged = cuts.join(F.broadcast(splits), "length").withColumn("bucket", bucket).drop("parts")
    first: dict[tuple[int, int], int] = {}
    upto: dict[int, int] = {}
    for r in sorted(ranged.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()):
        first[r.length, r.bucket] = upto.get(r.length, 0)
        upto[r.length] = upto.get(r.length, 0) + r.n
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranged.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    plan = np.array(sorted(best_fit(counts, max_tokens)), np.int64).reshape(-1, 6)
    offsets = np.array([(k, b, n) for (k, b), n in sorted(first.items())], np.int64).reshape(-1, 3)
    return _placed(ranked, plan, offsets, cuts.columns)


def _placed(ranked: DataFrame, plan: np.ndarray, offsets: np.ndarray, columns: list[str]) -> DataFrame:
    names = ["length", "rank", "count", "sequence", "per", "offset"]
    run = {n: plan[:, i] for i, n in enumerate(names)}
    plan_key = (run["length"] << 44) + run["rank"]
    range_key, range_first = (offsets[:, 0] << 40) + offsets[:, 1], offsets[:, 2]

    @trimmed
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket, rank = (batch.column(n).to_numpy() for n in ("length", "bucket", "rank"))
            rank = rank + range_first[np.searchsorted(range_key, (length << 40) + bucket)]
            at = np.searchsorted(plan_key, (length << 44) + rank, side="right") - 1
            k = rank - run["rank"][at]
            sequence = run["sequence"][at] + k // run["per"][at]
            offset = run["offset"][at] + k % run["per"][at] * length
            arrays = [batch.column(n) for n in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*columns).schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
