"""A hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(superclass | context) P(class | superclass, context) P(word | class): two softmaxes of 16 outcomes and a discounted share of
the class's training tokens. The most frequent words have classes of their own; the others share one by the last two bytes; a class's unknown words are one
outcome of it. The 256 classes are laid under 16 superclasses by repeated halving along the first singular vector of their bigram counts. Context features are
the word before, the word two before and the word three before (skips), the two words before (trigram) and the first with the third (skip trigram); each is
hashed to one of ROWS rows of 16 weights, for the second softmax together with the superclass.

Training is by distributed updates: tasks count, for every row and outcome, what was observed and what the model expects; sums by chunk of rows give the
step, STEP times the logarithm of their smoothed ratio, which is the gradient (observed minus expected) scaled as in iterative scaling. The first update takes
all training tokens against the model without features, whose expectation is exact. The following ones take a slice of the blocks each, all of them once; there the expectation is
one draw for each token, which is unbiased. The weights are a fixed table of ROWS x 32 numbers (8 MB); only it, and counts by class, come to the driver.

Counts of words grow with the corpus and never leave the executors. Documents are encoded in blocks, each with the sorted hashes of its
words. For ranges of hashes, blocks' counts are merged in a stream to the vocabulary; then the vocabulary's range meets the blocks' words
again, and the counts go back to their blocks, which are stored in buckets, so that they are not shuffled. Words are told by 64-bit hashes: among 10^8
distinct words any two share one with a probability below 0.03 %.

Defined results: a null or empty text is its end alone; documents with a null doc_id are never held out; without training tokens every word is unknown and the classes are
equally likely; repeated rows are each counted and scored; an empty table gives no rows; further columns are ignored. Base scores add one to every count, with
one outcome for all unknown words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, cut_by, over_rows, ready, trimmed
from .words import LOWER, NOT_SPACE, chunks, mix, span_hashes

#: tokens of a block, beyond one longer document
BLOCK_TOKENS = 1 << 20
#: words of the vocabulary that a task holds at once
RANGE_WORDS = 1 << 21
#: rows of weights, for each softmax; a power of 2
ROWS = 1 << 16
#: chunks by which rows are summed
CHUNKS = 64
#: words with a class of their own, the end included
FREQUENT = 128
#: the first update's step and smoothing, and those of the following
FIRST_STEP, FIRST_SMOOTHING = 0.4, 8.0
STEP, SMOOTHING = 0.3, 32.0
#: updates after the first, each from a slice of the blocks
SLICES = 2
#: tokens whose features are held, and whose probabilities are computed, at once
RUN, TOKENS = 1 << 18, 1 << 15
#: blocks of a task that counts for an update, so that its sums of ROWS x 32 numbers are small against what it read
TASK_BLOCKS = 16
#: the end of a text; its ending, 0, is that of no word
END = np.uint64(0x9D5C_03A1_6F2E_B847)
_OTHER = 255


def encoded(documents: DataFrame, held_out: Column) -> DataFrame:
    """Blocks of whole documents, in buckets: doc_id, size (tokens) and held of each, the block's terms and endings, and every token's place among them."""
    ready(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        parts: list[tuple] = []
        for batch in batches:
            for row, data, off in chunks(batch.column(1)):
                n = len(off) - 1
                h, ending, size = tokens(data, off)
                parts.append((batch.column(0).slice(row, n), batch.column(2).slice(row, n), size, h, ending))
                if sum(len(p[3]) for p in parts) >= BLOCK_TOKENS:
                    yield _block((task << 32) + made, parts)
                    made, parts = made + 1, []
        if parts:
            yield _block((task << 32) + made, parts)

    schema = f"block long, doc_id array<{kind}>, held binary, size binary, terms binary, ending binary, ids binary, n_terms long"
    return cut_by(given.mapInArrow(scan, schema), "blocks", "block", dealt=True)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and last two bytes of all words and ends, and the number of tokens of each text."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = NOT_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    before = np.where(end - start > 1, low[end - 2], 0) if len(end) else np.zeros(0, np.uint8)
    ending = before.astype(np.uint16) * np.uint16(256) + low[end - 1] if len(end) else np.zeros(0, np.uint16)
    at = np.searchsorted(start, off)
    return np.insert(span_hashes(low, start, end), at[1:], END), np.insert(ending, at[1:], 0), np.diff(at) + 1


def _block(number: int, parts: list[tuple]) -> pa.RecordBatch:
    ids, held = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1].to_numpy(zero_copy_only=False) for p in parts])
    size, h, ending = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    terms, first, place = np.unique(h, return_index=True, return_inverse=True)
    wide = 3 if len(terms) < 1 << 24 else 4
    place = place.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    binary = [held.astype(np.uint8), size.astype(np.int32), terms, ending[first], place]
    arrays = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b.tobytes()], pa.binary()) for b in binary), pa.array([len(terms)])]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_id", "held", "size", "terms", "ending", "ids", "n_terms"])


class Block(NamedTuple):
    """A block's arrays. trained: the tokens of documents that are not held out."""

    size: np.ndarray
    held: np.ndarray
    terms: np.ndarray
    ending: np.ndarray
    ids: np.ndarray
    trained: np.ndarray


_READ = ["held", "size", "terms", "ending", "ids"]


def read(held: pa.Scalar, size: pa.Scalar, terms: pa.Scalar, ending: pa.Scalar, ids: pa.Scalar) -> Block:
    size_ = np.frombuffer(size.as_buffer(), np.int32)
    raw = np.frombuffer(ids.as_buffer(), np.uint8).reshape(int(size_.sum()), -1)
    place = np.zeros((len(raw), 4), np.uint8)
    place[:, : raw.shape[1]] = raw
    held_ = np.frombuffer(held.as_buffer(), np.uint8).astype(bool)
    out = held_, np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(ending.as_buffer(), np.uint16), place.view("<u4").ravel().astype(np.int64)
    return Block(size_, *out, ~np.repeat(held_, size_))


# --- the vocabulary -------------------------------------------------------------------------------------------------


def _slices(terms: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins among sorted terms, and the end."""
    of = ((terms >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


_WORDS = "bucket int, terms binary, ending binary, n binary"


def vocabulary(blocks: DataFrame, ranges: int) -> DataFrame:
    """Ranges of the training words: sorted hashes, their endings and counts (int64)."""

    def counted(rows: Iterator[tuple]) -> Iterator[list]:
        for row in rows:
            b = read(*row)
            n = np.bincount(b.ids[b.trained], minlength=len(b.terms))
            own = np.flatnonzero(n)
            terms, ending, n = b.terms[own], b.ending[own], n[own]
            at = _slices(terms, ranges)
            some = np.flatnonzero(np.diff(at))
            yield [pa.array(some, pa.int32()), *(pa.array([x[at[r] : at[r + 1]].tobytes() for r in some], pa.binary()) for x in (terms, ending, n))]

    def merged(rows: Iterator[tuple]) -> Iterator[list]:
        bucket, held, size = None, [], 0

        def joined() -> list[np.ndarray]:
            terms, ending, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
            return [terms[first], ending[order][first], np.add.reduceat(n[order], first)]

        def made() -> list:
            return [pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in joined())]

        for r, terms, ending, n in rows:
            if bucket is not None and r.as_py() != bucket:
                yield made()
                held, size = [], 0
            bucket = r.as_py()
            held.append([np.frombuffer(x.as_buffer(), t) for x, t in ((terms, np.uint64), (ending, np.uint16), (n, np.int64))])
            size += len(held[-1][0])
            if size > 2 * max(RANGE_WORDS, len(held[0][0])):
                held = [joined()]
                size = len(held[0][0])
        if held:
            yield made()

    rows = over_rows(blocks, _READ, _WORDS, counted).repartition("bucket").sortWithinPartitions("bucket")
    return over_rows(rows, ["bucket", "terms", "ending", "n"], _WORDS, merged)


def counts_by_block(blocks: DataFrame, words: DataFrame, ranges: int) -> DataFrame:
    """block and c: the training counts of its terms (int64), in parts by range of hashes. A range's words come before the blocks that ask for them."""

    def asked(rows: Iterator[tuple]) -> Iterator[list]:
        for number, terms in rows:
            terms = np.frombuffer(terms.as_buffer(), np.uint64)
            at = _slices(terms, ranges)
            some = np.flatnonzero(np.diff(at))
            yield [pa.array(some, pa.int32()), pa.array([number.as_py()] * len(some), pa.int64()), pa.array([terms[at[r] : at[r + 1]].tobytes() for r in some], pa.binary())]

    def answered(rows: Iterator[tuple]) -> Iterator[list]:
        bucket, known, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r, number, terms, counts in rows:
            if r.as_py() != bucket:
                bucket, known, n = r.as_py(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            own = np.frombuffer(terms.as_buffer(), np.uint64)
            if not number.is_valid:
                known, n = own, np.frombuffer(counts.as_buffer(), np.int64)
                continue
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            c = np.where(known[at] == own, n[at], 0) if len(known) else np.zeros(len(own), np.int64)
            yield [pa.array([number.as_py()]), pa.array([bucket], pa.int32()), pa.array([c.tobytes()], pa.binary())]

    pairs = over_rows(blocks, ["block", "terms"], "bucket int, block long, terms binary", asked).withColumn("n", F.lit(None).cast("binary"))
    both = words.select("bucket", F.lit(None).cast("long").alias("block"), "terms", "n").unionByName(pairs)
    rows = both.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    out = over_rows(rows, ["bucket", "block", "terms", "n"], "block long, bucket int, c binary", answered)
    return out.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("c"))  # of one block: as much as its own terms


# --- classes --------------------------------------------------------------------------------------------------------


class Classes(NamedTuple):
    """The words with classes of their own and the endings with one, both sorted; leaf[i] is where class i lies; a leaf's superclass is its high half."""

    words: np.ndarray
    endings: np.ndarray
    leaf: np.ndarray

    def of(self, terms: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """The classes' leaves."""
        out = np.full(len(terms), _OTHER)
        for own, has, first in ((ending, self.endings, len(self.words)), (terms, self.words, 0)):
            if len(has):
                at = np.minimum(np.searchsorted(has, own), len(has) - 1)
                out = np.where(has[at] == own, first + at, out)
        return self.leaf[out]


class Model(NamedTuple):
    classes: Classes
    #: training tokens, distinct ones, and by leaf
    total: int
    distinct: int
    in_leaf: np.ndarray
    types: np.ndarray
    discount: np.ndarray
    #: logarithms of the classes' shares: superclasses, and classes in each
    outer: np.ndarray
    inner: np.ndarray
    #: weights of both softmaxes
    w1: np.ndarray
    w2: np.ndarray


def _words_of(words: DataFrame, schema: str, each: Callable[..., Iterator[list]]) -> DataFrame:
    arrays = lambda rows: (tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.uint64, np.uint16, np.int64))) for row in rows)
    return over_rows(words, ["terms", "ending", "n"], schema, lambda rows: each(arrays(rows)))


def classes_of(blocks: DataFrame, words: DataFrame) -> Classes:
    """The classes, and their order by halving. What comes to the driver is bounded: FREQUENT words, 65,536 endings and 256 x 256 counts."""

    def frequent(rows: Iterator[tuple]) -> Iterator[list]:
        for terms, _, n in rows:
            own = np.lexsort((terms, -n))[:FREQUENT]
            yield [pa.array(terms[own].view(np.int64)), pa.array(n[own])]

    top = _words_of(words, "term long, n long", frequent).filter(F.col("term") != F.lit(int(END.view(np.int64)))).orderBy(F.desc("n"), "term").limit(FREQUENT - 1)
    own = np.sort(np.array([END.view(np.int64), *(r.term for r in top.collect())], np.int64).view(np.uint64))

    def by_ending(rows: Iterator[tuple]) -> Iterator[list]:
        n = np.zeros(1 << 16, np.int64)
        for terms, ending, counts in rows:
            rest = ~np.isin(terms, own)
            n += np.bincount(ending[rest], counts[rest], 1 << 16).astype(np.int64)
        at = np.flatnonzero(n)
        yield [pa.array(at, pa.int32()), pa.array(n[at])]

    endings = _words_of(words, "ending int, n long", by_ending).groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(_OTHER - FREQUENT)
    first = Classes(own, np.sort(np.array([r.ending for r in endings.collect()], np.uint16)), np.arange(256))

    def pairs(rows: Iterator[tuple]) -> Iterator[list]:
        n = np.zeros(1 << 16, np.int64)
        for row in rows:
            b = read(*row)
            of = first.of(b.terms, b.ending)[b.ids]
            inside = np.ones(len(of), bool)
            inside[np.cumsum(b.size)[:-1]] = False  # a text's first token follows none
            inside[:1] = False
            at = np.flatnonzero(inside & b.trained)
            n += np.bincount(of[at - 1] * 256 + of[at], minlength=1 << 16)
        at = np.flatnonzero(n)
        yield [pa.array(at, pa.int32()), pa.array(n[at])]

    matrix = np.zeros(1 << 16)
    for r in over_rows(blocks, _READ, "pair int, n long", pairs).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        matrix[r.pair] = r.n
    order = halved(np.arange(256), matrix.reshape(256, 256))
    leaf = np.empty(256, np.int64)
    leaf[order] = np.arange(256)
    return first._replace(leaf=leaf)


def halved(own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """An order of classes in which those with like neighbours lie close: halves along the first singular vector, and so on in each."""
    if len(own) == 1:
        return own
    near = np.log1p(matrix[:, own] + matrix[own].T)
    near = near / (near.sum(0) + 1e-9)
    vector = np.linalg.svd(near - near.mean(1, keepdims=True), full_matrices=False)[2][0]
    order = own[np.argsort(np.round(vector, 9), kind="stable")]
    half = len(own) // 2
    return np.concatenate((halved(order[:half], matrix), halved(order[half:], matrix)))


def untrained(blocks: DataFrame, words: DataFrame, size: int = ROWS) -> Model:
    """The model without features: classes, their shares, and the discounted shares of words; size: rows of its weights, a power of 2."""
    classes = classes_of(blocks, words)

    def by_leaf(rows: Iterator[tuple]) -> Iterator[list]:
        sums = np.zeros((4, 256), np.int64)
        for terms, ending, n in rows:
            leaf = classes.of(terms, ending)
            for k, w in enumerate((n, None, n == 1, n == 2)):
                sums[k] += np.bincount(leaf, w, 256).astype(np.int64)
        yield [pa.array(np.arange(256), pa.int32()), *(pa.array(x) for x in sums)]

    sums = np.zeros((4, 256), np.int64)
    rows = _words_of(words, "leaf int, n long, types long, ones long, twos long", by_leaf).groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("n", "types", "ones", "twos")])
    for r in rows.collect():
        sums[:, r.leaf] = r.n, r.types, r.ones, r.twos
    n, types, ones, twos = sums
    discount = np.full(256, ones.sum() / (ones.sum() + 2 * twos.sum()) if ones.sum() else 0.5)
    discount[classes.leaf[: len(classes.words)]] = 0  # such a class has no unknown words
    inner = np.log(n.reshape(16, 16) + 0.5)
    outer = np.log(n.reshape(16, 16).sum(1) + 1.0)
    inner, outer = inner - np.log(np.exp(inner).sum(1, keepdims=True)), outer - np.log(np.exp(outer).sum())
    zero = np.zeros((size, 16), np.float32)
    return Model(classes, int(n.sum()), int(types.sum()), n, types, discount, outer.astype(np.float32), inner.astype(np.float32), zero, zero)


# --- the softmaxes --------------------------------------------------------------------------------------------------


def contexts(b: Block) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For runs of a block's tokens: hashes of every token's context features."""
    word = b.terms[b.ids]
    first = np.cumsum(b.size) - b.size
    place = np.arange(len(word)) - np.repeat(first, b.size)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(word), RUN):
        run = slice(a, min(a + RUN, len(word)))
        before = []
        for k in (1, 2, 3):
            w = np.zeros(run.stop - a, np.uint64)
            lead = max(0, k - a)
            w[lead:] = word[a + lead - k : run.stop - k]
            w[place[run] < k] = 0
            before.append(w)
        one, two, three = before
        yield run, [mix(one + np.uint64(1)), mix(two + np.uint64(2)), mix(three + np.uint64(3)), mix(one * odd + two), mix(three * odd + one + np.uint64(5))]


def rows_of(features: list[np.ndarray], superclass: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each feature's row of weights, for both softmaxes."""
    salt = mix(np.arange(16, dtype=np.uint64) + np.uint64(77))[superclass]
    last = np.uint64(size - 1)
    return [(f & last).astype(np.int64) for f in features], [((f >> np.uint64(20) ^ salt) & last).astype(np.int64) for f in features]


def _softmax(start: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - max z) and z - max z of every token's outcomes."""
    z = start
    for r in rows:
        z += weights.take(r, axis=0)
    z -= z.max(1, keepdims=True)
    return np.exp(z), z


def probabilities(model: Model, leaf: np.ndarray, rows1: list[np.ndarray], rows2: list[np.ndarray]) -> Iterator[tuple]:
    """For runs of tokens: the run, and of both softmaxes exp(z) and z."""
    outer = leaf >> 4
    for a in range(0, len(leaf), TOKENS):
        run = slice(a, a + TOKENS)
        start = np.repeat(model.outer[None, :], len(outer[run]), 0)
        yield run, _softmax(start, model.w1, [r[run] for r in rows1]), _softmax(model.inner.take(outer[run], axis=0), model.w2, [r[run] for r in rows2])


def _drawn(e: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """One outcome of each token, by its probabilities."""
    upto = np.cumsum(e, 1)
    x = random.random(len(e), np.float32) * upto[:, -1]
    return np.minimum((upto < x[:, None]).sum(1), 15)


_SUMS = "chunk int, o1 binary, x1 binary, o2 binary, x2 binary"


def _bins(rows: list[np.ndarray], outcome: np.ndarray, size: int) -> np.ndarray:
    return sum(np.bincount(r * 16 + outcome, minlength=size * 16) for r in rows)


def _sums(blocks: DataFrame, model: Model, first: bool) -> DataFrame:
    """Observed (o) and expected (x) counts of every row and outcome, by task and chunk. In the first update x2 counts superclasses, as the
    expectation of the model without features follows from them, and x1 is left empty."""

    total = len(model.w1)

    def each(rows: Iterator[tuple]) -> Iterator[list]:
        o1, x1, o2, x2 = (np.zeros(total * 16, np.int64) for _ in range(4))
        for number, *row in rows:
            b = read(*row)
            if not b.trained.any():
                continue
            leaf = model.classes.of(b.terms, b.ending)[b.ids]
            random = np.random.default_rng(number.as_py())
            for part, features in contexts(b):
                own = b.trained[part]
                of = leaf[part][own]
                outer, inner = of >> 4, of & 15
                rows1, rows2 = rows_of([f[own] for f in features], outer, total)
                o1 += _bins(rows1, outer, total)
                o2 += _bins(rows2, inner, total)
                if first:
                    x2 += _bins(rows2, outer, total)
                    continue
                d1, d2 = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
                for run, (e1, _), (e2, _) in probabilities(model, of, rows1, rows2):
                    d1[run], d2[run] = _drawn(e1, random), _drawn(e2, random)
                x1 += _bins(rows1, d1, total)
                x2 += _bins(rows2, d2, total)
        size = total * 16 // CHUNKS
        yield [pa.array(range(CHUNKS), pa.int32()), *(pa.array([x[k * size : (k + 1) * size].astype(np.int32).tobytes() for k in range(CHUNKS)], pa.binary()) for x in (o1, x1, o2, x2))]

    return over_rows(blocks, ["block", *_READ], _SUMS, each)


def updated(blocks: DataFrame, model: Model, first: bool = False) -> Model:
    """The model after one update from these blocks' training tokens."""
    outer, inner = np.exp(model.outer), np.exp(model.inner)

    def steps(rows: Iterator[tuple]) -> Iterator[list]:
        sums: dict[int, np.ndarray] = {}
        for chunk, *counts in rows:
            new = np.array([np.frombuffer(c.as_buffer(), np.int32) for c in counts], np.int64)
            sums[chunk.as_py()] = sums[chunk.as_py()] + new if chunk.as_py() in sums else new
        for chunk, (o1, x1, o2, x2) in sums.items():
            o1, x1, o2, x2 = (x.reshape(-1, 16).astype(float) for x in (o1, x1, o2, x2))
            if first:
                x1, x2 = o1.sum(1, keepdims=True) * outer, x2 @ inner
                # smoothed by the expected shares, so that rows without observations do not move
                some = lambda x: FIRST_SMOOTHING * x / np.maximum(x.sum(1, keepdims=True), 1e-9) + 1e-6
                step = [FIRST_STEP * np.log((o + some(x)) / (x + some(x))) for o, x in ((o1, x1), (o2, x2))]
            else:
                step = [STEP * np.log((o + SMOOTHING) / (x + SMOOTHING)) for o, x in ((o1, x1), (o2, x2))]
            yield [pa.array([chunk], pa.int32()), *(pa.array([s.astype(np.float32).tobytes()], pa.binary()) for s in step)]

    rows = over_rows(_sums(blocks, model, first).repartition("chunk"), ["chunk", "o1", "x1", "o2", "x2"], "chunk int, s1 binary, s2 binary", steps)
    w1, w2 = model.w1.copy(), model.w2.copy()
    size = len(w1) // CHUNKS
    for r in rows.collect():  # ROWS x 32 numbers in all
        own = slice(r.chunk * size, (r.chunk + 1) * size)
        w1[own] += np.frombuffer(r.s1, np.float32).reshape(-1, 16)
        w2[own] += np.frombuffer(r.s2, np.float32).reshape(-1, 16)
    return model._replace(w1=w1, w2=w2)


def trained(blocks: DataFrame, model: Model, slices: int = SLICES) -> Model:
    """The model after the first update, from all blocks, and `slices` further ones, in which each block takes part once."""
    n, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(cores, n // TASK_BLOCKS)))
    model = updated(blocks.coalesce(tasks), model, True)
    tasks = max(1, min(tasks, max(cores, tasks // max(1, slices))))
    for k in range(slices):
        model = updated((blocks if slices == 1 else blocks.filter(F.pmod(F.xxhash64("block"), F.lit(slices)) == k)).coalesce(tasks), model)
    return model


def log_within(model: Model, leaf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(word | class) from words' training counts; a class's unknown words share what its known ones were discounted."""
    n = np.maximum(model.in_leaf, 1)[leaf]
    unknown = np.where(model.in_leaf > 0, model.discount * model.types / np.maximum(model.in_leaf, 1), 1.0)[leaf]
    return np.log10(np.where(c > 0, (c - model.discount[leaf]) / n, np.maximum(unknown, 1e-300)))


def scored(blocks: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    base = np.log10(model.total + model.distinct + 1)

    def each(rows: Iterator[tuple]) -> Iterator[list]:
        for ids, parts, *row in rows:
            b = read(*row)
            c = np.concatenate([np.frombuffer(p["c"].as_buffer(), np.int64) for p in parts])
            leaf_of = model.classes.of(b.terms, b.ending)
            leaf = leaf_of[b.ids]
            score = log_within(model, leaf_of, c)[b.ids]
            for part, features in contexts(b):
                of, own = leaf[part], score[part]
                for run, (e1, z1), (e2, z2) in probabilities(model, of, *rows_of(features, of >> 4, len(model.w1))):
                    at = np.arange(len(e1))
                    log = z1[at, of[run] >> 4] - np.log(e1.sum(1)) + z2[at, of[run] & 15] - np.log(e2.sum(1))
                    own[run] += log.astype(float) / np.log(10)
            first = np.cumsum(b.size) - b.size
            total = lambda x: np.add.reduceat(x, first)
            n = len(b.size)
            counted = [pa.array(b.size.astype(np.int64)), pa.array(total((c > 0)[b.ids].astype(np.int64))), pa.array(np.full(n, model.total))]
            yield [ids.values, pa.array(b.held), *counted, pa.array(total(np.log10(c + 1.0)[b.ids]) - b.size * base), pa.array(total(score))]

    both = blocks.join(counts.hint("shuffle_hash"), "block")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return over_rows(both, ["doc_id", "c", *_READ], schema, each)


def language_model(documents: DataFrame, held_out: Column, slices: int = SLICES) -> DataFrame:
    """Every document's base and model score, learnt from those for which held_out is not true."""
    spark, tables = documents.sparkSession, Tables()
    blocks = tables.add(encoded(documents, held_out))
    pairs = blocks.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // RANGE_WORDS))
    words = tables.cut(vocabulary(blocks, ranges), "vocabulary")
    model = trained(blocks, untrained(blocks, words), slices)
    out = tables.cut(scored(blocks, counts_by_block(blocks, words, ranges), model), "lm-scores")
    tables.made.remove(out)
    tables.close()
    return out


def op11_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
