"""Quality classification by co-training two views of a document.

The content view sees the text: its words, and its layout (length, lines, letters' case, marks, repetition). The metadata view sees the
other columns only: source, language and n_chars. Features of words, layout and metadata each have naive Bayes models of hashed features, whose
shrunken log-odds give a document three numbers for each; a logistic curve for each view, fitted on labelled documents that the
counts have not seen, turns them into a probability. In each round a view counts, besides the labelled
documents, those that the other view is confident about. At last both views' calibrated log-odds are
combined by a further fitted curve, and every document is scored.

A document's feature numbers are kept as sorted differences of one to three bytes, so that they are a small part of its text;
only they meet the labels, by one sort-merge join. A round is one narrow pass over them: it labels by the last round's models
and counts both views. Feature counts are taken over all labelled and pseudo-labelled documents but those held back; a model
is two tables of at most FEATURES numbers for each part of a view. The curves are fitted on a bounded sample, and only it is held back: of a third
of the labelled documents, the CALIBRATION_ROWS with the smallest hash of doc_id, each once.

Two targets run side by side: `quality` and `toxic`; a document is kept if it is good and not toxic.

Defined results: a null text is the empty one, null metadata is a value of its own; several labels of one
doc_id count as their mean, half or more as 1; labels of unknown documents and null labels are ignored; without
labels of both classes a target has score 0.5 everywhere, and then decides nothing; repeated rows are all counted and
scored; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, ready, trimmed
from .words import ALNUM, chunks, words

FEATURES = 1 << 18
ROUNDS = 2
CALIBRATION_ROWS = 20_000
CONFIDENT = 0.98
#: pseudo-count with which a feature's log-odds shrink towards none
SHRINK = 8.0
TARGETS = ("quality", "toxic")
#: each view's parts, whose features are counted apart
VIEWS = {"content": ("words", "layout"), "meta": ("meta",)}
PARTS = tuple(p for parts in VIEWS.values() for p in parts)


def packed(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of ascending numbers below 2**21 as differences in bytes of seven bits; at has each row's first, and the end."""
    delta = flat.astype(np.int64)
    delta[1:] -= flat[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    delta[first] = flat[first]
    n = 1 + (delta >= 1 << 7) + (delta >= 1 << 14)
    end = np.cumsum(n)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(3):
        has = n > k
        out[end[has] - n[has] + k] = (delta[has] >> 7 * k & 127) | ((n[has] > k + 1) << 7)
    off = np.concatenate(([0], end))[at].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(off), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and each row's first, and the end."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    end = np.flatnonzero(data < 128)
    start = np.concatenate(([0], end + 1))[:-1]
    delta = np.zeros(len(end), np.int64)
    for k in range(3):
        has = start + k <= end
        delta[has] |= (data[start[has] + k] & 127).astype(np.int64) << 7 * k
    at = np.searchsorted(end, off - off[0])
    total = np.concatenate(([0], np.cumsum(delta)))
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at


def _step(x: float, *bounds: float) -> int:
    return int(np.searchsorted(bounds, x))


def _layout(raw: np.ndarray, h: np.ndarray) -> list[tuple[str, int]]:
    """Named coarse measures of a text's bytes and words."""
    n = max(1, len(raw))
    upper = float(((raw >= 65) & (raw <= 90)).sum()) / n
    lower = float(((raw >= 97) & (raw <= 122)).sum()) / n
    marks = float(((raw > 32) & (raw < 48)).sum() + ((raw > 57) & (raw < 65)).sum() + ((raw > 90) & (raw < 97)).sum() + ((raw > 122) & (raw < 127)).sum()) / n
    digits = float(((raw >= 48) & (raw <= 57)).sum()) / n
    lines = int((raw == 10).sum()) + 1
    distinct = len(np.unique(h)) / max(1, len(h))
    expected = min(1.0, 3.0 * max(1, len(h)) ** -0.25)
    return [
        ("size", _step(len(raw), 40, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600)), ("upper", _step(upper, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5)),
        ("lower", _step(lower, 0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.8)), ("marks", _step(marks, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.4)),
        ("digits", _step(digits, 0.001, 0.01, 0.03, 0.08, 0.2)), ("line", _step(len(raw) / lines, 10, 20, 40, 80, 160, 320, 640, 1280)),
        ("distinct", _step(distinct / expected, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)), ("word", _step(n / max(1, len(h)), 3, 4, 5, 6, 7, 8, 10, 14)),
    ]


@functools.lru_cache(maxsize=1 << 16)
def _hashed(name: str, value: object) -> int:
    import zlib

    return zlib.crc32(f"{name}={value}".encode("utf-8", "replace")) % FEATURES


def _rows(row: np.ndarray, feature: np.ndarray, n: int) -> pa.Array:
    """The distinct feature numbers of n rows, packed."""
    both = np.unique(row.astype(np.int64) * FEATURES + feature)
    return packed(both % FEATURES, np.searchsorted(both, np.arange(n + 1) * FEATURES))


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the packed feature numbers of every document's parts."""
    kind = documents.select("doc_id").schema.fields[0].dataType.simpleString()
    given = documents.select("doc_id", *[F.col(c).cast(t).alias(c) for c, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "double"))])

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang, size = (batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
            for row, data, off in chunks(batch.column(1)):
                h, at = words(data, off, ALNUM)
                n = len(off) - 1
                layout, meta = [], []
                for i in range(n):
                    layout += [_hashed(k, v) for k, v in _layout(data[off[i] : off[i + 1]], h[at[i] : at[i + 1]])]
                    long = None if size[row + i] is None else int(2 * np.log2(max(0.0, size[row + i]) + 1))
                    meta += [_hashed(k, v) for k, v in (("source", source[row + i]), ("lang", lang[row + i]), ("n_chars", long))]
                several = [_rows(np.repeat(np.arange(n), len(x) // n), np.array(x), n) for x in (layout, meta)]
                arrays = [batch.column(0).slice(row, n), _rows(np.repeat(np.arange(n), np.diff(at)), (h >> np.uint64(46)).astype(np.int64), n), *several]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *PARTS])

    return given.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{p} binary" for p in PARTS))


class Curve(NamedTuple):
    """A logistic curve over standardised inputs."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[1:] + self.weights[0], -15, 15)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Curve:
    """Ridge logistic regression by Newton steps; flat at even odds if a class is missing."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(x.shape[1] + 1)
    if 0 < y.sum() < len(y):
        a = np.column_stack((np.ones(len(x)), (x - mean) / scale))
        penalty = ridge * np.eye(len(w))
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
    return Curve(w, mean, scale)


class Model(NamedTuple):
    """One view's classifier for one target: the log-odds of its parts' features, and the curve over what they tell."""

    log_odds: tuple[np.ndarray, ...]
    curve: Curve | None

    def told(self, listed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.column_stack([told(lo, *x) for lo, x in zip(self.log_odds, listed)])


def told(log_odds: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's features: the scaled sum of log-odds and the means of the three highest and lowest."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    lo = log_odds[flat]
    lo = lo[np.lexsort((lo, row))]
    total = np.concatenate(([0.0], np.cumsum(lo)))
    three = np.minimum(n, 3)
    of = lambda a, b: total[b] - total[a]
    some = np.maximum(n, 1)
    return np.column_stack((of(at[:-1], at[1:]) / np.sqrt(some), of(at[1:] - three, at[1:]) / np.maximum(three, 1), of(at[:-1], at[:-1] + three) / np.maximum(three, 1)))


def _listed(batch: pa.RecordBatch) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Each view's features, part by part."""
    return {v: [unpacked(batch.column(p)) for p in parts] for v, parts in VIEWS.items()}


def _with_told(table: DataFrame, models: dict[tuple[str, str], Model], keep: list[str]) -> DataFrame:
    """`keep` columns and, for each view and target, the numbers told (no curve yet) or the calibrated log-odds."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields]
    names = [f"{v}_{t}" for v, t in models]
    raw = any(m.curve is None for m in models.values())
    fields += [f"{n} {'array<double>' if raw else 'double'}" for n in names]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = _listed(batch)
            arrays = [batch.column(c) for c in keep]
            for (v, _), m in models.items():
                x = m.told(listed[v])
                arrays.append(pa.array(list(x), pa.list_(pa.float64())) if m.curve is None else pa.array(m.curve.logit(x)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return table.select(*dict.fromkeys([*PARTS, *keep])).mapInArrow(scan, ", ".join(fields))


#: the place where the number of labelled rows is counted, behind all features
_ALL = FEATURES


def _counted(table: DataFrame, models: dict[tuple[str, str], Model]) -> dict[tuple[str, str], tuple[np.ndarray, ...]]:
    """Shrunken log-odds by view and target, from the rows with fold 0, in one pass.

    A row's label counts for both views; without one, a view counts what the other one is confident about. A
    task sends on at most FEATURES rows for each part.
    """
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(p, t, y): np.zeros(FEATURES + 1, np.int64) for p in PARTS for t in TARGETS for y in (0, 1)}
        for batch in batches:
            listed = _listed(batch)
            for v, other in zip(VIEWS, reversed(VIEWS)):
                for t in TARGETS:
                    y = batch.column(t).to_numpy()
                    if models:
                        z = models[other, t].curve.logit(models[other, t].told(listed[other]))
                        y = np.where(y >= 0, y, np.where(z > sure, 1, np.where(z < -sure, 0, -1)))
                    for p, (flat, at) in zip(VIEWS[v], listed[v]):
                        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                        for k in (0, 1):
                            sums[p, t, k] += np.bincount(flat[y[row] == k], minlength=FEATURES + 1)
                            sums[p, t, k][_ALL] += int((y == k).sum())
        for i, p in enumerate(PARTS):
            columns = [sums[p, t, k] for t in TARGETS for k in (0, 1)]
            at = np.flatnonzero(sum(columns))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), *(pa.array(c[at]) for c in columns)], names=["p", "f", *marks])

    marks = [f"{t}{k}" for t in TARGETS for k in (0, 1)]
    rows = table.filter("fold = 0").select(*PARTS, *TARGETS).mapInArrow(scan, ", ".join(["p int", "f long", *[f"{m} long" for m in marks]]))
    found = rows.groupBy("p", "f").agg(*[F.sum(m).alias(m) for m in marks]).toArrow()
    odds = {}
    for i, p in enumerate(PARTS):
        own = found.filter(pa.compute.equal(found["p"], i))
        for t in TARGETS:
            zero, one = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
            zero[own["f"].to_numpy()], one[own["f"].to_numpy()] = own[f"{t}0"].to_numpy(), own[f"{t}1"].to_numpy()
            odds[p, t] = shrunken(zero[:_ALL], one[:_ALL], zero[_ALL], one[_ALL])
    return {(v, t): tuple(odds[p, t] for p in parts) for v, parts in VIEWS.items() for t in TARGETS}


def shrunken(zero: np.ndarray, one: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """The features' log-odds over those of all rows, from their counts by class; all 0 if a class is missing."""
    if not n0 or not n1:
        return np.zeros(len(zero))
    share = n1 / (n0 + n1)
    p = (one + SHRINK * share) / (one + zero + SHRINK)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def trained(table: DataFrame, rounds: int = ROUNDS) -> tuple[dict[tuple[str, str], Model], dict[str, Curve]]:
    """Both views' models and the combining curves. table: features, fold (0 to count, 1 to calibrate if chosen) and labels (1, 0, -1)."""
    held = table.filter("fold = 1").filter(" or ".join(f"{t} >= 0" for t in TARGETS))
    chosen = held.select("doc_id").distinct().select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(CALIBRATION_ROWS)
    edge = chosen.agg(F.max("h")).first()[0]
    # only the rows chosen are kept back; all other labelled ones are counted
    table = table.withColumn("fold", F.when((F.col("fold") == 1) & (F.xxhash64("doc_id") <= F.lit(edge).cast("long")), 1).otherwise(0))
    # a document that is there many times is held once
    held = cut(table.filter("fold = 1").select("doc_id", *PARTS, *TARGETS).dropDuplicates(["doc_id"]).drop("doc_id"), "calibration")
    models: dict[tuple[str, str], Model] = {}
    for _ in range(rounds + 1):
        fresh = {key: Model(lo, None) for key, lo in _counted(table, models).items()}
        sample = _with_told(held, fresh, list(TARGETS)).toArrow()
        for (v, t), m in fresh.items():
            y = sample[t].to_numpy()
            x = np.array(sample[f"{v}_{t}"].to_pylist()).reshape(-1, 3 * len(VIEWS[v]))[y >= 0]
            models[v, t] = Model(m.log_odds, fit_curve(x, y[y >= 0].astype(float)))
    last = _with_told(held, models, list(TARGETS)).toArrow()
    combined = {}
    for t in TARGETS:
        y = last[t].to_numpy()
        x = np.column_stack([last[f"{v}_{t}"].to_numpy() for v in VIEWS])[y >= 0]
        combined[t] = fit_curve(x, y[y >= 0].astype(float))
    drop(held)
    return models, combined


def scored(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, each view's and the combined score of both targets, the decisions and `keep` of every document."""
    ready(documents.sparkSession)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*[F.avg(t).alias(t) for t in TARGETS])
    known = known.select("_id", *[F.when(F.col(t) >= 0.5, 1).when(F.col(t) < 0.5, 0).otherwise(-1).alias(t) for t in TARGETS])
    # one plan at every size: labels may be as many as documents, so neither side is ever broadcast
    table = features(documents).join(known.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id").fillna(-1, list(TARGETS))
    # one of three labelled documents may be kept back to calibrate; all others are counted
    fold = F.when((F.greatest(*TARGETS) >= 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0), 1).otherwise(0)
    table = cut(table.withColumn("fold", fold), "features")
    models, combined = trained(table, rounds)
    out = _with_told(table, models, ["doc_id"])
    for t in TARGETS:
        c = combined[t]
        z = F.lit(float(c.weights[0]))
        for i, v in enumerate(VIEWS):
            z = z + (F.col(f"{v}_{t}") - float(c.mean[i])) / float(c.scale[i]) * float(c.weights[i + 1])
        out = out.withColumn(f"{t}_score", 1 / (1 + F.exp(-z)))
    views = [(1 / (1 + F.exp(-F.col(f"{v}_{t}")))).alias(f"{v}_{t}") for t in TARGETS for v in VIEWS]
    out = out.select("doc_id", *[f"{t}_score" for t in TARGETS], *views)
    out = out.withColumns({"quality": (F.col("quality_score") >= 0.5).cast("int"), "toxic": (F.col("toxic_score") > 0.5).cast("int")})
    return out.withColumn("keep", (F.col("quality") == 1) & (F.col("toxic") == 0))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
