"""Benchmark decontamination by suffix arrays over shards of the training text.

Every shard (a bounded run of document words) gets a suffix array; every suffix of every benchmark item is
binary-searched in it, all of them at once, word by word, suffixes that begin with the same window once. The
search gives the interval of training positions that share the window; from there a match is followed to its
longest verbatim extent. Documents that hold a window of an item are contaminated.

Defined results: null or empty texts have no words and no hits; an item with fewer words than the
window is one window of all its words, an item without words matches nothing; items of equal text
count each under its own item_id, and a null item_id as the empty string; repeated documents each
get their row; empty tables give empty or all-clean results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept, ready, trimmed
from .words import ALNUM, chunks, mix, words

WINDOW = 10
#: characters of benchmark text searched in one pass over the documents; more items take more passes
BLOCK_CHARS = 4 << 20
#: blocks searched in one pass over the texts, before what they found is written
CHAIN = 4
#: occurrences followed at once
PAIRS = 1 << 20
#: words of a shard, beyond one longer document
SHARD_WORDS = 1 << 18
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` ranks at least; ranks are from 0, below 2**31 - 1.

    Prefix doubling: three ranks of 21 bits, or two of 31 where ranks are larger, fill the first key;
    afterwards only suffixes that still tie are ordered again, by the order of what follows them.
    """
    n = len(ranks)
    padded = np.zeros(n + 2, np.int64)
    padded[:n] = ranks + 1
    if padded.max() < 1 << 21:
        key, h = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2:], 3
    else:
        key, h = (padded[:n] << 31) | padded[1 : n + 1], 2
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.flatnonzero(fresh)
    group = np.repeat(head, np.diff(np.append(head, n)))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    while h < depth:
        size = np.diff(np.append(head, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        who, own = order[tied], group[tied]
        nxt = rank[np.minimum(who + h, n)]
        again = np.lexsort((nxt, own))
        order[tied] = who[again]
        nxt, own = nxt[again], own[again]
        split = np.ones(len(tied), bool)
        split[1:] = (nxt[1:] != nxt[:-1]) | (own[1:] != own[:-1])
        fresh[tied] = split
        head = np.flatnonzero(fresh)
        group = np.repeat(head, np.diff(np.append(head, n)))
        rank[order] = group
        h *= 2
    return order


class Block(NamedTuple):
    """Benchmark items of bounded size, ready to be searched. Items of one word sequence are one text."""

    words: np.ndarray  #: all texts' word hashes, one after the other
    end: np.ndarray  #: by word, where its text ends
    texts: list[list[str]]  #: item_ids of each text
    start: np.ndarray  #: first word of each distinct window
    need: np.ndarray  #: words of each distinct window
    held_at: np.ndarray  #: where each distinct window's texts begin in `held`, and the end
    held: np.ndarray  #: texts that hold the distinct windows, window by window
    suffix: np.ndarray  #: first word of every suffix that is a window or longer
    window_of: np.ndarray  #: its distinct window

    def texts_of(self, windows: np.ndarray) -> np.ndarray:
        """The texts that hold any of these windows."""
        n = (self.held_at[windows + 1] - self.held_at[windows]).astype(np.int64)
        first = np.repeat(self.held_at[windows] - (np.cumsum(n) - n), n)
        return np.unique(self.held[first + np.arange(len(first))])


def block(items: list[tuple[str, np.ndarray]], window: int) -> Block:
    by: dict[bytes, list[str]] = {}
    for item, h in items:
        by.setdefault(h.tobytes(), []).append(item)
    texts = [np.frombuffer(raw, np.uint64) for raw in by]
    suffix, need, owner, at = [], [], [], 0
    for k, h in enumerate(texts):
        n = min(window, len(h))
        first = np.arange(at, at + len(h) - n + 1)
        suffix.append(first)
        need.append(np.full(len(first), n))
        owner.append(np.full(len(first), k))
        at += len(h)
    if not texts:
        none = np.zeros(0, np.int64)
        return Block(np.zeros(0, np.uint64), none, [], none, none, np.zeros(1, np.int64), none, none, none)
    flat, suffix, need, owner = (np.concatenate(x) for x in (texts, suffix, need, owner))
    name = need.astype(np.uint64)
    for d in range(window):
        name = np.where(need > d, mix(name * np.uint64(0x9E3779B97F4A7C15) + flat[np.minimum(suffix + d, len(flat) - 1)]), name)
    _, first, window_of = np.unique(name, return_index=True, return_inverse=True)
    pair = np.unique(window_of.astype(np.int64) * len(texts) + owner)
    held_at = np.searchsorted(pair // len(texts), np.arange(len(first) + 1))
    end = np.repeat(np.cumsum([len(h) for h in texts]), [len(h) for h in texts])
    ids = [sorted(ids) for ids in by.values()]
    # a block goes to every worker: 40 bytes a word at most, as a block has fewer than 2**31 words
    flat32 = [x.astype(np.int32) for x in (end, suffix[first], need[first], held_at, pair % len(texts), suffix, window_of)]
    return Block(flat, flat32[0], ids, *flat32[1:])


def _bound(column: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """By binary search, where in each interval of the array the words `depth` further reach `word` (or pass it)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        middle = (lo[open_] + hi[open_]) // 2
        seen = column[np.minimum(order[middle] + depth, len(column) - 1)]
        below = seen <= word[open_] if right else seen < word[open_]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]


def _intervals(ranks: np.ndarray, order: np.ndarray, edges: np.ndarray, test: np.ndarray, items: Block) -> tuple[np.ndarray, np.ndarray]:
    """The interval of the array that begins with each distinct window; empty where there is none."""
    unknown = np.concatenate(([0], np.cumsum(test < 0)))
    lo, hi = np.zeros(len(items.start), np.int64), np.zeros(len(items.start), np.int64)
    live = np.flatnonzero(unknown[items.start + items.need] == unknown[items.start])
    lo[live], hi[live] = edges[test[items.start[live]]], edges[test[items.start[live]] + 1]
    padded = np.append(ranks, -1)  # what ends sorts first
    for d in range(1, int(items.need.max(initial=1))):
        live = live[hi[live] > lo[live]]
        go = live[items.need[live] > d]
        if not len(go):
            break
        word = test[items.start[go] + d]
        first = _bound(padded, order, lo[go], hi[go], word, d, False)
        lo[go], hi[go] = first, _bound(padded, order, first, hi[go], word, d, True)
    return lo, hi


def _flat(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(interval, index) of all places in the intervals, at most about PAIRS at once."""
    n = hi - lo
    upto = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(a, b), n[a:b])
        yield own, np.arange(len(own)) - np.repeat(upto[a:b] - n[a:b] - (upto[a - 1] if a else 0), n[a:b]) + lo[own]
        a = b


class Hits(NamedTuple):
    """What a shard holds of a block."""

    windows: np.ndarray  #: document * number of distinct windows + window, ascending
    covered: np.ndarray  #: by word, whether any occurrence covers it
    spans: np.ndarray  #: rows of (first word, words, document) of the longest matches; empty unless asked for


def search(joined: np.ndarray, starts: np.ndarray, items: Block, detail: bool) -> Hits:
    """All windows of the block in one shard; starts has the first word of each of its documents."""
    vocabulary, ranks = np.unique(joined, return_inverse=True)
    order = suffix_array(ranks, int(items.need.max()))
    edges = np.searchsorted(ranks[order], np.arange(len(vocabulary) + 1))
    slot = np.minimum(np.searchsorted(vocabulary, items.words), len(vocabulary) - 1)
    test = np.where(vocabulary[slot] == items.words, slot, -1)
    lo, hi = _intervals(ranks, order, edges, test, items)
    n, found, begins = len(joined), [], {}
    at = np.flatnonzero(hi > lo)
    for own, place in _flat(lo[at], hi[at]):
        w, p = at[own], order[place]
        found.append(np.unique((np.searchsorted(starts, p, side="right") - 1) * len(items.start) + w))
        for k in np.unique(items.need[w]):
            begins.setdefault(int(k), np.zeros(n + 1, np.int64))[p[items.need[w] == k] + 1] = 1
    covered = np.zeros(n, bool)
    for k, mark in begins.items():
        upto = np.cumsum(mark)
        covered |= upto[1:] > upto[np.maximum(np.arange(n) + 1 - k, 0)]
    spans = _longest(ranks, order, lo, hi, test, starts, items) if detail and len(at) else np.zeros((0, 3), np.int64)
    return Hits(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), covered, spans)


def _longest(ranks: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, test: np.ndarray, starts: np.ndarray, items: Block) -> np.ndarray:
    """Every occurrence of a suffix that no longer match of the same text holds, followed word by word to its end."""
    out = []
    live = np.flatnonzero(hi[items.window_of] > lo[items.window_of])
    begin = np.concatenate(([True], items.end[1:] != items.end[:-1]))  # first words of texts
    for own, place in _flat(lo[items.window_of[live]], hi[items.window_of[live]]):
        i, p = items.suffix[live[own]], order[place]
        inner = (p > 0) & ~begin[i] & (ranks[p - 1] == test[i - 1])
        i, p = i[~inner], p[~inner]
        m = items.need[items.window_of[live[own[~inner]]]].copy()
        open_ = np.arange(len(i))
        while len(open_):
            a, b = i[open_] + m[open_], p[open_] + m[open_]
            go = (a < items.end[i[open_]]) & (b < len(ranks))
            go[go] = test[a[go]] == ranks[b[go]]
            open_ = open_[go]
            m[open_] += 1
        d = np.searchsorted(starts, p, side="right") - 1
        out.append(np.unique(np.column_stack((p - starts[d], m, d)), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _item_words(text: str | None) -> np.ndarray:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    raw = " ".join(_WORD.findall(low)).encode("utf-8", "surrogatepass")
    return words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)[0]


def _shards(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets by document) of shards of about SHARD_WORDS words."""
    row0, held, offs, total = 0, [], [np.zeros(1, np.int64)], 0
    for row, data, off in chunks(column):
        h, at = words(data, off, ALNUM)
        if not held:
            row0 = row
        held.append(h)
        offs.append(at[1:] + total)
        total += len(h)
        if total >= SHARD_WORDS:
            yield row0, np.concatenate(held), np.concatenate(offs)
            held, offs, total = [], [np.zeros(1, np.int64)], 0
    if held:
        yield row0, np.concatenate(held), np.concatenate(offs)


def _parted(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's words with a word of its own after each document, so that no match crosses documents."""
    n = len(off) - 1
    out = np.empty(len(h) + n, np.uint64)
    ends = off[1:] + np.arange(n)
    gaps = np.zeros(len(out), bool)
    gaps[ends] = True
    out[gaps] = mix(np.arange(n, dtype=np.uint64) + np.uint64(0xA5A5000000000000))
    out[~gaps] = h
    return out, np.concatenate(([0], ends + 1))


def _blocks(benchmark: DataFrame, block_chars: int, window: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks of bounded size, and the blocks, of which the driver holds few at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))

    def made() -> Iterator[Block]:
        for k in range(n):
            part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            found = [(r.item_id, _item_words(r.text)) for r in part.collect()]
            yield block([(i, h) for i, h in found if len(h)], window)

    return n, made()


_STATE = "n_words long, n_hit long, items array<string>, hit_words array<long>, longest long, spans array<struct<start:long,words:long>>"


def _searched(text: Column, items: Block, detail: bool) -> Column:
    """What each text holds of the block; hit_words, longest and spans are left out (null) unless asked for."""

    @trimmed
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n = len(batch)
            n_words, n_hit, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            ids: list = [[]] * n
            words_hit: list = [[] if detail else None] * n
            spans: list = [[] if detail else None] * n
            for row0, h, off in _shards(batch):
                n_words[row0 : row0 + len(off) - 1] = np.diff(off)
                if not len(items.start) or not len(h):
                    continue
                joined, starts = _parted(h, off)
                hits = search(joined, starts, items, detail)
                doc, window = hits.windows // len(items.start), hits.windows % len(items.start)
                upto = np.concatenate(([0], np.cumsum(hits.covered)))
                for d in np.unique(doc):
                    own = window[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
                    ids[row0 + d] = sorted(i for t in items.texts_of(own) for i in items.texts[t])
                    a, b = starts[d], starts[d + 1]
                    n_hit[row0 + d] = upto[b] - upto[a]
                    if detail:
                        words_hit[row0 + d] = np.flatnonzero(hits.covered[a:b])
                        mine = hits.spans[hits.spans[:, 2] == d]
                        longest[row0 + d] = mine[:, 1].max(initial=0)
                        spans[row0 + d] = [{"start": x, "words": m} for x, m, _ in mine.tolist()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            arrays = [pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(pa.string())), pa.array(words_hit, pa.list_(pa.int64())), pa.array(longest), pa.array(spans, span)]
            yield pa.StructArray.from_arrays(arrays, names=["n_words", "n_hit", "items", "hit_words", "longest", "spans"])

    return F.arrow_udf(scan, _STATE)(text)


def _joined(found: list[Column]) -> Column:
    """What several blocks found for one text, as one."""
    if len(found) == 1:
        return found[0]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.array(*[x[c] for x in found]))))
    hit = union("hit_words")
    return F.struct(
        found[0]["n_words"].alias("n_words"), F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.array(*[x["items"] for x in found])))).alias("items"),
        hit.alias("hit_words"), F.greatest(*[x["longest"] for x in found]).alias("longest"), union("spans").alias("spans"),
    )


def _told(own: DataFrame, text: Column, benchmark: DataFrame, window: int, block_chars: int, detail: bool) -> DataFrame:
    """The rows of `own` with what they hold of the benchmark as the struct column `told`."""
    n, blocks = _blocks(benchmark, block_chars, window)
    state = own
    for k in range(0, n, CHAIN):
        found = [_searched(text, next(blocks), detail or n > 1) for _ in range(min(CHAIN, n - k))]
        names = [f"told{i}" for i in range(len(found))]
        state = state.select("*", *[f.alias(n) for f, n in zip(found, names)])
        state = state.withColumn("told", _joined([F.col(n) for n in (["told"] if k else []) + names])).drop(*names)
        if k + CHAIN < n:
            state = cut(state, "searched")
    return state


def hits(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_chars: int = BLOCK_CHARS, detail: bool = True) -> DataFrame:
    """One row per document: `keep` columns, n_words, n_hit, n_items, items (sorted ids) and, unless detail is False, hit_words,
    longest (words of the longest verbatim match) and spans (word start and length of each match that no other holds).

    The benchmark is a stated query set: it is searched in blocks of at most block_chars characters, each
    against all documents. A pass is narrow (no shuffle at all): only texts are sent to Python, and only
    what was found comes back. After CHAIN blocks what they found is written.
    """
    ready(documents.sparkSession)
    own = kept(documents.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string")))
    found = _told(own.table, F.col(own.table.columns[-1]), benchmark, window, block_chars, detail)
    told = ["n_words", "n_hit", "n_items", "items", *["hit_words", "longest", "spans"] * detail]
    columns = [F.size("told.items").cast("long") if c == "n_items" else F.col(f"told.{c}") for c in told]
    return found.select(*own.table.columns[:-1], *columns).toDF(*keep, *told)


def digest(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return hits(documents, benchmark, ["doc_id"], window, detail=False).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns, whatever those are called."""
    ready(documents.sparkSession)
    own = kept(documents)
    return own.back(_told(own.table, own["text"].cast("string"), benchmark, window, BLOCK_CHARS, False).filter("told.n_hit = 0"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
bk AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bk) x),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks) x),
hits AS MATERIALIZED (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, t)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) x GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
