"""Ranked lexical search by hierarchical max trees over document ranges.

The index cuts the documents, in the order they are read, into ranges of at most RANGE_ROWS documents. A range is one row: its
documents, its terms with their postings, and the root of each term's tree, the highest part of any document's score that
the term can give there. Below a root, a term has one node for FAN documents, and below that its documents, made from the postings when a range is opened.

Queries are searched in blocks of bounded size. The bound of a node is the weighted sum of the query terms' maxima. The search goes
best first on every level: each query opens the FIRST ranges of highest bounds, which gives it a threshold, the score of its k-th best document so
far; then the ranges whose bound reaches the threshold are opened, the rest never. In a range, nodes are opened from the highest bound
down, until a bound is below the threshold; those equal to it are opened, as a tie may be won by a smaller doc_id. The result is exact.

Scores are integers: a term's weight w is floor(1000 ln((2N + 2) / (2df + 1))), its part of a document's score w ((10^9 tf) div (1000 tf + 8m)) with
m = 10 + ((90 n N) div L), N documents with a term, L terms in all, n in this document. Terms are told by 64-bit hashes: for 10^9
distinct terms in the corpus and 10^4 in the queries, any two of them meet with a probability below 10^-6.

Defined results: null and empty texts, and texts without terms, are found by nothing; a query without terms, or whose terms are in no document, gives no rows;
repeated documents are each ranked; equal scores are ordered by doc_id, null last; repeated item_ids are each searched; empty
tables give no rows; further columns are ignored. The index takes every document and every word of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, cut, over_rows, ready, trimmed
from .words import ALNUM, chunks, words

#: documents of a range at most, and terms at which it ends before, beyond one longer document
RANGE_ROWS, RANGE_TERMS = 1024, 1 << 20
#: documents under a node
FAN = 32
#: ranges opened first for each query
FIRST = 3
#: characters of query texts searched in one pass over the index; more take more passes
BLOCK_CHARS = 1 << 20
#: terms of an opened range whose trees are held at once
HELD_TREES = 4096


class Index(NamedTuple):
    table: DataFrame
    documents: int
    terms: int


def index(documents: DataFrame) -> Index:
    """The ranges of all documents, written as a table: one count of documents and terms, then one narrow pass."""
    spark = documents.sparkSession
    ready(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    @trimmed
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for _, data, off in chunks(batch.column(0)):
                n = np.diff(words(data, off, ALNUM)[1])
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["d", "t"])

    of = given.select("text").mapInArrow(counted, "d long, t long").agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    total = (int(of[0]), int(of[1]))

    @trimmed
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for row, data, off in chunks(batch.column(1)):
                h, at = words(data, off, ALNUM)
                for i in range(len(off) - 1):
                    n = int(at[i + 1] - at[i])
                    if not n:
                        continue
                    ids.append(batch.column(0)[row + i])
                    held.append((*np.unique(h[at[i] : at[i + 1]], return_counts=True), n))
                    size += n
                    if len(ids) == RANGE_ROWS or size >= RANGE_TERMS:
                        yield _range((task << 32) + made, ids, held, total)
                        made, ids, held, size = made + 1, [], [], 0
        if ids:
            yield _range((task << 32) + made, ids, held, total)

    schema = f"range long, doc_id array<{kind}>, m binary, terms binary, df binary, tops binary, ordinals binary, tf binary"
    return Index(cut(given.mapInArrow(ranges, schema), "search-index"), *total)


def _range(number: int, ids: list, held: list[tuple], total: tuple[int, int]) -> pa.RecordBatch:
    """One row of the index. m, df, tops and tf are int64, int32, int64 and int32, terms are ascending; postings are ordered by term and document."""
    m = np.array([10 + 90 * n * total[0] // total[1] for _, _, n in held], np.int64)
    h, tf = np.concatenate([t for t, _, _ in held]), np.concatenate([c for _, c, _ in held])
    ordinal = np.repeat(np.arange(len(held)), [len(t) for t, _, _ in held])
    order = np.argsort(h, kind="stable")
    h, tf, ordinal = h[order], tf[order], ordinal[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    tops = np.maximum.reduceat(part(tf, m[ordinal]), first)
    binary = [m, h[first], np.diff(np.append(first, len(h))).astype(np.int32), tops, ordinal.astype(np.uint16), tf.astype(np.int32)]
    doc_ids = pa.array([i.as_py() for i in ids], ids[0].type)
    arrays = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), doc_ids), *(pa.array([b.tobytes()], pa.binary()) for b in binary)]
    return pa.RecordBatch.from_arrays(arrays, names=["range", "doc_id", "m", "terms", "df", "tops", "ordinals", "tf"])


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 gives to a document's score."""
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


class Block(NamedTuple):
    """Queries: their ids, the distinct terms of all, and for each query where its terms are among these."""

    ids: list
    terms: np.ndarray
    at: np.ndarray
    term: np.ndarray


def block(found: list[tuple]) -> Block:
    """Of (id, text) rows, those with a term."""
    sets = []
    for _, data, off in chunks(pa.array([t for _, t in found], pa.string())):
        h, at = words(data, off, ALNUM)
        sets += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    own = [(i, s) for (i, _), s in zip(found, sets) if len(s)]
    flat = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.uint64)
    terms, term = np.unique(flat, return_inverse=True)
    return Block([i for i, _ in own], terms, np.concatenate(([0], np.cumsum([len(s) for _, s in own]))).astype(np.int64), term)


def blocks(items: DataFrame, block_chars: int) -> Iterator[Block]:
    """The queries in blocks of bounded size, of which the driver holds one at a time."""
    given = items.select("item_id", F.col("text").cast("string").alias("text"))
    total = given.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for k in range(n):
        rows = given if n == 1 else given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield block([tuple(r) for r in rows.collect()])


def _found(terms: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms a range has, and where."""
    own = np.frombuffer(terms, np.uint64)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    has = np.flatnonzero(own[at] == wanted)
    return has, at[has]


def _weights(found: Index, queries: Block) -> np.ndarray:
    """The weight of each term of the block, 0 for those that no document has."""

    def each(rows: Iterator[tuple]) -> Iterator[list]:
        df = np.zeros(len(queries.terms), np.int64)
        for terms, counts in rows:
            has, at = _found(terms.as_buffer(), queries.terms)
            df[has] += np.frombuffer(counts.as_buffer(), np.int32)[at]
        at = np.flatnonzero(df)
        yield [pa.array(at), pa.array(df[at])]

    sums = over_rows(found.table, ["terms", "df"], "term long, df long", each).groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(queries.terms), np.int64)
    for r in sums.collect():  # at most as many as the block has terms
        out[r.term] = math.floor(1000 * math.log((2 * found.documents + 2) / (2 * r.df + 1)))
    return out


def bounds(terms: bytes, tops: bytes, queries: Block, weight: np.ndarray) -> np.ndarray:
    """The highest score that each query may find in a range."""
    has, at = _found(terms, queries.terms)
    top = np.zeros(len(queries.terms), np.int64)
    top[has] = np.frombuffer(tops, np.int64)[at] * weight[has]
    return np.add.reduceat(top[queries.term], queries.at[:-1])


def _best_ranges(found: Index, queries: Block, weight: np.ndarray, first: int) -> list[tuple[int, int]]:
    """(query, range) for the ranges of highest bounds, `first` of them for each query of the block; a task sends as many on at most."""

    def each(rows: Iterator[tuple]) -> Iterator[list]:
        best_bound, best = np.zeros((first, len(queries.ids)), np.int64), np.full((first, len(queries.ids)), -1, np.int64)
        for number, terms, tops in rows:
            b = bounds(terms.as_buffer(), tops.as_buffer(), queries, weight)
            n = np.full(len(b), number.as_py())
            for j in range(first):  # an insertion into the sorted columns
                more = b > best_bound[j]
                best_bound[j], b = np.where(more, b, best_bound[j]), np.where(more, best_bound[j], b)
                best[j], n = np.where(more, n, best[j]), np.where(more, best[j], n)
        j, q = np.nonzero(best_bound)
        yield [pa.array(q), pa.array(best[j, q]), pa.array(best_bound[j, q])]

    rows = over_rows(found.table, ["range", "terms", "tops"], "query long, range long, bound long", each)
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "range")
    chosen = rows.withColumn("n", F.row_number().over(highest)).filter(F.col("n") <= first)
    return [(r.query, r.range) for r in chosen.select("query", "range").collect()]


class Opened:
    """A range whose trees are made as queries ask for them."""

    def __init__(self, m: bytes, terms: bytes, df: bytes, ordinals: bytes, tf: bytes, queries: Block, weight: np.ndarray) -> None:
        self.m, self.weight = np.frombuffer(m, np.int64), weight
        self.ordinals, self.tf = np.frombuffer(ordinals, np.uint16), np.frombuffer(tf, np.int32)
        end = np.cumsum(np.frombuffer(df, np.int32))
        has, at = _found(terms, queries.terms)
        self.place = {int(t): (int(end[a - 1]) if a else 0, int(end[a])) for t, a in zip(has, at)}
        self.nodes = -(-len(self.m) // FAN)
        self.trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def tree(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The weighted maxima of all nodes, and below them the documents'."""
        if term not in self.trees:
            if len(self.trees) >= HELD_TREES:
                self.trees.clear()
            a, b = self.place[term]
            own = self.ordinals[a:b]
            leaves = np.zeros(self.nodes * FAN, np.int64)
            leaves[own] = part(self.tf[a:b], self.m[own]) * self.weight[term]
            self.trees[term] = (leaves.reshape(-1, FAN).max(1), leaves)
        return self.trees[term]

    def search(self, terms: np.ndarray, k: int, best: list[tuple], doc_ids: pa.Array) -> None:
        """Bring `best`, the k best so far as (-score, null, doc_id), up to date with this range's documents."""
        trees = [self.tree(int(t)) for t in terms if int(t) in self.place]
        if not trees:
            return
        over = sum(t[0] for t in trees)
        leaves = np.array([t[1] for t in trees])
        for node in np.argsort(-over, kind="stable"):
            least = max(1, -best[-1][0]) if len(best) == k else 1
            if over[node] < least:
                break
            score = leaves[:, node * FAN : (node + 1) * FAN].sum(0)
            hit = np.flatnonzero(score >= least)
            if len(hit):
                own = [doc_ids[int(node * FAN + i)].as_py() for i in hit]
                best += [(-int(score[i]), d is None, d) for i, d in zip(hit, own)]
                best.sort(key=lambda x: x[:2] if x[1] else x)
                del best[k:]


def _searched(found: Index, queries: Block, weight: np.ndarray, k: int, least: np.ndarray, chosen: list[tuple[int, int]], only: bool) -> DataFrame:
    """query, doc_id and score of the best documents that each task finds: in the chosen ranges only, or in all others, whose
    bound reaches the query's score so far."""
    kind = found.table.schema["doc_id"].dataType.elementType.simpleString()
    of: dict[int, list[int]] = {}
    for q, r in chosen:
        of.setdefault(r, []).append(q)

    def each(rows: Iterator[tuple]) -> Iterator[list]:
        best: dict[int, list[tuple]] = {}
        doc_type = None
        for number, ids, m, terms, df, tops, ordinals, tf in rows:
            doc_type = ids.type.value_type
            b = bounds(terms.as_buffer(), tops.as_buffer(), queries, weight)
            floor = np.maximum(least, 1)
            mine = of.get(number.as_py(), [])
            if only:
                asked = np.array(sorted(mine), np.int64)
            else:
                b[mine] = 0
                asked = np.flatnonzero(b >= floor)
            opened = None
            for q in asked[np.argsort(-b[asked], kind="stable")]:
                own = best.setdefault(int(q), [])
                if len(own) == k and b[q] < -own[-1][0]:
                    continue
                if opened is None:
                    opened = Opened(m.as_buffer(), terms.as_buffer(), df.as_buffer(), ordinals.as_buffer(), tf.as_buffer(), queries, weight)
                opened.search(queries.term[queries.at[q] : queries.at[q + 1]], k, own, ids.values)
        flat = [(q, x[2], -x[0]) for q, own in best.items() for x in own if -x[0] >= least[q]]
        if flat:
            q, d, s = zip(*flat)
            yield [pa.array(q, pa.int64()), pa.array(d, doc_type), pa.array(s, pa.int64())]

    table = found.table
    if only:
        ranges = table.sparkSession.createDataFrame([(r,) for r in of], "range long")  # FIRST for each query of the block at most
        table = table.join(F.broadcast(ranges), "range", "left_semi")
    return over_rows(table, ["range", "doc_id", "m", "terms", "df", "tops", "ordinals", "tf"], f"query long, doc_id {kind}, score long", each)


def _ranked(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(found: Index, items: DataFrame, k: int = 10, first: int = FIRST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text), from the index."""
    spark, tables, out = found.table.sparkSession, Tables(), None
    kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = found.table.schema["doc_id"].dataType.elementType.simpleString()
    for queries in blocks(items, block_chars):
        if not queries.ids:
            continue
        weight = _weights(found, queries)
        none = np.zeros(len(queries.ids), np.int64)
        chosen = _best_ranges(found, queries, weight, first)
        early = tables.cut(_ranked(_searched(found, queries, weight, k, none, chosen, True), "query", k), "search-first")
        least = none.copy()
        for r in early.filter(F.col("rank") == k).collect():  # one row a query
            least[r["query"]] = r["score"]
        later = _searched(found, queries, weight, k, least, chosen, False)
        both = _ranked(early.drop("rank").unionByName(later), "query", k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query long, item_id {kind}")  # the block's queries
        part_ = cut(both.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "search-found")
        out = part_ if out is None else out.unionByName(part_)
    tables.close()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables()
    found = index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tables.add(found.table)
    out = search(found, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    tables.close()
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, s WHERE len(t) > 0),
f AS (SELECT q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, item_id, doc_id, r),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM f WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 10
"""
