"""Interaction of filters: what each removes alone, after others and in every order.

Every document gets a mask of the filters it fails. Filters of one document are column expressions; the duplicate filter needs the
table: documents are range-sorted by the text's fingerprint, the full text and doc_id, and each is compared with the one before it. Ranges are cut by
fingerprint and doc_id, so that a group of copies of any size spreads over several. A document of a range's first fingerprint may have
its smaller copy in a range before; such documents, and for the last fingerprint of every range each text's smallest doc_id, go on with the text's SHA-256,
and one small join settles them. Then documents are light rows: they meet their labels and are summed by part and mask, which
is additive, and at last the masks of a part tell all counts of all orders.

Defined results: a null text is the empty one, a null part the empty string; a null doc_id is neither smaller nor larger than another, so it never fails as a
duplicate nor makes others fail; repeated rows with one doc_id are no duplicates of one another, and each counts; several labels of
one doc_id count as their largest; labels of unknown documents are ignored; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, cut, ready, trimmed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: the letter of the duplicate filter among those of op12
DUPLICATE = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """What fails: A under 200 words, B under half of the words distinct, C over 3 % capitals, D any of #$%&*|."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def _compared(kind: str) -> tuple:
    """The pass over sorted rows (fp, text, doc_id, part, mask) and its schema: a row a document, and one for each text of the last fingerprint."""
    names = ["doc_id", "part", "mask", "duplicate", "fp", "sha", "edge"]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_fp = last_fp = last_text = last_id = None  # last_id: the smallest doc_id of the last text
        edges: dict[bytes, object] = {}  # of the last fingerprint: each text's smallest doc_id
        id_type = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fp, text, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            id_type = ids.type
            if first_fp is None:
                first_fp = fp[0]
            same = np.zeros(n, bool)
            same[0] = last_fp == fp[0] and last_text == text[0].as_py()
            alike = np.flatnonzero(fp[1:] == fp[:-1]) + 1
            if len(alike):
                same[alike] = pc.equal(text.take(pa.array(alike)), text.take(pa.array(alike - 1))).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(~same)
            if not len(start) or start[0]:
                start = np.concatenate(([0], start))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            place = np.append(np.flatnonzero(valid), n)
            least = place[np.searchsorted(place, start)]  # each group's first doc_id, which is its smallest
            least = np.where(least < np.append(start[1:], n), least, -1)
            smallest = [ids[int(i)].as_py() if i >= 0 else None for i in least[[0, -1]]]
            held = ids.take(pa.array(least[group], mask=least[group] < 0))
            if same[0] and last_id is not None:
                held = pc.if_else(pa.array(group == 0), pa.scalar(last_id, ids.type), held)
                smallest = [last_id, last_id if len(start) == 1 else smallest[1]]
            duplicate = pc.fill_null(pc.not_equal(ids, held), False).to_numpy(zero_copy_only=False)
            open_ = np.flatnonzero((fp == first_fp) & ~duplicate & valid)
            sha: list = [None] * n
            shown = None
            for i in open_:
                if i == 0 or shown is None or not same[i]:
                    shown = hashlib.sha256(text[int(i)].as_py().encode()).digest()
                sha[i] = shown
            is_open = np.zeros(n, bool)
            is_open[open_] = True
            arrays = [ids, batch.column(3), batch.column(4), pa.array(duplicate), pa.array(fp, mask=~is_open), pa.array(sha, pa.binary()), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            # what the next batch, and the next range, must know
            if last_fp != fp[-1]:
                edges = {}
            for g in np.flatnonzero(fp[start] == fp[-1]):
                own = smallest[0] if g == 0 else smallest[1] if g == len(start) - 1 else ids[int(least[g])].as_py() if least[g] >= 0 else None
                if own is not None:
                    edges[hashlib.sha256(text[int(start[g])].as_py().encode()).digest()] = own
            last_fp, last_text, last_id = fp[-1], text[n - 1].as_py(), smallest[1]
        if edges:
            e = len(edges)
            fill = [pa.array(list(edges.values()), id_type), pa.array([""] * e), pa.array([0] * e, pa.int32()), pa.array([False] * e)]
            yield pa.RecordBatch.from_arrays([*fill, pa.array([last_fp] * e, pa.int64()), pa.array(list(edges), pa.binary()), pa.array([True] * e)], names=names)

    return scan, f"doc_id {kind}, part string, mask int, duplicate boolean, fp long, sha binary, edge boolean"


def masks(documents: DataFrame, part: str, filters: dict[str, Column], duplicate: str, tables: Tables) -> DataFrame:
    """doc_id, part, mask and n: how many documents of this doc_id and part fail the filters whose bits (by order of letters) are set.

    filters are conditions on the column `text`; all of them are judged after the sort, once for each document.
    """
    letters = sorted({*filters, duplicate})
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = documents.select("doc_id", text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    ranged = given.select(F.xxhash64("text").alias("fp"), "text", "doc_id", "part").repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    bits = [F.when(fails, 1 << letters.index(x)).otherwise(0) for x, fails in filters.items()]
    scan, schema = _compared(kind)
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    found = tables.cut(ranged.select("fp", "text", "doc_id", "part", mask.cast("int").alias("mask")).mapInArrow(scan, schema), "compared")
    own = F.lit(1 << letters.index(duplicate))
    rows = found.filter("not edge").withColumn("mask", F.col("mask") + F.when(F.col("duplicate"), own).otherwise(0))
    counted = rows.groupBy("doc_id", "part", "mask", "fp", "sha").agg(F.count("*").alias("n"))
    before = found.filter("edge").groupBy("fp", "sha").agg(F.min("doc_id").alias("_least"))
    settled = counted.filter("fp is not null").join(before, ["fp", "sha"], "left")
    settled = settled.withColumn("mask", F.col("mask") + F.when(F.col("_least") < F.col("doc_id"), own).otherwise(0))
    columns = ["doc_id", "part", "mask", "n"]
    return counted.filter("fp is null").select(columns).unionByName(settled.select(columns))


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the additive counts n, good and toxic of what masks() gives."""
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # labels may be as many as documents: neither side is ever broadcast
    both = found.join(told.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    some = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("quality").alias("good"), some("toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """For every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, from the parts' counters."""
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for k, x in enumerate(order):
            bit = 1 << letters.index(x)
            steps.append(("".join(order), k + 1, bit, before))
            before |= bit
    rows = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<o:string,s:int,b:int,e:int>>"))
    each = counts.select("*", rows.alias("x")).select("*", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"))
    fails = F.col("mask").bitwiseAND(F.col("x.b")) != 0
    gone = F.col("mask").bitwiseAND(F.col("x.e")) != 0
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0)).cast("long")
    share = math.factorial(len(letters))  # of all orders, one in as many as a document fails has this filter first among those
    return each.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"), total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("x.b")).alias("unique_fails"), total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * F.lit(share) / F.bit_count("mask"))), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, part: str, filters: dict[str, Column], duplicate: str = DUPLICATE) -> DataFrame:
    """The report of interactions() for documents, whose filters are conditions on the column `text`, named by single letters."""
    ready(documents.sparkSession)
    tables = Tables()
    counts = cut(counters(masks(documents, part, filters, duplicate, tables), labels), "counters")
    tables.close()
    return interactions(counts, "".join(sorted({*filters, duplicate})))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(documents, labels, "lang", text_filters(F.col("text")))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t.doc_id, part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b, (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text))::INT AS c,
 regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS e, coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, a + b + c + d + e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.bit | x2.bit | x3.bit | x4.bit | x5.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1 : k - 1]), 0)::INT AS prior FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM o) y)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
 CAST(coalesce(sum(n) FILTER (mask & bit = 0 AND mask & prior = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
 CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & prior > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(n * 120 // greatest(fails, 1)) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
