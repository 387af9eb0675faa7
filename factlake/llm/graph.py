"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, trimmed

#: links that a task holds at once
HELD = 100_000


def _contracted(links: DataFrame) -> DataFrame:
    """links(a, b) of each task, HELD at a time, as stars (a, b): each node with the smallest that those links reach.

    It spares the rounds that would follow most links one by one, whatever the number of links.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields)

    def stars(top: dict, schema: pa.Schema) -> pa.RecordBatch:
        pairs = [(x, _top(top, x)) for x in top]
        pairs = [(x, y) for x, y in pairs if x != y]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.types[i]) for i in (0, 1)], names=["a", "b"])

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}
        held, schema = 0, None
        for batch in batches:
            schema = batch.schema
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = _top(top, x), _top(top, y)
                if x != y:
                    top[max(x, y)] = min(x, y)
            held += batch.num_rows
            if held >= HELD:
                yield stars(top, schema)
                top, held = {}, 0
        if schema is not None:
            yield stars(top, schema)

    return links.mapInArrow(scan, fields)


def _top(top: dict, x):
    """The smallest node that x hangs on; the way to it becomes shorter."""
    top.setdefault(x, x)
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other only, and none of those hangs itself. a is larger than b."""
    hangs = edges.groupBy("a").agg(F.count("*").alias("n"))
    return hangs.join(edges.select(F.col("b").alias("a"), F.lit(True).alias("held")).distinct(), "a", "left").filter("n > 1 or held").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) → (node, root): root is the smallest node that links reach.

    Links that meet in one task are followed there. Each round then hangs every node's larger neighbours, then its smaller ones, on the smallest neighbour; the
    rounds end when every node hangs on a root, after O(log^2 n) of them. One number a round reaches the
    driver, and the plan is the same for any number of links: small tables are a matter of adaptive
    execution. An empty table gives an empty result; self links and repeated links count once.
    """
    whole = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = cut(_contracted(whole).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = cut(hung.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        drop(edges)
        edges = new
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    roots = cut(found, "roots")
    drop(edges)
    return roots


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of earlier links, roots(node, root), and further ones. Only links between earlier components are followed."""
    if roots is None:
        return components(links)
    new = links.select("a", "b")
    for x in "ab":
        new = new.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    found = components(new.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = found.join(roots.select("node"), "node", "left_anti")
    out = cut(moved.unionByName(fresh), "roots")
    drop(roots)
    drop(found)
    return out
