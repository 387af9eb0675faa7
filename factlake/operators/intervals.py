"""The innermost interval that holds a position: one sort and one sweep, linear in rows, without a range join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.session import checkpointed

#: positions of one key that a sweep takes at once; a key with more is cut into slices of its range, each a sweep of its own
SLICE_ROWS = 1_000_000


def innermost(uses: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str, found: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every row of uses with the columns `found` of the interval, among those with its keys, that begins last and holds its position; null where none does.

    An interval holds both its ends; of several that begin together the shortest counts, of those the one with the largest columns. Positions, keys or
    ends that are null are in no interval, and an interval without keys holds nothing. Repeated rows are each answered. Both tables are sorted together by key and
    position; a partition is swept as a stream that holds a stack of open intervals. A hot key is cut by position: an interval is then
    sent to the slices that it reaches, so rows grow by the intervals open at a cut only.
    """
    given = uses.select(F.struct(*uses.columns).alias("_use"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(at).cast("long").alias("_at"))
    own = [f"_k{i}" for i in range(len(keys))]
    known = intervals.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(begin).cast("long").alias("_at"), F.col(end).cast("long").alias("_end"), F.struct(*found).alias("_found"))
    known = known.dropna(subset=[*own, "_at", "_end"])
    # of the keys, only those with more rows than a slice come into this table
    hot = given.groupBy(*own).agg(F.count("_at").alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")).filter(F.col("_n") > slice_rows)
    hot = checkpointed(hot.select(*own, F.ceil(F.col("_n") / slice_rows).alias("_n"), "_lo", "_hi"))

    def sliced(position: Column) -> Column:
        wide = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.col("_n")))
        return F.coalesce(F.least(F.greatest(F.floor((position - F.col("_lo")) / wide), F.lit(0)), F.col("_n") - 1), F.lit(0))

    if hot.isEmpty():
        given, known = given.withColumns({"_end": F.lit(None).cast("long"), "_slice": F.lit(0)}), known.withColumn("_slice", F.lit(0))
    else:
        given = given.join(hot, own, "left").select("_use", *own, "_at", F.lit(None).cast("long").alias("_end"), sliced(F.col("_at")).cast("int").alias("_slice"))
        reached = F.sequence(sliced(F.col("_at")).cast("int"), sliced(F.greatest("_at", "_end")).cast("int"))
        known = known.join(hot, own, "left").select("_found", *own, "_at", "_end", F.explode(reached).alias("_slice"))
    both = known.withColumn("_use", F.lit(None).cast(given.schema["_use"].dataType)).unionByName(given.withColumn("_found", F.lit(None).cast(known.schema["_found"].dataType)))
    # at one position intervals open before uses, the longest first, so that the last one open is the answer
    order = [*own, "_slice", "_at", F.col("_use").isNotNull(), F.col("_end").desc(), "_found"]
    rows = both.repartition(*own, "_slice").sortWithinPartitions(*order).select(*own, "_slice", "_at", "_end", "_found", "_use")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, []  # the columns before the last two are the key, then position and end
        for batch in batches:
            *keyed, positions, ends = [c.to_pylist() for c in batch.columns[: len(own) + 3]]
            table = batch.column("_found")
            took, answers = [], []
            for i, (k, at_, end_) in enumerate(zip(zip(*keyed), positions, ends)):
                if k != key:
                    key, open_ = k, []
                if end_ is not None:
                    open_.append((end_, table[i].as_py()))
                    continue
                while open_ and at_ is not None and open_[-1][0] < at_:
                    open_.pop()
                took.append(i)
                answers.append(open_[-1][1] if open_ and at_ is not None else None)
            if took:
                yield pa.RecordBatch.from_arrays([batch.column("_use").take(pa.array(took)), pa.array(answers, table.type)], names=["_use", "_found"])

    schema = rows.select("_use", "_found").schema
    swept = rows.mapInArrow(sweep, schema)
    return swept.select("_use.*", *[F.col("_found")[c].alias(f"found_{c}") for c in found])
