"""Stored indexes that answer look-ups from a part of their rows and are kept up by what changed.

A store deals its rows to buckets by a hash of their keys, one folder each. A look-up reads the buckets of its keys; a change rewrites
the buckets that it touches, in folders of a new version, so that readers of the old one are not disturbed. What the driver
holds is one path for each bucket.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.session import checkpointed, shared_folder

BUCKETS = 64
#: files that a bucket's rows are spread over at most, whichever its keys
SPREAD = 4


class Store(NamedTuple):
    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    columns: str
    paths: tuple[str, ...]

    def bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*[k.cast("string") for k in keys or map(F.col, self.keys)]), F.lit(len(self.paths))).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = sorted({p for i, p in enumerate(self.paths) if p and (buckets is None or i in buckets)})
        return self.spark.read.schema(self.columns).parquet(*paths) if paths else self.spark.createDataFrame([], self.columns)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows' keys: at most as many numbers as there are buckets."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def with_buckets(self, rows: DataFrame, buckets: list[int]) -> Store:
        """A version in which these rows are what the buckets hold."""
        path = f"{self.root}/v-{uuid.uuid4().hex}"
        names = rows.columns
        spread = F.pmod(F.xxhash64(*names), F.lit(SPREAD))  # a key with a third of all rows is written by several tasks
        dealt = rows.withColumn("_b", self.bucket()).repartition("_b", spread).sortWithinPartitions("_b", *self.keys)
        dealt.write.partitionBy("_b").parquet(path)
        got = {r["_b"] for r in self.spark.read.schema(f"{self.columns}, _b int").parquet(path).select("_b").distinct().collect()} if buckets else set()
        paths = tuple((f"{path}/_b={i}" if i in got else "") if i in buckets else p for i, p in enumerate(self.paths))
        return self._replace(paths=paths)


def stored(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> Store:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    root = f"{shared_folder(rows.sparkSession)}/store-{uuid.uuid4().hex}"
    return Store(rows.sparkSession, root, keys, columns, ("",) * buckets).with_buckets(rows, list(range(buckets)))


# --- substrings of terms ---------------------------------------------------------------------------------------------

_BEGIN, _END = "\x02", "\x03"


def grams(text: Column) -> Column:
    """The distinct runs of three characters."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TermIndex(NamedTuple):
    """Rows by term, and terms by the runs of three characters that they hold, whatever the case; both ends of a term count as characters."""

    rows: Store
    grams: Store


def _postings(terms: DataFrame) -> DataFrame:
    return terms.select("term", F.explode(grams(F.concat(F.lit(_BEGIN), F.lower("term"), F.lit(_END)))).alias("gram"))


def term_index(terms: DataFrame, buckets: int = BUCKETS) -> TermIndex:
    """The index of code terms (term, term_type, file_path, line_number); null terms are found by nothing."""
    rows = terms.filter("term is not null")
    return TermIndex(stored(rows, "term", buckets=buckets), stored(_postings(rows.select("term").distinct()), "gram", buckets=buckets))


def matching(index: TermIndex, text: str, where: str = "anywhere") -> DataFrame:
    """Rows whose term has the text, whatever the case: at its `start`, at its `end` or `anywhere`.

    The postings of all the text's runs are intersected and the terms that are left compared with it; a text too short to have a run
    is compared with all terms.
    """
    low = text.lower()
    wanted = {"start": _BEGIN + low, "end": low + _END, "anywhere": low}[where]
    runs = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    term = F.lower("term")
    fits = {"start": term.startswith(low), "end": term.endswith(low), "anywhere": term.contains(low)}[where]
    spark = index.rows.spark
    if not runs:
        return index.rows.rows().filter(fits)
    asked = spark.createDataFrame([(g,) for g in runs], "gram string")
    own = index.grams.rows(index.grams.touched(asked)).filter(F.col("gram").isin(runs))
    found = checkpointed(own.groupBy("term").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(runs)).select("term").filter(fits))
    return index.rows.rows(index.rows.touched(found)).join(found, "term", "left_semi")


def with_files(index: TermIndex, old: DataFrame, fresh: DataFrame) -> TermIndex:
    """K1: the index after files were read again. old: their rows so far; fresh: what stands for them. Postings of terms that no row has any
    more go, those of new terms come; only buckets of terms and runs that are concerned are written."""
    old, fresh = checkpointed(old.filter("term is not null")), checkpointed(fresh.filter("term is not null"))
    terms = checkpointed(old.select("term").union(fresh.select("term")).distinct())
    buckets = index.rows.touched(terms)
    before = index.rows.rows(buckets)
    files = old.select("term", "file_path").distinct()
    after = checkpointed(before.join(files, ["term", "file_path"], "left_anti").unionByName(fresh.select(before.columns)))
    rows = index.rows.with_buckets(after, buckets)
    gone = terms.join(after.select("term").distinct(), "term", "left_anti")
    new = fresh.select("term").distinct().join(before.select("term").distinct(), "term", "left_anti")
    changed = checkpointed(_postings(gone).withColumn("add", F.lit(False)).unionByName(_postings(new).withColumn("add", F.lit(True))))
    at = index.grams.touched(changed)
    kept = index.grams.rows(at).join(changed.filter("not add").select("gram", "term"), ["gram", "term"], "left_anti")
    return TermIndex(rows, index.grams.with_buckets(kept.unionByName(changed.filter("add").select("gram", "term"), allowMissingColumns=True).select(index.grams.rows().columns), at))


# --- aggregates that are maintained ----------------------------------------------------------------------------------

_GROUP = ("table_name", "sql_type", "mapper_interface")


def operation_counts(ops: DataFrame, buckets: int = BUCKETS) -> Store:
    """How many operations each mapper has on each table by kind, from which distinct counts stay exact when files go."""
    return stored(ops.groupBy(*_GROUP).agg(F.count("*").alias("n")), "table_name", buckets=buckets)


def with_operations(counts: Store, old: DataFrame, fresh: DataFrame) -> Store:
    """The counts after files were read again: old and fresh are those files' operations. Only buckets of their tables are read and written."""
    delta = old.select(*_GROUP, F.lit(-1).alias("n")).unionByName(fresh.select(*_GROUP, F.lit(1).alias("n"))).groupBy(*_GROUP).agg(F.sum("n").alias("n")).filter("n <> 0")
    delta = checkpointed(delta)
    buckets = counts.touched(delta)
    merged = counts.rows(buckets).unionByName(delta).groupBy(*_GROUP).agg(F.sum("n").alias("n")).filter("n > 0")
    return counts.with_buckets(merged, buckets)


def stats_of(counts: DataFrame) -> DataFrame:
    """A1 from counts of operations."""
    kinds = counts.groupBy("table_name", "sql_type").agg(F.sum("n").alias("operations"), F.count("*").alias("mappers"))
    tables = kinds.groupBy("table_name").agg(F.max("mappers").alias("mappers_max"))
    mappers = counts.select("table_name", "mapper_interface").distinct().groupBy("table_name").agg(F.count("*").alias("mappers_distinct"))
    return kinds.join(tables, "table_name").join(mappers, "table_name")


# --- calls by both ends ----------------------------------------------------------------------------------------------


class EdgeStore(NamedTuple):
    """Call records twice, as tables of buckets: by what is called, and by who calls; in a bucket by key and line."""

    by_callee: DataFrame
    by_caller: DataFrame
    buckets: int

    def calls(self, side: str, name: str, method: str) -> DataFrame:
        """The bucket of the calls whose callee or caller (side) is this method; what else is in it is for the caller to filter."""
        table = self.by_callee if side == "callee" else self.by_caller
        spark = table.sparkSession
        own = spark.range(1).select(F.pmod(F.hash(F.lit(name), F.lit(method)), F.lit(self.buckets))).first()[0]
        files = [f for f in table.inputFiles() if (m := _BUCKET.search(f)) and int(m[1]) == own]
        return spark.read.schema(table.schema).parquet(*files) if files else table.limit(0)


#: the number of the bucket in the name of its file
_BUCKET = re.compile(r"_(\d{5})(?:\.[^/]*)?$")


def edge_store(edges: DataFrame, buckets: int | None = None) -> EdgeStore:
    """A look-up by class and method reads one bucket, and a join with the side's keys shuffles the other table only.
    As many buckets as shuffle partitions, unless given. A method with very many calls fills its bucket, which one task reads."""
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = []
    for side in ("callee", "caller"):
        keys, name = [f"{side}_class", f"{side}_method"], f"factlake_edges_{side}_{uuid.uuid4().hex}"
        rows = edges.repartition(n, *keys).write.format("parquet").option("path", f"{shared_folder(spark)}/{name}")
        rows.bucketBy(n, *keys).sortBy(*keys, "line_number").saveAsTable(name)
        made.append(spark.table(name))
    return EdgeStore(*made, n)
