"""Writes that replace by file or key, and a keyed cache with expiry."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TTL_DAYS, MOST_ENTRIES = 7, 1000


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """K3: rows of other files. files: file_path."""
    return rows.join(files.select("file_path").distinct(), "file_path", "left_anti")


def replaced_by_file(rows: DataFrame, fresh: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """K1: old rows with those of re-read files (by default the files of the fresh rows) replaced."""
    return without_files(rows, fresh if files is None else files).unionByName(fresh)


def append(rows: DataFrame, path: str) -> None:
    """K2: one atomic append; repeated rows are allowed."""
    rows.write.mode("append").parquet(path)


def publish(rows: DataFrame, path: str) -> str:
    """K5, K6: a new version of a table in a folder of its own, so that readers of the old one are not disturbed."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    rows.write.parquet(version)
    return version


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """K5: the table at path, or an empty one of its declared schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cache_key(*parts: Column) -> Column:
    """One key of all parts; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def short_key(*parts: Column) -> Column:
    """The MD5 variant, of the texts one behind the other; nulls are passed over."""
    return F.md5(F.concat_ws("", *parts))


def file_name(name: Column, model: Column, *parts: Column) -> Column:
    """The name of a cache file: the key of its parts, and name and model without anything but letters, digits, dots and dashes."""
    plain = lambda x: F.regexp_replace(x, r"[^A-Za-z0-9.\-]", "_")
    return F.concat_ws("_", short_key(*parts), plain(name), plain(model))


def alive(entries: DataFrame, now: Column | None = None, days: int = TTL_DAYS) -> DataFrame:
    """K9: entries that have not expired."""
    return entries.filter((now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)) <= F.col("created_at"))


def kept_recent(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """K9: the entries used last, as a top-k that is cut within partitions first."""
    return entries.orderBy(F.desc("last_used"), "key").limit(most)


def put(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """K9: the last entry of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("created_at"))
    return entries.unionByName(fresh).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def evicted(entries: DataFrame, prefix: str) -> DataFrame:
    """K9: entries whose key has another beginning."""
    return entries.filter(~F.col("key").startswith(prefix))


def invalidated(entries: DataFrame, path: str) -> DataFrame:
    """K9: entries that no change of this file makes stale."""
    return entries.filter(~F.exists(F.coalesce("invalidated_by", F.array().cast("array<string>")), lambda x: F.lit(path).contains(x)))


def looked_up(entries: DataFrame, key: str | None = None, task_type: str | None = None) -> DataFrame:
    """Entries by key or by type of task."""
    if key is not None:
        entries = entries.filter(F.col("key") == key)
    return entries if task_type is None else entries.filter(F.col("task_type") == task_type)
