"""Indexes over files that are kept up to date by content hash: only changed files are read, rows of vanished ones go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.operators.stores import without_files
from factlake.sources.files import changed, vanished

MAIN = "src/main/java/"


def with_hash(files: DataFrame) -> DataFrame:
    """Files (path, content) with the hash they are known by."""
    return files.withColumn("file_hash", F.md5("content"))


def preferred(files: DataFrame, marker: str = MAIN) -> DataFrame:
    """Of files (path) below a project, its first folder, those of its main sources if it has any, else all."""
    project = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
    main = F.col("path").contains(marker)
    keyed = files.withColumns({"_project": project, "_main": main})
    have = keyed.filter("_main").select("_project").distinct().withColumn("_have", F.lit(True))
    return keyed.join(have, "_project", "left").filter("_main or _have is null").drop("_project", "_main", "_have")


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content: binary) as text with their hash, and the paths of those that are no UTF-8, which are passed over."""
    text = files.withColumn("text", F.expr("try_validate_utf8(cast(content as string))"))
    good = text.filter("text is not null").select("path", F.col("text").alias("content"), F.md5("content").alias("file_hash"))
    return good, text.filter("text is null").select("path")


def refreshed(rows: DataFrame, meta: DataFrame, files: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Index rows (file_path, ...) and their meta (file_path, file_hash) brought up to the files (path, content, file_hash).

    build gives the rows of files and reads changed ones only; rows of changed and of vanished files are replaced,
    all others stay as they are. An index without rows is built from all files.
    """
    new = changed(files, meta)
    gone = vanished(meta, files).select("file_path").unionByName(new.select(F.col("path").alias("file_path")))
    kept = without_files(rows, gone)
    fresh = build(new).select(*rows.columns)
    now = without_files(meta, gone).unionByName(new.select(F.col("path").alias("file_path"), "file_hash"))
    return kept.unionByName(fresh), now
