"""Source files: scans, change detection and lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    """Path, content and content hash of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.md5("content").alias("file_hash"))


def changed(files: DataFrame, meta: DataFrame) -> DataFrame:
    """S3: files that the index does not know with this hash."""
    known = meta.select(F.col("file_path").alias("path"), "file_hash")
    return files.join(known, ["path", "file_hash"], "left_anti")


def vanished(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed files that are there no more; their rows are to go."""
    return meta.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def lines(files: DataFrame) -> DataFrame:
    """path, line_number, line; empty lines at the end are no lines."""
    body = F.regexp_replace("content", r"\n+$", "")
    return files.select("path", F.posexplode(F.split(body, "\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_number"), "line")


def null_literals(src_lines: DataFrame) -> DataFrame:
    """The lines that name null, comments and strings included."""
    return src_lines.filter(F.col("line").rlike(r"\bnull\b")).select(F.lit("null").alias("term"), F.lit("NULL_LITERAL").alias("term_type"), F.col("path").alias("file_path"), "line_number")


def imports(files: DataFrame) -> DataFrame:
    """Each imported name, in full and its last segment."""
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))).alias("name"))
    return found.select(F.explode(F.array("name", F.substring_index("name", ".", -1))).alias("term"), F.lit("IMPORT").alias("term_type"), F.col("path").alias("file_path"))


def git_diff(repository: str, base: str) -> str:
    """The diff from a base to the head, renames found; run on the driver."""
    return subprocess.run(["git", "-C", repository, "diff", "-M", base, "HEAD"], capture_output=True, text=True, check=True).stdout


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Sources with their expected JSON, where there is one."""
    sources = text_files(spark, path).select(F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("name"), "content")
    expected = text_files(spark, path, "*.expected.json").select(F.regexp_extract("path", r"([^/]+)\.expected\.json$", 1).alias("name"), F.col("content").alias("expected"))
    return sources.join(expected, "name", "left")
