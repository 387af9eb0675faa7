"""Tasks run by a client that a caller brings: cache, call, validation, one retry; and the validation of what came back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.columns import basis_of, name_in_line, score_of
from factlake.operators.evidence import checked_dependencies, overall_confidence
from factlake.operators.stores import cache_key


def executed(tasks: DataFrame, cache: DataFrame, call: Callable[[str], str | None], valid: Callable[[str | None], bool]) -> DataFrame:
    """Tasks (task_id, task_type, input) with output, status, cache_hit and retries.

    A task that the cache (key, output) knows by its input and type is CACHED. Others are called, and once more if the
    answer is not valid: COMPLETED, or SKIPPED with no output. Equal tasks are called once. A call that raises
    is an answer that is not valid. call runs in Arrow batches on the executors, one row after another.
    """
    keyed = tasks.withColumn("key", cache_key(F.col("input"), F.col("task_type")))
    known = cache.groupBy("key").agg(F.max("output").alias("_cached"))
    joined = keyed.join(known, "key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["input"]):
                output, ok, tries = None, False, 0
                while not ok and tries < 2:
                    tries += 1
                    try:
                        output = call(text)
                        ok = bool(valid(output))
                    except Exception:  # a client's failure is an answer that is not valid
                        ok = False
                rows.append((key, output if ok else None, "COMPLETED" if ok else "SKIPPED", tries - 1))
            yield pd.DataFrame(rows, columns=["key", "_output", "_status", "_retries"])

    missing = joined.filter("_cached is null").groupBy("key").agg(F.first("input").alias("input"))
    called = missing.mapInPandas(run, "key string, _output string, _status string, _retries int")
    out = joined.join(called, "key", "left")
    hit = F.col("_cached").isNotNull()
    return out.select(
        "task_id", "task_type", "key", F.coalesce("_cached", "_output").alias("output"), F.when(hit, "CACHED").otherwise(F.col("_status")).alias("status"),
        hit.alias("cache_hit"), F.coalesce("_retries", F.lit(0)).alias("retries"),
    )


def post_validated(claims: DataFrame, src_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (doc, pos, kind, target, line) checked against the source (doc, line_number, line).

    Gives the claims with the line they were checked at and a status, 1 for calls with a line of their own that pass, and
    per doc the score, what it rests on and its issues. A claim without a line is looked for in the source first (C12).
    """
    named = claims.filter("target is not null and target <> ''")
    own = F.coalesce(F.col("line").cast("string").try_cast("int"), F.lit(0))
    placed = named.withColumn("claimed", own)
    none = F.array().cast("array<string>")
    # the first line that has the name, of those claims only that come without one; repeated targets are looked for once
    asked = placed.filter("claimed = 0").select("doc", "target").distinct()
    lines = src_lines.select("doc", F.col("line").alias("_text"), F.col("line_number").alias("_n"))
    first = asked.join(lines, "doc").filter(name_in_line(F.col("target"), F.col("_text"))).groupBy("doc", "target").agg(F.min("_n").cast("int").alias("_first"))
    placed = placed.join(first, ["doc", "target"], "left")
    placed = placed.withColumn("at", F.when(F.col("claimed") == 0, F.coalesce("_first", F.lit(0))).otherwise(F.col("claimed"))).drop("_first")
    checked = checked_dependencies(placed.select("doc", "pos", F.col("at").cast("string").alias("line"), F.col("target").alias("name")), src_lines)
    found = placed.join(checked.select("doc", "pos", "passed", "issue"), ["doc", "pos"])
    status = ((F.col("kind") == "CALL") & (F.col("claimed") > 0) & F.coalesce("passed", F.lit(False))).cast("int")
    issues = checked.filter("issue is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "issue", "name"))).alias("issues"))
    overall = overall_confidence(checked).join(issues, "doc", "left")
    c = F.col("confidence")
    scores = overall.select("doc", score_of(c).alias("score"), basis_of(c).alias("basis"), F.coalesce("issues", none).alias("issues"))
    return found.select("doc", "pos", "kind", "target", "at", "passed", "issue", status.alias("status")), scores
