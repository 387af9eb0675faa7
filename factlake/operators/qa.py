"""Look-ups that questions about a code base are answered from: each gives one row with a JSON text, an error if nothing is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.facts import searched


def _answer(found: DataFrame, error: str) -> DataFrame:
    """found: at most one row with a json column; none, or a null, gives the error."""
    text = F.to_json(F.struct(F.lit(error).alias("error")))
    return found.agg(F.coalesce(F.max("json"), text).alias("json"))


def _sorted(columns: str | Column) -> Column:
    return F.array_sort(F.collect_set(columns))


def callers(calls: DataFrame, class_name: str, method: str | None = None) -> DataFrame:
    """Who calls a method, or each called method of a class. calls: call records."""
    who = F.concat_ws(".", "caller_class", "caller_method")
    own = calls.filter((F.col("callee_class") == class_name) & F.col("callee_method").isNotNull())
    if method is not None:
        listed = own.filter(F.col("callee_method") == method).agg(_sorted(who).alias("callers")).filter("size(callers) > 0")
        body = F.struct(F.lit(class_name).alias("class"), F.lit(method).alias("method"), F.size("callers").alias("callerCount"), "callers")
        return _answer(listed.select(F.to_json(body).alias("json")), f"no callers of {class_name}.{method}")
    each = own.groupBy("callee_method").agg(_sorted(who).alias("c"))
    whole = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("callee_method", "c")))).alias("callers")).filter("size(callers) > 0")
    body = F.struct(F.lit(class_name).alias("class"), F.size("callers").alias("methodCount"), "callers")
    return _answer(whole.select(F.to_json(body).alias("json")), f"no callers of {class_name}")


def callees(reports: DataFrame, class_name: str, method: str | None = None) -> DataFrame:
    """What the methods of an analysed class call, or the first method of a name. reports: class, methods."""
    own = reports.filter(F.col("class") == class_name).limit(1)
    none = F.array().cast("array<struct<target:string,line:int,type:string>>")
    calls = lambda m: F.coalesce(F.transform(m["calls"], lambda c: F.struct(c["target"].alias("target"), F.coalesce(c["line"].try_cast("int"), F.lit(0)).alias("line"), c["type"].alias("type"))), none)
    if method is not None:
        m = F.get(F.filter("methods", lambda m: m["name"] == method), F.lit(0))
        found = own.withColumn("m", m).filter("m is not null").withColumn("c", calls(F.col("m")))
        body = F.struct(F.lit(class_name).alias("class"), F.lit(method).alias("method"), F.size("c").alias("calleeCount"), F.col("c").alias("callees"))
        return _answer(found.select(F.to_json(body).alias("json")), f"no method {method} in {class_name}")
    named = F.transform("methods", lambda m: F.struct(m["name"].alias("method"), calls(m).alias("callees")))
    body = F.struct(F.lit(class_name).alias("class"), F.size("methods").alias("methodCount"), named.alias("callees"))
    return _answer(own.filter("methods is not null").select(F.to_json(body).alias("json")), f"{class_name} has not been analysed")


def db_dependencies(ops: DataFrame, mapper: str) -> DataFrame:
    """The tables and kinds of statement of a mapper."""
    found = ops.filter(F.col("mapper_interface") == mapper).agg(_sorted("table_name").alias("tables"), _sorted("sql_type").alias("sqlTypes")).filter("size(tables) > 0")
    body = F.struct(F.lit(mapper).alias("class"), F.size("tables").alias("tableCount"), "tables", "sqlTypes", F.lit(mapper).alias("mapperClass"))
    return _answer(found.select(F.to_json(body).alias("json")), f"no database dependencies of {mapper}")


def contradictions(findings: DataFrame, scores: DataFrame, doc) -> DataFrame:
    """The findings and the score of a document. findings: doc, rule, source, severity, status; scores: doc, score."""
    own = findings.filter((F.col("doc") == doc) & (F.col("status") == "CONTRADICTORY"))
    listed = own.agg(F.array_sort(F.collect_list(F.struct("rule", "source", "severity"))).alias("contradictions")).filter("size(contradictions) > 0")
    score = scores.filter(F.col("doc") == doc).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    body = F.struct(F.lit(doc).alias("class"), F.size("contradictions").alias("contradictionCount"), "score", "contradictions")
    return _answer(listed.crossJoin(score).select(F.to_json(body).alias("json")), f"no contradictions of {doc}")  # one row each


def table_sharing(ops: DataFrame, table: str) -> DataFrame:
    """The mappers that share a table."""
    found = ops.filter(F.col("table_name") == table).agg(_sorted("mapper_interface").alias("classes")).filter("size(classes) > 0")
    body = F.struct(F.lit(table).alias("table"), F.size("classes").alias("classCount"), "classes")
    return _answer(found.select(F.to_json(body).alias("json")), f"no class shares {table}")


def search(calls: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """Methods by keyword, distinct, at most `limit` (10 if that is outside 1 to 50)."""
    distinct = calls.select("caller_class", "caller_method").distinct()
    blank = {"line_number": F.lit(0), "callee_class": F.lit(""), "call_type": F.lit("")}
    found = searched(distinct.withColumns(blank), keyword, limit)
    listed = found.agg(F.array_sort(F.collect_list(F.struct(F.col("caller_class").alias("className"), F.col("caller_method").alias("methodName")))).alias("results")).filter("size(results) > 0")
    body = F.struct(F.lit(keyword).alias("keyword"), F.size("results").alias("resultCount"), "results")
    return _answer(listed.select(F.to_json(body).alias("json")), f"nothing found for {keyword}")
