"""Lookups and aggregates over terms, calls and mapper operations.

Every operator takes DataFrames and returns a lazy one; filters and column lists reach the scan. A null
argument gives an empty result (P16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import top_packages

_ORDER = ("file_path", "line_number")


def _equal(df: DataFrame, **values: str | None) -> DataFrame:
    for column, value in values.items():
        if value is None:
            return df.limit(0)
        df = df.filter(F.col(column) == value)
    return df


def find_by_class(terms: DataFrame, name: str | None) -> DataFrame:
    """Rows that declare or import a class."""
    return _equal(terms, term=name).filter(F.col("term_type").isin("IMPORT", "CLASS")).orderBy(*_ORDER)


def find_callers(terms: DataFrame, method: str | None) -> DataFrame:
    """Calls `<anything>.method`, whatever the case; wildcards in the name are plain characters."""
    if method is None:
        return terms.limit(0)
    return terms.filter((F.col("term_type") == "CALLEE") & F.lower("term").endswith("." + method.lower())).orderBy(*_ORDER)


def find_by_prefix(terms: DataFrame, prefix: str | None, term_type: str | None) -> DataFrame:
    """Terms of a type by prefix, whatever the case."""
    if prefix is None:
        return terms.limit(0)
    return _equal(terms, term_type=term_type).filter(F.lower("term").startswith(prefix.lower())).orderBy("term", "file_path")


def find_by_type(terms: DataFrame, term_type: str | None) -> DataFrame:
    """P4."""
    return _equal(terms, term_type=term_type).orderBy(*_ORDER)


def record_count(df: DataFrame) -> DataFrame:
    """P5."""
    return df.agg(F.count("*").alias("n"))


def calls_by(calls: DataFrame, side: str, name: str | None, method: str | None, limit: int | None = None) -> DataFrame:
    """Records by caller or callee class and method, by line, at most `limit`."""
    out = _equal(calls, **{f"{side}_class": name, f"{side}_method": method}).orderBy("line_number", "caller_class", "callee_class", "call_type")
    return out if limit is None else out.limit(limit)


def per_node_limit(calls: DataFrame, limit: int = 30) -> DataFrame:
    """The first records by line of each called method. One window, cut early within partitions."""
    w = Window.partitionBy("callee_class", "callee_method").orderBy("line_number", "caller_class", "caller_method", "call_type")
    return calls.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def operations_on(ops: DataFrame, table: str | None) -> DataFrame:
    """P11."""
    return _equal(ops, table_name=table).orderBy("sql_type", "method_name")


def operations_on_field(ops: DataFrame, table: str | None, field: str | None, strict: bool = False) -> DataFrame:
    """Operations on a table that read or write a field. By default rows that name all columns count too;
    `strict` keeps only rows whose list has the field itself."""
    if field is None:
        return ops.limit(0)
    hit = F.array_contains("fields", field)
    if not strict:
        hit = hit | F.arrays_overlap("fields", F.array(F.lit("WILDCARD"), F.lit("*"))) | F.col("fields").isNull()
    return operations_on(ops, table).filter(hit)


def operations_of(ops: DataFrame, mapper: str | None, method: str | None) -> DataFrame:
    """P13."""
    return _equal(ops, mapper_interface=mapper, method_name=method).orderBy("table_name")


def field_mappings(mappings: DataFrame, mapper: str | None) -> DataFrame:
    """P14."""
    return _equal(mappings, mapper_interface=mapper).orderBy("java_type", "property_name")


def field_mappings_by_column(mappings: DataFrame, column: str | None) -> DataFrame:
    """P15."""
    return _equal(mappings, column_name=column).orderBy("mapper_interface", "java_type")


def field_mappings_by_table(mappings: DataFrame, ops: DataFrame, table: str | None) -> DataFrame:
    """Mappings of the mappers that touch a table, as a semi-join."""
    return mappings.join(_equal(ops, table_name=table), "mapper_interface", "left_semi").orderBy("java_type", "property_name")


def operations_for_calls(ops: DataFrame, calls: DataFrame) -> DataFrame:
    """Operations behind a list of calls (columns mappers, methods: arrays, zipped as far as both go)."""
    n = F.least(F.size("mappers"), F.size("methods"))
    zipped = calls.select(F.posexplode(F.arrays_zip(F.slice("mappers", F.lit(1), n).alias("m"), F.slice("methods", F.lit(1), n).alias("f"))).alias("pos", "c"))
    found = zipped.join(ops, (F.col("c.m") == F.col("mapper_interface")) & (F.col("c.f") == F.col("method_name")))
    w = Window.partitionBy("mapper_interface", "method_name", "table_name", "sql_type").orderBy("pos", "xml_line", "source_file")
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "c")


def table_stats(ops: DataFrame) -> DataFrame:
    """A1: per table and kind of statement, operations and mappers; mappers_max is the largest number of mappers of
    any one kind, mappers_distinct that of the table. Distinct mappers are counted from (table, kind, mapper) groups,
    so that a table with a third of all rows is summed where its rows are."""
    each = ops.groupBy("table_name", "sql_type", "mapper_interface").agg(F.count("*").alias("n"))
    kinds = each.groupBy("table_name", "sql_type").agg(F.sum("n").alias("operations"), F.count("*").alias("mappers"))
    tables = kinds.groupBy("table_name").agg(F.max("mappers").alias("mappers_max"))
    mappers = each.select("table_name", "mapper_interface").distinct().groupBy("table_name").agg(F.count("*").alias("mappers_distinct"))
    return kinds.join(tables, "table_name").join(mappers, "table_name")


def table_sharing(ops: DataFrame) -> DataFrame:
    """A2: per table its mappers and their packages of three levels, most shared first."""
    pairs = ops.select("table_name", "mapper_interface").distinct()
    return (
        pairs.groupBy("table_name").agg(
            F.array_sort(F.collect_list("mapper_interface")).alias("mappers"), F.count("*").alias("mapper_count"),
            F.array_sort(F.collect_set(top_packages(F.col("mapper_interface")))).alias("packages"),
        ).orderBy(F.desc("mapper_count"), "table_name")
    )


def all_tables(ops: DataFrame) -> DataFrame:
    """A3."""
    return ops.select("table_name").distinct().orderBy("table_name")


def module_count(ops: DataFrame, levels: int = 3) -> DataFrame:
    """A4: distinct packages of so many levels."""
    return ops.select(top_packages(F.col("mapper_interface"), levels).alias("p")).distinct().agg(F.count("*").alias("modules"))


def shared_tables(ops: DataFrame, least: int = 3) -> DataFrame:
    """R8 (rule C5): tables that mappers of several modules touch, with their penalty."""
    modules = ops.select("table_name", top_packages(F.col("mapper_interface")).alias("module")).distinct()
    counted = modules.groupBy("table_name").agg(F.count("*").alias("modules")).filter(F.col("modules") >= least)
    return counted.withColumn("penalty", F.lit(-0.1))


def callers_of(terms: DataFrame, name: str, exclude_declaring: bool = False) -> DataFrame:
    """Files that import or call a class, one row each, imports before calls."""
    declaring = find_by_class(terms, name)
    if exclude_declaring:
        declaring = declaring.filter("term_type = 'IMPORT'")
    called = terms.filter((F.col("term_type") == "CALLEE") & F.lower("term").startswith(name.lower() + "."))
    both = declaring.withColumn("rank", F.lit(0)).unionByName(called.withColumn("rank", F.lit(1)))
    w = Window.partitionBy("file_path").orderBy("rank", "line_number", "term")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("file_path", "line_number", "term", F.when(F.col("rank") == 0, "IMPORT").otherwise("CALL").alias("how"))


def callers_with_implementors(terms: DataFrame, implements: DataFrame, interface: str) -> DataFrame:
    """Callers of an interface and of each class that implements it (table interface, class), one row a file."""
    names = implements.filter(F.col("interface") == interface).select(F.col("class").alias("name"))
    names = names.unionByName(terms.sparkSession.range(1).select(F.lit(interface).alias("name"))).distinct()
    own = terms.filter(F.col("term_type").isin("IMPORT", "CLASS")).join(names, F.col("term") == F.col("name")).withColumn("rank", F.lit(0))
    calls = terms.filter(F.col("term_type") == "CALLEE").withColumn("scope", F.regexp_replace("term", r"\.[^.]*$", ""))
    calls = calls.join(names, F.col("scope") == F.col("name")).drop("scope").withColumn("rank", F.lit(1))
    w = Window.partitionBy("file_path").orderBy("rank", "line_number", "term")
    return own.unionByName(calls).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def searched(methods: DataFrame, keyword: str, limit: int) -> DataFrame:
    """Rows whose caller_method or caller_class has the keyword; a limit outside 1 to 50 becomes 10."""
    limit = limit if 1 <= limit <= 50 else 10
    hit = F.lower("caller_method").contains(keyword.lower()) | F.lower("caller_class").contains(keyword.lower())
    return methods.filter(hit).orderBy("caller_class", "caller_method", "line_number", "callee_class", "call_type").limit(limit)
