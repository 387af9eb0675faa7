from pyspark.sql import functions as F

from factlake.operators import facts
from factlake.schemas import CALL_RECORDS, CODE_TERMS

ROWS = [
    ("UserService", "process", "OrderService", "createOrder", "DIRECT", "U.java", 10, None),
    ("ServiceA", "a", "Target", "run", "DIRECT", "A.java", 10, None),
    ("ServiceB", "b", "Target", "run", "DIRECT", "B.java", 5, "HIGH"),
    ("ReportController", "generate", "ReportService", None, "SPRING_INJECTION", "R.java", 3, None),
]


def test_lookups_and_order(spark):
    calls = spark.createDataFrame(ROWS, CALL_RECORDS)
    assert [r.caller_class for r in facts.calls_by(calls, "callee", "Target", "run").collect()] == ["ServiceB", "ServiceA"]
    assert facts.calls_by(calls, "caller", "UserService", "process").count() == 1
    assert facts.calls_by(calls, "callee", "ReportService", "x").count() == 0
    assert facts.calls_by(calls, "callee", None, "x").count() == 0
    many = spark.range(50).select(F.lit("C").alias("caller_class"), F.lit("m").alias("caller_method"), F.lit("T").alias("callee_class"), F.lit("f").alias("callee_method"), F.lit("DIRECT").alias("call_type"), F.lit("p").alias("file_path"), F.col("id").cast("int").alias("line_number"), F.lit(None).cast("string").alias("confidence"))
    assert facts.calls_by(many, "callee", "T", "f", 10).count() == 10
    assert facts.per_node_limit(many).count() == 30


def test_q06_wildcards_are_plain_and_case_is_not_told(spark):
    terms = spark.createDataFrame([("Foo.get_x", "CALLEE", "a", 1), ("Foo.getax", "CALLEE", "a", 2), ("foo.GET_X", "CALLEE", "b", 1)], CODE_TERMS)
    assert facts.find_callers(terms, "get_x").count() == 2
    assert facts.find_by_prefix(terms, "FOO.", "CALLEE").count() == 3


def test_q04_wildcard_fields(spark):
    ops = spark.createDataFrame([("m", "a", "SELECT", "t", ["WILDCARD"]), ("m", "b", "SELECT", "t", ["x", "y"]), ("m", "c", "SELECT", "t", None), ("m", "d", "SELECT", "t", ["z"])], "mapper_interface string, method_name string, sql_type string, table_name string, fields array<string>")
    assert {r.method_name for r in facts.operations_on_field(ops, "t", "x").collect()} == {"a", "b", "c"}
    assert {r.method_name for r in facts.operations_on_field(ops, "t", "x", strict=True).collect()} == {"b"}


def test_q05_mapper_counts(spark):
    ops = spark.createDataFrame([("m1", "t", "SELECT"), ("m2", "t", "SELECT"), ("m3", "t", "INSERT")], "mapper_interface string, table_name string, sql_type string")
    r = facts.table_stats(ops).filter("sql_type = 'SELECT'").first()
    assert (r.operations, r.mappers, r.mappers_max, r.mappers_distinct) == (2, 2, 2, 3)


def test_q11_declaring_file_counts_unless_excluded(spark):
    terms = spark.createDataFrame([("X", "CLASS", "X.java", 1), ("X", "IMPORT", "A.java", 2), ("X.foo", "CALLEE", "A.java", 9), ("X.foo", "CALLEE", "B.java", 3)], CODE_TERMS)
    got = {r.file_path: r.how for r in facts.callers_of(terms, "X").collect()}
    assert got == {"X.java": "IMPORT", "A.java": "IMPORT", "B.java": "CALL"}
    assert {r.file_path for r in facts.callers_of(terms, "X", exclude_declaring=True).collect()} == {"A.java", "B.java"}


def test_sharing(spark):
    rows = [(f"com.a.mod{i}.x.M{i}", "sys_order", "SELECT") for i in range(4)] + [(f"com.a.mod{i}.x.N{i}", "sys_user", "SELECT") for i in range(2)]
    ops = spark.createDataFrame(rows, "mapper_interface string, table_name string, sql_type string")
    assert [r.table_name for r in facts.shared_tables(ops).collect()] == ["sys_order"]
    assert [(r.table_name, r.mapper_count) for r in facts.table_sharing(ops).collect()] == [("sys_order", 4), ("sys_user", 2)]
