"""The Java reader, intervals, call resolution and type hierarchy."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factlake.operators.intervals import innermost
from factlake.sources import java_facts


def brute(uses, intervals):
    out = []
    for k, at in uses:
        held = [(b, -e, n) for key, b, e, n in intervals if None not in (k, at, b, e) and key == k and b <= at <= e]
        out.append((k, at, max(held)[2] if held else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_rows", [1_000_000, 7])
def test_innermost_is_brute_force(spark, slice_rows):
    """Nested and crossing intervals, ties, empty ones, null keys and ends, a hot key cut into slices, repeated uses."""
    r = random.Random(slice_rows)
    keys = ["a", "a", "a", "b", "c", None]
    uses = [(r.choice(keys), r.choice([None, *range(60)])) for _ in range(300)]
    intervals = [(r.choice(keys), (b := r.randrange(50)), r.choice([None, b, b + r.randrange(25), b - 1]), f"n{i % 9}") for i in range(60)]
    got = innermost(
        spark.createDataFrame(uses, "k string, at int"), spark.createDataFrame(intervals, "k string, b int, e int, n string"), ["k"], "at", "b", "e", ["n"], slice_rows
    ).collect()
    assert sorted(map(tuple, got), key=repr) == brute(uses, intervals)


def test_innermost_of_empty_tables_and_plan(spark):
    uses, intervals = spark.createDataFrame([("a", 1)], "k string, at int"), spark.createDataFrame([], "k string, b int, e int, n string")
    assert [tuple(x) for x in innermost(uses, intervals, ["k"], "at", "b", "e", ["n"]).collect()] == [("a", 1, None)]
    assert innermost(uses.limit(0), intervals, ["k"], "at", "b", "e", ["n"]).count() == 0
    plan = innermost(uses, intervals, ["k"], "at", "b", "e", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def edges(spark, lexical=True, **files):
    given = spark.createDataFrame([(f"src/main/java/com/example/{n.replace('__', '/')}.java", t) for n, t in files.items()], "path string, content string")
    found = java_facts.java_facts(given)
    return sorted((x.caller_class, x.caller_method, x.callee_class, x.callee_method) for x in java_facts.call_edges(found, lexical).collect())


@pytest.mark.parametrize("lexical", [True, False])
def test_receivers_that_any_rule_resolves(spark, lexical):
    """A field, a type, this, none, an import of another package, accessors; nothing without sources."""
    got = edges(
        spark, lexical, AgentRunner="package com.example;\npublic class AgentRunner {\n public void run() {}\n}\n",
        A="package com.example;\npublic class A {\n    private AgentRunner runner;\n    void execute() {\n        runner.run();\n    }\n}\n",
        B="package com.example;\npublic class B {\n    void process() { Detector.detect(); }\n}\n",
        C="package com.example;\npublic class C {\n void process() {\n this.helper();\n some();\n }\n void helper() {}\n void some() {}\n}\n",
        D="package com.example.web;\nimport com.example.service.OrderService;\npublic class D {\n private OrderService orders;\n void submit() { orders.processOrder(); }\n}\n",
        E="package com.example;\npublic class E {\n void process() { int v = getValue(); setValue(42); toString(); hashCode(); doRealWork(); }\n void doRealWork() {}\n}\n",
    )
    p = "com.example."
    assert got == sorted([
        (p + "A", "execute", p + "AgentRunner", "run"), (p + "B", "process", p + "Detector", "detect"), (p + "C", "process", p + "C", "helper"), (p + "C", "process", "UNKNOWN", "some"),
        (p + "web.D", "submit", p + "service.OrderService", "processOrder"), (p + "E", "process", "UNKNOWN", "doRealWork"),
    ])
    assert edges(spark, lexical, Empty="") == []


def test_scopes_are_lexical(spark):
    text = """package com.example;
    class A { Repo x; void m(Dao x) { x.one(); { x.two(); } Runnable r = () -> { Mail y = null; y.three(); }; y.four(); }
      void n() { x.five(); } class In { Mail x; void o() { x.six(); A.this.x.seven(); } } void p() { x.eight(); } }"""
    got = {m: c for _, _, c, m in edges(spark, A=text)}
    p = "com.example."
    assert got == {
        "one": p + "Dao", "two": p + "Dao", "three": p + "Mail", "four": "UNKNOWN", "five": p + "Repo", "six": p + "Mail", "seven": p + "A", "eight": p + "Repo",
    }
    assert {m: c for _, _, c, m in edges(spark, False, A=text)}["one"] == p + "Mail"  # the last field of that name in the file


def test_inherited_fields_over_files_and_cycles(spark):
    got = edges(
        spark, Top="package com.example;\nclass Top extends Low { protected Dao dao; }", Mid="package com.example;\nclass Mid extends Top { }",
        Low="package com.example;\nclass Low extends Mid { void m() { dao.find(); } void n(Repo dao) { dao.save(); } }",
    )
    assert got == [("com.example.Low", "m", "com.example.Dao", "find"), ("com.example.Low", "n", "com.example.Repo", "save")]


def test_reader_takes_linear_time_and_any_text():
    def seconds(n):
        text = "package p;\n" + "\n".join(f"class C{i} {{ Dao d; void m(int a) {{ d.find(a, \"x(\"); if (a > 1) {{ Repo r = new Repo(); r.go(); }} }} }}" for i in range(n))
        began = time.perf_counter()
        rows = sum(1 for _ in java_facts.facts("p", text))
        return rows, time.perf_counter() - began

    (few, one), (many, eight) = seconds(2000), seconds(16000)
    assert abs(many - 8 * few) <= 8 and eight < 20 * one
    r = random.Random(1)
    pieces = ['"', "'", "/*", "*/", "//", "{", "}", "(", ")", ";", "class", "A", "new", "<", ">", "->", "@", ",", "=", "x", ".", "\n", '"""', "enum", "record", "case", ":", "[", "]", "import", "for"]
    for _ in range(400):
        list(java_facts.facts("p", " ".join(r.choice(pieces) for _ in range(60))))
    assert sum(1 for _ in java_facts.facts("p", "class A { void m() { " + "x(" * 20_000)) > 20_000


def test_hierarchy(spark):
    files = spark.createDataFrame([
        ("A.java", "package a; import b.*; interface I extends J, b.K { } interface J { } abstract class P implements I { } class C extends P { } class D extends C implements Z, Q { } enum E implements J { X }"),
        ("B.java", "package b; public interface K extends L { } interface L { } public interface Q { }"),
    ], "path string, content string")
    got = {(x.interface, x["class"]) for x in java_facts.implementors(java_facts.java_facts(files)).collect()}
    up = {"a.I", "a.J", "b.K", "b.L"}
    want = {(i, c) for i in up for c in ("a.P", "a.C", "a.D")} | {("a.Z", "a.D"), ("b.Q", "a.D"), ("a.J", "a.E")}
    assert got == want
    assert java_facts.implementors(java_facts.java_facts(files.limit(0))).count() == 0
    methods = java_facts.java_facts(files).filter(F.col("kind") == "method")
    assert methods.count() == 0
