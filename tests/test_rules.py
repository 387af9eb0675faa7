"""Names, types and routes by their rules, capped impact against a queue, and what aggregates and look-ups give for odd rows."""

import collections
import json
import random

from pyspark.sql import functions as F

from factlake.functions import columns as c
from factlake.operators import agents, aggregates, evidence, impact, qa, reports, stores
from factlake.schemas import CALL_RECORDS
from factlake.sources import index


def _each(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_dependency_names(spark):
    given = {
        "com.shop.order.service.IOrderMainService": "orderMainService", "IOrderMainService": "orderMainService",
        "com.shop.api.IOrderInfoCmd.findOrderById()": "orderInfoCmd", "findOrderService": "findOrderService", "Item": "item", "I": "i", "a.b.run(x.y(1))": "b",
        "run(1)": "run", "": "",
    }
    assert _each(spark, list(given), c.dependency_name) == list(given.values())
    assert _each(spark, [None], c.dependency_name) == [None]


def test_tool_classes(spark):
    given = {
        "StringUtils": True, "com.x.MyStringUtil": True, "FooServiceImpl": True, "bmsMapperImpl": True, "java.util.X": False, "java.util.Arrays": True, "org.apache.commons.lang3.X": True,
        "com.stream.core.util.X": True, "org.slf4j.Logger": False, "objectUtils": False, "IBaseService": True, "orderService": False,
    }
    assert _each(spark, list(given), reports.is_tool_class) == list(given.values())
    assert _each(spark, [None], reports.is_tool_class) == [False]


def test_types_of_dependencies_and_risks(spark):
    assert _each(spark, ["field", "method_call", "injection", "FIELD", None], reports.clean_dependency_type) == ["field", "method_call", "field", "field", "field"]
    assert _each(spark, ["SECURITY", "security", "CONCURRENCY", "PERFORMANCE", None], reports.clean_risk_type) == ["SECURITY", "MAINTAINABILITY", "MAINTAINABILITY", "PERFORMANCE", "MAINTAINABILITY"]
    assert _each(spark, ["CERTAIN", "LIKELY", "POSSIBLE", None], reports.clean_risk_confidence) == ["CERTAIN", "POSSIBLE", "POSSIBLE", None]


def test_cross_object_calls(spark):
    given = {"itemMapper.selectItems": True, "this.selectItems": False, "selectItems": False, "this.dao.save": True, ".x": True, "": False}
    assert _each(spark, list(given), c.is_cross_object_call) == list(given.values())
    assert _each(spark, [None], c.is_cross_object_call) == [False]
    assert _each(spark, ["itemMapper.selectItems", "this.a", "a(b.c)", "x.", "", None], c.normalised_method) == ["selectItems", "a", "c)", "x.", None, None]


def test_routes(spark):
    rows = [("UserDto", "class", 900, 30, None), ("userVO", "class", 900, 30, None), ("Kind", "enum", 900, 30, None), ("Api", "interface", 900, 30, False), ("Api", "interface", 900, 30, True), ("A", "class", 300, 8, None), ("A", "class", 800, 15, None), ("A", "class", 801, 15, None), ("A", "class", 300, 16, None), ("ModelX", "class", 900, 30, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, k string, loc int, m int, d boolean")
    got = [r[1] for r in df.select("i", c.route(F.col("n"), F.col("k"), F.col("loc"), F.col("m"), F.col("d"))).orderBy("i").collect()]
    assert got == ["SINGLE"] * 4 + ["MULTI"] + ["SINGLE"] * 2 + ["MULTI"] * 3


def test_comment_and_blank_lines(spark):
    given = {"\t// x": True, "\t": True, "": True, " \r": True, "\t * y": True, "/* z": True, "a // b": False, "\timport x;": False}
    assert _each(spark, list(given), c.is_comment_or_blank) == list(given.values())
    assert _each(spark, ["\timport x;"], c.is_import_comment_or_blank) == [True]


def _queue(seeds, edges, hops, per_node, total):
    """One method after another from a queue."""
    calls = collections.defaultdict(list)
    for caller, callee, line in sorted(edges, key=lambda e: (e[2], e[0])):
        calls[callee].append(caller)
    seen, found, queue = set(seeds), {}, collections.deque((s, 0, [s]) for s in sorted(seeds))
    while queue and len(found) < total:
        method, hop, path = queue.popleft()
        if hop >= hops:
            continue
        for caller in calls[method][:per_node]:
            if caller not in seen:
                seen.add(caller)
                found[caller] = (hop + 1, [*path, caller])
                queue.append((caller, hop + 1, [*path, caller]))
    return found


def test_capped_impact_equals_a_queue(spark):
    r = random.Random(3)
    for n, m, per_node, total in ((30, 120, 3, 10), (60, 600, 5, 200), (12, 40, 2, 3), (400, 2500, 30, 200)):
        edges = [(f"C{r.randrange(n):03}.m", f"C{r.randrange(n):03}.m", i) for i in range(m)]
        seeds = ["C000.m", "C001.m"]
        rows = [(a.split(".")[0], "m", b.split(".")[0], "m", "DIRECT", "f", line, None) for a, b, line in edges]
        seed = spark.createDataFrame([(s.split(".")[0], "m", [s]) for s in seeds], "class_name string, method_name string, path array<string>")
        got = impact.impacts(seed, spark.createDataFrame(rows, CALL_RECORDS), 3, per_node, total).collect()
        want = _queue(seeds, edges, 3, per_node, total)
        assert {f"{x.class_name}.{x.method_name}": (x.hop, x.path) for x in got} == want
        assert len(want) <= total + per_node - 1


def test_impact_may_pass_the_total_by_the_last_method_only(spark):
    rows = [(f"C{k:03}", "m", f"P{k // 30}", "m", "DIRECT", "f", k, None) for k in range(240)] + [(f"P{k}", "m", "A", "m", "DIRECT", "f", k, None) for k in range(8)]
    seed = spark.createDataFrame([("A", "m", ["A.m"])], "class_name string, method_name string, path array<string>")
    assert impact.impacts(seed, spark.createDataFrame(rows, CALL_RECORDS)).count() == 8 + 7 * 30


def test_reports_of_impact(spark, tmp_path):
    rows = [("a.BController", "b", "A", "a", "DIRECT", "f", 1, None)]
    seed = spark.createDataFrame([("A", "a", ["A.a"])], "class_name string, method_name string, path array<string>")
    got = impact.impacts(seed, spark.createDataFrame(rows, CALL_RECORDS))
    assert [r.line for r in impact.markdown(got).orderBy("at").collect()] == ["# Impact", "| package | direct | indirect | total |", "|-|-|-|-|", "| a | 1 | 0 | 1 |", "* 🔴 A.a → a.BController.b"]
    impact.write_impact(got, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/heat-map").first().total == 1 and spark.read.json(f"file://{tmp_path}/out/impact").count() == 1


def test_normalised_without_methods_drops_calls(spark):
    schema = "doc int, dependencies array<struct<name:string,type:string,line:string>>, keyMethods array<struct<name:string,line:string,calls:array<struct<target:string,line:string,type:string>>>>, risks array<struct<type:string,description:string,line:string>>"
    rows = [(1, [("run", "method_call", "3"), ("A", "x", "2")], [], []), (2, [("run", "method_call", "3"), ("run", "method_call", "3")], [("m", "1", None)], None), (3, None, None, None)]
    got = {r.doc: r for r in reports.normalised(spark.createDataFrame(rows, schema)).collect()}
    assert [d.name for d in got[1].dependencies] == ["a"] and got[1].keyMethods == []
    assert [(x.target, x.line) for x in got[2].keyMethods[0].calls] == [("run", 3)]
    assert got[3].dependencies is None and got[3].keyMethods is None


def test_timings(spark):
    ms = [49856, 39761, 108657, 44646, 668, 78468, 77128]
    r = aggregates.timings(spark.createDataFrame([(x,) for x in ms], "ms long")).first()
    assert (r.n, r.least, r.median, r.average, r.p90, r.most) == (7, 668, 49856, 57026, 108657, 108657)
    r = aggregates.timings(spark.createDataFrame([(x,) for x in (1, 1, 5, 9)], "ms long")).first()
    assert (r.median, r.average) == (5, 4)
    assert aggregates.timings(spark.createDataFrame([], "g string, ms long"), "g").count() == 0


def test_statistics_are_counted(spark):
    out = spark.createDataFrame([("p", "MODEL"), ("q", "odd"), ("r", None)], "package string, layer string")
    files = spark.createDataFrame([("p", "SERVICE"), ("p", None), ("p", "SERVICE")], "package string, layer string")
    said = spark.createDataFrame([("q", "nonsense"), ("r", "UTIL")], "package string, layer string")
    risks = spark.createDataFrame([("p", "HIGH"), ("p", "LOW"), ("r", "MEDIUM")], "package string, severity string")
    got = {r.package: (r.files, r.layer, r.high, r.medium) for r in aggregates.corrected_statistics(out, files, said, risks).collect()}
    assert got == {"p": (3, "SERVICE", 1, 0), "q": (0, "UNKNOWN", 0, 0), "r": (0, "UTIL", 0, 1)}


def test_strategies_and_summaries(spark, tmp_path):
    files = spark.createDataFrame([("big", f"f{i}") for i in range(11)] + [("small", f"f{i}") for i in range(10)], "package string, file string")
    assert {(r.package, r.strategy) for r in aggregates.with_strategy(files).collect()} == {("big", "GROUPED"), ("small", "DIRECT")}
    out = spark.createDataFrame([("a.b", "SERVICE", 2, 1, 0, "s", ["e"]), (None, "UTIL", 1, 0, 0, "t", None)], "package string, layer string, files int, high int, medium int, summary string, entries array<string>")
    aggregates.write_summaries(out, f"file://{tmp_path}/out")
    got = spark.read.option("wholetext", True).text(f"file://{tmp_path}/out/json").collect()
    assert [r.name for r in got] == ["a_b_package"] and json.loads(got[0].value)["files"] == 2


def test_tasks(spark):
    tasks = spark.createDataFrame([(1, "T", "a"), (2, "T", "a"), (3, "U", "bad"), (4, "T", None)], "task_id int, task_type string, input string")
    none = spark.createDataFrame([], "key string, output string")

    def call(text):
        if text == "bad":
            raise ValueError(text)
        return f"<{text}>"

    got = {r.task_id: (r.status, r.output, r.retries) for r in agents.executed(tasks, none, call, lambda out: out is not None).collect()}
    assert got == {1: ("COMPLETED", "<a>", 0), 2: ("COMPLETED", "<a>", 0), 3: ("SKIPPED", None, 1), 4: ("COMPLETED", "<None>", 0)}


def test_verdicts_that_fail_stay_open(spark):
    claims = spark.createDataFrame([("a",), ("b",)], "claim string")

    def broken(claim):
        raise ValueError("no verdict")

    assert {r.status for r in evidence.cross_verified(claims, broken).collect()} == {"PENDING"}
    assert {r.status for r in evidence.cross_verified(claims, broken, enabled=False).collect()} == {"SKIPPED"}


def test_answers(spark):
    empty = spark.createDataFrame([], CALL_RECORDS)
    assert json.loads(qa.callers(empty, "X", "m").first().json) == {"error": "no callers of X.m"}
    r = spark.createDataFrame([("X", [("m", [("t", "4", None)])])], "class string, methods array<struct<name:string,calls:array<struct<target:string,line:string,type:string>>>>")
    assert json.loads(qa.callees(r, "X", "m").first().json) == {"class": "X", "method": "m", "calleeCount": 1, "callees": [{"target": "t", "line": 4}]}
    assert "error" in json.loads(qa.callees(r, "X", "n").first().json) and "error" in json.loads(qa.callees(r, "Y").first().json)


def test_index_is_refreshed(spark):
    now = index.with_hash(spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "new")], "path string, content string"))
    meta = now.filter("path <> 'c'").select(F.col("path").alias("file_path"), F.when(F.col("path") == "b", "old").otherwise(F.col("file_hash")).alias("file_hash"))
    meta = meta.unionByName(spark.createDataFrame([("gone", "h")], "file_path string, file_hash string"))
    rows = meta.select("file_path", F.lit("kept").alias("v"))
    built = []
    fresh, after = index.refreshed(rows, meta, now, lambda f: built.append(f) or f.select(F.col("path").alias("file_path"), F.col("content").alias("v")))
    assert sorted((r.file_path, r.v) for r in fresh.collect()) == [("a", "kept"), ("b", "two"), ("c", "new")]
    assert sorted(r.path for r in built[0].collect()) == ["b", "c"] and after.count() == 3
    assert index.refreshed(fresh, after, now, lambda f: built.append(f) or f.select(F.col("path").alias("file_path"), F.col("content").alias("v")))[0].count() == 3 and built[1].count() == 0


def test_cache_names(spark):
    df = spark.createDataFrame([("a b/C.java", "m:1", "src", "prompt")], "n string, m string, s string, p string")
    name = df.select(stores.file_name(F.col("n"), F.col("m"), F.col("s"), F.col("p"))).first()[0]
    assert name.endswith("_a_b_C.java_m_1") and len(name.split("_")[0]) == 32
