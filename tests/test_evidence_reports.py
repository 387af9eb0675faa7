import datetime as dt
import json
import time

from pyspark.sql import functions as F

from factlake.operators import evidence, reports, stores
from factlake.schemas import CACHE_ENTRIES

SOURCE = ["class A {", "@Autowired", "private FooService foo;", "// comment", "", "@Mapper", "}"]


def _src(spark):
    return spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(SOURCE)], "doc string, line_number int, line string")


def test_r1_claims(spark):
    claims = [("d", 0, "3", "foo"), ("d", 1, "2", "foo"), ("d", 2, "4", "zzz"), ("d", 3, "1", "zzz"), ("d", 4, "99", "foo"), ("d", 5, "x", "foo"), ("d", 6, "6", "BarMapper"), ("d", 7, None, "foo")]
    got = {r.pos: (r.passed, r.issue) for r in evidence.checked_dependencies(spark.createDataFrame(claims, "doc string, pos int, line string, name string"), _src(spark)).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, "NAME_NOT_FOUND"), 4: (False, "OUT_OF_RANGE"), 5: (None, "BAD_LINE"), 6: (True, None), 7: (None, "BAD_LINE")}


def test_a10_and_offsets(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", None)], "doc string, passed boolean")
    assert {r.doc: r.confidence for r in evidence.overall_confidence(df).collect()} == {"a": "CERTAIN", "b": "MEDIUM", "c": "UNKNOWN"}
    c = spark.createDataFrame([("d", 0, 5, "foo"), ("d", 1, 5, "nothing")], "doc string, pos int, line int, name string")
    assert {r.pos: r.line_offset for r in evidence.nearest_offset(c, _src(spark)).collect()} == {0: -2, 1: None}


def test_owning_and_closest(spark):
    m = spark.createDataFrame([("d", "a", 10), ("d", "b", 20)], "doc string, name string, line int")
    i = spark.createDataFrame([("d", 0, 5), ("d", 1, 15), ("d", 2, 20), ("d", 3, None)], "doc string, pos int, line int")
    assert {r.pos: r.method for r in evidence.owning_method(i.filter("line is not null"), m).collect()} == {0: None, 1: "a", 2: "b"}
    assert {r.pos: r.method for r in evidence.closest_method(i, m).collect()} == {0: "a", 1: "a", 2: "b", 3: "a"}


def test_contradictions(spark):
    m = spark.createDataFrame([("d", "a", "HIGH", 2, ["b()", "this.c()", "a()"], ["x"]), ("d", "b", "HIGH", 8, [], ["z.c"]), ("d", "c", "HIGH", 0, [], [])], "doc string, name string, complexity string, complexity_value int, calls array<string>, called_by array<string>")
    assert [r.source for r in evidence.complexity_contradictions(m).collect()] == ["a"]
    c1 = {(r.source, r.target): (r.penalty, r.status) for r in evidence.call_contradictions(m).collect()}
    assert c1 == {("a", "b"): (-0.2, "CONTRADICTORY"), ("a", "c"): (0.0, "INCOMPLETE")}
    rep = spark.createDataFrame([("d", "LOW")], "doc string, overall_complexity string")
    c2 = evidence.summary_contradictions(rep, m)
    assert c2.count() == 1
    risks = spark.createDataFrame([("d", "a", 4), ("d", "b", 3)], "doc string, method string, line int")
    c3 = evidence.risk_contradictions(risks, _src(spark))
    assert [r.source for r in c3.collect()] == ["a"]
    every = c2.unionByName(c3).unionByName(evidence.call_contradictions(m)).unionByName(evidence.complexity_contradictions(m))
    s = evidence.contradiction_scores(every).first()
    assert abs(s.score - 0.8) < 1e-9 and s.methods == ["a"]
    scored = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.0)], "doc string, name string, score double")
    assert {r.name: r.score for r in evidence.injected(scored, every).collect()} == {"a": 0.1, "b": 0.1}


def test_votes_and_constraints(spark):
    v = spark.createDataFrame([(1, "我确认"), (1, "否认"), (1, "先否认后确认"), (2, "确认"), (2, "否认"), (3, "否认"), (4, "yes, no doubt"), (4, None)], "claim_id int, vote string")
    assert {r.claim_id: (r.yes, r.no, r.status) for r in evidence.voted(v).collect()} == {1: (2, 1, "PASSED"), 2: (1, 1, "PENDING"), 3: (0, 1, "REJECTED"), 4: (0, 0, "PENDING")}
    assert {r.claim_id: r.status for r in evidence.voted(v, "yes", "no").collect()}[4] == "PASSED"
    c = spark.createDataFrame([("Foo.bar(x) is called",), ("Foo.baz() too",), ("nothing",)], "claim string")
    assert [r.status for r in evidence.constraint_checked(c, ["must call Foo.bar() first"]).collect()] == ["PASSED", "REJECTED", "PENDING"]


def test_json_repair(spark):
    assert json.loads(reports.repaired('{"a": "x\ny"}')) == {"a": "x\ny"}
    assert json.loads(reports.repaired('{"a": "say "hi" now", "b": 1}')) == {"a": 'say "hi" now', "b": 1}
    assert reports.repaired('{"m":[{"a":1},{"b":2,"c":3') == '{"m":[{"a":1}]}'
    assert reports.repaired('{"a":{"b":1},"c":"cut of') == '{"a":{"b":1}}'
    assert reports.repaired('{"a": {"k": "}"}, "b": [1, {"c": "d"') == '{"a": {"k": "}"}}'
    assert reports.repaired('{"a": "x\ty", "m": [{"n": "say "hi" now"}, {"o": "p') == '{"a": "x\\ty", "m": [{"n": "say \\"hi\\" now"}]}'
    for same in ("no json", "12", '"text"', "", "  ", '{"a": ', None, '{"a": [1, 2], "b": }'):
        assert reports.repaired(same) == same
    assert list(reports.objects_in('x {"a": 1} y {"b": 2} {')) == [{"a": 1}, {"b": 2}]
    began = time.perf_counter()
    reports.repaired('{"m": [' + '{"a": "x "q" y", "n": {"b": "c"}}, ' * 100_000)
    assert time.perf_counter() - began < 20


def test_json_escapes(spark):
    from factlake.functions import columns

    text = 'a"b\\c\nd\re\tf' + "".join(map(chr, (1, 8, 12, 31))) + "é/😀"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(columns.json_escaped(F.col("t")).alias("e")).collect()
    assert [x.e for x in got] == ['a\\"b\\\\c\\nd\\re\\tf\\u0001\\u0008\\u000c\\u001fé/😀', "", ""]


def test_reports(spark):
    raw = [("d", json.dumps({"class": "A", "overall_complexity": "LOW", "methods": [{"name": "m", "line": 3, "calls": [{"target": "b.run", "line": "4"}, {"target": "this.x", "line": 5}], "risks": [{"description": "[FACT] r", "line": 9}]}], "risks": [{"description": f"t{i}"} for i in range(4)]})), ("bad", "no json")]
    r = reports.read_reports(spark.createDataFrame(raw, "doc string, json string")).cache()
    assert r.filter("doc = 'd'").first().methods[0].line == "3" and r.filter("doc = 'bad'").first()["class"] is None
    assert reports.dependencies_of(r.filter("doc = 'd'")).first().dependencies == ["b.run"]
    s = reports.class_summary(r.filter("doc = 'd'")).first()
    assert (s.n_methods, s.n_risks, s.texts) == (1, 5, ["t0", "t1", "t2", "[FACT] r"])
    assert sorted((x.kind, x.claim, x.confidence) for x in reports.dependency_claims(r).collect()) == [("CALL", "b.run", "MEDIUM"), ("CALL", "this.x", "MEDIUM"), ("RISK", "[FACT] r", "HIGH")]


def test_findings_from_one_reading(spark):
    call, by = (lambda *xs: [{"target": x} for x in xs]), (lambda *xs: [{"caller": x} for x in xs])
    first = {"overall_complexity": "low", "methods": [
        {"name": "a", "complexity": " high ", "complexity_value": "2", "calls": call("b(1, 2)", "this.b", "this.c", "a", "dao.b", "nowhere", None, ""), "called_by": by("x.y")},
        {"name": "b", "complexity": "HIGH", "complexity_value": 8, "calls": call("a"), "called_by": by("x.c", "z.d()")},
        {"name": "b", "complexity": "HIGH", "called_by": by("q.a", None)},
        {"name": "c", "complexity": "HIGH", "complexity_value": "many", "calls": [], "called_by": []},
        {"name": None, "complexity": "MEDIUM", "complexity_value": 9, "calls": call("b")},
        {"name": "d", "calls": call("b")},
    ]}
    cut = '{"overall_complexity": "LOW", "methods": [{"name": "e", "complexity": "LOW", "complexity_value": 8}, {"name": "f'
    raw = [("1", json.dumps(first)), ("2", cut), ("3", "no json"), ("4", None), ("5", '{"methods": []}'), (None, json.dumps(first))]
    r = reports.read_reports(spark.createDataFrame(raw, "doc string, json string")).cache()
    got = evidence.contradictions(r)
    assert got.columns == ["doc", "source", "target", "rule", "severity", "penalty", "status", "rule_order"]
    c4 = lambda doc, name: (doc, name, None, "C4", "LOW", -0.1, "CONTRADICTORY", 2)
    c1 = lambda a, b: ("1", a, b, "C1", "MEDIUM", -0.2, "CONTRADICTORY", 4)
    wanted = [c4("1", "a"), c4("1", None), c4("2", "e"), c4(None, "a"), c4(None, None), ("1", None, None, "C2", "HIGH", -0.3, "CONTRADICTORY", 3)]
    wanted += [c1("a", "b"), c1("b", "a"), c1("d", "b"), ("1", "a", "c", "C1", "MEDIUM", 0.0, "INCOMPLETE", 4)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    m = r.select("doc", F.explode("methods").alias("m")).select("doc", "m.name", "m.complexity", F.col("m.complexity_value").try_cast("int").alias("complexity_value"), F.col("m.calls.target").alias("calls"), F.array_compact(F.col("m.called_by.caller")).alias("called_by"))
    united = evidence.united(C4=evidence.complexity_contradictions(m), C2=evidence.summary_contradictions(r, m), C1=evidence.call_contradictions(m))
    assert sorted(map(repr, united.collect())) == sorted(map(repr, got.collect()))


def test_reports_are_read_once(spark):
    from factlake.plans import QUERIES

    plan = QUERIES["a9_report_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("parseJson("), plan.count("ArrowEvalPython"), plan.count("Relation [")) == (1, 1, 1, 1)
    assert "repair_json(CASE WHEN" in plan  # whole texts stay out of Python
    assert "RepartitionByExpression [c_custkey" in plan  # a small file gives long texts


def test_clean_dependencies(spark):
    df = spark.range(1).select(F.expr("array(named_struct('name', 'com.x.IOrderService', 'type', 'odd', 'line', '12'), named_struct('name', 'StringUtils', 'type', 'field', 'line', '1'), named_struct('name', 'Bar.go()', 'type', 'field', 'line', '2'), named_struct('name', 'Baz', 'type', 'field', 'line', 'x'))").alias("d"))
    got = df.select(reports.clean_dependencies(F.col("d")).alias("d")).first().d
    assert [(x.name, x.type) for x in got] == [("bar", "field"), ("orderService", "field"), ("baz", "field")]


def test_groups(spark):
    g = spark.createDataFrame([(0, "g1", "a"), (1, "g2", "a"), (1, "g2", "b")], "pos int, name string, file string")
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert {r.file: r.name for r in reports.grouped_files(g, f).collect()} == {"a": "g1", "b": "g2", "c": "(rest)"}
    m = spark.createDataFrame([("p", 1, 2, 1, 1, 0, ["c", "d", "e"], "two"), ("p", 0, 3, 1, 1, 1, ["a", "b", "x"], "one")], "package string, pos int, files int, classes int, methods int, risks int, entries array<string>, text string")
    r = reports.merged_groups(m).first()
    assert (r.files, r.entries, r.text) == (5, ["a", "b", "x", "c", "d"], "one；two")


def test_cache(spark):
    now = dt.datetime(2026, 1, 10)
    e = spark.createDataFrame([("k1", "T", "h", "m", "o", dt.datetime(2026, 1, 9), dt.datetime(2026, 1, 9), ["Foo"]), ("k2", "U", "h", "m", "o", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2), None)], CACHE_ENTRIES)
    assert [r.key for r in stores.alive(e, F.lit(now)).collect()] == ["k1"]
    assert [r.key for r in stores.kept_recent(e, 1).collect()] == ["k1"]
    assert [r.key for r in stores.invalidated(e, "src/Foo.java").collect()] == ["k2"]
    assert stores.put(e, e.withColumn("created_at", F.lit(now))).count() == 2
    assert [r.key for r in stores.looked_up(e, task_type="U").collect()] == ["k2"] and stores.evicted(e, "k1").count() == 1
    assert stores.table_or_empty(spark, "/tmp/no-such-table-here", CACHE_ENTRIES).count() == 0
