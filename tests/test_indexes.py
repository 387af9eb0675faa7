"""Stored indexes: look-ups against scans, and upkeep against a rebuild after random refreshes."""

import collections
import random
import re

from pyspark.sql import functions as F

from factlake.operators import evidence, facts, impact, indexes

TERM = "term string, term_type string, file_path string, line_number int"
NAMES = ["OrderService.create", "orderservice", "Order", "a.b", "x", "", "Été.wort", "promo", "PROMO.code", "ab", "order.Promo", "%_.x"]


def some_terms(r, n, files):
    return [(r.choice([*NAMES, f"T{r.randrange(40)}.m{r.randrange(5)}", None]), "CALLEE", f"F{r.choice(files)}", r.randrange(50)) for _ in range(n)]


def found(index, text, where):
    return collections.Counter(tuple(x) for x in indexes.matching(index, text, where).collect())


def scanned(rows, text, where):
    test = {"start": str.startswith, "end": str.endswith, "anywhere": str.__contains__}[where]
    return collections.Counter(x for x in rows if x[0] is not None and test(x[0].lower(), text.lower()))


def test_term_index_is_a_scan_after_any_refresh(spark):
    r = random.Random(2)
    rows = some_terms(r, 300, range(12))
    index = indexes.term_index(spark.createDataFrame(rows, TERM), buckets=8)
    for step in range(4):
        if step:
            again = [f"F{f}" for f in r.sample(range(14), 3)]  # some are new
            old = [x for x in rows if x[2] in again]
            fresh = [x for x in some_terms(r, 30, [f[1:] for f in again[: 3 - (step == 3)]])]
            rows = [x for x in rows if x[2] not in again] + fresh
            index = indexes.with_files(index, spark.createDataFrame(old, TERM), spark.createDataFrame(fresh, TERM))
        for text, where in (("promo", "anywhere"), (".CREATE", "end"), ("order", "start"), ("t1", "start"), ("a", "anywhere"), ("", "anywhere"), ("été", "start"), ("%_.", "anywhere"), ("none of them", "anywhere"), ("x", "end")):
            assert found(index, text, where) == scanned(rows, text, where), (step, text, where)
    wanted = {x[0] for x in rows if x[0] is not None}
    assert {x.term for x in index.grams.rows().select("term").distinct().collect()} == wanted - {""}  # which holds no run
    rebuilt = indexes.term_index(spark.createDataFrame(rows, TERM), buckets=8)
    assert sorted(map(tuple, index.grams.rows().collect())) == sorted(map(tuple, rebuilt.grams.rows().collect()))


def test_look_ups_read_few_buckets_and_old_versions_stay(spark):
    r = random.Random(3)
    rows = [(f"Name{i}.call", "CALLEE", f"F{i % 5}", i) for i in range(400)]
    index = indexes.term_index(spark.createDataFrame(rows, TERM), buckets=32)
    one = indexes.matching(index, "Name317.call", "start")
    assert [x.line_number for x in one.collect()] == [317] and len(one.inputFiles()) <= 4 * indexes.SPREAD
    before = index.rows.rows()
    later = indexes.with_files(index, spark.createDataFrame(rows[:1], TERM), spark.createDataFrame([], TERM))
    assert before.count() == 400 and later.rows.rows().count() == 399
    assert sum(a != b for a, b in zip(index.rows.paths, later.rows.paths)) == 1
    empty = indexes.term_index(spark.createDataFrame([], TERM), buckets=4)
    assert indexes.matching(empty, "abc").count() == 0
    r.shuffle(rows)
    assert indexes.with_files(empty, spark.createDataFrame([], TERM), spark.createDataFrame(rows, TERM)).rows.rows().count() == 400


OPS = "table_name string, sql_type string, mapper_interface string, source_file string"


def test_counts_are_a_rebuild_after_random_refreshes(spark):
    r = random.Random(5)
    some = lambda files, n: [(f"t{r.randrange(4)}", r.choice(["SELECT", "UPDATE"]), f"com.a.m{r.randrange(4)}.M{r.randrange(6)}", r.choice(files)) for _ in range(n)]
    files = [f"f{i}" for i in range(8)]
    rows = some(files, 200)
    counts = indexes.operation_counts(spark.createDataFrame(rows, OPS), buckets=4)
    for _ in range(4):
        again = r.sample(files, 2)
        old, fresh = [x for x in rows if x[3] in again], some(again, r.choice([0, 5, 40]))
        rows = [x for x in rows if x[3] not in again] + fresh
        counts = indexes.with_operations(counts, spark.createDataFrame(old, OPS), spark.createDataFrame(fresh, OPS))
        now = spark.createDataFrame(rows, OPS)
        tupled = lambda df: sorted(map(tuple, df.select("table_name", "sql_type", "operations", "mappers", "mappers_max", "mappers_distinct").collect()))
        assert tupled(indexes.stats_of(counts.rows())) == tupled(facts.table_stats(now))
        shared = lambda df: sorted((x.table_name, x.modules) for x in facts.shared_tables(df).collect())
        assert shared(counts.rows()) == shared(now)
        sharing = lambda df: [tuple(x) for x in facts.table_sharing(df).collect()]
        assert sharing(counts.rows()) == sharing(now)


def test_edges_are_not_shuffled(spark):
    r = random.Random(7)
    name = lambda: f"com.p{r.randrange(3)}.C{r.randrange(20)}"
    rows = [(name(), f"m{r.randrange(3)}", name(), f"m{r.randrange(3)}", "DIRECT", "f", i) for i in range(2000)]
    edges = spark.createDataFrame(rows, "caller_class string, caller_method string, callee_class string, callee_method string, call_type string, file_path string, line_number int")
    store = indexes.edge_store(edges)
    seed = spark.createDataFrame([("com.p1.C3", "m1", ["com.p1.C3.m1"])], "class_name string, method_name string, path array<string>")
    key = lambda df: sorted((x.class_name, x.method_name, x.hop) for x in df.collect())
    assert key(impact.impacts(seed, store.by_callee, total=None, per_node=None)) == key(impact.impacts(seed, edges, total=None, per_node=None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hop = seed.join(store.by_callee, (F.col("callee_class") == F.col("class_name")) & (F.col("callee_method") == F.col("method_name")))
        plan = hop._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the frontier's
    one = facts.calls_by(store.calls("callee", "com.p1.C3", "m1"), "callee", "com.p1.C3", "m1")
    assert len(one.inputFiles()) == 1 < len(store.by_callee.inputFiles())
    assert store.calls("callee", "nobody", "m").filter("callee_class = 'nobody'").count() == 0
    want = sorted((x[6], x[0]) for x in rows if x[2:4] == ("com.p1.C3", "m1"))
    assert [(x.line_number, x.caller_class) for x in one.collect()] == want


def test_constraints_by_brute_force(spark):
    r = random.Random(9)
    call = lambda: f"{r.choice(['Foo', 'oo', 'a.Foo', 'Bar', 'o'])}.{r.choice(['go', 'run'])}"
    constraints = [f"must call {call()}() before {call()}()" for _ in range(4)] + ["Bar.run(x) only", None]
    claims = [" and ".join(f"{call()}({r.choice(['', 'x', 'a, b'])})" for _ in range(r.randrange(4))) for _ in range(120)] + [None, "", "Foo.go"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(claims)], "id int, claim string")
    table = spark.createDataFrame([(c,) for c in constraints], "constraint string")

    def status(claim):
        names = [f"{m}()" for m in re.findall(r"(\w+\.\w+)\([^)]*\)", claim or "")]
        return "PENDING" if not names else "PASSED" if all(any(n in c for c in constraints if c) for n in names) else "REJECTED"

    got = {x.id: x.status for x in evidence.constraint_checked(df, table).collect()}
    assert got == {i: status(c) for i, c in enumerate(claims)}
    assert {x.status for x in evidence.constraint_checked(df, table.limit(0)).collect()} <= {"PENDING", "REJECTED"}
