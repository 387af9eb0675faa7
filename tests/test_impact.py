from pyspark.sql import functions as F

from factlake.operators import impact
from factlake.schemas import CALL_RECORDS, CHANGED_FILES


def _edges(spark, pairs, kind="DIRECT"):
    rows = [(a.split(".")[0], a.split(".")[1], b.split(".")[0], b.split(".")[1], kind, f"{a}.java", i, None) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, CALL_RECORDS)


def _change(spark, key="A.a", kind="MODIFIED", significance="HIGH", n=1):
    c, m = key.split(".")
    return spark.createDataFrame([(f"{c}{i}.java", c, "MODIFIED", significance, [(c, m, m, kind, None, 1, 1)]) for i in range(n)], CHANGED_FILES)


def _run(spark, edges, **more):
    got, note = impact.analyse(_change(spark, **more), edges)
    return got if got is None else {f"{r.class_name}.{r.method_name}": r for r in got.collect()}


def test_chain_levels_and_hops(spark):
    got = _run(spark, _edges(spark, [("B.b", "A.a"), ("C.c", "B.b"), ("D.d", "C.c"), ("E.e", "D.d")]))
    assert {k: (v.hop, v.level, v.confidence) for k, v in got.items()} == {"B.b": (1, "DIRECT", "HIGH"), "C.c": (2, "INDIRECT", "MEDIUM"), "D.d": (3, "INDIRECT", "MEDIUM")}
    assert got["D.d"].path == ["A.a", "B.b", "C.c", "D.d"]


def test_two_paths_cycles_and_repeated_records_once(spark):
    got = _run(spark, _edges(spark, [("B.b", "A.a"), ("C.c", "A.a"), ("D.d", "B.b"), ("D.d", "C.c"), ("A.a", "D.d"), ("B.b", "A.a")]))
    assert sorted(got) == ["B.b", "C.c", "D.d"] and got["D.d"].hop == 2


def test_confidence_by_call_type(spark):
    assert _run(spark, _edges(spark, [("B.b", "A.a")], "SPRING_INJECTION"))["B.b"].confidence == "MEDIUM"
    assert _run(spark, _edges(spark, [("B.b", "A.a")], "REFLECTION"))["B.b"].confidence == "LOW"


def test_added_low_and_deleted(spark):
    e = _edges(spark, [("B.b", "A.a")])
    assert not _run(spark, e, kind="ADDED") and not _run(spark, e, significance="LOW")
    assert _run(spark, e, kind="DELETED")["B.b"].path[0] == "A.a [DELETED]"


def test_caps_and_degradation(spark):
    e = _edges(spark, [(f"C{i}.m", "A.a") for i in range(40)])
    assert len(_run(spark, e)) == 30
    assert impact.analyse(_change(spark, n=51), e)[0] is None
    assert impact.analyse(_change(spark), None) == (None, "no call edges: file level only")


def test_summary_heat_map_and_paths(spark):
    got, _ = impact.analyse(_change(spark), _edges(spark, [("BController.b", "A.a"), ("CService.c", "BController.b")]))
    s = impact.summary(got).first()
    assert (s.direct, s.indirect, s.layers) == (1, 1, {"CONTROLLER": 1, "SERVICE": 1})
    assert [(r.package, r.total) for r in impact.heat_map(got).collect()] == [("(default)", 2)]
    assert [r.path for r in impact.high_risk_paths(got).collect()] == ["🔴 A.a → BController.b"]


def test_q16_package_layer_ties_and_shares(spark):
    rows = [("p", "MODEL")] + [("p", "SERVICE")] + [("q", x) for x in ("SERVICE", "HANDLER", "MODEL")] + [("r", "UTIL")] * 3 + [("r", "MODEL")]
    got = {r.package_name: r for r in impact.package_layers(spark.createDataFrame(rows, "package_name string, layer string")).collect()}
    assert got["p"].layer == "SERVICE" and got["p"].composition is None
    assert got["q"].layer == "UNKNOWN" and got["q"].composition == "33.3% SERVICE + 33.3% HANDLER + 33.3% MODEL"
    assert got["r"].layer == "UTIL"


def test_layers(spark):
    from factlake.functions.columns import layer_of

    rows = [("FooController", "x", []), ("Util", "x", []), ("FooUtil", "a.dto", []), ("Foo", "a.biz.b", []), ("FooListener", "x", ["Component"]), ("Foo", "x", ["Component"]), ("Foo", "servicex", [])]
    df = spark.createDataFrame(rows, "n string, p string, a array<string>")
    assert [r[0] for r in df.select(layer_of(F.col("n"), F.col("p"), F.col("a"))).collect()] == ["CONTROLLER", "UTIL", "MODEL", "SERVICE", "HANDLER", "UNKNOWN", "UNKNOWN"]
