"""Queries over JSON reports, their clean-up, the rules and look-ups on them, each with SQL that reads the JSON by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import columns as c
from factlake.operators import agents, aggregates, evidence, qa, reports, stores
from factlake.plans.queries import _LINES, _classes, _ops, _query, _src, _t
from factlake.schemas import REPORT
from factlake.sources.views import view

_REP = ("report_texts",)
_DEP = "struct<name:string, type:string, line:string>"
_FLAT = f"class string, architecture_issues string, dependencies array<{_DEP}>, keyMethods array<struct<name:string, line:string, calls:array<struct<target:string, line:string, type:string>>>>, risks array<struct<type:string, description:string, line:string, confidence:string>>"
_TAGGED = "methods array<struct<name:string, calls:array<struct<target:string, tag:string>>, risks:array<struct<description:string, tag:string>>>>"
#: members of each report as rows: methods with their index, calls, risks
_M = r""", m AS (SELECT doc, i AS mp, x.m ->> 'name' AS name, x.m ->> 'complexity' AS complexity, TRY_CAST(x.m ->> 'complexity_value' AS INT) AS v, x.m AS m FROM (SELECT doc, unnest(from_json(json -> 'methods', '["json"]')) AS m, generate_subscripts(from_json(json -> 'methods', '["json"]'), 1) - 1 AS i FROM report_texts) x),
mc AS (SELECT doc, mp, name, CAST(generate_subscripts(from_json(m -> 'calls', '["json"]'), 1) - 1 AS INT) AS pos, unnest(from_json(m -> 'calls', '["json"]')) AS x FROM m),
mr AS (SELECT doc, mp, name, CAST(generate_subscripts(from_json(m -> 'risks', '["json"]'), 1) - 1 AS INT) AS pos, unnest(from_json(m -> 'risks', '["json"]')) AS x FROM m),
tr AS (SELECT doc, CAST(generate_subscripts(from_json(json -> 'risks', '["json"]'), 1) - 1 AS INT) AS pos, unnest(from_json(json -> 'risks', '["json"]')) AS x FROM report_texts),
dep AS (SELECT doc, CAST(generate_subscripts(from_json(json -> 'dependencies', '["json"]'), 1) - 1 AS INT) AS pos, unnest(from_json(json -> 'dependencies', '["json"]')) AS x FROM report_texts),
km AS (SELECT doc, CAST(generate_subscripts(from_json(json -> 'keyMethods', '["json"]'), 1) - 1 AS INT) AS pos, unnest(from_json(json -> 'keyMethods', '["json"]')) AS x FROM report_texts) """
_TOOLS = "'(?i)(StringUtil|BeanUtil|BigDecimalUtil|DateUtils|JSONUtil|ListUtil|MapUtil|CollectionUtils|Arrays|Collections|IBaseService|BaseMapper|ServiceImpl|MapperImpl)'"


def _raw(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "report_texts").withColumn("doc", F.col("doc").cast("long"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    return reports.read_reports(_raw(s, d))


def _flat(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("doc", F.from_json("json", _FLAT).alias("r")).select("doc", "r.*")


def _methods(s: SparkSession, d: str) -> DataFrame:
    """doc, name, complexity, complexity_value, calls (targets) and called_by (callers) of every method."""
    m = _reports(s, d).select("doc", F.explode("methods").alias("m"))
    names = lambda a, f: F.transform(f"m.{a}", lambda x: x[f])
    return m.select("doc", "m.name", "m.complexity", F.col("m.complexity_value").try_cast("int").alias("complexity_value"), names("calls", "target").alias("calls"), names("called_by", "caller").alias("called_by"))


@_query("n4_repaired_json", r""", w AS (SELECT doc, text, regexp_replace(text, '[^}\]]*$', '') AS whole FROM broken_json)
SELECT doc, CASE WHEN json_valid(text) OR NOT contains(text, '{') THEN text WHEN contains(text, chr(10)) THEN replace(replace(text, chr(10), '\n'), chr(9), '\t') WHEN json_valid(regexp_replace(text, '([a-z]) "(\w+)" ', '\1 \\"\2\\" ')) THEN regexp_replace(text, '([a-z]) "(\w+)" ', '\1 \\"\2\\" ')
  ELSE whole || repeat(']', len(whole) - len(replace(whole, '[', '')) - len(whole) + len(replace(whole, ']', ''))) || repeat('}', len(whole) - len(replace(whole, '{', '')) - len(whole) + len(replace(whole, '}', ''))) END AS json FROM w""", ("broken_json",))
def _(s, d):
    return view(s, d, "broken_json").select("doc", reports.repair_json(F.col("text")).alias("json"))


@_query("n5_n7_read_methods", _M + "SELECT doc, name, m ->> 'line' AS line, complexity, CAST(v AS VARCHAR) AS complexity_value, CAST(json_array_length(m -> 'calls') AS INT) AS calls FROM m", _REP)
def _(s, d):
    m = _reports(s, d).select("doc", F.explode("methods").alias("m"))
    return m.select("doc", "m.name", "m.line", "m.complexity", "m.complexity_value", F.size("m.calls").alias("calls"))


@_query("n5_objects_in_text", "SELECT event_id, unnest([event_type, 'tail']) AS k FROM events")
def _(s, d):
    text = F.concat(F.lit("noise } "), F.to_json(F.struct(F.col("event_type").alias("k"))), F.lit(' and {"k": "tail"} {"k": '))
    return reports.objects_of(_t(s, d, "events").select("event_id", text.alias("text")), "text").select("event_id", F.col("object")["k"].alias("k"))


_NAME = r"lower(substr(regexp_replace(regexp_extract(p, '([^.]*)$', 1), '^I([A-Z])', '\1'), 1, 1)) || substr(regexp_replace(regexp_extract(p, '([^.]*)$', 1), '^I([A-Z])', '\1'), 2)"
_PLAIN = r"CASE WHEN n LIKE '%(%' THEN regexp_replace(regexp_replace(n, '\(.*$', ''), '\.[^.]*$', '') ELSE n END"


@_query("c8_dependency_names", f"SELECT doc, pos, {_NAME} AS name FROM (SELECT doc, pos, {_PLAIN} AS p FROM (SELECT doc, pos, x ->> 'name' AS n FROM dep) y) z".replace("SELECT doc, pos, lower", _M + "SELECT doc, pos, lower", 1), _REP)
def _(s, d):
    return _flat(s, d).select("doc", F.posexplode("dependencies").alias("pos", "x")).select("doc", "pos", c.dependency_name(F.col("x.name")).alias("name"))


@_query("n1_n3_p21_c9_clean_dependencies", _M + f""", f AS (SELECT doc, pos, {_NAME} AS name, type, line FROM (SELECT doc, pos, {_PLAIN} AS p, type, line FROM (SELECT doc, pos, x ->> 'name' AS n, x ->> 'type' AS type, x ->> 'line' AS line FROM dep WHERE NOT contains(coalesce(x ->> 'type', ''), 'method_call')) y) z)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY coalesce(TRY_CAST(line AS INT), 2147483647), pos) - 1 AS INT) AS at, name, CASE WHEN type IN ('field', 'method_call') THEN type ELSE 'field' END AS type, line FROM f WHERE NOT regexp_matches(name, {_TOOLS})""", _REP)
def _(s, d):
    out = reports.normalised(_flat(s, d)).select("doc", F.posexplode("dependencies").alias("at", "x"))
    return out.select("doc", "at", "x.name", "x.type", "x.line")


@_query("n1_n2_j6_moved_calls", _M + r""", k AS (SELECT doc, pos, x ->> 'name' AS name, TRY_CAST(x ->> 'line' AS INT) AS l FROM km),
mv AS (SELECT doc, pos, x ->> 'name' AS target, TRY_CAST(x ->> 'line' AS INT) AS line FROM dep WHERE contains(coalesce(x ->> 'type', ''), 'method_call')),
own AS (SELECT mv.*, CASE WHEN line IS NULL THEN 0 ELSE coalesce((SELECT arg_max(k.pos, k.l * 100 + k.pos) FROM k WHERE k.doc = mv.doc AND k.l <= mv.line), (SELECT arg_min(k.pos, abs(k.l - mv.line) * 100 + k.pos) FROM k WHERE k.doc = mv.doc AND k.l IS NOT NULL)) END AS owner FROM mv)
SELECT k.doc, k.name AS method, target, line, type FROM k JOIN (SELECT doc, owner, target, line, 'method_call' AS type FROM own UNION ALL SELECT doc, pos, 'z', -1, 'unknown' FROM km WHERE (x -> 'calls') IS NOT NULL) o ON o.doc = k.doc AND o.owner = k.pos""", _REP)
def _(s, d):
    m = reports.normalised(_flat(s, d)).select("doc", F.explode("keyMethods").alias("m"))
    return m.select("doc", F.col("m.name").alias("method"), F.explode("m.calls").alias("x")).select("doc", "method", "x.target", "x.line", "x.type")


@_query("n1_c9_t4_clean_risks", _M + "SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY coalesce(TRY_CAST(x ->> 'line' AS INT), 2147483647), pos) - 1 AS INT) AS at, CASE WHEN x ->> 'type' IN ('SECURITY', 'PERFORMANCE', 'MAINTAINABILITY') THEN x ->> 'type' ELSE 'MAINTAINABILITY' END AS type, x ->> 'description' AS description FROM tr", _REP)
def _(s, d):
    return reports.normalised(_flat(s, d)).select("doc", F.posexplode("risks").alias("at", "x")).select("doc", "at", "x.type", "x.description")


@_query("c9_risk_confidence", _M + "SELECT doc, mp, CASE WHEN x ->> 'confidence' IS NOT NULL THEN CASE WHEN x ->> 'confidence' IN ('CERTAIN', 'POSSIBLE') THEN x ->> 'confidence' ELSE 'POSSIBLE' END END AS confidence FROM (SELECT doc, CAST(mp AS INT) AS mp, x FROM mr UNION ALL SELECT doc, -1, x FROM tr) y", _REP)
def _(s, d):
    r = _reports(s, d)
    of = r.select("doc", F.posexplode("methods").alias("mp", "m")).select("doc", "mp", F.explode("m.risks").alias("x"))
    every = of.unionByName(r.select("doc", F.lit(-1).alias("mp"), F.explode("risks").alias("x")))
    return every.select("doc", "mp", reports.clean_risk_confidence(F.col("x.confidence")).alias("confidence"))


@_query("p20_cross_object_calls", _M + r", t AS (SELECT doc, mp, pos, x ->> 'target' AS t FROM mc) SELECT doc, mp, pos, t LIKE '%.%' AND regexp_replace(t, '\.[^.]*$', '') <> 'this' AS cross_object, regexp_extract(t, '([^.]*)$', 1) AS method FROM t", _REP)
def _(s, d):
    t = _reports(s, d).select("doc", F.posexplode("methods").alias("mp", "m")).select("doc", F.col("mp").cast("long").alias("mp"), F.posexplode("m.calls").alias("pos", "x"))
    return t.select("doc", "mp", "pos", c.is_cross_object_call(F.col("x.target")).alias("cross_object"), c.normalised_method(F.col("x.target")).alias("method"))


@_query("g5_dependencies", _M + r""", t AS (SELECT doc, x ->> 'target' AS t, min(mp * 100 + pos) AS o FROM mc GROUP BY ALL)
SELECT doc, string_agg(t, ',' ORDER BY o) AS dependencies FROM t WHERE t LIKE '%.%' AND regexp_replace(t, '\.[^.]*$', '') <> 'this' GROUP BY doc""", _REP)
def _(s, d):
    return reports.dependencies_of(_reports(s, d)).withColumn("dependencies", F.array_join("dependencies", ","))


@_query("n12_tagged_claims", _M + "SELECT doc, 'method_call' AS kind, x ->> 'target' AS claim, CASE WHEN x ->> 'tag' = '[FACT]' THEN 'HIGH' ELSE 'LOW' END AS confidence FROM mc UNION ALL SELECT doc, 'risk', x ->> 'description', CASE WHEN x ->> 'tag' = '[FACT]' THEN 'HIGH' ELSE 'LOW' END FROM mr", _REP)
def _(s, d):
    r = _raw(s, d).select("doc", F.from_json("json", _TAGGED).alias("r")).select("doc", "r.*")
    return reports.tagged_claims(r, "LOW").select("doc", "kind", "claim", "confidence")


@_query("n12_flat_claims", _M + "SELECT doc, 'key_method' AS kind, pos, x ->> 'name' AS claim, 'MEDIUM' AS confidence FROM km UNION ALL SELECT doc, 'dependency', pos, x ->> 'name', 'MEDIUM' FROM dep UNION ALL SELECT doc, 'risk', pos, x ->> 'description', 'MEDIUM' FROM tr", _REP)
def _(s, d):
    return reports.flat_claims(_flat(s, d), "MEDIUM")


@_query("p23_verified_levels", _M + "SELECT doc, mp, pos, (x ->> 'tag') IS NOT NULL AS ok FROM mc", _REP)
def _(s, d):
    r = _raw(s, d).select("doc", F.from_json("json", _TAGGED).alias("r")).select("doc", "r.*")
    claims = reports.tagged_claims(r, "LOW").filter("kind = 'method_call'")
    return claims.select("doc", F.col("mp").cast("long").alias("mp"), "pos", c.should_verify(F.col("confidence"), "MEDIUM").alias("ok"))


@_query("a14_class_summary", _M + """, texts AS (SELECT doc, 0 AS g, pos AS o, x ->> 'description' AS t FROM tr WHERE pos < 3 UNION ALL SELECT doc, 1, mp * 100 + pos, x ->> 'description' FROM mr)
SELECT doc, CAST(3 AS INT) AS n_methods, CAST((SELECT count(*) FROM tr WHERE tr.doc = r.doc) + (SELECT count(*) FROM mr WHERE mr.doc = r.doc) AS INT) AS n_risks, (SELECT string_agg(t, '|' ORDER BY g, o) FROM texts WHERE texts.doc = r.doc) AS texts, CAST(json ->> 'contradiction_count' AS INT) AS contradiction_count FROM report_texts r""", _REP)
def _(s, d):
    r = _raw(s, d).select("doc", F.from_json("json", REPORT + ", contradiction_count string").alias("r")).select("doc", "r.*")
    return reports.class_summary(r).withColumn("texts", F.array_join("texts", "|"))


_C4 = "SELECT doc, name AS source, NULL AS target, 'C4' AS rule, 'LOW' AS severity, CAST(-0.1 AS DOUBLE) AS penalty, 'CONTRADICTORY' AS status FROM m WHERE v > 0 AND ((upper(complexity) = 'HIGH' AND v <= 3) OR (upper(complexity) = 'LOW' AND v >= 8) OR (upper(complexity) = 'MEDIUM' AND v NOT BETWEEN 4 AND 6))"
_C2 = "SELECT r.doc, NULL AS source, NULL AS target, 'C2' AS rule, 'HIGH' AS severity, CAST(-0.3 AS DOUBLE) AS penalty, 'CONTRADICTORY' AS status FROM report_texts r JOIN m USING (doc) WHERE r.json ->> 'overall_complexity' = 'LOW' GROUP BY r.doc HAVING avg(CASE WHEN upper(complexity) = 'HIGH' THEN 1.0 ELSE 0 END) >= 0.5"
_C1 = r"""SELECT a.doc, a.name AS source, a.t AS target, 'C1' AS rule, 'MEDIUM' AS severity, CAST(CASE WHEN json_array_length(b.m -> 'called_by') = 0 THEN 0 ELSE -0.2 END AS DOUBLE) AS penalty, CASE WHEN json_array_length(b.m -> 'called_by') = 0 THEN 'INCOMPLETE' ELSE 'CONTRADICTORY' END AS status
FROM (SELECT DISTINCT doc, name, regexp_replace(regexp_replace(x ->> 'target', '^this\.', ''), '\(.*$', '') AS t FROM mc WHERE NOT (x ->> 'target' LIKE '%.%' AND regexp_replace(x ->> 'target', '\.[^.]*$', '') <> 'this')) a JOIN m b ON b.doc = a.doc AND b.name = a.t
WHERE a.name <> a.t AND NOT list_contains(list_transform(from_json(b.m -> 'called_by', '["json"]'), lambda j: regexp_extract(j ->> 'caller', '([^.]*)$', 1)), a.name)"""


def _findings(s: SparkSession, d: str) -> DataFrame:
    raw = view(s, d, "report_texts", dealt_by="c_custkey").withColumn("doc", F.col("doc").cast("long"))
    return evidence.contradictions(reports.read_reports(raw))


@_query("r4_complexity_contradictions", _M + _C4, _REP)
def _(s, d):
    return evidence.complexity_contradictions(_methods(s, d))


@_query("r5_summary_contradictions", _M + _C2, _REP)
def _(s, d):
    return evidence.summary_contradictions(_reports(s, d), _methods(s, d))


@_query("r6_j8_call_contradictions", _M + _C1, _REP)
def _(s, d):
    return evidence.call_contradictions(_methods(s, d))


@_query("u3_united_findings", _M + f"SELECT doc, source, target, rule, severity, penalty, status, CAST(CASE rule WHEN 'C4' THEN 2 WHEN 'C2' THEN 3 ELSE 4 END AS INT) AS rule_order FROM ({_C4} UNION ALL {_C2} UNION ALL {_C1}) u", _REP)
def _(s, d):
    return _findings(s, d)


@_query("a9_report_scores", _M + f"SELECT doc, least(1.0, round(sum(CASE severity WHEN 'HIGH' THEN 0.3 WHEN 'MEDIUM' THEN 0.15 ELSE 0.05 END), 6))::DOUBLE AS score, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS methods FROM ({_C4} UNION ALL {_C2} UNION ALL {_C1}) u WHERE status = 'CONTRADICTORY' GROUP BY doc", _REP)
def _(s, d):
    return evidence.contradiction_scores(_findings(s, d)).withColumn("methods", F.array_join("methods", ","))


@_query("j10_injected_scores", _M + f""", u AS (SELECT * FROM ({_C4} UNION ALL {_C1}) y WHERE status = 'CONTRADICTORY')
SELECT m.doc, m.name, greatest(0.1, v / 10.0 + coalesce((SELECT sum(penalty) FROM u WHERE u.doc = m.doc AND u.source = m.name), 0))::DOUBLE AS score, coalesce((SELECT string_agg(rule, ',' ORDER BY rule) FROM u WHERE u.doc = m.doc AND u.source = m.name), '') AS rules FROM m""", _REP)
def _(s, d):
    scored = _methods(s, d).select("doc", "name", (F.col("complexity_value") / 10.0).alias("score"))
    out = evidence.injected(scored, _findings(s, d))
    return out.select("doc", "name", F.round("score", 9).alias("score"), F.coalesce(F.array_join("rules", ","), F.lit("")).alias("rules"))


@_query("n9_with_callers", """SELECT doc, CAST(json_array_length(json -> 'callers') AS INT) AS callers, json -> 'callers' ->> '$[0].file' AS first_file, json ->> 'class' AS class FROM (
  SELECT doc, CASE WHEN doc % 2 = 0 THEN regexp_replace(json, '\\}$', '') || ',"callers":[{"file":"F' || CAST(doc AS VARCHAR) || '.java"},{"file":"G.java"}]}' ELSE json END AS json FROM report_texts) x""", _REP)
def _(s, d):
    given = _raw(s, d)
    who = given.filter("doc % 2 = 0").select("doc", F.explode(F.array(F.concat(F.lit("F"), F.col("doc").cast("string"), F.lit(".java")), F.lit("G.java"))).alias("file"))
    callers = who.select("doc", "file", F.lit("IMPORT").alias("type"), F.lit(3).alias("line"), F.lit("x").alias("description"))
    out = reports.with_callers(given, callers)
    listed = F.from_json(F.get_json_object("json", "$.callers"), "array<struct<file:string>>")
    return out.select("doc", F.size(listed).alias("callers"), F.get(listed, F.lit(0))["file"].alias("first_file"), F.get_json_object("json", "$.class").alias("class")).withColumn("callers", F.when(F.col("callers") >= 0, F.col("callers")))


@_query("n6_merged_reports", "SELECT c_custkey AS doc, 'K' || CAST(c_custkey AS VARCHAR) AS class, CASE WHEN c_custkey % 3 = 0 THEN 'm1' ELSE 'm0,m1' END AS methods FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    given = _t(s, d, "customer").select(k.alias("doc"))
    text = F.concat(F.lit('{"class": "K'), F.col("doc").cast("string"), F.lit('", "summary": "s"}'))
    method = F.when((F.col("doc") % 3 == 0) & (F.col("pos") == 0), "no json").otherwise(F.concat(F.lit('{"name": "m'), F.col("pos").cast("string"), F.lit('", "complexity": "LOW"}')))
    methods = given.select("doc", F.explode(F.array(F.lit(1), F.lit(0))).alias("pos")).select("doc", "pos", method.alias("json"))
    out = reports.merged(given.select("doc", text.alias("json")), methods)
    return out.select("doc", "class", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"))


@_query("n8_k7_json_rows", "SELECT c_custkey AS doc, '{\"name\":\"' || c_name || '\",\"n\":' || CAST(c_nationkey AS VARCHAR) || '}' AS json FROM customer")
def _(s, d):
    return reports.to_json(_t(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")))


@_query("n8_nested_form", _M + """SELECT doc, 'Class: ' || (json ->> 'class') || ', Complexity: ' || (json ->> 'overall_complexity') AS summary, CAST((SELECT count(*) FROM mc WHERE mc.doc = r.doc) AS INT) AS calls, CASE WHEN doc % 2 = 0 THEN 'COMPLETED' END AS status, '[]' AS risks FROM report_texts r""", _REP)
def _(s, d):
    r = _reports(s, d)
    traces = r.filter("doc % 2 = 0").select("doc", F.lit("t1").alias("task_id"), F.lit("COMPLETED").alias("status"), F.lit(False).alias("cache_hit"), F.lit(0).alias("retries"))
    out = reports.nested_form(r, traces)
    member = lambda name: F.get_json_object("json", f"$.{name}")
    calls = F.flatten(F.transform(F.from_json(member("methods"), "array<struct<calls:array<struct<type:string>>>>"), lambda m: m["calls"]))
    same = F.size(F.filter(calls, lambda c: c["type"] == "same_file"))
    return out.select("doc", member("summary").alias("summary"), same.alias("calls"), member("executionTrace.t1.status").alias("status"), member("risks").alias("risks"))


@_query("n11_verified_risks", _M + "SELECT doc, pos, pos % 2 = 0 AS verified FROM tr", _REP)
def _(s, d):
    r = _reports(s, d)
    checked = r.select("doc", F.posexplode("risks").alias("pos", "x")).select("doc", "pos", (F.col("pos") % 2 == 0).alias("passed"))
    out = reports.verified_risks(r.select("doc", "risks"), checked)
    return out.select("doc", F.posexplode("risks").alias("pos", "x")).select("doc", "pos", "x.verified")


# rules on texts


_FAIL = "CASE WHEN k % 9 = 0 THEN 'root' WHEN k % 9 = 1 THEN 'className' WHEN k % 9 = 2 THEN 'stereotype' WHEN k % 9 = 3 THEN 'keyMethods' WHEN k % 9 = 4 THEN 'dependencies' WHEN k % 9 = 5 THEN 'complexity' WHEN k % 9 = 6 THEN 'fields' END"


@_query("r11_c19_summary_failures", f"SELECT k AS doc, {_FAIL} AS failure FROM (SELECT c_custkey AS k FROM customer) x")
def _(s, d):
    k = F.col("c_custkey") % 9
    keep = lambda n, text: F.when(k == n, F.lit("")).otherwise(F.lit(text))
    text = F.concat(
        F.lit('{"x": 1'), keep(1, ', "className": "A"'), F.when(k == 2, ', "stereotype": " "').otherwise(', "stereotype": "S"'), F.when(k == 3, ', "keyMethods": []').otherwise(', "keyMethods": [1]'),
        F.when(k == 4, ', "dependencies": 3').otherwise(', "dependencies": []'), F.when(k == 5, ', "complexity": null').otherwise(', "complexity": "LOW"'), F.lit(', "summary": "s", "frameworkDesc": "f"'), keep(6, ', "fields": []'), F.lit("}"),
    )
    words = F.concat(F.lit('{"className": "'), F.repeat(F.lit("w "), 600), F.lit('"}'))
    given = _t(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.when(k == 0, F.when(F.col("c_custkey") % 2 == 0, words).otherwise("{ no json")).otherwise(text).alias("json"))
    return given.select("doc", reports.summary_failure().alias("failure"))


@_query("r11_method_failures", "SELECT k AS doc, CASE k % 6 WHEN 0 THEN 'method' WHEN 1 THEN 'l1Evidence' WHEN 2 THEN 'overallScore' WHEN 3 THEN 'reasoningBasis' WHEN 4 THEN 'riskIndicators' END AS failure FROM (SELECT c_custkey AS k FROM customer) x")
def _(s, d):
    k = F.col("c_custkey") % 6
    text = F.concat(
        F.when(k == 0, '{"method": "other"').otherwise('{"method": "run"'), F.when(k == 1, ', "l1Evidence": {"calls": []}').otherwise(', "l1Evidence": {"fieldsUsed": ["a"]}'), F.lit(', "l2Confidence": {'),
        F.when(k == 2, '"overallScore": 1.5').otherwise('"overallScore": 0.5'), F.when(k == 3, ', "reasoningBasis": "GUESS"').otherwise(', "reasoningBasis": "PARTIAL"'), F.when(k == 4, "").otherwise(', "riskIndicators": []'), F.lit("}}"),
    )
    return _t(s, d, "customer").select(F.col("c_custkey").alias("doc"), text.alias("json")).select("doc", reports.method_failure(F.lit("run")).alias("failure"))


@_query("r11_grouping_failures", "SELECT k AS doc, CASE k % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'groups' WHEN 2 THEN 'groups[1].name' WHEN 3 THEN 'groups[0].files' END AS failure FROM (SELECT c_custkey AS k FROM customer) x")
def _(s, d):
    k = F.col("c_custkey") % 5
    good = '{"group": "g", "files": ["a"]}'
    text = F.when(k == 0, '{"a": 1}').when(k == 1, "[]").when(k == 2, f'[{good}, {{"name": " ", "files": ["b"]}}]').when(k == 3, f'[{{"name": "n", "files": []}}, {good}]').otherwise(f"[{good}]")
    return _t(s, d, "customer").select(F.col("c_custkey").alias("doc"), text.alias("json")).select("doc", reports.grouping_failure().alias("failure"))


# evidence over the lines of documents


@_query("r3_annotated_items", "SELECT doc_id AS doc, CASE WHEN toxic = 1 THEN 'LOW' WHEN quality = 1 THEN 'CERTAIN' ELSE 'HIGH' END AS confidence FROM labels")
def _(s, d):
    la = _t(s, d, "labels").select(F.col("doc_id").alias("doc"), F.when(F.col("quality") == 1, "dependencies").otherwise("risks").alias("category"), F.lit(0).alias("pos"), "toxic")
    issues = la.filter("toxic = 1").select("doc", "category", "pos", F.lit("LOW").alias("confidence"))
    return evidence.annotated(la.select("doc", "category", "pos"), issues).select("doc", "confidence")


_RANGES = ", t AS (SELECT doc, max(line_number) AS n FROM src GROUP BY doc), r AS (SELECT doc_id AS doc, CAST(1 + doc_id % 4 AS INT) AS b, CAST(3 + doc_id % 4 AS INT) AS e FROM documents WHERE doc_id % 5 <> 0)"


@_query("j12_in_any_range", _LINES + _RANGES + " SELECT c.doc_id AS doc, c.line FROM claims c WHERE EXISTS (SELECT 1 FROM r WHERE r.doc = c.doc_id AND c.line BETWEEN b AND e) OR (NOT EXISTS (SELECT 1 FROM r WHERE r.doc = c.doc_id) AND EXISTS (SELECT 1 FROM t WHERE t.doc = c.doc_id AND c.line BETWEEN 1 AND n))", ("claims",))
def _(s, d):
    claims = _t(s, d, "claims").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), "line")
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("doc"))
    ranges = docs.filter("doc % 5 <> 0").select("doc", (1 + F.col("doc") % 4).cast("int").alias("begin_line"), (3 + F.col("doc") % 4).cast("int").alias("end_line"))
    totals = _src(s, d).groupBy("doc").agg(F.max("line_number").alias("n_lines"))
    return evidence.in_any_range(claims, ranges, totals).select("doc", "line")


@_query("r2_range_issues", _LINES.replace(", src", "WITH src", 1) + ", t AS (SELECT doc, max(line_number) AS n FROM src GROUP BY doc) SELECT doc_id AS doc, CASE WHEN TRY_CAST(l AS INT) IS NULL THEN 'BAD_LINE' ELSE 'OUT_OF_RANGE' END AS issue, 'LOW' AS confidence FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'x' ELSE CAST(1 + doc_id % 30 AS VARCHAR) END AS l FROM labels) y LEFT JOIN t ON t.doc = doc_id WHERE TRY_CAST(l AS INT) IS NULL OR TRY_CAST(l AS INT) NOT BETWEEN 1 AND coalesce(n, 0)")
def _(s, d):
    line = F.when(F.col("toxic") == 1, "x").otherwise((1 + F.col("doc_id") % 30).cast("string"))
    claims = _t(s, d, "labels").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), line.alias("line"))
    totals = _src(s, d).groupBy("doc").agg(F.max("line_number").alias("n_lines"))
    return evidence.checked_ranges(claims, totals).filter("issue is not null").select("doc", "issue", "confidence")


@_query("c12_first_line_of_name", _LINES + ", w AS (SELECT doc, line_number, line FROM src) SELECT doc_id AS doc, CAST(coalesce((SELECT min(line_number) FROM w WHERE w.doc = doc_id AND contains(line, name)), 0) AS INT) AS line FROM claims", ("claims",))
def _(s, d):
    lines = F.split(F.regexp_replace("text", r"\n+$", ""), "\n", -1)
    texts = _t(s, d, "documents").filter("text is not null").groupBy("doc_id").agg(F.first(lines).alias("lines"))
    claims = _t(s, d, "claims").join(texts, "doc_id", "left")
    return claims.select(F.col("doc_id").alias("doc"), c.line_of_name(F.col("name"), F.coalesce("lines", F.array().cast("array<string>"))).alias("line"))


_CLAIMED = "SELECT doc_id AS doc, line AS l, name FROM claims"


@_query("n10_post_validated", _LINES + f""", w AS (SELECT doc, line_number, line FROM src), cl AS (SELECT doc, name, CASE WHEN doc % 2 = 0 THEN 0 ELSE l END AS claimed FROM ({_CLAIMED}) x),
p AS (SELECT doc, name, claimed, CAST(CASE WHEN claimed = 0 THEN coalesce((SELECT min(line_number) FROM w WHERE w.doc = cl.doc AND contains(w.line, name)), 0) ELSE claimed END AS INT) AS place FROM cl),
k AS (SELECT p.*, EXISTS (SELECT 1 FROM w WHERE w.doc = p.doc AND w.line_number = p.place) AS there, EXISTS (SELECT 1 FROM w WHERE w.doc = p.doc AND line_number BETWEEN p.place AND p.place + 2 AND contains(w.line, name)) AS hit FROM p)
SELECT doc, place, there AND hit AS passed, CASE WHEN NOT there THEN 'OUT_OF_RANGE' WHEN NOT hit THEN 'NAME_NOT_FOUND' END AS issue, CAST(CASE WHEN claimed > 0 AND there AND hit THEN 1 ELSE 0 END AS INT) AS status FROM k""", ("claims",))
def _(s, d):
    line = F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("line"))
    claims = _t(s, d, "claims").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), F.lit("CALL").alias("kind"), F.col("name").alias("target"), line.cast("string").alias("line"))
    return agents.post_validated(claims, _src(s, d))[0].select("doc", F.col("at").alias("place"), "passed", "issue", "status")


@_query("n10_c13_scores", _LINES + f""", w AS (SELECT doc, line_number, line FROM src), k AS (SELECT doc, EXISTS (SELECT 1 FROM w WHERE w.doc = x.doc AND w.line_number = l) AND EXISTS (SELECT 1 FROM w WHERE w.doc = x.doc AND line_number BETWEEN l AND l + 2 AND contains(w.line, name)) AS ok FROM ({_CLAIMED}) x)
SELECT doc, CAST(CASE WHEN r >= 1 THEN 1.0 WHEN r >= 0.8 THEN 0.8 WHEN r >= 0.5 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS score, CASE WHEN r >= 0.8 THEN 'SOLID_ANALYSIS' WHEN r >= 0.5 THEN 'HEURISTIC' ELSE 'PARTIAL' END AS basis FROM (SELECT doc, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS r FROM k GROUP BY doc) y""", ("claims",))
def _(s, d):
    claims = _t(s, d, "claims").select(F.col("doc_id").alias("doc"), F.monotonically_increasing_id().alias("pos"), F.lit("CALL").alias("kind"), F.col("name").alias("target"), F.col("line").cast("string").alias("line"))
    return agents.post_validated(claims, _src(s, d))[1].select("doc", "score", "basis")


@_query("r9_cross_verified", "SELECT doc_id AS doc, CASE WHEN quality IS NULL THEN 'PENDING' WHEN quality = 1 THEN 'PASSED' ELSE 'REJECTED' END AS status FROM labels")
def _(s, d):
    claims = _t(s, d, "labels").select(F.col("doc_id").alias("doc"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("claim"))
    verdict = lambda claim: claim.map({"good": True, "bad": False})
    return evidence.cross_verified(claims, verdict).select("doc", "status")


_RULES = "SELECT 'must call ' || CASE p_size % 3 WHEN 0 THEN 'app.' ELSE '' END || 'Svc' || CAST(p_size AS VARCHAR) || '.run() before Dao.load(x) or Log' || CAST(p_partkey AS VARCHAR) || '.note()' AS rule FROM part"
_CLAIMS = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'nothing here' WHEN 1 THEN 'vc' || CAST(l_quantity AS INT) || '.run(' || CAST(l_partkey AS VARCHAR) || ') is called' WHEN 2 THEN 'Svc' || CAST(l_suppkey % 60 AS VARCHAR) || '.run(a) and Log' || CAST(l_partkey AS VARCHAR) || '.note()' ELSE 'Dao.load(1)' END AS claim FROM lineitem"


@_query("r10_x22_constraints", f"""WITH c AS ({_RULES}), k AS ({_CLAIMS}), m AS (SELECT DISTINCT claim, unnest(regexp_extract_all(claim, '(\\w+\\.\\w+)\\([^)]*\\)', 1)) || '()' AS x FROM k),
s AS (SELECT DISTINCT x, EXISTS (SELECT 1 FROM c WHERE contains(rule, x)) AS known FROM m), v AS (SELECT claim, bool_and(known) AS ok FROM m JOIN s USING (x) GROUP BY claim)
SELECT k, n, CASE WHEN ok IS NULL THEN 'PENDING' WHEN ok THEN 'PASSED' ELSE 'REJECTED' END AS status FROM k LEFT JOIN v USING (claim)""")
def _(s, d):
    rules = s.sql(_RULES.replace("VARCHAR", "STRING").replace("FROM part", "FROM {part}"), part=_t(s, d, "part"))
    claims = s.sql(_CLAIMS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {lineitem}"), lineitem=_t(s, d, "lineitem"))
    return evidence.constraint_checked(claims, rules.withColumnRenamed("rule", "constraint")).select("k", "n", "status")


@_query("r13_executed_tasks", "SELECT p_partkey AS task_id, CASE WHEN p_partkey % 4 = 0 THEN 'CACHED' WHEN p_partkey % 4 = 3 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status, p_partkey % 4 = 0 AS cache_hit, CAST(CASE p_partkey % 4 WHEN 3 THEN 1 ELSE 0 END AS INT) AS retries, CASE p_partkey % 4 WHEN 0 THEN 'known' WHEN 3 THEN NULL ELSE 'done ' || CAST(p_partkey AS VARCHAR) END AS output FROM part")
def _(s, d):
    k = F.col("p_partkey")
    tasks = _t(s, d, "part").select(k.alias("task_id"), F.lit("SUMMARY").alias("task_type"), F.concat(F.when(k % 4 == 3, "bad ").otherwise(""), k.cast("string")).alias("input"))
    cache = tasks.filter("task_id % 4 = 0").select(stores.cache_key(F.col("input"), F.col("task_type")).alias("key"), F.lit("known").alias("output"))
    out = agents.executed(tasks, cache, lambda text: f"done {text}", lambda text: text is not None and "bad" not in text)
    return out.select("task_id", "status", "cache_hit", "retries", "output")


# aggregates


@_query("a17_corrected_statistics", """SELECT c_mktsegment AS package, count(*) AS files, CASE WHEN c_mktsegment = 'BUILDING' THEN 'UTIL' ELSE 'SERVICE' END AS layer, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE NULL END AS composition, count(*) FILTER (c_nationkey % 3 = 0) AS high, count(*) FILTER (c_nationkey % 3 = 1) AS medium FROM customer GROUP BY c_mktsegment""".replace("CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE NULL END", "CAST(NULL AS VARCHAR)"))
def _(s, d):
    cu = _t(s, d, "customer").withColumnRenamed("c_mktsegment", "package")
    outputs = cu.select("package", F.lit("MODEL").alias("layer")).distinct()
    said = cu.filter("package = 'BUILDING'").select("package", F.explode(F.array(F.lit("UTIL"), F.lit("nonsense"))).alias("layer"))
    sev = F.when(F.col("c_nationkey") % 3 == 0, "HIGH").when(F.col("c_nationkey") % 3 == 1, "MEDIUM").otherwise("LOW")
    return aggregates.corrected_statistics(outputs, cu.select("package", F.lit("SERVICE").alias("layer")), said, cu.select("package", sev.alias("severity")))


@_query("a19_profile_context", """SELECT 'LAYER' AS part, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) AS INT) AS at, o_orderpriority || ': ' || CAST(n AS VARCHAR) || ' classes' AS line FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) x
UNION ALL (SELECT 'CONSTRAINT', CAST(row_number() OVER (ORDER BY n_nationkey) AS INT), n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 3)""")
def _(s, d):
    layers = _t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("layer")).agg(F.count("*").alias("n"))
    rules = _t(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.when(F.col("n_regionkey") == 2, "ERROR").otherwise("WARN").alias("severity"), F.col("n_name").alias("description"))
    return aggregates.profile_context(layers, rules)


@_query("a20_a21_timings", """, t AS (SELECT o_orderpriority, ms, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM (SELECT o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders) x)
SELECT o_orderpriority, max(n) AS n, min(ms) AS least, max(ms) AS most, CAST(floor(sum(ms) / count(*)) AS BIGINT) AS average, max(ms) FILTER (i = n // 2) AS median, max(ms) FILTER (i = (n * 90 + 99) // 100 - 1) AS p90 FROM t GROUP BY 1""".replace(", t AS", "WITH t AS", 1))
def _(s, d):
    return aggregates.timings(_t(s, d, "orders").select("o_orderpriority", F.floor("o_totalprice").alias("ms")), "o_orderpriority")


@_query("r12_t7_validated_aggregates", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'package' WHEN p_partkey % 5 = 1 THEN 'layer' END AS failure,
  CASE WHEN p_partkey % 7 = 0 THEN '（无摘要）' WHEN p_partkey % 7 = 1 THEN repeat('s', 100) || '…' ELSE 's' || p_name END AS summary, CASE p_partkey % 7 WHEN 2 THEN 5 ELSE 1 END::INT AS n_entries,
  CASE WHEN p_size > 0 AND p_partkey % 7 <> 1 THEN '该包存在 ' || CAST(p_size AS VARCHAR) || ' 个高风险、0 个中风险问题，建议优先处理高风险项。' WHEN p_partkey % 7 = 1 THEN repeat('r', 500) END AS refactoring FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    many = F.array_repeat(F.lit("e"), 9)
    long = F.array(F.repeat(F.lit("x"), 3000))
    out = _t(s, d, "part").select(
        k.alias("id"), F.when(k % 5 == 0, "q").otherwise("p").alias("package"), F.when(k % 5 == 1, "ODD").otherwise("SERVICE").alias("layer"),
        F.when(k % 7 == 0, " ").when(k % 7 == 1, F.repeat(F.lit("s"), 400)).otherwise(F.concat(F.lit("s"), "p_name")).alias("summary"),
        F.when(k % 7 == 2, many).when(k % 7 == 1, long).otherwise(F.array(F.lit("e"))).alias("entries"), F.array().cast("array<string>").alias("responsibilities"),
        F.when(k % 7 == 1, F.repeat(F.lit("r"), 900)).otherwise("").alias("refactoring"), F.col("p_size").alias("high"), F.lit(0).alias("medium"),
    )
    expected = out.select("id", F.lit("p").alias("expected_package"))
    return aggregates.validated_aggregates(out, expected).select("id", "failure", "summary", F.size("entries").alias("n_entries"), "refactoring")


@_query("r14_j14_a15_aggregated", """, f AS (SELECT s_nationkey AS package, s_suppkey AS file FROM supplier), n AS (SELECT package, count(*) AS n FROM f GROUP BY 1)
SELECT package, n AS files, CASE WHEN n <= 4 THEN 1 ELSE (SELECT count(DISTINCT CASE WHEN file % 3 = 2 THEN 9 ELSE file % 3 END) FROM f WHERE f.package = n.package) END AS groups FROM n""".replace(", f AS", "WITH f AS", 1))
def _(s, d):
    f = _t(s, d, "supplier").select(F.col("s_nationkey").alias("package"), F.col("s_suppkey").alias("file"))
    groups = f.filter("file % 3 < 2").select("package", "file", (F.col("file") % 3).cast("int").alias("pos"), F.concat(F.lit("g"), (F.col("file") % 3).cast("string")).alias("name"))
    summarise = lambda rows: rows.groupBy("package", "pos").agg(F.count("*").alias("files"), F.lit(1).cast("long").alias("groups"))
    merge = lambda rows: rows.groupBy("package").agg(F.sum("files").alias("files"), F.sum("groups").alias("groups"))
    return aggregates.aggregated(f, groups, summarise, merge, most=4).select("package", "files", "groups")


@_query("a16_package_input", "SELECT layer, count(*) AS n FROM (SELECT CASE WHEN class_name LIKE '%Controller' THEN 'CONTROLLER' WHEN class_name LIKE '%ServiceImpl' THEN 'SERVICE' WHEN class_name LIKE '%Mapper' THEN 'REPOSITORY' ELSE 'UNKNOWN' END AS layer FROM class_facts) x GROUP BY 1", ("class_facts",))
def _(s, d):
    f = view(s, d, "class_facts")
    entries = f.select(F.col("loc").alias("pos"), "package_name", c.layer_of(c.simple_name(F.col("class_name")), F.lit("x")).alias("layer")).withColumnRenamed("package_name", "package")
    return reports.package_input(entries).select(F.explode("layers").alias("layer", "n"))


@_query("k8_summary_files", "SELECT 'p.' || o_orderpriority AS package, 'p_' || o_orderpriority || '_package' AS name, '# p.' || o_orderpriority || chr(10) || chr(10) || 's' || chr(10) || chr(10) || '| layer | files | HIGH | MEDIUM |' || chr(10) || '|-|-|-|-|' || chr(10) || '| SERVICE | ' || CAST(count(*) AS VARCHAR) || ' | 1 | 0 |' || chr(10) || chr(10) || '* a' || chr(10) || '* b' AS markdown FROM orders GROUP BY o_orderpriority")
def _(s, d):
    o = _t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("files"))
    out = o.select(F.concat(F.lit("p."), "o_orderpriority").alias("package"), F.lit("SERVICE").alias("layer"), "files", F.lit(1).alias("high"), F.lit(0).alias("medium"), F.lit("s").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("entries"))
    return aggregates.summary_markdown(out).select("package", aggregates.file_name(F.col("package"), "package").alias("name"), "markdown")


# questions


@_query("n13_callers", "SELECT 'com.m5.S5' AS class, callee_method AS method, string_agg(DISTINCT caller_class || '.' || caller_method, ',' ORDER BY caller_class || '.' || caller_method) AS callers FROM call_records WHERE callee_class = 'com.m5.S5' AND callee_method IS NOT NULL GROUP BY callee_method", ("call_records",))
def _(s, d):
    found = qa.callers(_t(s, d, "call_records"), "com.m5.S5")
    r = found.select(F.from_json("json", "class string, methodCount int, callers map<string,array<string>>").alias("r")).select("r.*")
    return r.select("class", F.explode("callers").alias("method", "x")).select("class", "method", F.array_join("x", ",").alias("callers"))


@_query("n13_callers_of_method", "SELECT 'm1' AS method, CAST(count(DISTINCT caller_class || '.' || caller_method) AS INT) AS callers FROM call_records WHERE callee_class = 'com.m5.S5' AND callee_method = 'm1'", ("call_records",))
def _(s, d):
    found = qa.callers(_t(s, d, "call_records"), "com.m5.S5", "m1")
    return found.select(F.get_json_object("json", "$.method").alias("method"), F.get_json_object("json", "$.callerCount").cast("int").alias("callers"))


@_query("n13_callees", _M + "SELECT name AS method, CAST(json_array_length(m -> 'calls') AS INT) AS callees FROM m WHERE doc = 5", _REP)
def _(s, d):
    found = qa.callees(_reports(s, d), "com.p5.C5")
    r = found.select(F.from_json("json", "callees array<struct<method:string,callees:array<struct<target:string>>>>").alias("r"))
    return r.select(F.explode("r.callees").alias("x")).select("x.method", F.size("x.callees").alias("callees"))


@_query("n13_db_dependencies", "SELECT string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, string_agg(DISTINCT sql_type, ',' ORDER BY sql_type) AS types FROM db_operations WHERE mapper_interface = (SELECT min(mapper_interface) FROM db_operations)", ("db_operations",))
def _(s, d):
    ops = _ops(s, d)
    first = ops.agg(F.min("mapper_interface")).first()[0]
    r = qa.db_dependencies(ops, first).select(F.from_json("json", "tables array<string>, sqlTypes array<string>").alias("r"))
    return r.select(F.array_join("r.tables", ",").alias("tables"), F.array_join("r.sqlTypes", ",").alias("types"))


@_query("n13_contradictions", _M + f"SELECT CAST(count(*) AS INT) AS n, least(1.0, round(sum(CASE severity WHEN 'HIGH' THEN 0.3 WHEN 'MEDIUM' THEN 0.15 ELSE 0.05 END), 6))::DOUBLE AS score FROM ({_C4} UNION ALL {_C2} UNION ALL {_C1}) u WHERE status = 'CONTRADICTORY' AND doc = 9", _REP)
def _(s, d):
    found = _findings(s, d)
    out = qa.contradictions(found, evidence.contradiction_scores(found), 9)
    return out.select(F.get_json_object("json", "$.contradictionCount").cast("int").alias("n"), F.get_json_object("json", "$.score").cast("double").alias("score"))


@_query("n13_table_sharing", "SELECT 'Brand#11' AS table_name, string_agg(DISTINCT mapper_interface, ',' ORDER BY mapper_interface) AS classes FROM db_operations WHERE table_name = 'Brand#11'", ("db_operations",))
def _(s, d):
    r = qa.table_sharing(_ops(s, d), "Brand#11").select(F.from_json("json", "table string, classes array<string>").alias("r"))
    return r.select(F.col("r.table").alias("table_name"), F.array_join("r.classes", ",").alias("classes"))


@_query("n13_search", "SELECT caller_class AS class_name, caller_method AS method_name FROM (SELECT DISTINCT caller_class, caller_method FROM call_edges WHERE lower(caller_class) LIKE '%service%' ORDER BY 1, 2 LIMIT 7) x", ("call_edges",))
def _(s, d):
    r = qa.search(_t(s, d, "call_edges"), "Service", 7).select(F.from_json("json", "results array<struct<className:string,methodName:string>>").alias("r"))
    return r.select(F.explode("r.results").alias("x")).select(F.col("x.className").alias("class_name"), F.col("x.methodName").alias("method_name"))


@_query("n13_nothing_known", "SELECT 'no callers of com.none.X' AS error UNION ALL SELECT 'no class shares nowhere' UNION ALL SELECT 'nothing found for §'")
def _(s, d):
    calls = _t(s, d, "call_records")
    found = qa.callers(calls, "com.none.X").unionByName(qa.table_sharing(_ops(s, d), "nowhere")).unionByName(qa.search(calls, "§"))
    return found.select(F.get_json_object("json", "$.error").alias("error"))


# plain expressions


@_query("c13_scores_and_bases", "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 ELSE 0 END AS DOUBLE) AS score, CASE o_orderkey % 5 WHEN 0 THEN 'SOLID_ANALYSIS' WHEN 1 THEN 'SOLID_ANALYSIS' WHEN 2 THEN 'HEURISTIC' WHEN 3 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS basis FROM orders")
def _(s, d):
    k = F.col("o_orderkey") % 5
    level = F.when(k == 0, "CERTAIN").when(k == 1, "HIGH").when(k == 2, "MEDIUM").when(k == 3, "LOW").otherwise("odd")
    return _t(s, d, "orders").select("o_orderkey", c.score_of(level).alias("score"), c.basis_of(level).alias("basis"))


@_query("c14_c17_c2_c22_texts", "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '...' ELSE c_name END AS short, c_nationkey % 2 = 0 AS has_b, 'com.a.' || c_name AS full_name, c_name || ' → ' || c_mktsegment AS path FROM customer")
def _(s, d):
    csv = F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("c_nationkey") % 2 == 0, "a, b").otherwise("ab,c")
    return _t(s, d, "customer").select(
        "c_custkey", c.shortened(F.col("c_name"), 12).alias("short"), c.has_field(csv, "b").alias("has_b"), c.qualified(F.translate("c_name", ".", "_"), F.lit("com.a.B")).alias("full_name"),
        c.path_text(F.array("c_name", "c_mktsegment")).alias("path"),
    )


@_query("c15_json_escaped", r"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(8), '\u0008'), chr(31), '\u001f') AS escaped
FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(8) || chr(31) || chr(13) || '\' ELSE '' END AS t FROM documents) x WHERE NOT regexp_matches(t, '[\x00-\x07\x0B\x0C\x0E-\x1E]')""")
def _(s, d):
    more = F.when(F.col("doc_id") % 2 == 0, F.lit("\b\x1f\r\\")).otherwise("")
    given = _t(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t")).filter(~F.col("t").rlike(r"[\x00-\x07\x0B\x0C\x0E-\x1E]"))
    return given.select("doc_id", c.json_escaped(F.col("t")).alias("escaped"))


@_query("c18_roots", "SELECT k, CASE WHEN k % 3 = 0 THEN 'w/app' WHEN k % 3 = 1 THEN 'w' END AS project, 'w/app/m' || CAST(k AS VARCHAR) || '/src/main/java' AS source FROM (SELECT c_custkey AS k FROM customer) x")
def _(s, d):
    k = F.col("c_custkey")
    path = F.concat(F.lit("w/app/m"), k.cast("string"), F.lit("/src/main/java/com/A.java"))
    marked = F.when(k % 3 == 0, F.array(F.lit("w"), F.lit("w/app"))).otherwise(F.array().cast("array<string>"))
    built = F.when(k % 3 == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("w")))
    return _t(s, d, "customer").select(k.alias("k"), c.project_root(path, marked, built).alias("project"), c.source_root(path).alias("source"))


@_query("c20_c21_profiles", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.1 WHEN c_custkey % 3 = 1 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS temperature, CASE WHEN c_custkey % 2 = 0 THEN 'big' ELSE 'fallback' END AS profile FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    wanted = F.when(k % 3 < 2, F.lit(0.7))
    profiles = F.create_map(F.lit("open:m1"), F.lit("big"))
    return _t(s, d, "customer").select(
        "c_custkey", c.effective_temperature(k % 3 == 0, F.lit(0.1), wanted).alias("temperature"),
        c.profile_of(F.lit("Open"), F.when(k % 2 == 0, "M1").otherwise("other"), profiles, F.lit("fallback")).alias("profile"),
    )


@_query("p7_infrastructure_calls", "SELECT p_partkey, p_partkey % 4 IN (0, 1, 2) AS hit FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "put").when(k == 1, "getName").otherwise("run")
    return _t(s, d, "part").select("p_partkey", c.is_infrastructure_call(name, F.when(k == 2, "Arrays.asList").otherwise("com.a.B")).alias("hit"))


@_query("c19_token_estimates", "SELECT doc_id, CAST(ceil(length(text) / 1.5) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return _t(s, d, "documents").filter("text is not null").select("doc_id", c.token_estimate(F.col("text")).alias("tokens"))


_TAKEN = ("T", "U")


@_query("s12_k9_cache_entries", "SELECT CAST(event_id AS VARCHAR) AS key, event_type AS task_type FROM events WHERE event_type = 'click' AND event_id % 10 <> 3 AND CAST(event_id AS VARCHAR) NOT LIKE '1%'")
def _(s, d):
    e = _t(s, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("task_type"), F.when(F.col("event_id") % 10 == 3, F.array(F.lit("Foo"))).alias("invalidated_by"))
    return stores.evicted(stores.invalidated(stores.looked_up(e, task_type="click"), "src/Foo.java"), "1").select("key", "task_type")


@_query("k9_k10_put_entries", "SELECT md5(event_type || '-' || CAST(user_id AS VARCHAR)) AS key, max(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def _(s, d):
    e = _t(s, d, "events").select(stores.short_key(F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("key"), "event_id", F.timestamp_seconds(F.col("event_id")).alias("created_at"))
    return stores.put(e.filter("event_id < 500"), e.filter("event_id >= 500")).select("key", "event_id")
