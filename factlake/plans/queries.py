"""Named queries of operators, over the tables or the views derived from them, with their SQL where SQL can say it; README.md lists what has none.

Keys begin with the identifiers of the operators that a query exercises. Queries over source texts and reports are in
text_queries.py and report_queries.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import columns as c
from factlake.operators import evidence, facts, impact, indexes, reports, sqltext, stores
from factlake.session import shared_folder
from factlake.sources.views import TABLES, view, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MAPPER, TABLE = "com.asia.india.Mapper1", "Brand#11"


def _query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (with_sql(*views) + " " if views else "") + sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in TABLES else view(spark, sf_dir, name)


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "db_operations").withColumn("fields", F.split("fields_csv", ","))


def _first_mapper(rows: DataFrame) -> str | None:
    """The argument of a look-up: the first mapper that there is."""
    return rows.agg(F.min("mapper_interface")).first()[0]


_CALL = "caller_class, caller_method, callee_class, callee_method, call_type, file_path, line_number"
_CALLS = _CALL.split(", ")


@_query("p1_find_by_class", "SELECT * FROM code_terms WHERE term = 'com.pkg.Brand11' AND term_type IN ('IMPORT', 'CLASS')", ("code_terms",))
def _(s, d):
    return facts.find_by_class(_t(s, d, "code_terms"), "com.pkg.Brand11")


@_query("p2_find_callers", "SELECT * FROM code_terms WHERE lower(term) LIKE '%.promo' AND term_type = 'CALLEE'", ("code_terms",))
def _(s, d):
    return facts.find_callers(_t(s, d, "code_terms"), "PROMO")


@_query("p3_find_by_prefix", "SELECT * FROM code_terms WHERE lower(term) LIKE 'svc1%' AND term_type = 'METHOD'", ("code_terms",))
def _(s, d):
    return facts.find_by_prefix(_t(s, d, "code_terms"), "SVC1", "METHOD")


@_query("p4_find_by_type", "SELECT * FROM code_terms WHERE term_type = 'CLASS'", ("code_terms",))
def _(s, d):
    return facts.find_by_type(_t(s, d, "code_terms"), "CLASS")


@_query("p5_record_count", "SELECT count(*) AS n FROM call_records", ("call_records",))
def _(s, d):
    return facts.record_count(_t(s, d, "call_records"))


@_query("p9_calls_by_caller", f"SELECT {_CALL} FROM call_records WHERE caller_class = 'com.m3.S3' AND caller_method = 'm2'", ("call_records",))
def _(s, d):
    return facts.calls_by(_t(s, d, "call_records"), "caller", "com.m3.S3", "m2").select(*_CALLS)


@_query("p10_calls_by_callee", f"SELECT {_CALL} FROM call_records WHERE callee_class = 'com.m5.S5' AND callee_method = 'm1' ORDER BY line_number, caller_class, callee_class, call_type LIMIT 10", ("call_records",))
def _(s, d):
    return facts.calls_by(_t(s, d, "call_records"), "callee", "com.m5.S5", "m1", 10).select(*_CALLS)


_OPS = "mapper_interface, method_name, sql_type, table_name, fields_csv, xml_line, source_file"
_OPC = _OPS.split(", ")


@_query("p11_operations_on_table", f"SELECT {_OPS} FROM db_operations WHERE table_name = '{TABLE}'", ("db_operations",))
def _(s, d):
    return facts.operations_on(_ops(s, d), TABLE).select(*_OPC)


@_query("p12_operations_on_field", f"SELECT {_OPS} FROM db_operations WHERE table_name = '{TABLE}' AND (list_contains(string_split(fields_csv, ','), 'promo') OR fields_csv = 'WILDCARD')", ("db_operations",))
def _(s, d):
    return facts.operations_on_field(_ops(s, d), TABLE, "promo").select(*_OPC)


@_query("p12_operations_on_field_strict", f"SELECT {_OPS} FROM db_operations WHERE table_name = '{TABLE}' AND list_contains(string_split(fields_csv, ','), 'promo')", ("db_operations",))
def _(s, d):
    return facts.operations_on_field(_ops(s, d), TABLE, "promo", strict=True).select(*_OPC)


@_query("p13_operations_of_mapper_method", f"SELECT {_OPS} FROM db_operations WHERE mapper_interface = (SELECT min(mapper_interface) FROM db_operations) AND method_name = 'q1'", ("db_operations",))
def _(s, d):
    ops = _ops(s, d)
    return facts.operations_of(ops, _first_mapper(ops), "q1").select(*_OPC)


@_query("p15_mappings_by_column", "SELECT * FROM db_field_mappings WHERE column_name = 'col_7'", ("db_field_mappings",))
def _(s, d):
    return facts.field_mappings_by_column(_t(s, d, "db_field_mappings"), "col_7")


@_query("p14_field_mappings", "SELECT * FROM db_field_mappings WHERE mapper_interface = (SELECT min(mapper_interface) FROM db_field_mappings)", ("db_field_mappings",))
def _(s, d):
    m = _t(s, d, "db_field_mappings")
    return facts.field_mappings(m, _first_mapper(m)).select(*m.columns)


@_query("p16_null_argument", f"SELECT {_OPS} FROM db_operations WHERE table_name = '{TABLE}'", ("db_operations",))
def _(s, d):
    # a null argument adds nothing to what a table gives
    ops = _ops(s, d)
    return facts.operations_on(ops, None).unionByName(facts.operations_of(ops, None, "q1")).unionByName(facts.operations_on(ops, TABLE)).select(*_OPC)


@_query("j1_mappings_by_table", f"SELECT * FROM db_field_mappings m WHERE EXISTS (SELECT 1 FROM db_operations o WHERE o.mapper_interface = m.mapper_interface AND o.table_name = '{TABLE}')", ("db_operations", "db_field_mappings"))
def _(s, d):
    m = _t(s, d, "db_field_mappings")
    return facts.field_mappings_by_table(m, _ops(s, d), TABLE).select(*m.columns)


@_query("j2_operations_for_calls", "SELECT DISTINCT mapper_interface, method_name, table_name, sql_type FROM db_operations", ("db_operations",))
def _(s, d):
    # one list of calls for each mapper: all its methods
    ops = _ops(s, d)
    some = ops.select("mapper_interface", "method_name").distinct()
    calls = some.groupBy("mapper_interface").agg(F.array_sort(F.collect_list("method_name")).alias("methods")).select(F.transform("methods", lambda _: F.col("mapper_interface")).alias("mappers"), "methods")
    return facts.operations_for_calls(ops, calls).select("mapper_interface", "method_name", "table_name", "sql_type")


@_query("a1_table_stats", """, k AS (SELECT table_name, sql_type, count(*) AS operations, count(DISTINCT mapper_interface) AS mappers FROM db_operations GROUP BY ALL)
SELECT k.*, max(mappers) OVER (PARTITION BY table_name) AS mappers_max, n AS mappers_distinct
FROM k JOIN (SELECT table_name, count(DISTINCT mapper_interface) AS n FROM db_operations GROUP BY ALL) t USING (table_name)""", ("db_operations",))
def _(s, d):
    return facts.table_stats(_ops(s, d))


@_query("a2_table_sharing", """SELECT table_name, array_to_string(list_sort(list(DISTINCT mapper_interface)), ',') AS mappers, count(DISTINCT mapper_interface) AS mapper_count,
  array_to_string(list_sort(list(DISTINCT array_to_string(string_split(mapper_interface, '.')[1:3], '.'))), ',') AS packages FROM db_operations GROUP BY table_name""", ("db_operations",))
def _(s, d):
    return facts.table_sharing(_ops(s, d)).withColumns({"mappers": F.array_join("mappers", ","), "packages": F.array_join("packages", ",")})


@_query("a3_all_tables", "SELECT DISTINCT table_name FROM db_operations", ("db_operations",))
def _(s, d):
    return facts.all_tables(_ops(s, d))


@_query("a4_module_count", "SELECT count(DISTINCT array_to_string(string_split(mapper_interface, '.')[1:3], '.')) AS modules FROM db_operations", ("db_operations",))
def _(s, d):
    return facts.module_count(_ops(s, d))


@_query("r8_shared_tables", "SELECT table_name, count(DISTINCT array_to_string(string_split(mapper_interface, '.')[1:3], '.')) AS modules, CAST(-0.1 AS DOUBLE) AS penalty FROM db_operations GROUP BY table_name HAVING count(DISTINCT array_to_string(string_split(mapper_interface, '.')[1:3], '.')) >= 3", ("db_operations",))
def _(s, d):
    return facts.shared_tables(_ops(s, d))


@_query("t1_per_node_limit", f"SELECT {_CALL}, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY callee_class, callee_method ORDER BY line_number, caller_class, caller_method, call_type) AS INT) AS rn FROM call_records) x WHERE rn <= 30", ("call_records",))
def _(s, d):
    return facts.per_node_limit(_t(s, d, "call_records")).select(*_CALLS, "rn")


@_query("t3_u1_callers_of_class", """, b AS (SELECT *, 0 AS r FROM code_terms WHERE term = 'com.pkg.Brand11' AND term_type IN ('IMPORT', 'CLASS')
  UNION ALL SELECT *, 1 FROM code_terms WHERE term_type = 'CALLEE' AND lower(term) LIKE 'com.pkg.brand11.%')
SELECT file_path, line_number, term, CASE r WHEN 0 THEN 'IMPORT' ELSE 'CALL' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY r, line_number, term) AS rn FROM b) x WHERE rn = 1""", ("code_terms",))
def _(s, d):
    return facts.callers_of(_t(s, d, "code_terms"), "com.pkg.Brand11")


@_query("j11_callers_with_implementors", """, impl AS (SELECT DISTINCT term AS class FROM code_terms WHERE term LIKE 'com.pkg.Brand1%'), names AS (SELECT class AS name FROM impl UNION SELECT 'com.pkg.Brand55'),
b AS (SELECT t.*, 0 AS r FROM code_terms t JOIN names ON term = name WHERE term_type IN ('IMPORT', 'CLASS')
  UNION ALL SELECT t.*, 1 FROM code_terms t JOIN names ON regexp_replace(term, '\\.[^.]*$', '') = name WHERE term_type = 'CALLEE')
SELECT file_path, line_number, term FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY r, line_number, term) AS rn FROM b) x WHERE rn = 1""", ("code_terms",))
def _(s, d):
    t = _t(s, d, "code_terms")
    impl = t.filter(F.col("term").startswith("com.pkg.Brand1")).select(F.lit("com.pkg.Brand55").alias("interface"), F.col("term").alias("class")).distinct()
    return facts.callers_with_implementors(t, impl, "com.pkg.Brand55").select("file_path", "line_number", "term")


@_query("t6_search_methods", f"SELECT {_CALL} FROM call_edges WHERE lower(caller_class) LIKE '%mapper%' OR lower(caller_method) LIKE '%mapper%' ORDER BY caller_class, caller_method, line_number, callee_class, call_type LIMIT 10", ("call_edges",))
def _(s, d):
    return facts.searched(_t(s, d, "call_edges"), "Mapper", 99).select(*_CALLS)


_SEED = "'com.p2.C7'"
_BFS = f""", bfs AS (
  SELECT 'com.p2.C7' AS k, 'm1' AS m, 0 AS hop
  UNION SELECT e.caller_class, e.caller_method, hop + 1 FROM bfs JOIN call_edges e ON e.callee_class = k AND e.callee_method = m WHERE hop < 3
), best AS (SELECT k AS class_name, m AS method_name, min(hop) AS hop FROM bfs GROUP BY ALL HAVING min(hop) > 0) """


def _seed(s):
    return s.range(1).select(F.lit("com.p2.C7").alias("class_name"), F.lit("m1").alias("method_name"), F.array(F.lit("com.p2.C7.m1")).alias("path"))


def _impact(s, d):
    return impact.impacts(_seed(s), _t(s, d, "call_edges"), per_node=None, total=None)


_LAYER = """CASE WHEN class_name LIKE '%Controller' THEN 'CONTROLLER' WHEN class_name LIKE '%ServiceImpl' THEN 'SERVICE' WHEN class_name LIKE '%Mapper' THEN 'REPOSITORY' ELSE 'UNKNOWN' END"""


@_query("g1_impact", _BFS + f"SELECT class_name, method_name, CAST(hop AS INT) AS hop, CASE hop WHEN 1 THEN 'DIRECT' ELSE 'INDIRECT' END AS level, {_LAYER} AS layer FROM best", ("call_edges",))
def _(s, d):
    return _impact(s, d).select("class_name", "method_name", "hop", "level", "layer")


_FIRST = "SELECT *, row_number() OVER (ORDER BY line_number, caller_class, caller_method, call_type) AS rn FROM call_edges WHERE callee_class = 'com.p2.C7' AND callee_method = 'm1'"


@_query("g1_capped_impact", f"SELECT DISTINCT caller_class AS class_name, caller_method AS method_name FROM ({_FIRST}) x WHERE rn <= 4 AND NOT (caller_class = 'com.p2.C7' AND caller_method = 'm1')", ("call_edges",))
def _(s, d):
    return impact.impacts(_seed(s), _t(s, d, "call_edges"), max_hops=1, per_node=4).select("class_name", "method_name")


@_query("k7_impact_markdown", _BFS + """, heat AS (SELECT regexp_replace(class_name, '\\.[^.]*$', '') AS package, count(*) FILTER (hop = 1) AS d, count(*) FILTER (hop > 1) AS i, count(*) AS t FROM best GROUP BY 1)
SELECT CAST(2 + row_number() OVER (ORDER BY t DESC, package) AS INT) AS at, '| ' || package || ' | ' || CAST(d AS VARCHAR) || ' | ' || CAST(i AS VARCHAR) || ' | ' || CAST(t AS VARCHAR) || ' |' AS line FROM heat""".replace("best GROUP BY ALL HAVING", "best GROUP BY ALL HAVING"), ("call_edges",))
def _(s, d):
    return impact.markdown(_impact(s, d)).filter("line like '| com%'")


@_query("a5_impact_summary", _BFS + f"SELECT {_LAYER} AS layer, count(*) AS n, (SELECT count(*) FROM best WHERE hop = 1) AS direct, (SELECT count(*) FROM best WHERE hop > 1) AS indirect FROM best GROUP BY 1", ("call_edges",))
def _(s, d):
    return impact.summary(_impact(s, d)).select("direct", "indirect", F.explode("layers").alias("layer", "n"))


@_query("a6_heat_map", _BFS + "SELECT regexp_replace(class_name, '\\.[^.]*$', '') AS package, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS indirect, count(*) AS total FROM best GROUP BY 1", ("call_edges",))
def _(s, d):
    return impact.heat_map(_impact(s, d))


@_query("t2_g4_high_risk_paths", """, h AS (SELECT caller_class AS c, caller_method AS m, arg_min(call_type, line_number) AS t FROM call_edges WHERE callee_class = 'com.p2.C7' AND callee_method = 'm1' AND NOT (caller_class = 'com.p2.C7' AND caller_method = 'm1') GROUP BY ALL),
r AS (SELECT *, CASE t WHEN 'DIRECT' THEN 3 WHEN 'REFLECTION' THEN 1 ELSE 2 END AS risk FROM h)
SELECT CAST(risk AS INT) AS risk, 1 AS hop, CASE WHEN risk >= 3 THEN '🔴 ' ELSE '🟡 ' END || 'com.p2.C7.m1 → ' || c || '.' || m AS path FROM r WHERE risk >= 2 ORDER BY risk DESC, c, m LIMIT 5""", ("call_edges",))
def _(s, d):
    return impact.high_risk_paths(_impact(s, d))


@_query("g3_confidence", "SELECT call_type, h AS hop, CASE call_type WHEN 'DIRECT' THEN CASE WHEN h >= 2 THEN 'MEDIUM' ELSE 'HIGH' END WHEN 'REFLECTION' THEN 'LOW' ELSE 'MEDIUM' END AS confidence, count(*) AS n FROM (SELECT call_type, 1 + line_number % 3 AS h FROM call_edges) x GROUP BY ALL", ("call_edges",))
def _(s, d):
    e = _t(s, d, "call_edges").withColumn("hop", 1 + F.col("line_number") % 3)
    return e.groupBy("call_type", "hop", c.impact_confidence(F.col("call_type"), F.col("hop")).alias("confidence")).agg(F.count("*").alias("n"))


_CLASS_LAYER = """CASE WHEN annotation = 'RestController' THEN 'CONTROLLER' WHEN annotation = 'Configuration' THEN 'CONFIG' WHEN class_name LIKE '%Controller' THEN 'CONTROLLER'
  WHEN class_name LIKE '%ServiceImpl' THEN 'SERVICE' WHEN class_name LIKE '%Mapper' THEN 'REPOSITORY' WHEN package_name LIKE '%.web.%' THEN 'CONTROLLER' WHEN package_name LIKE '%.biz.%' THEN 'SERVICE'
  WHEN package_name LIKE '%.dao.%' THEN 'REPOSITORY' WHEN package_name LIKE '%.feign.%' THEN 'CLIENT' WHEN package_name LIKE '%.dto.%' THEN 'MODEL' ELSE 'UNKNOWN' END"""


def _classes(s, d):
    f = _t(s, d, "class_facts")
    return f.withColumn("layer", c.layer_of(c.simple_name(F.col("class_name")), F.col("package_name"), F.array("annotation")))


@_query("c4_c7_class_layer", f"SELECT class_name, package_name, {_CLASS_LAYER} AS layer FROM class_facts", ("class_facts",))
def _(s, d):
    return _classes(s, d).select("class_name", "package_name", "layer")


@_query("a7_package_layer", f", l AS (SELECT package_name, {_CLASS_LAYER} AS layer, count(*) AS n FROM class_facts GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY package_name) AS total, max(n) OVER (PARTITION BY package_name) AS most FROM l) "
        "SELECT package_name, CAST(max(total) AS BIGINT) AS total, CASE WHEN max(most) * 2 >= max(total) THEN arg_max(layer, n * 100 - list_position(['CONTROLLER','SERVICE','REPOSITORY','HANDLER','CONFIG','CLIENT','MODEL','UTIL','UNKNOWN'], layer)) ELSE 'UNKNOWN' END AS layer FROM t GROUP BY package_name", ("class_facts",))  # fmt: skip
def _(s, d):
    return impact.package_layers(_classes(s, d)).select("package_name", "total", "layer")


@_query("a8_layer_composition", f""", l AS (SELECT package_name, {_CLASS_LAYER} AS layer, count(*) AS n FROM class_facts GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY package_name) AS total, max(n) OVER (PARTITION BY package_name) AS most FROM l)
SELECT package_name, CAST(max(total) AS BIGINT) AS total, 'UNKNOWN' AS layer, string_agg(printf('%.1f%% %s', floor(n * 1000.0 / total + 0.5) / 10, layer), ' + ' ORDER BY n DESC, list_position(['CONTROLLER','SERVICE','REPOSITORY','HANDLER','CONFIG','CLIENT','MODEL','UTIL','UNKNOWN'], layer)) AS composition FROM t WHERE most * 2 < total GROUP BY package_name""", ("class_facts",))
def _(s, d):
    return impact.package_layers(_classes(s, d)).filter("composition is not null")


@_query("p17_route", """, k AS (SELECT class_name || CASE WHEN loc % 7 = 0 THEN 'Vo' ELSE '' END AS class_name, CASE loc % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' ELSE 'class' END AS kind, loc, n_methods, loc % 2 = 0 AS d FROM class_facts)
SELECT class_name, CASE WHEN class_name LIKE '%Vo' OR kind = 'enum' OR (kind = 'interface' AND NOT d) OR (loc <= 300 AND n_methods <= 8) OR (loc <= 800 AND n_methods <= 15) THEN 'SINGLE' ELSE 'MULTI' END AS mode FROM k""", ("class_facts",))
def _(s, d):
    f = _t(s, d, "class_facts").withColumn("class_name", F.concat("class_name", F.when(F.col("loc") % 7 == 0, "Vo").otherwise("")))
    kind = F.when(F.col("loc") % 5 == 0, "interface").when(F.col("loc") % 5 == 1, "enum").otherwise("class")
    return f.select("class_name", c.route(c.simple_name(F.col("class_name")), kind, F.col("loc"), F.col("n_methods"), F.col("loc") % 2 == 0).alias("mode"))


@_query("p6_p8_method_filters", "SELECT name, regexp_matches(name, '^(get|set|is)[A-Z]') OR name IN ('toString','hashCode','equals','getClass','valueOf','add','size','contains','remove','iterator','toArray','startPage','getDataTable','toAjax','error','success') AS trivial, "
        "regexp_matches(name, 'ByName|ByTableName|ByColumn') AS by_table FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'get' || p_name WHEN 1 THEN 'size' WHEN 2 THEN 'find' || 'ByName' WHEN 3 THEN 'setX' ELSE 'run' END AS name FROM part) x")  # fmt: skip
def _(s, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("get"), "p_name")).when(k == 1, "size").when(k == 2, "findByName").when(k == 3, "setX").otherwise("run")
    out = _t(s, d, "part").select(name.alias("name"))
    return out.select("name", c.is_trivial_call(F.col("name")).alias("trivial"), c.is_table_parameter_method(F.col("name")).alias("by_table"))


@_query("c1_c3_names", "SELECT file_path, replace(regexp_replace(regexp_replace(file_path, '^.*src/main/java/', ''), '\\.java$', ''), '/', '.') AS class_name, regexp_replace(callee_class, '^.*\\.', '') AS simple, regexp_replace(callee_class, '\\.[^.]*$', '') AS package, count(*) AS n FROM call_edges GROUP BY ALL", ("call_edges",))
def _(s, d):
    e = _t(s, d, "call_edges")
    return e.groupBy("file_path", c.class_of_path(F.col("file_path")).alias("class_name"), c.simple_name(F.col("callee_class")).alias("simple"), c.package_of(F.col("callee_class")).alias("package")).agg(F.count("*").alias("n"))


@_query("x10_tables_of_sql", """SELECT sql_id, CASE sql_type WHEN 'SELECT' THEN regexp_extract(sql_text, 'FROM (\\w+)', 1) || ',' || regexp_extract(sql_text, 'JOIN (\\w+)', 1) WHEN 'INSERT' THEN regexp_extract(sql_text, 'INTO (\\w+)', 1)
  WHEN 'UPDATE' THEN regexp_extract(sql_text, 'UPDATE (\\w+)', 1) ELSE regexp_extract(sql_text, 'FROM (\\w+)', 1) END AS tables FROM sql_texts""", ("sql_texts",))
def _(s, d):
    return _t(s, d, "sql_texts").select("sql_id", F.array_join(sqltext.tables_of(F.col("sql_text"), F.col("sql_type")), ",").alias("tables"))


@_query("x11_fields_of_sql", """SELECT sql_id, CASE sql_type
  WHEN 'SELECT' THEN CASE WHEN sql_text LIKE 'SELECT *%' THEN 'WILDCARD,' ELSE 'p_name,p_size,' END || regexp_extract(sql_text, 'WHERE t\\.(c\\d)', 1) || ',d' || CASE WHEN sql_text LIKE 'SELECT *%' THEN ',p_size' ELSE '' END
  WHEN 'INSERT' THEN 'id,' || regexp_extract(sql_text, ', (c\\d)', 1) || ',name'
  WHEN 'UPDATE' THEN 'DYNAMIC,c1' || CASE WHEN regexp_extract(sql_text, ', (c\\d)', 1) = 'c1' THEN '' ELSE ',' || regexp_extract(sql_text, ', (c\\d)', 1) END || ',id'
  ELSE regexp_extract(sql_text, 'AND (c\\d)', 1) || ',id' END AS fields FROM sql_texts""", ("sql_texts",))
def _(s, d):
    return _t(s, d, "sql_texts").select("sql_id", F.array_join(sqltext.fields_of(F.col("sql_text"), F.col("sql_type")), ",").alias("fields"))


@_query("x12_without_tags", "SELECT sql_id, trim(regexp_replace(regexp_replace(regexp_replace(sql_text, '</?trim[^>]*>', '', 'g'), '[#$]\\{[^}]+\\}', '?', 'g'), '\\s+', ' ', 'g')) AS text FROM sql_texts", ("sql_texts",))
def _(s, d):
    return _t(s, d, "sql_texts").select("sql_id", sqltext.without_tags(F.col("sql_text")).alias("text"))


@_query("a18_votes", """, v AS (SELECT claim_id, CASE WHEN contains(vote, '确认') THEN 1 WHEN contains(vote, '否认') THEN 0 END AS side FROM votes), n AS (SELECT claim_id, count(*) FILTER (side = 1) AS yes, count(*) FILTER (side = 0) AS no FROM v GROUP BY claim_id)
SELECT *, CASE WHEN yes > no THEN 'PASSED' WHEN no > yes THEN 'REJECTED' ELSE 'PENDING' END AS status FROM n""", ("votes",))
def _(s, d):
    return evidence.voted(_t(s, d, "votes"))


_LINES = """, src AS (SELECT doc_id AS doc, unnest(string_split(regexp_replace(text, '\\n+$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n+$', ''), chr(10)), 1) AS line_number FROM documents WHERE text IS NOT NULL) """


def _src(s, d):
    lines = F.posexplode(F.split(F.regexp_replace("text", r"\n+$", ""), "\n", -1)).alias("at", "line")
    return _t(s, d, "documents").select(F.col("doc_id").alias("doc"), lines).select("doc", (F.col("at") + 1).alias("line_number"), "line")


def _claims(s, d):
    return _t(s, d, "claims").select(F.col("doc_id").alias("doc"), F.lit(0).alias("pos"), "line", "name")


_WORD = "(contains(line, name))"
_R1 = _LINES + f""", r AS (SELECT c.doc_id AS doc, c.line AS n, c.name, bool_or({_WORD}) AS hit, bool_or(s.line_number = c.line) AS there, bool_or(s.line_number = c.line AND regexp_matches(trim(s.line), '^(//|\\*)')) AS comment
  FROM (SELECT doc_id, line, name FROM claims) c LEFT JOIN (SELECT doc AS sd, line_number, line FROM src) s ON sd = c.doc_id AND line_number BETWEEN c.line AND c.line + 2 GROUP BY ALL) """.replace("(contains(line, name))", "contains(s.line, c.name)")


@_query("r1_checked_dependencies", _R1 + "SELECT doc, n AS line, name, coalesce(there AND (hit OR comment), false) AS passed, CASE WHEN there IS NOT TRUE THEN 'OUT_OF_RANGE' WHEN NOT (hit OR comment) THEN 'NAME_NOT_FOUND' END AS issue FROM r", ("claims",))
def _(s, d):
    return evidence.checked_dependencies(_claims(s, d), _src(s, d)).select("doc", "line", "name", "passed", "issue")


@_query("a10_overall_confidence", _R1 + "SELECT CAST(doc % 10 AS BIGINT) AS doc, count(*) AS total, count(*) FILTER (there AND (hit OR comment)) AS passed_count, CASE WHEN count(*) FILTER (there AND (hit OR comment)) = count(*) THEN 'CERTAIN' WHEN count(*) FILTER (there AND (hit OR comment)) >= 0.8 * count(*) THEN 'HIGH' WHEN count(*) FILTER (there AND (hit OR comment)) >= 0.5 * count(*) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r GROUP BY 1", ("claims",))
def _(s, d):
    return evidence.overall_confidence(evidence.checked_dependencies(_claims(s, d), _src(s, d)).withColumn("doc", F.col("doc") % 10))


@_query("r2_checked_ranges", _LINES + ", t AS (SELECT doc, max(line_number) AS n FROM src GROUP BY doc) SELECT doc_id AS doc, line, line BETWEEN 1 AND coalesce(n, 0) AS passed FROM claims LEFT JOIN t ON doc = doc_id", ("claims",))
def _(s, d):
    totals = _src(s, d).groupBy("doc").agg(F.max("line_number").alias("n_lines"))
    return evidence.checked_ranges(_claims(s, d), totals).select("doc", "line", "passed")


@_query("c11_nearest_offset", _LINES + ", h AS (SELECT doc_id, c.line, c.name, s.line_number - c.line AS off FROM claims c JOIN (SELECT doc AS sd, line_number, line AS txt FROM src) s ON sd = doc_id AND line_number BETWEEN c.line - 5 AND c.line + 5 AND contains(txt, c.name)) SELECT c.doc_id AS doc, c.line, c.name, CAST((SELECT arg_min(off, abs(off) * 2 + CASE WHEN off > 0 THEN 1 ELSE 0 END) FROM h WHERE h.doc_id = c.doc_id) AS INT) AS line_offset FROM claims c", ("claims",))
def _(s, d):
    return evidence.nearest_offset(_claims(s, d), _src(s, d)).select("doc", "line", "name", "line_offset")


_STRIPPED = r"regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@_query("p19_comment_or_blank_lines", _LINES.replace(", src", "WITH src", 1) + f"SELECT doc, count(*) AS n_lines, count(*) FILTER ({_STRIPPED} = '' OR regexp_matches({_STRIPPED}, '^(//|/\\*|\\*)')) AS n_blank FROM src GROUP BY doc")
def _(s, d):
    return _src(s, d).groupBy("doc").agg(F.count("*").alias("n_lines"), F.count_if(c.is_comment_or_blank(F.col("line"))).alias("n_blank"))


@_query("n5_json_props", "SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def _(s, d):
    found = reports.objects_of(_t(s, d, "events").select("user_id", "props"), "props")
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("object")["k"].try_cast("bigint")).alias("total"))


@_query("k9_cache_recent", "SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, key LIMIT 1000")
def _(s, d):
    entries = _t(s, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("last_used"), F.max("event_id").alias("event_id"))
    return stores.kept_recent(entries).select("key", "event_id")


@_query("k9_cache_alive", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(s, d):
    e = _t(s, d, "events").withColumn("created_at", F.col("ts"))
    last = F.broadcast(e.agg(F.max("ts").alias("now")))
    return stores.alive(e.crossJoin(last), F.col("now")).select("event_id")


@_query("k10_cache_keys", "SELECT event_id, sha256('[' || chr(34) || event_type || chr(34) || ',' || chr(34) || CAST(user_id AS VARCHAR) || chr(34) || ']') AS key FROM events")
def _(s, d):
    return _t(s, d, "events").select("event_id", stores.cache_key(F.col("event_type"), F.col("user_id")).alias("key"))


@_query("s3_changed_files", "SELECT doc_id, md5(text) AS file_hash FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def _(s, d):
    from factlake.sources.files import changed

    # an index of all files, in which those of one language have another hash
    files = _t(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("file_hash"), "doc_id", "lang")
    meta = files.select(F.col("path").alias("file_path"), F.when(F.col("lang") == "en", "old").otherwise(F.col("file_hash")).alias("file_hash"))
    return changed(files, meta).select("doc_id", "file_hash")


@_query("k1_replace_by_file", f"SELECT {_CALL} FROM call_edges WHERE file_path NOT LIKE '%/C1%' UNION ALL SELECT {_CALL.replace('line_number', 'line_number + 1')} FROM call_edges WHERE file_path LIKE '%/C1%'", ("call_edges",))
def _(s, d):
    e = _t(s, d, "call_edges")
    fresh = e.filter(F.col("file_path").contains("/C1")).withColumn("line_number", F.col("line_number") + 1)
    return stores.replaced_by_file(e, fresh).select(*_CALLS)


@_query("a20_a21_percentiles", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_disc(o_totalprice, 0.9) AS p90, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return _t(s, d, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice)").alias("p90"), F.count("*").alias("n"))


@_query("j5_enclosing_range", """WITH r AS (SELECT l_suppkey, l_returnflag || l_linestatus AS name, min(l_orderkey) AS b, max(l_orderkey) AS e FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
SELECT CAST(c.l_suppkey AS VARCHAR) AS path, l_orderkey AS line, arg_max(name, b * 1000000000 - e) AS caller_method FROM c JOIN r ON r.l_suppkey = c.l_suppkey AND l_orderkey BETWEEN b AND e GROUP BY c.l_suppkey, l_orderkey HAVING count(*) FILTER (b * 1000000000 - e = (SELECT max(z.b * 1000000000 - z.e) FROM r z WHERE z.l_suppkey = c.l_suppkey AND c.l_orderkey BETWEEN z.b AND z.e)) = 1""")
def _(s, d):
    from factlake.sources.java_facts import enclosing_methods

    # the orders between the first and last one of a kind are its range; lines that two kinds begin and end alike are left out
    items = _t(s, d, "lineitem").withColumn("path", F.col("l_suppkey").cast("string"))
    kind = F.concat("l_returnflag", "l_linestatus").alias("name")
    ranges = items.groupBy("path", kind).agg(F.min("l_orderkey").alias("begin_line"), F.max("l_orderkey").alias("end_line"), F.lit("").alias("class_name"))
    tied = ranges.groupBy("path", "begin_line", "end_line").agg(F.count("*").alias("n")).filter("n > 1").select("path").distinct()
    calls = items.select("path", F.col("l_orderkey").alias("line")).distinct().join(tied, "path", "left_anti")
    return enclosing_methods(calls, ranges).select("path", "line", "caller_method")


@_query("j6_owning_method", """, m AS (SELECT conv_id, turn FROM conversations WHERE role = 'user') SELECT conv_id AS doc, CAST(turn AS INT) AS pos, turn AS line, (SELECT 'u' || CAST(max(m.turn) AS VARCHAR) FROM m WHERE m.conv_id = c.conv_id AND m.turn <= c.turn) AS method FROM conversations c WHERE role <> 'user'""".replace(", m AS", "WITH m AS", 1))
def _(s, d):
    t = _t(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "role")
    methods = t.filter("role = 'user'").select("doc", "line", F.concat(F.lit("u"), F.col("line").cast("string")).alias("name"))
    return evidence.owning_method(t.filter("role <> 'user'").select("doc", "line", F.col("line").cast("int").alias("pos")), methods)


@_query("j7_closest_method", "WITH m AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') SELECT c.conv_id AS doc, c.turn AS line, 'a' || CAST((SELECT arg_min(m.turn, abs(m.turn - c.turn) * 1000 + m.turn) FROM m WHERE m.conv_id = c.conv_id) AS VARCHAR) AS method FROM conversations c WHERE role <> 'assistant'")
def _(s, d):
    t = _t(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "role")
    methods = t.filter("role = 'assistant'").select("doc", "line", F.concat(F.lit("a"), F.col("line").cast("string")).alias("name"))
    return evidence.closest_method(t.filter("role <> 'assistant'").select("doc", "line", F.col("line").alias("pos")), methods).select("doc", "line", "method")


@_query("t5_distinct_calls", "SELECT doc, name, line, pos FROM (SELECT l_suppkey AS doc, l_returnflag AS name, l_linenumber AS line, l_orderkey AS pos, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber ORDER BY l_orderkey) AS rn FROM lineitem) x WHERE rn = 1")
def _(s, d):
    calls = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("pos"))
    return reports.distinct_calls(calls)


@_query("k2_k5_k6_published", "SELECT n_nationkey, n_name, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) x GROUP BY ALL")
def _(s, d):
    # a new version of a table, rows appended to it, and a table that is not there yet
    rows = _t(s, d, "nation").select("n_nationkey", "n_name")
    folder = shared_folder(s)
    path = stores.publish(rows, f"{folder}/nation")
    stores.append(rows, path)
    none = stores.table_or_empty(s, f"{folder}/no-such-table", rows.schema)
    return stores.table_or_empty(s, path, rows.schema).unionByName(none).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("n"))


@_query("a9_contradiction_scores", "SELECT doc, CASE WHEN s > 1 THEN 1.0 ELSE s END AS score FROM (SELECT o_custkey AS doc, round(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 0.3 WHEN '2-HIGH' THEN 0.15 ELSE 0.05 END)::DOUBLE, 6) AS s FROM orders GROUP BY 1) x")
def _(s, d):
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").otherwise("LOW")
    f = _t(s, d, "orders").select(F.col("o_custkey").alias("doc"), sev.alias("severity"), F.lit("CONTRADICTORY").alias("status"), F.lit("m").alias("source"))
    return evidence.contradiction_scores(f).select("doc", "score")


@_query("a13_risk_overview", "SELECT o_custkey AS doc, count(*) FILTER (o_orderpriority = '1-URGENT') AS high, count(*) FILTER (o_orderpriority = '2-HIGH') AS medium, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey)[1:5], ',') AS first FROM orders GROUP BY 1")
def _(s, d):
    sev = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").otherwise("?")
    r = _t(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.lit(False).alias("top_level"), F.col("o_orderkey").alias("pos"), sev.alias("severity"), F.col("o_orderkey").cast("string").alias("description"))
    return reports.risk_overview(r).withColumn("first", F.array_join("first", ","))


@_query("a11_status_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS rejected, count(*) FILTER (o_orderstatus = 'P') AS pending, CAST(0 AS BIGINT) AS skipped, count(*) AS total FROM orders")
def _(s, d):
    m = F.col("o_orderstatus")
    return evidence.status_summary(_t(s, d, "orders").select(F.when(m == "F", "PASSED").when(m == "O", "REJECTED").when(m == "P", "PENDING").otherwise("OTHER").alias("status")))


#: after some files were read again: their lines have moved, their terms are called otherwise
_REREAD = "file_path LIKE '%/F1%'"
_MOVED = f"""now AS (SELECT * FROM code_terms WHERE NOT {_REREAD} UNION ALL SELECT replace(replace(term, 'Svc1', 'Task1'), 'steel', 'Promo_tin'), term_type, file_path, line_number + 1 FROM code_terms WHERE {_REREAD})"""


@_query("p2_p3_t6_trigram_index", f""", {_MOVED}
SELECT 'end' AS how, * FROM now WHERE lower(term) LIKE '%.promo_burnished_tin' UNION ALL SELECT 'start', * FROM now WHERE lower(term) LIKE 'svc1%'
UNION ALL SELECT 'anywhere', * FROM now WHERE contains(lower(term), 'promo') UNION ALL SELECT 'short', * FROM now WHERE contains(lower(term), 'k1') UNION ALL SELECT 'none', * FROM now WHERE contains(lower(term), 'promo steel')""", ("code_terms",))
def _(s, d):
    terms = _t(s, d, "code_terms")
    old = terms.filter(_REREAD)
    fresh = old.withColumns({"term": F.expr("replace(replace(term, 'Svc1', 'Task1'), 'steel', 'Promo_tin')"), "line_number": F.col("line_number") + 1})
    index = indexes.with_files(indexes.term_index(terms, 16), old, fresh)
    asked = {"end": (".PROMO_burnished_tin", "end"), "start": ("SVC1", "start"), "anywhere": ("Promo", "anywhere"), "short": ("K1", "anywhere"), "none": ("promo steel", "anywhere")}
    parts = [indexes.matching(index, *a).select(F.lit(how).alias("how"), *terms.columns) for how, a in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NOW_OPS = "now AS (SELECT * FROM db_operations WHERE source_file NOT LIKE '%7.xml' UNION ALL SELECT mapper_interface, method_name, sql_type, replace(table_name, 'Brand#1', 'Brand#9') AS table_name, fields_csv, xml_line, source_file FROM db_operations WHERE source_file LIKE '%7.xml' AND sql_type <> 'UPDATE')"


@_query("a1_r8_maintained_counts", f""", {_NOW_OPS}, k AS (SELECT table_name, sql_type, count(*) AS operations, count(DISTINCT mapper_interface) AS mappers FROM now GROUP BY ALL),
t AS (SELECT table_name, count(DISTINCT mapper_interface) AS n, count(DISTINCT array_to_string(string_split(mapper_interface, '.')[1:3], '.')) AS modules FROM now GROUP BY ALL)
SELECT k.*, max(mappers) OVER (PARTITION BY table_name) AS mappers_max, n AS mappers_distinct, CASE WHEN modules >= 3 THEN modules END AS modules FROM k JOIN t USING (table_name)""", ("db_operations",))
def _(s, d):
    ops = _t(s, d, "db_operations")
    old = ops.filter("source_file LIKE '%7.xml'")
    fresh = old.filter("sql_type <> 'UPDATE'").withColumn("table_name", F.expr("replace(table_name, 'Brand#1', 'Brand#9')"))
    counts = indexes.with_operations(indexes.operation_counts(ops, 16), old, fresh).rows()
    return indexes.stats_of(counts).join(facts.shared_tables(counts).select("table_name", "modules"), "table_name", "left")


@_query("p9_p10_j3_edge_store", f""", one AS (SELECT 'called' AS how, {_CALL} FROM call_edges WHERE callee_class = 'com.p2.C7' AND callee_method = 'm1' UNION ALL SELECT 'calls', {_CALL} FROM call_edges WHERE caller_class = 'com.p2.C7' AND caller_method = 'm1'),
hop AS (SELECT DISTINCT b.caller_class, b.caller_method FROM call_edges a JOIN call_edges b ON b.callee_class = a.caller_class AND b.callee_method = a.caller_method)
SELECT * FROM one UNION ALL SELECT 'hop', caller_class, caller_method, '', '', '', '', 0 FROM hop""", ("call_edges",))
def _(s, d):
    store = indexes.edge_store(_t(s, d, "call_edges"))
    called = facts.calls_by(store.calls("callee", "com.p2.C7", "m1"), "callee", "com.p2.C7", "m1").select(F.lit("called").alias("how"), *_CALLS)
    calls = facts.calls_by(store.calls("caller", "com.p2.C7", "m1"), "caller", "com.p2.C7", "m1").select(F.lit("calls").alias("how"), *_CALLS)
    nodes = store.by_caller.select(F.col("caller_class").alias("callee_class"), F.col("caller_method").alias("callee_method")).distinct()
    hop = store.by_callee.join(nodes, ["callee_class", "callee_method"], "left_semi").select("caller_class", "caller_method").distinct()
    rest = {"callee_class": F.lit(""), "callee_method": F.lit(""), "call_type": F.lit(""), "file_path": F.lit(""), "line_number": F.lit(0)}
    return called.unionByName(calls).unionByName(hop.withColumns({"how": F.lit("hop"), **rest}))
