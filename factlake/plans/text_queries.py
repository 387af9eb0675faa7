"""Queries over source texts: Java classes, mapper XML, diffs and JSON reports, each with SQL that reads the texts by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators import diffs, evidence, impact, implicit, sqltext
from factlake.plans.queries import _query
from factlake.sources import files, index, java_facts, mapper_xml
from factlake.sources.views import view

_JAVA = ("java_files",)
#: the lines of each file, and those without comments and what strings hold
_LINES = r""", jl AS (
  SELECT path, raw, n, regexp_replace(regexp_replace(raw, '"[^"]*"', '""', 'g'), '/\*.*?\*/|//.*', '', 'g') AS line
  FROM (SELECT path, unnest(string_split(content, chr(10))) AS raw, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS n FROM java_files) z
), decl AS (
  SELECT path, n, line, CASE WHEN regexp_matches(lag(line) OVER w, '^\s*@\w+$') THEN n - 1 ELSE n END AS begins, lag(line) OVER w AS before
  FROM jl WINDOW w AS (PARTITION BY path ORDER BY n)
), pkg AS (SELECT path, max(regexp_extract(line, '^package ([\w.]+);', 1)) AS package FROM jl GROUP BY path
), cls AS (SELECT path, package || '.' || regexp_extract(line, '\bclass (\w+)', 1) AS class_name, regexp_extract(line, 'extends (\w+)', 1) AS parent, begins, before FROM decl JOIN pkg USING (path) WHERE regexp_matches(line, '\bclass \w+')
), ends AS (SELECT path, n AS e FROM jl WHERE line = '    }'
), meth AS (
  SELECT path, class_name, regexp_extract(d.line, '(\w+)\(', 1) AS name, regexp_extract(d.line, '(\w+) \w+\(', 1) AS type, regexp_extract(d.line, 'public|private|protected', 0) AS visibility, d.begins AS begin_line, min(e) AS end_line
  FROM decl d JOIN cls USING (path) JOIN ends USING (path) WHERE regexp_matches(d.line, '^    (public|private|protected) [\w ]+\(.*\) \{$') AND e > n GROUP BY ALL
), calls AS (
  SELECT path, n, regexp_replace(x, '\($', '') AS x FROM (SELECT path, n, unnest(regexp_extract_all(line, '@?[\w.]+\(')) AS x FROM jl WHERE NOT regexp_matches(line, '^    (public|private|protected) [\w ]+\(')) z
  WHERE x NOT LIKE '@%' AND x NOT IN ('if(', 'for(', 'while(', 'switch(', 'catch(')
), called AS (
  SELECT path, n, regexp_extract(x, '([^.]*)$', 1) AS name, CASE WHEN x LIKE '%.%' THEN regexp_replace(x, '\.[^.]*$', '') ELSE '' END AS scope FROM calls
), plain AS (SELECT * FROM called WHERE NOT regexp_matches(name, '^(get|set|is)[A-Z]') AND name NOT IN ('toString', 'hashCode', 'equals', 'getClass', 'valueOf', 'add', 'size', 'contains', 'remove', 'iterator', 'toArray', 'startPage', 'getDataTable', 'toAjax', 'error', 'success')
), imp AS (SELECT path, regexp_extract(line, '^import (static )?([\w.]+);', 2) AS name FROM jl WHERE line LIKE 'import %'
), fld AS (SELECT path, regexp_extract(line, '(\w+) \w+;$', 1) AS type, regexp_extract(line, '(\w+);$', 1) AS name, before FROM decl WHERE regexp_matches(line, '^    private \w+ \w+;$')
) """


def _files(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "java_files")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return java_facts.java_facts(_files(s, d))


@_query("x2_imports", _LINES + "SELECT unnest([name, regexp_extract(name, '([^.]*)$', 1)]) AS term, 'IMPORT' AS term_type, path AS file_path FROM imp", _JAVA)
def _(s, d):
    return files.imports(_files(s, d))


@_query("x5_null_literals", _LINES + r"SELECT 'null' AS term, 'NULL_LITERAL' AS term_type, path AS file_path, n AS line_number FROM jl WHERE regexp_matches(raw, '\bnull\b')", _JAVA)
def _(s, d):
    return files.null_literals(files.lines(_files(s, d)))


@_query("x1_x3_x4_code_terms", _LINES + r"""SELECT regexp_extract(class_name, '([^.]*)$', 1) AS term, 'CLASS' AS term_type, path AS file_path, begins AS line_number FROM cls
UNION ALL SELECT regexp_extract(before, '@(\w+)', 1), 'ANNOTATION', path, begins FROM cls WHERE before LIKE '%@%'
UNION ALL SELECT name, 'METHOD', path, begin_line FROM meth
UNION ALL SELECT unnest(CASE WHEN scope = '' THEN [name] ELSE [scope || '.' || name, name] END), 'CALLEE', path, n FROM plain""", _JAVA)
def _(s, d):
    return java_facts.code_terms(_facts(s, d))


@_query("x6_methods", _LINES + "SELECT path, class_name, name, type, visibility, begin_line, end_line FROM meth", _JAVA)
def _(s, d):
    return _facts(s, d).filter("kind = 'method'").select("path", "class_name", "name", "type", "visibility", "begin_line", "end_line")


@_query("x6_fields", _LINES + r"""SELECT path, class_name, name, type, regexp_extract_all(fld.before, '@(\w+)', 1)[1] AS annotation FROM fld JOIN cls USING (path)""", _JAVA)
def _(s, d):
    return _facts(s, d).filter("kind = 'field'").select("path", "class_name", "name", "type", F.get("annotations", F.lit(0)).alias("annotation"))


@_query("x7_injected_fields", _LINES + r""", own AS (SELECT class_name, name AS field, type AS field_type FROM fld JOIN cls USING (path) WHERE regexp_matches(fld.before, '@(Autowired|Resource|Inject)\b')),
up AS (SELECT c.class_name, i.name AS parent_class FROM cls c JOIN imp i ON i.path = c.path AND regexp_extract(i.name, '([^.]*)$', 1) = c.parent WHERE i.name IN (SELECT class_name FROM cls)),
above AS (SELECT * FROM up UNION SELECT a.class_name, u.parent_class FROM above a JOIN up u ON u.class_name = a.parent_class)
SELECT * FROM own UNION SELECT a.class_name, field, field_type FROM above a JOIN own o ON o.class_name = a.parent_class WHERE a.class_name <> a.parent_class""", _JAVA)
def _(s, d):
    return java_facts.injected_fields(_facts(s, d))


_EDGES = r""", edge AS (
  SELECT DISTINCT p.path, p.n, p.name, p.scope, m.name AS caller_method, cls.class_name, package,
    CASE WHEN p.scope = 'this' THEN regexp_extract(cls.class_name, '([^.]*)$', 1) WHEN f.type IS NOT NULL THEN f.type WHEN regexp_matches(p.scope, '^[A-Z]\w*$') THEN p.scope END AS simple
  FROM plain p JOIN cls USING (path) JOIN pkg USING (path) LEFT JOIN fld f ON f.path = p.path AND f.name = p.scope LEFT JOIN meth m ON m.path = p.path AND p.n BETWEEN m.begin_line AND m.end_line
)"""


@_query("x8_j4_call_edges", _LINES + _EDGES + r"""SELECT class_name AS caller_class, coalesce(caller_method, '') AS caller_method, CASE WHEN simple IS NULL THEN 'UNKNOWN' ELSE coalesce((SELECT min(i.name) FROM imp i WHERE i.path = edge.path AND regexp_extract(i.name, '([^.]*)$', 1) = simple), package || '.' || simple) END AS callee_class,
  name AS callee_method, 'DIRECT' AS call_type, path AS file_path, n AS line_number FROM edge
WHERE name NOT IN ('put', 'get', 'stream', 'collect', 'forEach')""", _JAVA)
def _(s, d):
    return java_facts.call_edges(_facts(s, d)).drop("confidence")


@_query("j5_p22_enclosing_methods", _LINES + "SELECT path, n AS line, called.name, coalesce(m.name, '') AS caller_method, m.class_name AS caller_class FROM called LEFT JOIN meth m USING (path) WHERE n BETWEEN begin_line AND end_line OR path NOT IN (SELECT path FROM meth)", _JAVA)
def _(s, d):
    found = _facts(s, d)
    calls = found.filter("kind = 'call'").select("path", F.col("begin_line").alias("line"), "name")
    return java_facts.enclosing_methods(calls, found.filter("kind = 'method'"))


#: what the texts of several shapes say in comments about themselves
_SAID = r""", said AS (SELECT path, n, string_split(e, '|') AS e FROM (SELECT path, n, unnest(string_split(regexp_extract(raw, '//= (.*)$', 1), ';')) AS e FROM (
  SELECT path, unnest(string_split(content, chr(10))) AS raw, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS n FROM java_shapes) y WHERE contains(raw, '//= ')) z),
heirs AS (SELECT DISTINCT unnest(regexp_extract_all(content, '//\+ ([^|\n]*)', 1)) AS interface, unnest(regexp_extract_all(content, '//\+ [^|\n]*\|([^\n]*)', 1)) AS class FROM java_shapes) """
_SHAPES = ("java_shapes",)


@_query("x8_j4_scoped_calls", _SAID + "SELECT DISTINCT e[1] AS caller_class, e[2] AS caller_method, e[3] AS callee_class, e[4] AS callee_method, path AS file_path, n AS line_number FROM said", _SHAPES)
def _(s, d):
    found = java_facts.java_facts(view(s, d, "java_shapes"))
    return java_facts.call_edges(found).drop("call_type", "confidence")


@_query("j11_implementors", _SAID + "SELECT interface, class FROM heirs", _SHAPES)
def _(s, d):
    return java_facts.implementors(java_facts.java_facts(view(s, d, "java_shapes")))


@_query("j11_x16_derived_impls", _SAID + r""", used AS (SELECT path, unnest(regexp_extract_all(content, '@Autowired\s*(?:private\s+)?(\w+)\s+\w+', 1)) AS u FROM java_shapes),
simple AS (SELECT DISTINCT regexp_extract(interface, '([^.]*)$', 1) AS i, class FROM heirs)
SELECT path, 'INTERFACE_IMPL' AS dimension, class AS target, CASE WHEN count(*) OVER (PARTITION BY path, u) > 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM used JOIN simple ON u = i""", _SHAPES)
def _(s, d):
    files_ = view(s, d, "java_shapes")
    heirs = java_facts.implementors(java_facts.java_facts(files_))
    return implicit.interface_impls(files_, heirs.select(F.substring_index("interface", ".", -1).alias("interface"), "class").distinct())


@_query("x9_method_bodies", _LINES + "SELECT path, class_name, name, string_agg(raw, chr(10) ORDER BY n) AS body FROM meth JOIN jl USING (path) WHERE n BETWEEN begin_line AND end_line GROUP BY path, class_name, name, begin_line", _JAVA)
def _(s, d):
    return java_facts.method_body(_facts(s, d).filter("kind = 'method'"), _files(s, d))


@_query("j13_first_declared", _LINES + "SELECT path, name, min(begin_line) AS begin_line FROM meth GROUP BY ALL", _JAVA)
def _(s, d):
    return java_facts.first_declared(_facts(s, d).filter("kind = 'method'"))


@_query("s1_s2_scanned_files", "SELECT path, md5(content) AS file_hash FROM java_files WHERE content LIKE '%mapper%'", _JAVA)
def _(s, d):
    given = _files(s, d)
    raw = given.select("path", F.encode("content", "UTF-8").alias("content")).unionByName(given.limit(1).select(F.lit("app/src/main/java/Broken.java").alias("path"), F.unhex(F.lit("C328FF")).alias("content")))
    outside = given.limit(1).select(F.lit("app0/tools/Other.java").alias("path"), F.encode(F.lit("class Other"), "UTF-8").alias("content"))
    good, _ = index.readable(index.preferred(raw.unionByName(outside)))
    return good.select("path", "file_hash")


_STALE = "regexp_matches(path, '[02468]ServiceImpl')"


@_query("s8_k6_incremental_index", _LINES + f""", edges AS (SELECT unnest(CASE WHEN scope = '' THEN [name] ELSE [scope || '.' || name, name] END) AS term, 'CALLEE' AS term_type, path AS file_path, n AS line_number FROM plain)
SELECT * FROM edges UNION ALL SELECT 'kept', 'CALLEE', path, 1 FROM java_files WHERE NOT {_STALE}""".replace("FROM edges UNION", f"FROM edges WHERE regexp_matches(file_path, '[02468]ServiceImpl') UNION"), _JAVA)
def _(s, d):
    # an index that knows every other file, one that has vanished and stale hashes of the rest
    now = index.with_hash(_files(s, d))
    stale = F.col("path").rlike("[02468]ServiceImpl")
    meta = now.select(F.col("path").alias("file_path"), F.when(stale, "old").otherwise(F.col("file_hash")).alias("file_hash"))
    gone = s.range(1).select(F.lit("app9/Gone.java").alias("file_path"), F.lit("h").alias("file_hash"))
    meta = meta.unionByName(gone)
    rows = meta.select(F.when(F.col("file_hash") == "old", "stale").otherwise("kept").alias("term"), F.lit("CALLEE").alias("term_type"), "file_path", F.lit(1).alias("line_number"))
    fresh, _ = index.refreshed(rows, meta, now, lambda f: java_facts.code_terms(java_facts.java_facts(f)).filter("term_type = 'CALLEE'"))
    return fresh


@_query("j9_r7_risk_contradictions", _LINES + r""", k AS (SELECT path, n, regexp_replace(raw, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM jl)
SELECT path AS doc, 'm' || CAST(n AS VARCHAR) AS source, 'C3' AS rule, 'HIGH' AS severity, CAST(-0.5 AS DOUBLE) AS penalty, 'CONTRADICTORY' AS status FROM k WHERE (t = '' OR regexp_matches(t, '^(//|/\*|\*)')) AND n < (SELECT max(n) FROM jl)""", _JAVA)
def _(s, d):
    # a risk claimed for every line
    src = files.lines(_files(s, d)).withColumnRenamed("path", "doc")
    risks = src.select("doc", F.concat(F.lit("m"), F.col("line_number").cast("string")).alias("method"), F.col("line_number").alias("line"))
    return evidence.risk_contradictions(risks, src).drop("target")


# implicit dependencies: patterns over whole files


@_query("x15_injections", r"SELECT path, 'SPRING_INJECTION' AS dimension, unnest(regexp_extract_all(content, '@(?:Autowired|Resource|Inject)\s*(?:\w+\s+)?(?:private\s+|public\s+|protected\s+)?(\w+)\s+\w+', 1)) AS target, 'HIGH' AS confidence FROM java_files", _JAVA)
def _(s, d):
    return implicit.injections(_files(s, d))


@_query("x16_interface_impls", r"""SELECT path, 'INTERFACE_IMPL' AS dimension, u || 'Impl' || CAST(i AS VARCHAR) AS target, CASE WHEN count(*) OVER (PARTITION BY path, u) > 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
FROM (SELECT path, u, unnest(CASE WHEN length(u) % 2 = 0 THEN [1, 2] ELSE [1] END) AS i FROM (SELECT path, unnest(regexp_extract_all(content, '@Autowired\s*(?:private\s+)?(\w+)\s+\w+', 1)) AS u FROM java_files) x) y""", _JAVA)
def _(s, d):
    types = _files(s, d).select(F.explode(F.regexp_extract_all("content", F.lit(r"private (\w+Mapper) "), F.lit(1))).alias("interface")).distinct()
    both = types.select("interface", F.explode(F.when(F.length("interface") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("i"))
    return implicit.interface_impls(_files(s, d), both.select("interface", F.concat("interface", F.lit("Impl"), F.col("i").cast("string")).alias("class")))


@_query("x17_x18_x19_x20_patterns", r"""SELECT path, 'REFLECTION_CALL' AS dimension, 'getBean' AS target, 'MEDIUM' AS confidence FROM java_files WHERE contains(content, 'getBean(')
UNION ALL SELECT path, 'CONFIG_REFERENCE', '@Value', 'LOW' FROM (SELECT path, unnest(regexp_extract_all(content, '@Value\("\$\{')) AS v FROM java_files) x
UNION ALL SELECT path, 'CONDITIONAL_BEAN', '@Conditional', 'MEDIUM' FROM java_files WHERE contains(content, 'k1')
UNION ALL SELECT path, 'EVENT_LISTENER', '@EventListener public void on(', 'HIGH' FROM java_files WHERE contains(content, 'k2')""", _JAVA)
def _(s, d):
    more = F.when(F.col("content").contains("k1"), "@ConditionalOnBean").when(F.col("content").contains("k2"), "@EventListener public void on(E e)").otherwise("")
    given = _files(s, d).withColumn("content", F.concat("content", more))
    return implicit.detected(given, ("EVENT_LISTENER", "CONDITIONAL_BEAN", "REFLECTION_CALL", "CONFIG_REFERENCE"))


@_query("x21_u2_a12_dimensions", r"""SELECT dim AS dimension, (SELECT count(*) FROM (SELECT unnest(CASE dim WHEN 'SPRING_INJECTION' THEN regexp_extract_all(content, '@(?:Autowired|Resource|Inject)\s*(?:\w+\s+)?(?:private\s+|public\s+|protected\s+)?(\w+)\s+\w+', 1)
  WHEN 'INTERFACE_IMPL' THEN regexp_extract_all(content, '@Autowired\s*(?:private\s+)?(\w+)\s+\w+', 1) WHEN 'REFLECTION_CALL' THEN regexp_extract_all(content, 'getBean\(|Class\.forName\(') WHEN 'CONFIG_REFERENCE' THEN regexp_extract_all(content, '@Value\("\$\{') ELSE [] END) AS x FROM java_files) y) AS n
FROM (SELECT unnest(['SPRING_INJECTION', 'INTERFACE_IMPL', 'EVENT_LISTENER', 'CONDITIONAL_BEAN', 'REFLECTION_CALL', 'CONFIG_REFERENCE']) AS dim) z""", _JAVA)
def _(s, d):
    return implicit.by_dimension(implicit.detected(_files(s, d))).select("dimension", "n")


@_query("a12_detection_summary", r"SELECT 6 AS dimensions, CAST(4 AS BIGINT) AS with_findings, CAST(2 AS BIGINT) AS without, CAST(sum(len(regexp_extract_all(content, '@Autowired\s*private')) * 2 + len(regexp_extract_all(content, 'getBean\(')) + len(regexp_extract_all(content, '@Value'))) AS BIGINT) AS findings FROM java_files", _JAVA)
def _(s, d):
    return implicit.summarised(implicit.detected(_files(s, d)))


# mapper XML

_XML = ("mapper_files",)
_STATEMENTS = r""", xml AS (SELECT path, content, regexp_extract(content, 'namespace="([^"]*)"', 1) AS ns, regexp_extract(content, '<sql id="cols">(.*?)</sql>', 1) AS cols FROM mapper_files),
st AS (SELECT path, ns, cols, content, unnest(['select', 'insert', 'update', 'delete']) AS kind FROM xml),
raw AS (SELECT path, ns, kind, content, regexp_extract(content, '<' || kind || '\s+id="([^"]*)"', 1) AS id, replace(regexp_extract(content, '(?s)<' || kind || '\s[^>]*>(.*?)</' || kind || '>', 1), '<include refid="cols"/>', cols) AS body FROM st),
statements AS (SELECT path AS source_file, ns AS mapper_interface, id AS method_name, upper(kind) AS sql_type,
  trim(regexp_replace(replace(regexp_replace(regexp_replace(body, '<!\[CDATA\[|\]\]>', '', 'g'), '</?(?:where|if)[^<>]*>', '', 'g'), '&lt;', '<'), '\s+', ' ', 'g')) AS sql_text,
  CAST(len(string_split(split_part(content, '<' || kind || ' ', 1), chr(10))) AS INT) AS xml_line FROM raw) """


def _xml(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "mapper_files").withColumnRenamed("content", "content")


@_query("s4_s5_s7_x13_c16_statements", _STATEMENTS + "SELECT * FROM statements", _XML)
def _(s, d):
    return mapper_xml.statements(_xml(s, d))


@_query("s6_result_maps", r""", x AS (SELECT path, content, unnest(regexp_extract_all(content, '<(?:id|result) property[^>]*>')) AS e FROM mapper_files)
SELECT path AS source_file, regexp_extract(content, 'namespace="([^"]*)"', 1) AS mapper_interface, regexp_extract(content, '<resultMap[^>]*type="([^"]*)"', 1) AS java_type, regexp_extract(e, 'property="([^"]*)"', 1) AS property_name, regexp_extract(e, 'column="([^"]*)"', 1) AS column_name, e LIKE '<id %' AS is_id FROM x""", _XML)
def _(s, d):
    return mapper_xml.mappings(_xml(s, d))


_TABLES = r"list_distinct(list_concat(list_concat(regexp_extract_all(sql_text, '(?:FROM|INTO|^UPDATE) (\w+)', 1), regexp_extract_all(sql_text, 'JOIN (\w+)', 1)), []))"


@_query("k4_x10_mapper_operations", _STATEMENTS + f"SELECT source_file, mapper_interface, method_name, sql_type, xml_line, unnest({_TABLES}) AS table_name FROM statements", _XML)
def _(s, d):
    return sqltext.operations(mapper_xml.statements(_xml(s, d))).select("source_file", "mapper_interface", "method_name", "sql_type", "xml_line", "table_name")


@_query("k4_s8_replaced_operations", _STATEMENTS + f"SELECT source_file, mapper_interface, method_name, sql_type, xml_line, unnest({_TABLES}) AS table_name FROM statements UNION ALL SELECT path, 'old', 'm', 'SELECT', 0, 't' FROM mapper_files WHERE false", _XML)
def _(s, d):
    now = index.with_hash(_xml(s, d))
    meta = now.select(F.col("path").alias("file_path"), F.lit("old").alias("file_hash"))
    old = meta.select(F.col("file_path"), F.col("file_path").alias("source_file"), F.lit("old").alias("mapper_interface"), F.lit("m").alias("method_name"), F.lit("SELECT").alias("sql_type"), F.lit(0).alias("xml_line"), F.lit("t").alias("table_name"))
    build = lambda f: sqltext.operations(mapper_xml.statements(f)).select(F.col("source_file").alias("file_path"), "source_file", "mapper_interface", "method_name", "sql_type", "xml_line", "table_name")
    rows, _ = index.refreshed(old, meta, now, build)
    return rows.drop("file_path")


@_query("x11_mapper_fields", _STATEMENTS + r""", part AS (SELECT source_file, method_name, sql_type, sql_text, regexp_extract(sql_text, 'WHERE (.*?)(?: ORDER BY|$)', 1) AS w FROM statements),
f AS (SELECT source_file, method_name, CASE sql_type
  WHEN 'SELECT' THEN list_concat(list_concat(regexp_extract_all(regexp_extract(sql_text, 'SELECT (.*?) FROM', 1), '\w+\.\w+'), regexp_extract_all(w, '(\w+\.\w+) ?=', 1)), regexp_extract_all(sql_text, 'ORDER BY (\w+\.\w+)', 1))
  WHEN 'INSERT' THEN regexp_extract_all(regexp_extract(sql_text, '\w+ \(([^)]*)\) VALUES', 1), '\w+')
  WHEN 'UPDATE' THEN list_concat(list_concat(regexp_extract_all(regexp_extract(sql_text, 'SET (.*?) WHERE', 1), '(\w+) =', 1), regexp_extract_all(w, '(\w+) [<>=]', 1)), regexp_extract_all(w, '(\w+) (?:IN|BETWEEN)', 1))
  ELSE regexp_extract_all(w, '(\w+) (?:IN|BETWEEN)', 1) END AS fs FROM part)
SELECT source_file, method_name, CAST(i AS INT) AS at, regexp_extract(x, '([^.]*)$', 1) AS field FROM (SELECT source_file, method_name, x, min(i) AS i FROM (SELECT source_file, method_name, unnest(fs) AS y, regexp_extract(unnest(fs), '([^.]*)$', 1) AS x, generate_subscripts(fs, 1) AS i FROM f) z GROUP BY ALL) u""".replace("CAST(i AS INT) AS at", "CAST(row_number() OVER (PARTITION BY source_file, method_name ORDER BY i) AS INT) AS at"), _XML)
def _(s, d):
    ops = mapper_xml.statements(_xml(s, d))
    return ops.select("source_file", "method_name", F.posexplode(sqltext.fields_of(F.col("sql_text"), F.col("sql_type"))).alias("at", "field")).withColumn("at", F.col("at") + 1)


# diffs

_DIFF = ("diff_texts",)
_SECTIONS = r""", dl AS (SELECT diff_id, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS n FROM diff_texts),
fs AS (SELECT *, sum(CASE WHEN line LIKE 'diff --git %' THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY n) AS f FROM dl),
hs AS (SELECT *, sum(CASE WHEN line LIKE '@@ %' THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id, f ORDER BY n) AS h FROM fs WHERE f > 0),
sec AS (SELECT diff_id, f, max(regexp_extract(line, '^diff --git a/(.*) b/', 1)) AS old_path, max(regexp_extract(line, '^diff --git a/.* b/(.*)$', 1)) AS new_path, bool_or(line LIKE 'new file mode%') AS added, bool_or(line LIKE 'deleted file mode%') AS deleted, bool_or(line LIKE 'Binary files %') AS bin,
  coalesce(bool_and(regexp_matches(line, '^[+-]\s*(import\s.*|(//|/\*|\*).*|)$')) FILTER (h > 0 AND regexp_matches(line, '^[+-]')), true) AS low FROM hs GROUP BY diff_id, f),
res AS (SELECT *, CASE WHEN added THEN 'ADDED' WHEN deleted THEN 'DELETED' ELSE 'MODIFIED' END AS change_type, CASE WHEN deleted THEN old_path ELSE new_path END AS file_path FROM sec WHERE NOT bin AND new_path LIKE '%.java'),
cl AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(file_path, '\.java$', ''), '^.*src/(main|test)/java/', ''), '^src/', ''), '/', '.') AS class_name FROM res) """


@_query("s9_p18_changed_files", _SECTIONS + "SELECT diff_id, file_path, class_name, change_type, CASE WHEN low THEN 'LOW' ELSE 'HIGH' END AS significance FROM cl", _DIFF)
def _(s, d):
    return diffs.changed_files(view(s, d, "diff_texts")).select("diff_id", "file_path", "class_name", "change_type", "significance")


@_query("x14_changed_methods", _SECTIONS + r""", decl AS (SELECT diff_id, f, h, first(name ORDER BY n) AS name FROM (SELECT diff_id, f, h, n, regexp_extract(substr(line, 2), '\b(?:public|private|protected|static)\s+(?:\w+\s+)*(\w+)\s*\(', 1) AS name FROM hs WHERE h > 0 AND regexp_matches(line, '^[-+ ]')) x WHERE name <> '' GROUP BY ALL),
places AS (SELECT diff_id, f, h, regexp_extract(line, '^@@ -(\d+)', 1)::INT AS old_start_line, regexp_extract(line, '\+(\d+)', 1)::INT AS new_start_line FROM hs WHERE line LIKE '@@ %')
SELECT diff_id, file_path, class_name, name AS method_name, old_start_line, new_start_line FROM cl JOIN decl USING (diff_id, f) JOIN places USING (diff_id, f, h) WHERE change_type = 'MODIFIED' AND NOT low""", _DIFF)
def _(s, d):
    m = diffs.changed_files(view(s, d, "diff_texts")).select("diff_id", "file_path", F.explode("changed_methods").alias("m"))
    return m.select("diff_id", "file_path", "m.class_name", "m.method_name", "m.old_start_line", "m.new_start_line")


@_query("a5_s9_changed_counts", _SECTIONS + r""", decl AS (SELECT DISTINCT diff_id, f, h FROM hs WHERE h > 0 AND regexp_matches(line, '^[-+ ]') AND regexp_matches(substr(line, 2), '\b(?:public|private|protected|static)\s+(?:\w+\s+)*(\w+)\s*\('))
SELECT count(*) AS changed_files, (SELECT count(*) FROM cl JOIN decl USING (diff_id, f) WHERE change_type = 'MODIFIED' AND NOT low) AS changed_methods FROM cl WHERE NOT low""", _DIFF)
def _(s, d):
    none = impact.impacts(s.range(0).select(F.lit("").alias("class_name"), F.lit("").alias("method_name"), F.array(F.lit("")).alias("path")), view(s, d, "call_edges"))
    return impact.summary(none, diffs.changed_files(view(s, d, "diff_texts"))).select("changed_files", "changed_methods")


@_query("g1_seeds", _SECTIONS + r""", decl AS (SELECT diff_id, f, h, first(name ORDER BY n) AS name FROM (SELECT diff_id, f, h, n, regexp_extract(substr(line, 2), '\b(?:public|private|protected|static)\s+(?:\w+\s+)*(\w+)\s*\(', 1) AS name FROM hs WHERE h > 0 AND regexp_matches(line, '^[-+ ]')) x WHERE name <> '' GROUP BY ALL)
SELECT DISTINCT class_name, name AS method_name, class_name || '.' || name AS path FROM cl JOIN decl USING (diff_id, f) WHERE change_type = 'MODIFIED' AND NOT low""", _DIFF)
def _(s, d):
    return impact.seeds(diffs.changed_files(view(s, d, "diff_texts"))).select("class_name", "method_name", F.array_join("path", ">").alias("path"))
