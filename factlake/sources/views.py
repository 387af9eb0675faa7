"""Fact tables derived from the star-schema tables, as one SQL text for Spark and other engines.

No corpus of source code comes with the data, so calls, terms, mapper operations and SQL texts are derived
deterministically from it. Texts keep to what Spark SQL and ANSI engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.sources import texts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_CLASS = "'com.p' || {k5} || '.C' || {k} || CASE {n} % 4 WHEN 0 THEN 'Controller' WHEN 1 THEN 'ServiceImpl' WHEN 2 THEN 'Mapper' ELSE '' END"


def _class(n: str) -> str:
    return _CLASS.format(n=n, k=_s(n), k5=_s(f"{n} % 5"))


VIEWS = {
    "call_records": f"""
SELECT 'com.m' || {_s("l_suppkey % 7")} || '.S' || {_s("l_suppkey")} AS caller_class, 'm' || {_s("l_linenumber")} AS caller_method,
  'com.m' || {_s("(l_partkey % 97) % 7")} || '.S' || {_s("l_partkey % 97")} AS callee_class, 'm' || {_s("l_linenumber % 5")} AS callee_method,
  CASE l_returnflag WHEN 'A' THEN 'DIRECT' WHEN 'N' THEN 'SPRING_INJECTION' ELSE 'REFLECTION' END AS call_type,
  'src/main/java/com/m' || {_s("l_suppkey % 7")} || '/S' || {_s("l_suppkey")} || '.java' AS file_path,
  CAST(l_orderkey AS INT) AS line_number, CAST(NULL AS STRING) AS confidence
FROM {{lineitem}}""",
    "call_edges": f"""
SELECT {_class("a")} AS caller_class, 'm' || {_s("o % 5")} AS caller_method, {_class("b")} AS callee_class,
  'm' || {_s("CAST((o - o % 5) / 5 AS BIGINT) % 5")} AS callee_method,
  CASE o % 3 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'SPRING_INJECTION' ELSE 'REFLECTION' END AS call_type,
  'src/main/java/com/p' || {_s("a % 5")} || '/C' || {_s("a")} || '.java' AS file_path, CAST(o AS INT) AS line_number
FROM (SELECT o_orderkey AS o, o_custkey AS a, (o_custkey * 31 + o_orderkey) % (SELECT count(*) FROM {{customer}}) AS b FROM {{orders}}) x""",
    "db_operations": f"""
SELECT 'com.' || lower(replace(r_name, ' ', '_')) || '.' || lower(replace(n_name, ' ', '_')) || '.Mapper' || {_s("s_suppkey")} AS mapper_interface,
  'q' || {_s("l_linenumber")} AS method_name, CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'INSERT' ELSE 'UPDATE' END AS sql_type,
  p_brand AS table_name, CASE WHEN p_size % 10 = 0 THEN 'WILDCARD' ELSE lower(replace(p_type, ' ', ',')) END AS fields_csv,
  CAST(l_orderkey AS INT) AS xml_line, 'mapper/M' || {_s("s_suppkey")} || '.xml' AS source_file
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  JOIN {{lineitem}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey""",
    "db_field_mappings": f"""
SELECT 'com.' || lower(replace(r_name, ' ', '_')) || '.' || lower(replace(n_name, ' ', '_')) || '.Mapper' || {_s("s_suppkey")} AS mapper_interface,
  'com.domain.' || c_mktsegment AS java_type, 'prop' || {_s("c_custkey")} AS property_name, 'col_' || {_s("c_custkey % 50")} AS column_name,
  c_custkey % 20 = 0 AS is_id, 'mapper/M' || {_s("s_suppkey")} || '.xml' AS source_file
FROM {{customer}} JOIN {{supplier}} ON s_suppkey = c_custkey % (SELECT count(*) FROM {{supplier}}) + 1
  JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "code_terms": f"""
SELECT CASE WHEN p_partkey % 6 = 0 THEN 'com.pkg.' || replace(p_brand, '#', '') ELSE replace(replace(p_brand, '#', ''), 'Brand', 'Svc') || '.' || lower(replace(p_type, ' ', '_')) END AS term,
  CASE p_size % 6 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'IMPORT' WHEN 2 THEN 'METHOD' WHEN 3 THEN 'CALLEE' WHEN 4 THEN 'ANNOTATION' ELSE 'NULL_LITERAL' END AS term_type,
  'src/F' || {_s("p_partkey % 50")} || '.java' AS file_path, CAST(p_partkey AS INT) AS line_number
FROM {{part}}""",
    "sql_texts": f"""
SELECT p_partkey AS sql_id, CASE p_partkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS sql_type,
  CASE p_partkey % 4
    WHEN 0 THEN CASE WHEN p_size % 5 = 0 THEN 'SELECT *' ELSE 'SELECT t.p_name,   p_size AS sz' END || ' FROM t_' || {_s("p_size")} || ' t LEFT JOIN x_' || {_s("p_size % 7")} || ' x ON t.id = x.id WHERE t.c' || {_s("p_size % 9")} || ' = #{{{{id}}}} AND d LIKE #{{{{q}}}} ORDER BY p_size DESC'
    WHEN 1 THEN 'INSERT INTO t_' || {_s("p_size")} || ' (id, c' || {_s("p_size % 9")} || ', name) VALUES (#{{{{a}}}}, #{{{{b}}}}, #{{{{c}}}})'
    WHEN 2 THEN 'UPDATE t_' || {_s("p_size")} || ' SET <trim>c1 = #{{{{x}}}}, c' || {_s("p_size % 9")} || ' = #{{{{y}}}}</trim> WHERE id = $' || '{{{{id}}}}'
    ELSE 'DELETE FROM t_' || {_s("p_size")} || ' WHERE id IN (1, 2) AND c' || {_s("p_size % 9")} || ' > 3' END AS sql_text
FROM {{part}}""",
    "class_facts": f"""
SELECT {_class("c_custkey")} AS class_name, CASE c_custkey % 11 WHEN 0 THEN 'RestController' WHEN 1 THEN 'Component' WHEN 2 THEN 'Configuration' ELSE '' END AS annotation,
  'com.' || CASE c_nationkey % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'biz' WHEN 2 THEN 'dao' WHEN 3 THEN 'dto' WHEN 4 THEN 'feign' ELSE 'core' END || '.n' || {_s("c_nationkey")} AS package_name,
  CAST(c_custkey % 900 AS INT) AS loc, CAST(c_custkey % 20 AS INT) AS n_methods
FROM {{customer}}""",
    "votes": "SELECT conv_id AS claim_id, CASE WHEN role = 'user' THEN 'I 确认 turn ' || CAST(turn AS STRING) WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN '否认' ELSE '否认? 确认' END ELSE 'yes, no doubt' END AS vote, turn FROM {conversations}",
    "claims": """
SELECT l.doc_id, CAST(1 + (l.doc_id * 7 + l.quality) % 12 AS INT) AS line, CASE WHEN l.toxic = 1 THEN 'moron' ELSE 'the' END AS name
FROM {labels} l""",
    **texts.VIEWS,
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TABLES}


def view(spark: SparkSession, sf_dir: str, name: str, dealt_by: str | None = None) -> DataFrame:
    """dealt_by: a column by which the rows are dealt to as many partitions as a shuffle has, where a small file gives long texts."""
    sql = VIEWS[name]
    used = tables(spark, sf_dir, *[t for t in TABLES if "{" + t + "}" in sql])
    if dealt_by:
        used = {t: rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_by) for t, rows in used.items()}
    return spark.sql(sql, **used)


def with_sql(*names: str) -> str:
    """A WITH clause that defines the views for an engine that has the tables under their names."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
