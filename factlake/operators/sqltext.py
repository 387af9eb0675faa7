"""Tables and fields of SQL texts, as column expressions.

Like what it follows, it reads by patterns: only the first SELECT and WHERE, no subquery scopes, names
qualified by a schema are cut at the dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: patterns and keywords of the extraction
NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
TABLE_PATTERNS = {
    "SELECT": (rf"(?i)\bFROM\s+({NAME})", rf"(?i)\bJOIN\s+({NAME})"),
    "INSERT": (rf"(?i)\bINSERT\s+(?:INTO\s+)?({NAME})",),
    "UPDATE": (rf"(?i)\bUPDATE\s+({NAME})",),
    "DELETE": (rf"(?i)\bDELETE\s+FROM\s+({NAME})",),
}
SELECT_LIST = r"(?is)\bSELECT\s+(.*?)\s+FROM\b"
SELECT_ITEM = rf"^({NAME}(?:\.{NAME})?)"
INSERT_LIST = rf"(?i)\bINSERT\s+(?:INTO\s+)?{NAME}\s*\(([^)]+)\)"
SET_CLAUSE = r"(?is)\bSET\s+(.*?)(?:\bWHERE\b|$)"
SET_ITEM = rf"(?i)({NAME})\s*="
WHERE_CLAUSE = r"(?is)\bWHERE\s+(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|\bHAVING\b|$)"
COMPARED = rf"(?i)(?:^|[^a-zA-Z0-9_])({NAME}\.{NAME}|{NAME})\s*[=<>!]"
TESTED = rf"(?i)(?:^|[^a-zA-Z0-9_.])({NAME}(?:\.{NAME})?)\s+(?:LIKE|IN|BETWEEN|IS|NOT)"
ORDERED = r"(?is)\b(?:ORDER|GROUP)\s+BY\s+(.*?)(?:$|\bLIMIT\b|\bHAVING\b|;)"
TAG = r"(?i)<(/?)(?:if|where|foreach|choose|when|otherwise|trim|set|bind)[^>]*>"
PARAMETER = r"[#$]\{[^}]+\}"
KEYWORDS = (
    "SELECT FROM WHERE AND OR NOT IN LIKE BETWEEN IS NULL AS ON SET INTO VALUES ORDER GROUP BY ASC DESC LIMIT OFFSET HAVING DISTINCT ALL CASE WHEN THEN ELSE "
    "END LEFT RIGHT INNER OUTER CROSS JOIN COUNT SUM AVG MIN MAX TRUE FALSE NOW CURDATE SYSDATE DATE TIME TIMESTAMP"
).split()


def _is_keyword(x: Column) -> Column:
    return x.isin(*KEYWORDS, *[k.lower() for k in KEYWORDS])


def squeezed(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, r"\s+", " "))


def without_tags(sql: Column) -> Column:
    """Mapper tags go, their text stays, parameters become ?."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), TAG, ""), PARAMETER, "?"))


def tables_of(sql: Column, kind: Column) -> Column:
    """Distinct table names in order of appearance, joined ones last."""
    out = F.array().cast("array<string>")
    for k, patterns in TABLE_PATTERNS.items():
        found = F.concat(*[F.regexp_extract_all(squeezed(sql), F.lit(p), F.lit(1)) for p in patterns])
        out = F.when(kind == k, found).otherwise(out)
    return F.array_distinct(F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda x: ~_is_keyword(x)))


def _items(clause: Column) -> Column:
    return F.when(clause == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(clause, ","), lambda p: F.trim(p)))


def fields_of(sql: Column, kind: Column) -> Column:
    """X11: distinct fields in order of the clauses, without aliases' prefixes; WILDCARD and DYNAMIC mark what cannot be told."""
    s = squeezed(sql)
    none = F.array().cast("array<string>")
    marks = F.concat(
        F.when(F.regexp_like(s, F.lit(r"(?i)\bSELECT\s+\*")), F.array(F.lit("WILDCARD"))).otherwise(none),
        F.when(F.regexp_like(sql, F.lit(r"\$\{[^}]+\}")), F.array(F.lit("DYNAMIC"))).otherwise(none),
    )
    selected = F.filter(F.transform(_items(F.regexp_extract(s, SELECT_LIST, 1)), lambda p: F.regexp_extract(p, SELECT_ITEM, 1)), lambda x: x != "")
    where = F.regexp_extract(s, WHERE_CLAUSE, 1)
    tested = F.concat(F.regexp_extract_all(where, F.lit(COMPARED), F.lit(1)), F.regexp_extract_all(where, F.lit(TESTED), F.lit(1)))
    ordered = F.transform(_items(F.regexp_extract(s, ORDERED, 1)), lambda p: F.trim(F.regexp_replace(p, r"\s+(?:ASC|DESC).*", "")))
    inserted = _items(F.regexp_extract(s, INSERT_LIST, 1))
    assigned = F.regexp_extract_all(F.regexp_extract(s, SET_CLAUSE, 1), F.lit(SET_ITEM), F.lit(1))
    found = (
        F.when(kind == "SELECT", F.concat(selected, tested, ordered)).when(kind == "INSERT", inserted)
        .when(kind == "UPDATE", F.concat(assigned, tested)).when(kind == "DELETE", tested).otherwise(none)
    )
    plain = F.filter(F.concat(marks, found), lambda x: (x != "") & ~_is_keyword(x))
    columns = F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"^[^.]*\.", "")).otherwise(x))
    return F.array_distinct(F.filter(F.coalesce(columns, none), lambda x: (x != "") & ~_is_keyword(x)))


def operations(statements: DataFrame) -> DataFrame:
    """K4: one row for each statement and table it touches, with its fields; statements without a table give none.

    statements: mapper_interface, method_name, sql_type, sql_text, xml_line, source_file.
    """
    text = without_tags(F.col("sql_text"))
    out = statements.select("*", F.explode(tables_of(text, F.col("sql_type"))).alias("table_name"))
    return out.withColumn("fields", fields_of(F.col("sql_text"), F.col("sql_type")))
