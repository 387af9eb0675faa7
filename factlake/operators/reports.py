"""Analysis reports: tolerant JSON reading, repair, clean-up, merging and summaries.

Report JSON is read with string leaves, since producers write numbers and strings alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from factlake.functions.columns import dependency_name, is_cross_object_call, one_of, too_many_words
from factlake.schemas import REPORT

#: fixed values: allowed types of dependencies and risks, and names of tool classes
DEP_TYPES = ("field", "method_call")
RISK_TYPES = ("SECURITY", "PERFORMANCE", "MAINTAINABILITY")
RISK_CONFIDENCE = ("CERTAIN", "POSSIBLE")
TOOL_CLASSES = (
    "StringUtil", "BeanUtil", "BigDecimalUtil", "DateUtils", "JSONUtil", "ListUtil", "MapUtil", "CollectionUtils", "Arrays", "Collections", "IBaseService",
    "BaseMapper", "ServiceImpl", "MapperImpl",
)
TOOL_PACKAGES = ("com.stream.core.util.", "org.apache.commons.")
SUMMARY_CHARS, SHORT_SUMMARY_CHARS, REFACTOR_CHARS, LIST_ITEMS, TOKENS_MOST = 200, 100, 500, 5, 1500
_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def repaired(text: str | None) -> str | None:
    """Control characters, then unescaped quotes, then truncation, each on top of the one before; the first result that is a JSON object or array, else the text as it came.

    Of a text cut off, what follows its last whole object or array goes, and what is open there is closed.
    """
    if text is None or not text.strip():
        return text
    out = text
    for step in (_without_controls, _quoted, _closed):
        out = step(out)
        if _is_json(out):
            return out
    return text


def _is_json(t: str) -> bool:
    if not t.strip().startswith(("{", "[")):
        return False
    try:
        json.loads(t, strict=False)
    except (ValueError, RecursionError):
        return False
    return True


#: a run of a string's characters, an escape, a quote, or anything between strings
_PIECES = re.compile(r'\\.|"|[^"\\]+|\\', re.S)


def _without_controls(t: str) -> str:
    """Line ends and tabs inside strings, escaped."""
    out, inside = [], False
    for m in _PIECES.finditer(t):
        piece = m[0]
        if not inside and piece[0] == "\\":  # between strings nothing is escaped
            inside ^= piece.count('"') == 1
        elif piece == '"':
            inside = not inside
        elif inside and piece[0] != "\\":
            piece = piece.replace("\n", "\\n").replace("\r", "\\n").replace("\t", "\\t")
        out.append(piece)
    return "".join(out)


def _quoted(t: str) -> str:
    """A quote inside a value that neither a comma, a colon, a closing bracket nor the end follows is one of the text."""
    out, inside, value, colon = [], False, False, False
    for m in _PIECES.finditer(t):
        piece = m[0]
        if not inside and piece[0] == "\\":
            colon = False
            if piece[-1] == '"':
                inside, value = True, False
        elif piece == '"':
            if not inside:
                inside, value, colon = True, colon, False
            elif not value or _ENDS.match(t, m.end()):
                inside = False
            else:
                out.append("\\")
        elif not inside and (seen := piece.strip(_BLANK)):
            colon = seen[-1] == ":"
        out.append(piece)
    return "".join(out)


#: what counts as blank: every character up to the space
_BLANK = "".join(map(chr, range(33)))
_ENDS = re.compile(r"[\x00-\x20]*(?:[,}\]:]|\Z)")


def _closed(t: str) -> str:
    """One scan with a stack of what is open, up to the last whole object or array."""
    body = t[: max(t.rfind("}"), t.rfind("]")) + 1] or t
    stack, inside = [], False
    for m in _PIECES.finditer(body):
        piece = m[0]
        if piece == '"' or not inside and piece == '\\"':
            inside = not inside
        elif not inside:
            for c in re.findall(r"[{}\[\]]", piece):
                if c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif stack and stack[-1] == c:
                    stack.pop()
    return body + "".join(reversed(stack))


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def read_reports(raw: DataFrame) -> DataFrame:
    """Reports (doc, json) as columns, texts that need it repaired; unreadable ones have null fields."""
    broken = F.when(F.expr("try_parse_json(json)").isNull(), F.col("json"))  # a branch does not keep texts from Python, a null does
    text = F.coalesce(repair_json(broken), F.col("json"))
    return raw.select("doc", F.from_json(text, REPORT).alias("r")).select("doc", "r.*")


def is_tool_class(name: Column) -> Column:
    """A listed name anywhere, whatever the case, or a tool package in front."""
    low = F.lower(name)
    hit = F.lit(False)
    for x in TOOL_CLASSES:
        hit = hit | low.contains(x.lower())
    for x in TOOL_PACKAGES:
        hit = hit | name.startswith(x)
    return F.coalesce(hit, F.lit(False))


def without_tool_classes(items: Column) -> Column:
    """An array of structs with a name, dependencies or fields, without tool classes; items without a name stay."""
    return F.filter(items, lambda x: ~is_tool_class(x["name"]))


def by_line(items: Column) -> Column:
    """T4: an array of structs by line, in their order where lines are equal; lines that are no numbers last."""
    placed = F.transform(items, lambda d, i: F.struct(F.coalesce(d["line"].try_cast("int"), F.lit((1 << 31) - 1)).alias("_o"), i.alias("_i"), d.alias("d")))
    return F.transform(F.array_sort(placed), lambda x: x["d"])


def clean_dependencies(deps: Column) -> Column:
    """An array of (name, type, line) by line, names and types in one form, then without tool classes."""
    formed = F.transform(deps, lambda d: F.struct(dependency_name(d["name"]).alias("name"), clean_dependency_type(d["type"]).alias("type"), d["line"].alias("line")))
    return by_line(without_tool_classes(formed))


def is_method_call(kind: Column) -> Column:
    """Whether a dependency's type says that it is a call."""
    return F.coalesce(kind.contains("method_call") | kind.contains("方法调用"), F.lit(False))


def owner_of(line: Column, methods: Column) -> Column:
    """The index of the method that a call at this line belongs to; methods: an array of structs with a line.

    The method that begins last before or at the line; before all, the nearest one; without a line, the first;
    null if there are no methods.
    """
    at = line.try_cast("int")
    known = F.filter(F.transform(methods, lambda m, i: F.struct(m["line"].try_cast("int").alias("l"), i.alias("i"))), lambda x: x["l"].isNotNull())
    before = F.array_max(F.filter(known, lambda x: x["l"] <= at))["i"]
    nearest = F.array_min(F.transform(known, lambda x: F.struct(F.abs(x["l"] - at).alias("d"), x["i"].alias("i"))))["i"]
    return F.when(F.size(methods) > 0, F.coalesce(F.when(at.isNotNull(), before), F.when(at >= 0, nearest), F.lit(0)))


def normalised(reports: DataFrame) -> DataFrame:
    """Reports with calls moved from their dependencies to the methods they belong to, and everything in one form.

    reports: dependencies (name, type, line), keyMethods (name, line, calls: target, line, type) and risks (type, description, line).
    Calls of a report without methods are dropped; a call that its method has already is not added again;
    columns beside these stay, architecture_issues goes.
    """
    calls = F.filter("dependencies", lambda d: is_method_call(d["type"]))
    moved = F.transform(calls, lambda d: F.struct(owner_of(d["line"], F.col("keyMethods")).alias("owner"), F.struct(d["name"].alias("target"), d["line"].try_cast("int").alias("line"), d["type"].alias("type")).alias("call")))
    none = F.array().cast("array<struct<target:string,line:int,type:string>>")

    def with_calls(m: Column, i: Column) -> Column:
        own = F.coalesce(clean_call_objects(m["calls"]), none)
        new = F.transform(F.filter(F.coalesce(F.col("_moved"), F.array().cast("array<struct<owner:int,call:struct<target:string,line:int,type:string>>>")), lambda x: x["owner"] == i), lambda x: x["call"])
        return F.struct(m["name"].alias("name"), m["line"].alias("line"), F.array_distinct(F.concat(own, new)).alias("calls"))

    out = reports.withColumn("_moved", moved).withColumn("keyMethods", by_line(F.transform("keyMethods", with_calls))).drop("_moved", "architecture_issues")
    kept = F.filter("dependencies", lambda d: ~is_method_call(d["type"]))
    risks = F.transform("risks", lambda r: F.struct(clean_risk_type(r["type"]).alias("type"), r["description"].alias("description"), r["line"].alias("line")))
    return out.withColumns({"dependencies": clean_dependencies(kept), "risks": by_line(risks)})


def clean_calls(calls: Column) -> Column:
    """Calls given as texts, `name(...)`, as (target, line, type) with what is unknown filled in."""
    return F.transform(calls, lambda c: F.struct(_uncalled(c).alias("target"), F.lit(-1).alias("line"), F.lit("unknown").alias("type")))


def clean_call_objects(calls: Column) -> Column:
    """Calls given as (target, line, type): no parameter lists, line -1 and type unknown where they are missing."""
    return F.transform(calls, lambda c: F.struct(_uncalled(c["target"]).alias("target"), F.coalesce(c["line"].try_cast("int"), F.lit(-1)).alias("line"), F.coalesce(c["type"], F.lit("unknown")).alias("type")))


def _uncalled(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\(.*$", "")


def clean_risk_type(kind: Column) -> Column:
    """As it is written, else MAINTAINABILITY."""
    return one_of(kind, RISK_TYPES, "MAINTAINABILITY")


def clean_dependency_type(kind: Column) -> Column:
    """C9."""
    return one_of(kind, DEP_TYPES, "field")


def clean_risk_confidence(confidence: Column) -> Column:
    """None stays none."""
    return F.when(confidence.isNotNull(), one_of(confidence, RISK_CONFIDENCE, "POSSIBLE"))


def distinct_calls(calls: DataFrame) -> DataFrame:
    """T5: one call of each name and line of a doc, the first."""
    w = Window.partitionBy("doc", "name", "line").orderBy("pos")
    return calls.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def dependencies_of(reports: DataFrame) -> DataFrame:
    """Per report the distinct targets of calls on other objects, in order."""
    targets = F.flatten(F.transform("methods", lambda m: F.transform(F.coalesce(m["calls"], F.array().cast("array<struct<target:string,line:string,type:string>>")), lambda c: c["target"])))
    return reports.select("doc", F.array_distinct(F.filter(targets, lambda t: is_cross_object_call(t))).alias("dependencies"))


def merged(summaries: DataFrame, methods: DataFrame) -> DataFrame:
    """Summary reports (doc, json) and method reports (doc, pos, json) as one row each; method texts that cannot be read are passed over."""
    m = methods.withColumn("m", F.from_json("json", "name string, complexity string, complexity_value string")).filter("m.name is not null")
    each = m.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms")).select("doc", F.transform("ms", lambda x: x["m"]).alias("methods"))
    s = summaries.select("doc", F.from_json("json", "class string, summary string").alias("s"))
    return s.join(each, "doc", "left").select("doc", "s.class", "s.summary", F.coalesce("methods", F.array().cast("array<struct<name:string,complexity:string,complexity_value:string>>")).alias("methods"))


def to_json(reports: DataFrame) -> DataFrame:
    """Each row but its doc as JSON."""
    return reports.select("doc", F.to_json(F.struct(*[c for c in reports.columns if c != "doc"])).alias("json"))


def nested_form(reports: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Reports (class, overall_complexity, methods) in the nested form, as JSON: a summary line, methods with their calls as of
    the same file and their risks, dependencies; fields and risks of the file stay empty.

    traces (doc, task_id, status, cache_hit, retries) are put in by task, if there are any.
    """
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    calls = lambda m: F.transform(F.coalesce(m["calls"], empty("struct<target:string,line:string,type:string>")), lambda c: F.struct(c["target"].alias("target"), F.coalesce(c["line"].try_cast("int"), F.lit(0)).alias("line"), F.lit("same_file").alias("type")))
    methods = F.transform("methods", lambda m: F.struct(F.coalesce(m["name"], F.lit("")).alias("name"), F.coalesce(m["line"].try_cast("int"), F.lit(0)).alias("line"), calls(m).alias("calls"), m["risks"].alias("risks")))
    complexity = F.when(F.coalesce("overall_complexity", F.lit("")) != "", F.concat(F.lit(", Complexity: "), F.col("overall_complexity"))).otherwise("")
    summary = F.concat(F.lit("Class: "), F.coalesce("class", F.lit("")), complexity).alias("summary")
    out = reports.join(dependencies_of(reports), "doc")
    parts = [summary, F.lit("").alias("framework"), empty("string").alias("fields"), methods.alias("methods"), empty("string").alias("risks"), F.col("dependencies")]
    if traces is not None:
        each = traces.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_id", F.struct("status", F.col("cache_hit").alias("cacheHit"), F.col("retries").alias("retryCount")))))).alias("executionTrace"))
        out, parts = out.join(each, "doc", "left"), [*parts, F.col("executionTrace")]
    return out.select("doc", F.to_json(F.struct(*parts)).alias("json"))


def risk_overview(risks: DataFrame, most: int = 5) -> DataFrame:
    """Risks (doc, top_level, pos, severity, description) by severity, unknown ones as LOW, and the first five texts, top-level ones first.

    Ranks are cut within partitions first, so that no document's risks are gathered but the first ones.
    """
    s = F.upper("severity")
    counts = risks.groupBy("doc").agg(F.count_if(s == "HIGH").alias("high"), F.count_if(s == "MEDIUM").alias("medium"), F.count_if(~s.isin("HIGH", "MEDIUM") | s.isNull()).alias("low"))
    w = Window.partitionBy("doc").orderBy(F.desc("top_level"), "pos", "description")
    first = risks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    texts = first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "description"))), lambda x: x["description"]).alias("first"))
    return counts.join(texts, "doc")


def class_summary(reports: DataFrame) -> DataFrame:
    """Methods, risks and up to five risk texts of each report, three at most of its own and then its methods', and its contradictions.

    reports may have a column contradiction_count; what is missing or no number counts as 0.
    """
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("risks", lambda r: r["description"]), none)
    inner = F.coalesce(F.flatten(F.transform("methods", lambda m: F.transform(F.coalesce(m["risks"], F.expr("cast(array() as array<struct<type:string,description:string,line:string,severity:string,impact:string,suggestion:string,confidence:string>>)")), lambda r: r["description"]))), none)
    count = F.coalesce(F.col("contradiction_count").cast("string").try_cast("int"), F.lit(0)) if "contradiction_count" in reports.columns else F.lit(0)
    return reports.select("doc", F.coalesce(F.size("methods"), F.lit(0)).alias("n_methods"), (F.size(own) + F.size(inner)).alias("n_risks"), F.slice(F.concat(F.slice(own, 1, 3), inner), 1, 5).alias("texts"), count.alias("contradiction_count"))


def merged_groups(groups: DataFrame) -> DataFrame:
    """Outputs of groups (package, pos, files, classes, methods, risks, entries, text) as one row a package: sums, the first five entries, joined texts."""
    before = F.sum(F.coalesce(F.size("entries"), F.lit(0))).over(Window.partitionBy("package").orderBy("pos", "entries", "text").rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast(groups.schema["entries"].dataType)
    groups = groups.withColumn("entries", F.when(F.coalesce(before, F.lit(0)) < 5, F.slice(F.coalesce("entries", none), 1, 5)).otherwise(none))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "entries", "text")))
    out = groups.groupBy("package").agg(*[F.sum(c).alias(c) for c in ("files", "classes", "methods", "risks")], ordered.alias("o"))
    return out.select("package", "files", "classes", "methods", "risks", F.slice(F.flatten(F.transform("o", lambda x: x["entries"])), 1, 5).alias("entries"), F.array_join(F.transform("o", lambda x: x["text"]), "；").alias("text"))


def grouped_files(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Files (file) by the first group (pos, name, file) that names them; the rest form a last one."""
    w = Window.partitionBy("file").orderBy("pos")
    first = groups.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("file", "pos", "name")
    out = files.join(first, "file", "left")
    return out.select("file", F.coalesce("name", F.lit("(rest)")).alias("name"), F.coalesce("pos", F.lit((1 << 31) - 1)).alias("pos"))


def package_input(entries: DataFrame) -> DataFrame:
    """Entries (pos, package, layer) as layer counts and the last package that is named."""
    layers = entries.groupBy("layer").agg(F.count("*").alias("n"))
    return layers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers")).crossJoin(
        entries.agg(F.max(F.when(F.coalesce("package", F.lit("")) != "", F.struct("pos", "package"))).getField("package").alias("package"))
    )


def with_callers(reports: DataFrame, callers: DataFrame) -> DataFrame:
    """Reports (doc, json) with their callers (doc, file, type, line, description) as one more member; none leaves them as they are.

    The member is set in a text that parses as an object; any other text stays.
    """
    each = callers.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("file", "line", "type", "description"))).alias("c"))
    listed = F.to_json(F.transform("c", lambda x: F.struct(x["file"].alias("file"), x["type"].alias("type"), x["line"].alias("line"), x["description"].alias("description"))))
    body = F.regexp_replace("json", r"\s*\}\s*$", "")
    joined = F.concat(body, F.when(body.rlike(r"^\s*\{\s*$"), F.lit("")).otherwise(F.lit(",")), F.lit('"callers":'), listed, F.lit("}"))
    whole = F.expr("try_parse_json(json)").isNotNull() & F.col("json").rlike(r"^\s*\{")
    return reports.join(each, "doc", "left").select("doc", F.when(F.col("c").isNotNull() & whole, joined).otherwise(F.col("json")).alias("json"))


def flat_claims(reports: DataFrame, threshold: str) -> DataFrame:
    """N12, of the flat form: claims of the methods, dependencies and risks of a report, all at the threshold, in that order."""
    parts = (("key_method", "keyMethods", "name"), ("dependency", "dependencies", "name"), ("risk", "risks", "description"))
    out = None
    for kind, column, field in parts:
        part = reports.select("doc", F.posexplode(column).alias("pos", "x")).select("doc", F.lit(kind).alias("kind"), "pos", F.col(f"x.{field}").alias("claim"), F.lit(threshold).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out.filter("claim is not null")


def tagged_claims(reports: DataFrame, threshold: str) -> DataFrame:
    """N12, of the nested form: claims of each method's calls and risks; those tagged as facts are HIGH, the rest at the threshold."""
    methods = reports.select("doc", F.posexplode("methods").alias("mp", "m"))
    out = None
    for kind, column, field in (("method_call", "calls", "target"), ("risk", "risks", "description")):
        x = methods.select("doc", "mp", F.posexplode(f"m.{column}").alias("pos", "x"))
        part = x.select("doc", F.lit(kind).alias("kind"), "mp", "pos", F.col(f"x.{field}").alias("claim"), F.when(F.col("x.tag") == "[FACT]", "HIGH").otherwise(threshold).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out.filter("claim is not null")


def dependency_claims(reports: DataFrame) -> DataFrame:
    """What a report claims, one row each: calls with a position, and risks."""
    m = reports.select("doc", F.posexplode("methods").alias("mp", "m"))
    calls = m.select("doc", F.posexplode("m.calls").alias("pos", "c"), "m.name", "mp").select("doc", F.lit("CALL").alias("kind"), "mp", "pos", F.col("c.target").alias("claim"), F.col("c.line").alias("line"), F.lit("MEDIUM").alias("confidence"))
    risks = m.select("doc", F.posexplode("m.risks").alias("pos", "r"), "mp").select("doc", F.lit("RISK").alias("kind"), "mp", "pos", F.col("r.description").alias("claim"), F.col("r.line").alias("line"), F.when(F.col("r.description").startswith("[FACT]"), "HIGH").otherwise("MEDIUM").alias("confidence"))
    return calls.unionByName(risks)


def verified_risks(reports: DataFrame, checked: DataFrame) -> DataFrame:
    """A report's risks with whether each passed. checked: doc, pos, passed."""
    each = checked.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("passed", F.lit(False)).alias("passed")))).alias("ok"))
    out = reports.join(each, "doc", "left")
    return out.withColumn("risks", F.transform("risks", lambda r, i: r.withField("verified", F.coalesce(F.try_element_at("ok", i), F.lit(False))))).drop("ok")


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that a row breaks, null if it keeps all."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in rules])


def _present(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def _member(column: str, name: str) -> Column:
    return F.get_json_object(column, f"$.{name}")


def _is_array(column: str, name: str) -> Column:
    return F.coalesce(_member(column, name).rlike(r"^\s*\["), F.lit(False))


def summary_failure(column: str = "json") -> Column:
    """R11, of summaries: the field that fails first, null if none does."""
    text, member = F.col(column), lambda name: _present(_member(column, name))
    some = F.coalesce(F.json_array_length(_member(column, "keyMethods")), F.lit(0)) > 0
    return first_failure([
        (_present(text) & ~too_many_words(text) & F.expr(f"try_parse_json({column})").isNotNull() & text.rlike(r"^\s*\{"), "root"),
        (member("className"), "className"), (member("stereotype"), "stereotype"), (_is_array(column, "keyMethods") & some, "keyMethods"),
        (_is_array(column, "dependencies"), "dependencies"), (member("complexity"), "complexity"), (member("summary"), "summary"),
        (member("frameworkDesc"), "frameworkDesc"), (_is_array(column, "fields"), "fields"),
    ])


#: fixed values: what a method's score may rest on
BASES = ("SOLID_ANALYSIS", "HEURISTIC", "PARTIAL", "UNKNOWN")


def method_failure(expected: Column, column: str = "json") -> Column:
    """R11, of method analyses: the field that fails first, null if none does. expected: the method's name, null or empty for any."""
    text = F.col(column)
    size = lambda name: F.coalesce(F.json_array_length(_member(column, name)), F.lit(0))
    score = _member(column, "l2Confidence.overallScore").try_cast("double")
    named = _member(column, "method").isNotNull() & (F.coalesce(expected, F.lit("")).isin("") | (_member(column, "method") == expected))
    description = _member(column, "description")
    return first_failure([
        (_present(text) & F.expr(f"try_parse_json({column})").isNotNull() & text.rlike(r"^\s*\{"), "root"), (named, "method"),
        (description.isNull() | (F.trim(description) != ""), "description"),
        (size("l1Evidence.calls") + size("l1Evidence.calledBy") + size("l1Evidence.fieldsUsed") > 0, "l1Evidence"),
        (_member(column, "l2Confidence").rlike(r"^\s*\{"), "l2Confidence"), (score.between(0, 1), "overallScore"),
        (_member(column, "l2Confidence.reasoningBasis").isin(*BASES), "reasoningBasis"), (_is_array(column, "l2Confidence.riskIndicators"), "riskIndicators"),
    ])


def grouping_failure(column: str = "json") -> Column:
    """R11, of groupings: json, groups, or the first group without a name or files; null if none fails."""
    groups = F.from_json(F.col(column), "array<struct<group:string,name:string,files:array<string>>>")
    bad = lambda test: F.array_position(F.transform(groups, lambda g: F.coalesce(test(g), F.lit(True))), F.lit(True))
    name = bad(lambda g: F.trim(F.coalesce(g["group"], g["name"], F.lit(""))) == "")
    files = bad(lambda g: F.size(F.coalesce(g["files"], F.array().cast("array<string>"))) == 0)
    at = lambda n, what: F.concat(F.lit("groups["), (n - 1).cast("string"), F.lit("]."), F.lit(what))
    named = (name > 0) & ((files == 0) | (name <= files))
    return F.when(~F.coalesce(F.expr(f"try_parse_json({column})").isNotNull() & F.col(column).rlike(r"^\s*\["), F.lit(False)), "json").when(F.size(groups) == 0, "groups").when(named, at(name, "name")).when(files > 0, at(files, "files"))


def truncated_lists(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """T7."""
    return df.withColumn(column, F.slice(column, 1, n))


def objects_of(df: DataFrame, column: str) -> DataFrame:
    """One row for each object in a text column, with `at`, its place, and `object`, its members as texts; further columns stay."""
    return df.select("*", F.posexplode(_objects(F.col(column))).alias("at", "object"))


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(_listed)


def _listed(text: str | None) -> list[dict[str, str]]:
    written = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    return [{k: written(v) for k, v in x.items()} for x in objects_in(text or "")]


def objects_in(text: str) -> Iterator[dict]:
    """The objects of a text, whatever stands between them."""
    decoder, at = json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = decoder.raw_decode(text, at)
            yield found
        except ValueError:
            at += 1
