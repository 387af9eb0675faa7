"""Evidence: claims checked against source lines, contradictions within reports, scores and votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import is_comment_or_blank, is_cross_object_call, name_in_line, normalised_method, stripped

SEVERITY_WEIGHTS = {"HIGH": 0.3, "MEDIUM": 0.15, "LOW": 0.05}
SKIPPED = r"^@(Autowired|Resource|Inject)"


def checked_dependencies(claims: DataFrame, src_lines: DataFrame) -> DataFrame:
    """Claims (doc, pos, line, name) with `passed` and `issue`.

    A claim passes if its line has the name (or, of a mapper, the annotation), if one of the next two lines
    does, injection annotations passed over, or if its line is a comment. One equi-join of the claims' three
    lines with the source (doc, line_number, line); null or non-numeric lines are issues that are not counted.
    """
    c = claims.withColumn("n", F.expr("try_cast(line as int)"))
    probes = c.filter("n is not null").select("doc", "pos", "name", "n", F.explode(F.sequence(F.col("n"), F.col("n") + 2)).alias("line_number"))
    text = F.col("text")
    seen = probes.join(src_lines.select("doc", "line_number", F.col("line").alias("text")), ["doc", "line_number"])
    first = F.col("line_number") == F.col("n")
    hit = name_in_line(F.col("name"), text)
    mapper = F.col("name").endswith("Mapper") & text.contains("@Mapper")
    ok = F.when(first, hit | mapper | stripped(text).rlike(r"^(//|\*)")).otherwise(hit & ~stripped(text).rlike(SKIPPED))
    found = seen.groupBy("doc", "pos", "name", "n").agg(F.bool_or(ok).alias("ok"), F.bool_or(first).alias("there"))
    out = c.join(found.select("doc", "pos", "ok", "there"), ["doc", "pos"], "left")
    inside = F.coalesce("there", F.lit(False))
    passed = F.when(F.col("n").isNotNull(), inside & F.coalesce("ok", F.lit(False)))
    issue = F.when(F.col("n").isNull(), "BAD_LINE").when(~inside, "OUT_OF_RANGE").when(~passed, "NAME_NOT_FOUND")
    return out.select("doc", "pos", "line", "name", passed.alias("passed"), issue.alias("issue"), F.when(issue == "NAME_NOT_FOUND", "MEDIUM").when(issue.isNotNull(), "LOW").alias("confidence"))


def checked_ranges(claims: DataFrame, totals: DataFrame) -> DataFrame:
    """R2: whether claimed lines (doc, pos, line) lie in the source (doc, n_lines), and the LOW issue where not.

    A line that is no number is an issue, but is not counted: passed is null.
    """
    n = F.expr("try_cast(line as int)")
    passed = n.between(1, F.coalesce("n_lines", F.lit(0)))
    issue = F.when(n.isNull(), "BAD_LINE").when(~passed, "OUT_OF_RANGE")
    return claims.join(totals, "doc", "left").select("doc", "pos", "line", passed.alias("passed"), issue.alias("issue"), F.when(issue.isNotNull(), "LOW").alias("confidence"))


def contains_line(begin: Column, end: Column, line: Column) -> Column:
    """Both ends count."""
    return line.between(begin, end)


def in_any_range(claims: DataFrame, ranges: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Claims (doc, pos, line) whose line lies in a method of theirs (doc, begin_line, end_line).

    With totals (doc, n_lines), a doc without any method is one range, the whole file.
    """
    if totals is not None:
        whole = totals.join(ranges.select("doc").distinct(), "doc", "left_anti")
        ranges = ranges.select("doc", "begin_line", "end_line").unionByName(whole.select("doc", F.lit(1).alias("begin_line"), F.col("n_lines").cast("int").alias("end_line")))
    return claims.join(ranges, (claims["doc"] == ranges["doc"]) & contains_line(ranges["begin_line"], ranges["end_line"], claims["line"]), "left_semi")


def overall_confidence(checked: DataFrame) -> DataFrame:
    """A10: per doc the share of passed claims and what it is called; claims that were not counted do not count."""
    rate = F.col("passed_count") / F.col("total")
    out = checked.groupBy("doc").agg(F.count("passed").alias("total"), F.count_if("passed").alias("passed_count"))
    name = F.when(F.col("total") == 0, "UNKNOWN").when(rate >= 1, "CERTAIN").when(rate >= 0.8, "HIGH").when(rate >= 0.5, "MEDIUM").otherwise("LOW")
    return out.withColumn("confidence", name)


def nearest_offset(claims: DataFrame, src_lines: DataFrame, reach: int = 5) -> DataFrame:
    """How far off the claimed line the nearest line with the name is, the one before first; null if there is none."""
    probes = claims.select("doc", "pos", "name", "line", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line_number"))
    seen = probes.join(src_lines.select("doc", "line_number", F.col("line").alias("text")), ["doc", "line_number"]).filter(name_in_line(F.col("name"), F.col("text")))
    off = F.col("line_number") - F.col("line")
    best = seen.groupBy("doc", "pos").agg(F.min(F.struct(F.abs(off).alias("d"), off.alias("off"))).alias("b")).select("doc", "pos", F.col("b.off").alias("line_offset"))
    return claims.join(best, ["doc", "pos"], "left")


def annotated(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Items (doc, category, pos) with the confidence of their issue, else that of their category."""
    base = F.when(F.col("category") == "dependencies", "CERTAIN").when(F.col("category") == "risks", "HIGH").otherwise("MEDIUM")
    return items.join(issues.select("doc", "category", "pos", F.col("confidence").alias("_c")), ["doc", "category", "pos"], "left").withColumn("confidence", F.coalesce("_c", base)).drop("_c")


def owning_method(items: DataFrame, methods: DataFrame) -> DataFrame:
    """Items (doc, pos, line) with the method (doc, name, line) that begins last before or at their line."""
    m = methods.select("doc", F.col("line").alias("_at"), F.lit(0).alias("_side"), F.col("name").alias("_m"), F.lit(None).cast("int").alias("pos"))
    i = items.select("doc", F.col("line").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_m"), F.col("pos").cast("int"))
    w = Window.partitionBy("doc").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = m.unionByName(i).withColumn("method", F.last("_m", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("doc", "pos", F.col("_at").alias("line"), "method")


def closest_method(items: DataFrame, methods: DataFrame) -> DataFrame:
    """Items (doc, pos, line) with the method nearest to their line, the earlier of two; items without a line get the first method.

    Of methods that begin in one line the first by name counts, those without a line never. Two windows over items and
    methods together find the neighbours; items never meet all methods of their document.
    """
    m = methods.filter("line is not null").groupBy("doc", "line").agg(F.min("name").alias("name"))
    rows = m.select("doc", F.col("line").alias("_at"), F.lit(0).alias("_side"), F.struct("line", "name").alias("_m"), F.lit(None).alias("pos"))
    own = items.select("doc", F.col("line").alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_m"), "pos").filter("_at is not null")
    w = Window.partitionBy("doc").orderBy("_at", "_side")
    both = rows.unionByName(own).withColumns({
        "_before": F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_m", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).filter("_side = 1")
    nearer = F.when(F.col("_before.line").isNull() | (F.col("_after.line") - F.col("_at") < F.col("_at") - F.col("_before.line")), F.col("_after.name")).otherwise(F.col("_before.name"))
    best = both.select("doc", "pos", nearer.alias("_near")).distinct()
    first = m.groupBy("doc").agg(F.min(F.struct("line", "name")).getField("name").alias("_first"))
    out = items.join(best, ["doc", "pos"], "left").join(first, "doc", "left")
    return out.withColumn("method", F.when(F.col("line").isNull(), F.col("_first")).otherwise(F.col("_near"))).drop("_near", "_first")


def _finding(rule: str, severity: str, penalty: Column | float, source: Column | None = None, target: Column | None = None, status: Column | str = "CONTRADICTORY") -> list[Column]:
    none = F.lit(None).cast("string")
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        (none if source is None else source).alias("source"), (none if target is None else target).alias("target"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        value(penalty).alias("penalty"), value(status).alias("status"),
    ]


def _expected(complexity: Column, value: Column) -> Column:
    """The values that a complexity word stands for where the value given is none of them, else null."""
    c = F.upper(F.trim(complexity))
    bad = F.when((c == "HIGH") & (value <= 3), "7-10").when((c == "LOW") & (value >= 8), "1-3").when((c == "MEDIUM") & ~value.between(4, 6), "4-6")
    return F.when(value > 0, bad)


def complexity_contradictions(methods: DataFrame) -> DataFrame:
    """R4 (rule C4): complexity words that do not fit their value. methods: doc, name, complexity, complexity_value."""
    bad = methods.filter(_expected(F.col("complexity"), F.col("complexity_value")).isNotNull())
    return bad.select("doc", *_finding("C4", "LOW", -0.1, F.col("name")))


def summary_contradictions(reports: DataFrame, methods: DataFrame) -> DataFrame:
    """R5 (rule C2): a report of LOW complexity with half of its methods HIGH."""
    high = methods.groupBy("doc").agg(F.avg((F.upper("complexity") == "HIGH").cast("int")).alias("high"))
    bad = reports.filter(F.upper("overall_complexity") == "LOW").join(high, "doc").filter("high >= 0.5")
    return bad.select("doc", *_finding("C2", "HIGH", -0.3))


def _without_arguments(target: Column) -> Column:
    """As cleaned reports have it; raw ones may still name parameters."""
    return F.regexp_replace(target, r"(?s)\(.*$", "")


def call_contradictions(methods: DataFrame) -> DataFrame:
    """J8, R6 (rule C1): a call within a report that the called method does not list. methods: doc, name, calls (targets), called_by (callers).

    Calls on other objects and recursion are passed over; an empty list only counts as incomplete.
    """
    calls = methods.select("doc", "name", F.explode("calls").alias("t")).filter(F.col("t").isNotNull() & ~is_cross_object_call(F.col("t")))
    calls = calls.select("doc", "name", normalised_method(_without_arguments(F.col("t"))).alias("target")).filter("name <> target").distinct()
    other = methods.select("doc", F.col("name").alias("target"), "called_by")
    bad = calls.join(other, ["doc", "target"]).filter(~F.exists(F.coalesce("called_by", F.array().cast("array<string>")), lambda x: normalised_method(_without_arguments(x)) == F.col("name")))
    empty = F.coalesce(F.size("called_by"), F.lit(0)) <= 0
    return bad.select("doc", *_call_finding(F.col("name"), F.col("target"), empty))


def _call_finding(source: Column, target: Column, empty: Column) -> list[Column]:
    return _finding("C1", "MEDIUM", F.when(empty, 0.0).otherwise(-0.2), source, target, F.when(empty, "INCOMPLETE").otherwise("CONTRADICTORY"))


def risk_contradictions(risks: DataFrame, src_lines: DataFrame) -> DataFrame:
    """J9, R7 (rule C3): risks (doc, method, line) that point to a comment or blank line."""
    hit = risks.join(src_lines.select("doc", "line_number", F.col("line").alias("text")), (risks["doc"] == src_lines["doc"]) & (risks["line"] == F.col("line_number")))
    return hit.filter(is_comment_or_blank(F.col("text"))).select(risks["doc"], F.col("method").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("C3").alias("rule"), F.lit("HIGH").alias("severity"), F.lit(-0.5).alias("penalty"), F.lit("CONTRADICTORY").alias("status"))


#: the order of the rules' findings
RULE_ORDER = ("C5", "C3-top", "C4", "C2", "C1", "C3")


def united(**findings: DataFrame) -> DataFrame:
    """The findings of all rules, given by rule, as one table with rule_order; rules without any are left out."""
    columns = ["doc", "source", "target", "rule", "severity", "penalty", "status"]
    out = None
    for i, rule in enumerate(RULE_ORDER):
        found = findings.get(rule.replace("-", "_"))
        if found is not None:
            part = found.select(*columns, F.lit(i).alias("rule_order"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no findings of the rules {RULE_ORDER}")
    return out


def contradictions(reports: DataFrame) -> DataFrame:
    """What rules C4, C2 and C1 find, as `united` has it, from one reading of the reports. reports: doc, overall_complexity, methods.

    A method is dealt out under its name and each of its calls under the name called, so that both sides of C1 meet in one group and no
    report is joined with itself; one row of the report has what C2 counts.
    """
    plain = lambda t: normalised_method(_without_arguments(t))
    high = lambda m: F.upper(m["complexity"]) == "HIGH"
    counted = lambda items: F.when(items.isNotNull(), F.size(items))
    names = F.array().cast("array<string>")
    method = "struct<complexity:string, value:int, callers:array<string>, empty:boolean>"

    def row(key=None, source=None, of=None, low=None, n=None, n_high=None) -> Column:
        given = {"key": (key, "string"), "source": (source, "string"), "method": (of, method), "low": (low, "boolean"), "n": (n, "long"), "n_high": (n_high, "long")}
        return F.struct(F.lit(low is not None).alias("whole"), *[(F.lit(None) if x is None else x).cast(kind).alias(name) for name, (x, kind) in given.items()])

    def rows_of(m: Column) -> Column:
        callers = F.array_compact(F.coalesce(F.transform(m["called_by"], lambda x: plain(x["caller"])), names))
        own = F.filter(F.transform(m["calls"], lambda x: x["target"]), lambda t: ~is_cross_object_call(t))
        called = F.array_distinct(F.filter(F.transform(own, plain), lambda t: t != m["name"]))
        of = F.struct(m["complexity"], m["complexity_value"].try_cast("int"), callers, F.coalesce(F.size(m["called_by"]), F.lit(0)) <= 0)
        return F.concat(F.array(row(m["name"], of=of)), F.transform(F.coalesce(called, names), lambda t: row(t, m["name"])))

    whole = row(low=F.coalesce(F.upper("overall_complexity") == "LOW", F.lit(False)), n=counted(F.col("methods")), n_high=counted(F.filter("methods", high)))
    every = F.concat(F.array(whole), F.flatten(F.transform("methods", rows_of)))
    # outer, as a plain explode would also test the size of its array below, which parses each report a second time
    dealt = reports.select("doc", F.inline_outer(F.coalesce(every, F.array(whole))))
    each = dealt.groupBy("doc", "whole", "key").agg(
        F.collect_set("source").alias("sources"), F.collect_list("method").alias("methods"), F.bool_or("low").alias("low"), F.sum("n").alias("n"), F.sum("n_high").alias("n_high")
    )
    found = lambda columns, rule: F.struct(*columns, F.lit(RULE_ORDER.index(rule)).alias("rule_order"))
    key, known = F.col("key"), F.col("doc").isNotNull()
    c4 = F.transform(F.filter("methods", lambda m: _expected(m["complexity"], m["value"]).isNotNull()), lambda _: found(_finding("C4", "LOW", -0.1, key), "C4"))
    missed = lambda m: F.transform(F.filter("sources", lambda s: ~F.array_contains(m["callers"], s)), lambda s: found(_call_finding(s, key, m["empty"]), "C1"))
    c1 = F.when(known, F.flatten(F.transform("methods", missed)))
    c2 = F.when(known & F.col("low") & (F.col("n") > 0) & (2 * F.col("n_high") >= F.col("n")), F.array(found(_finding("C2", "HIGH", -0.3), "C2")))
    lists = F.flatten(F.array_compact(F.array(c4, c1, c2)))
    return each.select("doc", F.inline_outer(lists)).filter("rule is not null")


def cross_verified(claims: DataFrame, verdict, enabled: bool = True) -> DataFrame:
    """Claims with the status of a verdict: true PASSED, false REJECTED, null or an error PENDING; SKIPPED if not enabled.

    verdict: a function of a pandas series of claims that gives a series of booleans; a batch that raises stays PENDING.
    """
    if not enabled:
        return claims.withColumn("status", F.lit("SKIPPED"))

    @F.pandas_udf("boolean")
    def told(claim: pd.Series) -> pd.Series:
        try:
            return verdict(claim)
        except Exception:  # whatever a caller's verdict raises leaves its claims open
            return pd.Series([None] * len(claim), dtype="object")

    ok = told(F.col("claim"))
    return claims.withColumn("_ok", ok).withColumn("status", F.when(F.col("_ok"), "PASSED").when(~F.col("_ok"), "REJECTED").otherwise("PENDING")).drop("_ok")


def contradiction_scores(findings: DataFrame) -> DataFrame:
    """Per doc the severities' weights of contradictory findings, 1 at most, and the methods concerned."""
    weight = F.lit(0.0)
    for s, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    bad = findings.filter("status = 'CONTRADICTORY'")
    return bad.groupBy("doc").agg(F.least(F.lit(1.0), F.round(F.sum(weight), 6)).alias("score"), F.array_sort(F.collect_set("source")).alias("methods"))


def injected(methods: DataFrame, findings: DataFrame) -> DataFrame:
    """Methods (doc, name, score) with their contradictory findings and a score lowered by the penalties, 0.1 at least."""
    each = findings.filter("status = 'CONTRADICTORY' and source is not null").groupBy("doc", F.col("source").alias("name")).agg(F.sum("penalty").alias("penalty"), F.array_sort(F.collect_list("rule")).alias("rules"))
    out = methods.join(each, ["doc", "name"], "left")
    return out.withColumn("score", F.when(F.col("score").isNotNull(), F.greatest(F.lit(0.1), F.col("score") + F.coalesce("penalty", F.lit(0.0)))))


#: fixed values: the words that confirm and deny a claim
CONFIRMS, DENIES = "确认", "否认"


def voted(votes: DataFrame, confirms: str = CONFIRMS, denies: str = DENIES) -> DataFrame:
    """Per claim the majority of votes; a vote that has both words confirms, one with neither counts for none, and a tie is PENDING."""
    side = F.when(F.col("vote").contains(confirms), 1).when(F.col("vote").contains(denies), 0)
    counted = votes.groupBy("claim_id").agg(F.count_if(side == 1).alias("yes"), F.count_if(side == 0).alias("no"))
    return counted.withColumn("status", F.when(F.col("yes") > F.col("no"), "PASSED").when(F.col("no") > F.col("yes"), "REJECTED").otherwise("PENDING"))


def status_summary(results: DataFrame) -> DataFrame:
    """Results by status; skipped ones are not in the total."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return results.agg(*[count(s) for s in ("PASSED", "REJECTED", "PENDING", "SKIPPED")], F.count_if(F.col("status") != "SKIPPED").alias("total"))


def mentioned_methods(text: Column) -> Column:
    """`Class.method()` of each mention with a parameter list."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\w+\.\w+)\([^)]*\)"), F.lit(1)), lambda x: F.concat(x, F.lit("()")))


def named_in(constraints: DataFrame) -> DataFrame:
    """The `Class.method()` that stand in constraints (column `constraint`), as column `named`: with the class in full, and with
    each end of its name, as a mention need not begin where the name does."""
    words = constraints.select(F.explode(F.regexp_extract_all("constraint", F.lit(r"(\w+\.\w+\(\))"), F.lit(0))).alias("w")).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.instr("w", ".") - 1), lambda i: F.expr("w").substr(i, F.length("w")))
    return words.select(F.explode(ends).alias("named")).distinct()


def constraint_checked(claims: DataFrame, constraints: DataFrame | list[str]) -> DataFrame:
    """Whether every method that a claim names stands in some constraint; claims without one are PENDING.

    Constraints are a table (column `constraint`) of any size, or a list. Mentions and the names in constraints meet in one join
    on the name; claims of equal text are judged once.
    """
    if isinstance(constraints, list):
        constraints = claims.sparkSession.createDataFrame([(c,) for c in constraints], "constraint string")
    each = claims.select("claim").distinct().select("claim", F.explode_outer(mentioned_methods(F.col("claim"))).alias("named"))
    known = named_in(constraints).withColumn("known", F.lit(1))
    judged = each.join(known, "named", "left").groupBy("claim").agg(F.count("named").alias("_n"), F.count("known").alias("_known"))
    judged = judged.withColumnRenamed("claim", "_claim")
    out = claims.join(judged, F.col("claim").eqNullSafe(F.col("_claim")), "left")
    status = F.when(F.col("_n") == 0, "PENDING").when(F.col("_n") == F.col("_known"), "PASSED").otherwise("REJECTED")
    return out.withColumn("status", status).drop("_claim", "_n", "_known")
