"""Implicit dependencies of source files, found by patterns: one row for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: patterns by kind of dependency
INJECTED = tuple(rf"@{a}\s*(?:\w+\s+)?(?:private\s+|public\s+|protected\s+)?(\w+)\s+\w+" for a in ("Autowired", "Resource", "Inject"))
LISTENER = r"@EventListener\s*(?:public\s+|private\s+|protected\s+)?\w+\s+\w+\("
CONDITIONS = ("@Conditional", "@Profile")
REFLECTION = (r"getBean\(", r"Class\.forName\(")
CONFIG = r"@Value\(\"\$\{"
DIMENSIONS = ("SPRING_INJECTION", "INTERFACE_IMPL", "EVENT_LISTENER", "CONDITIONAL_BEAN", "REFLECTION_CALL", "CONFIG_REFERENCE")


def _rows(files: DataFrame, dimension: str, targets: Column, confidence: str) -> DataFrame:
    found = files.select("path", F.explode(targets).alias("target"))
    return found.select("path", F.lit(dimension).alias("dimension"), "target", F.lit(confidence).alias("confidence"))


def _flag(pattern: str, name: str) -> Column:
    return F.when(F.regexp_like("content", F.lit(pattern)), F.lit(name))


def injections(files: DataFrame) -> DataFrame:
    """X15."""
    return _rows(files, DIMENSIONS[0], F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in INJECTED]), "HIGH")


def interface_impls(files: DataFrame, implements: DataFrame | None = None) -> DataFrame:
    """Implementors from a table (interface, class), certain if it is the only one; without it, autowired types that stay open."""
    used = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(INJECTED[0]), F.lit(1))).alias("interface"))
    if implements is None:
        return used.select("path", F.lit(DIMENSIONS[1]).alias("dimension"), F.col("interface").alias("target"), F.lit("UNRESOLVED").alias("confidence"))
    counts = implements.groupBy("interface").agg(F.count("*").alias("n"))
    out = used.join(implements, "interface").join(counts, "interface")
    return out.select("path", F.lit(DIMENSIONS[1]).alias("dimension"), F.col("class").alias("target"), F.when(F.col("n") <= 1, "HIGH").otherwise("MEDIUM").alias("confidence"))


def listeners(files: DataFrame) -> DataFrame:
    """X17."""
    return _rows(files, DIMENSIONS[2], F.regexp_extract_all("content", F.lit(LISTENER), F.lit(0)), "HIGH")


def conditional_beans(files: DataFrame) -> DataFrame:
    """At most one row of each kind."""
    return _rows(files, DIMENSIONS[3], F.array_compact(F.array(*[_flag(c, c) for c in CONDITIONS])), "MEDIUM")


def reflection(files: DataFrame) -> DataFrame:
    """X19."""
    return _rows(files, DIMENSIONS[4], F.array_compact(F.array(_flag(REFLECTION[0], "getBean"), _flag(REFLECTION[1], "Class.forName"))), "MEDIUM")


def config_references(files: DataFrame) -> DataFrame:
    """X20."""
    return _rows(files, DIMENSIONS[5], F.array_repeat(F.lit("@Value"), F.regexp_count("content", F.lit(CONFIG))), "LOW")


def detected(files: DataFrame, enabled: tuple[str, ...] = DIMENSIONS, implements: DataFrame | None = None) -> DataFrame:
    """All enabled dimensions together."""
    parts = [injections(files), interface_impls(files, implements), listeners(files), conditional_beans(files), reflection(files), config_references(files)]
    chosen = [p for d, p in zip(DIMENSIONS, parts) if d in enabled]
    out = chosen[0]
    for p in chosen[1:]:
        out = out.unionByName(p)
    return out


def by_dimension(found: DataFrame, enabled: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row for each enabled dimension in its order, also where nothing was found: dimension, rank, n, findings of each kind of target."""
    names = ", ".join(f"named_struct('dimension', '{x}', 'rank', {i})" for i, x in enumerate(DIMENSIONS) if x in enabled)
    every = found.sparkSession.range(1).select(F.explode(F.expr(f"array({names})")).alias("d")).select("d.*")
    each = found.groupBy("dimension").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))
    return every.join(each, "dimension", "left").select("dimension", "rank", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("targets", F.lit(0)).alias("targets"))


def summarised(found: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Dimensions, those with and without findings, findings in all."""
    each = found.groupBy("dimension").agg(F.count("*").alias("n"))
    n = len(dimensions)
    return each.agg(F.lit(n).alias("dimensions"), F.count("*").alias("with_findings"), (n - F.count("*")).alias("without"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
