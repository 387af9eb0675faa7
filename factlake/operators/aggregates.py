"""Aggregates over groups of analysed files, their correction, and the strategies that produce them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import LAYERS, layer_rank, shortened, token_estimate
from factlake.operators.impact import package_layers
from factlake.operators.reports import LIST_ITEMS, REFACTOR_CHARS, SHORT_SUMMARY_CHARS, SUMMARY_CHARS, TOKENS_MOST

#: files that are summarised at once; more are grouped first
DIRECT_MOST = 10


def profile_context(layers: DataFrame, constraints: DataFrame, top: int = 5, most: int = 3) -> DataFrame:
    """The layers (layer, n) with most classes, ties by name, and the first constraints (pos, severity, description) that are errors, as lines (part, at, line)."""
    first = layers.orderBy(F.desc("n"), "layer").limit(top)
    w = Window.orderBy(F.desc("n"), "layer")
    lines = first.select(F.lit("LAYER").alias("part"), F.row_number().over(w).alias("at"), F.format_string("%s: %d classes", "layer", "n").alias("line"))
    errors = constraints.filter("severity = 'ERROR'").orderBy("pos").limit(most)
    return lines.unionByName(errors.select(F.lit("CONSTRAINT").alias("part"), F.row_number().over(Window.orderBy("pos")).alias("at"), F.col("description").alias("line")))


def timings(runs: DataFrame, *by: str) -> DataFrame:
    """Per group runs (ms: whole numbers), least, most, average rounded down, upper median and 90th percentile by rank.

    The upper median is the run with as many before as after it, or one more before; exact, from counts of equal times.
    """
    each = runs.groupBy(*by, "ms").agg(F.count("*").alias("c"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(part.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.withColumn("upto", upto).withColumn("total", F.sum("c").over(part))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("ms")))
    median, p90 = F.floor(F.col("total") / 2), F.ceil(F.col("total") * 9 / 10) - 1
    return ranked.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.floor(F.sum(F.col("ms") * F.col("c")) / F.sum("c")).alias("average"),
        at(median).alias("median"), at(p90).alias("p90"),
    )


def corrected_statistics(outputs: DataFrame, input_files: DataFrame, said_layers: DataFrame, risks: DataFrame) -> DataFrame:
    """Per package what can be counted instead of what was said: files, layer and its composition, risks.

    outputs: package, layer (said); input_files: package, layer; said_layers: package, layer, of which names that
    are no layers are passed over; risks: package, severity. The layers said for files count, if any is one, else those
    of the input, else the one said for the package, else UNKNOWN.
    """
    valid = said_layers.filter(F.col("layer").isin(*LAYERS))
    said = package_layers(valid.select(F.col("package").alias("package_name"), "layer"))
    given = package_layers(input_files.select(F.col("package").alias("package_name"), F.coalesce("layer", F.lit("UNKNOWN")).alias("layer")))
    files = input_files.groupBy("package").agg(F.count("*").alias("files"))
    counts = risks.groupBy("package").agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "MEDIUM").alias("medium"))
    out = outputs.select("package", F.col("layer").alias("_told"))
    for name, df in (("s", said), ("g", given)):
        out = out.join(df.select(F.col("package_name").alias("package"), F.col("layer").alias(f"_{name}"), F.col("composition").alias(f"_{name}c")), "package", "left")
    out = out.join(files, "package", "left").join(counts, "package", "left")
    composition = F.when(F.col("_s").isNotNull(), F.col("_sc")).otherwise(F.col("_gc"))
    told = F.when(F.col("_told").isin(*LAYERS), F.col("_told"))
    return out.select(
        "package", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("_s", "_g", told, F.lit("UNKNOWN")).alias("layer"), composition.alias("composition"),
        F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("medium", F.lit(0)).alias("medium"),
    )


#: fixed value: what stands for an overview that was not written
RISK_SENTENCE = "该包存在 %d 个高风险、%d 个中风险问题，建议优先处理高风险项。"


def corrected_summary(summary: Column) -> Column:
    """A summary of SUMMARY_CHARS at most; an empty one is marked as such."""
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", "（无摘要）").otherwise(F.substring(summary, 1, SUMMARY_CHARS))


def corrected_refactoring(text: Column, high: Column, medium: Column) -> Column:
    """At most REFACTOR_CHARS; where there are risks and nothing was written, a sentence that counts them."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    counted = F.format_string(RISK_SENTENCE, high.cast("long"), medium.cast("long"))
    return F.when((high + medium > 0) & empty, counted).otherwise(F.substring(text, 1, REFACTOR_CHARS))


def validated_aggregates(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Aggregates with the field that fails, package or layer, or null, and everything else corrected in place.

    outputs: id, package, layer, summary, entries, responsibilities, refactoring, high, medium; expected: id, expected_package,
    null for any. Where all of an aggregate is over TOKENS_MOST by estimate, its summary is cut once more.
    """
    out = outputs.join(expected, "id", "left")
    name = F.trim(F.coalesce("package", F.lit("")))
    failed = F.when((name == "") | ~F.coalesce(name == F.col("expected_package"), F.lit(True)), "package").when(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False)), "layer")
    out = out.withColumns({
        "failure": failed, "summary": corrected_summary(F.col("summary")), "entries": F.slice("entries", 1, LIST_ITEMS),
        "responsibilities": F.slice("responsibilities", 1, LIST_ITEMS), "refactoring": corrected_refactoring(F.col("refactoring"), F.col("high"), F.col("medium")),
    })
    size = token_estimate(F.to_json(F.struct(*[c for c in outputs.columns if c != "id"])))
    return out.withColumn("summary", F.when(size > TOKENS_MOST, shortened(F.col("summary"), SHORT_SUMMARY_CHARS, "…")).otherwise(F.col("summary"))).drop("expected_package")


def with_strategy(files: DataFrame, most: int = DIRECT_MOST) -> DataFrame:
    """Files (package, file) with the way their package is summarised: DIRECT up to `most` of them, else GROUPED.

    Packages are counted from groups, so that one with a third of all files is summed where its files are.
    """
    n = files.groupBy("package").agg(F.count("*").alias("n_files"))
    return files.join(n, "package").withColumn("strategy", F.when(F.col("n_files") <= most, "DIRECT").otherwise("GROUPED"))


def aggregated(files: DataFrame, groups: DataFrame, summarise: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], most: int = DIRECT_MOST) -> DataFrame:
    """One row for each package. files: package, file; groups: package, file, pos, name.

    summarise gets rows (package, pos, name, file) and gives one row for each (package, pos); merge gets the rows of grouped
    packages and gives one for each package. A direct package is one group at position 0 and is not merged; files
    that no group names form a last one.
    """
    way = with_strategy(files, most)
    direct = way.filter("strategy = 'DIRECT'").select("package", F.lit(0).alias("pos"), F.lit("").alias("name"), "file")
    w = Window.partitionBy("package", "file").orderBy("pos")
    first = groups.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("package", "file", "pos", "name")
    rest = F.lit((1 << 31) - 1)
    grouped = way.filter("strategy = 'GROUPED'").join(first, ["package", "file"], "left").select("package", F.coalesce("pos", rest).alias("pos"), F.coalesce("name", F.lit("(rest)")).alias("name"), "file")
    return summarise(direct).drop("pos").unionByName(merge(summarise(grouped)))


def layer_histogram(entries: DataFrame) -> DataFrame:
    """Entries (package, layer) by layer, in the layers' order."""
    return entries.groupBy("package", "layer").agg(F.count("*").alias("n")).withColumn("rank", layer_rank(F.col("layer")))


def file_name(package: Column, kind: str) -> Column:
    """K8: the name, without an ending, of the file of a package's or module's summary."""
    return F.concat(F.translate(F.coalesce(package, F.lit("module")), ".", "_"), F.lit(f"_{kind}"))


def summary_markdown(outputs: DataFrame) -> DataFrame:
    """K8: package, json and Markdown text of each summary (package, layer, files, high, medium, summary, entries)."""
    listed = F.array_join(F.transform(F.coalesce("entries", F.array().cast("array<string>")), lambda e: F.concat(F.lit("\n* "), e)), "")
    head = F.concat(F.lit("# "), F.col("package"), F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n"))
    facts = F.format_string("| layer | files | HIGH | MEDIUM |\n|-|-|-|-|\n| %s | %d | %d | %d |\n", "layer", F.col("files").cast("long"), F.col("high").cast("long"), F.col("medium").cast("long"))
    return outputs.select("package", F.to_json(F.struct(*outputs.columns)).alias("json"), F.concat(head, facts, listed).alias("markdown"))


def write_summaries(outputs: DataFrame, folder: str, kind: str = "package") -> None:
    """K8: JSON and Markdown of all summaries, in folders by the names the files go by. Summaries without a package are left out."""
    named = summary_markdown(outputs.filter("package is not null")).withColumn("name", file_name(F.col("package"), kind))
    for ending, column in (("json", "json"), ("md", "markdown")):
        named.select("name", F.col(column).alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(f"{folder}/{ending}")
