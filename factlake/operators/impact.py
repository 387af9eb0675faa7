"""Impact of changed methods over call edges, by levels.

One join per hop: the frontier meets the edges on the called method, what has been reached is taken out by
an anti-join. The driver only asks whether a frontier is empty. Frontiers are written to the checkpoint
folder, as later hops read them again and executors may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import impact_confidence, layer_of, package_of, path_text, risk_score, simple_name
from factlake.session import checkpointed

MAX_HOPS, PER_NODE, TOTAL, MAX_FILES = 3, 30, 200, 50
_NODE = ["class_name", "method_name"]


def seeds(changed_files: DataFrame) -> DataFrame:
    """Changed methods that spread: none of files of low significance, none that were added; deleted ones are marked."""
    m = changed_files.filter("significance <> 'LOW'").select(F.explode("changed_methods").alias("m")).filter("m.change_type <> 'ADDED'")
    key = F.concat_ws(".", "m.class_name", "m.method_name")
    mark = F.when(F.col("m.change_type") == "DELETED", F.concat(key, F.lit(" [DELETED]"))).otherwise(key)
    return m.select("m.class_name", "m.method_name", F.array(mark).alias("path")).dropDuplicates(_NODE)


def impacts(seed: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, per_node: int | None = PER_NODE, total: int | None = TOTAL) -> DataFrame:
    """G1: class_name, method_name, hop, level, confidence, path, layer of every method reached against the calls.

    The shortest way counts. Methods are met in order: seeds by name, the callers of an earlier method before those
    of a later one, those of one method by line. per_node call records of each method are followed, by line, whether
    or not their callers were met before. Once `total` methods are reached no further method is followed, so that at
    most total + per_node - 1 are found. Only calls of methods on the frontier are ever ranked. Without a total
    nothing needs the order, and of the shortest ways the first by its text and line counts.
    """
    calls = edges.filter("callee_method is not null")
    order = F.row_number().over(Window.orderBy(*_NODE)) if total is not None else F.lit(0)
    frontier = checkpointed(seed.select(*_NODE, "path").withColumn("ord", order.cast("long")))
    visited, found, reached = frontier.select(*_NODE), None, 0
    for hop in range(1, max_hops + 1):
        if total is not None and reached >= total:
            break
        step = frontier.join(calls, (F.col("callee_class") == F.col("class_name")) & (F.col("callee_method") == F.col("method_name")))
        if per_node is not None:
            w = Window.partitionBy("callee_class", "callee_method").orderBy("line_number", "caller_class", "caller_method", "call_type")
            step = step.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_node)
        else:
            step = step.withColumn("rn", F.lit(0))
        step = step.select(F.col("caller_class").alias("class_name"), F.col("caller_method").alias("method_name"), F.concat("path", F.array(F.concat_ws(".", "caller_class", "caller_method"))).alias("path"), "call_type", "line_number", "ord", "rn")
        step = step.join(visited, _NODE, "left_anti")
        by = ["ord", "rn"] if total is not None else [path_text(F.col("path")).alias("text")]
        first = F.min(F.struct(*by, "line_number", "call_type", "path")).alias("f")
        step = step.groupBy(*_NODE).agg(first)
        if total is not None:
            # the frontier, and so the step, is bounded by the caps: at most per_node callers of each of total + per_node methods
            earlier = Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
            parents = step.groupBy(F.col("f.ord").alias("parent")).agg(F.count("*").alias("new"))
            parents = parents.withColumn("before", F.coalesce(F.sum("new").over(earlier), F.lit(0)) + reached).filter(F.col("before") < total)
            step = step.join(parents, F.col("f.ord") == F.col("parent"), "left_semi")
            step = step.select(*_NODE, "f.path", "f.call_type", F.row_number().over(Window.orderBy("f.ord", "f.rn")).cast("long").alias("ord"))
        else:
            step = step.select(*_NODE, "f.path", "f.call_type", F.lit(0).cast("long").alias("ord"))
        step = checkpointed(step.withColumn("hop", F.lit(hop)))
        n = step.count()
        if not n:
            break
        found = step if found is None else found.unionByName(step)
        visited = visited.unionByName(step.select(*_NODE))
        frontier, reached = step.select(*_NODE, "path", "ord"), reached + n
    if found is None:
        found = seed.select(*_NODE, "path", F.lit("").alias("call_type"), F.lit(0).alias("hop")).limit(0)
    level = F.when(F.col("hop") == 1, "DIRECT").otherwise("INDIRECT")
    layer = layer_of(simple_name(F.col("class_name")), package_of(F.col("class_name")))
    return found.select(*_NODE, "hop", level.alias("level"), impact_confidence(F.col("call_type"), F.col("hop")).alias("confidence"), "path", layer.alias("layer"))


def analyse(changed_files: DataFrame, edges: DataFrame | None, **caps: int | None) -> tuple[DataFrame | None, str | None]:
    """The impacts, or None with a note where there are too many changed files or no edges to follow."""
    n = changed_files.count()
    if n > MAX_FILES:
        return None, f"{n} changed files: package level only"
    if edges is None:
        return None, "no call edges: file level only"
    return impacts(seeds(changed_files), edges, **caps), None


def summary(impact: DataFrame, changed_files: DataFrame | None = None) -> DataFrame:
    """A5: methods reached directly and indirectly, and per layer; with the changed files also those that are not of LOW significance, and their methods."""
    layers = impact.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("hop") == 1).alias("d"))
    out = layers.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("direct"), F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("indirect"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layers"),
    )
    if changed_files is None:
        return out
    counted = changed_files.filter("significance is null or significance <> 'LOW'")
    files = counted.agg(F.count("*").alias("changed_files"), F.coalesce(F.sum(F.greatest(F.size("changed_methods"), F.lit(0))), F.lit(0)).alias("changed_methods"))
    return out.crossJoin(files)  # one row each


def high_risk_paths(impact: DataFrame, limit: int = 5) -> DataFrame:
    """The riskiest paths, shortest first, those of score 2 and more."""
    scored = impact.withColumn("risk", risk_score(F.col("hop"), F.col("confidence"))).filter("risk >= 2")
    mark = F.when(F.col("risk") >= 3, "🔴 ").otherwise("🟡 ")
    return scored.orderBy(F.desc("risk"), "hop", *_NODE).limit(limit).select("risk", "hop", F.concat(mark, path_text(F.col("path"))).alias("path"))


def heat_map(impact: DataFrame) -> DataFrame:
    """Per package, methods reached directly, indirectly and in all; the hottest first."""
    package = package_of(F.col("class_name"), "(default)")
    out = impact.groupBy(package.alias("package")).agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") > 1).alias("indirect"), F.count("*").alias("total"))
    return out.orderBy(F.desc("total"), "package")


def markdown(impact: DataFrame, limit: int = 5) -> DataFrame:
    """K7: the impact as lines of Markdown (at, line): a heading, a row for each package by heat, and the riskiest paths.

    Packages and at most `limit` paths are all that is written; the methods themselves stay in the table.
    """
    spark = impact.sparkSession
    head = spark.createDataFrame([(0, 0, "", "# Impact"), (0, 1, "", "| package | direct | indirect | total |"), (0, 2, "", "|-|-|-|-|")], "part int, n int, by string, line string")
    heat = heat_map(impact)
    rows = heat.select(F.lit(1).alias("part"), (-F.col("total")).cast("int").alias("n"), F.col("package").alias("by"), F.format_string("| %s | %d | %d | %d |", "package", "direct", "indirect", "total").alias("line"))
    risky = high_risk_paths(impact, limit).select(F.lit(2).alias("part"), F.col("hop").alias("n"), F.col("path").alias("by"), F.concat(F.lit("* "), F.col("path")).alias("line"))
    w = Window.orderBy("part", "n", "by")
    return head.unionByName(rows).unionByName(risky).select((F.row_number().over(w) - 1).alias("at"), "line")


def write_impact(impact: DataFrame, folder: str) -> None:
    """K7: the impacts as JSON, the heat map as a file of its own, and the Markdown text."""
    impact.write.mode("overwrite").json(f"{folder}/impact")
    heat_map(impact).write.mode("overwrite").json(f"{folder}/heat-map")
    markdown(impact).orderBy("at").coalesce(1).select("line").write.mode("overwrite").text(f"{folder}/markdown")


def package_layers(classes: DataFrame) -> DataFrame:
    """Per package its layer, if one has half of the classes or more (ties: the first in order), else
    UNKNOWN and the shares of all layers. classes: package_name, layer."""
    from factlake.functions.columns import layer_rank

    counts = classes.groupBy("package_name", "layer").agg(F.count("*").alias("n")).withColumn("rank", layer_rank(F.col("layer")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "rank", "layer", "n")))
    out = counts.groupBy("package_name").agg(F.sum("n").alias("total"), ordered.alias("ls"))
    top = F.col("ls")[0]
    pure = top["n"] * 2 >= F.col("total")
    shares = F.transform("ls", lambda x: F.format_string("%.1f%% %s", x["n"] * 100.0 / F.col("total"), x["layer"]))
    return out.select("package_name", "total", F.when(pure, top["layer"]).otherwise("UNKNOWN").alias("layer"), F.when(~pure, F.array_join(shares, " + ")).alias("composition"))
