"""Unified diffs to changed files and methods, by windows over segments of lines.

The input has one row for each diff (diff_id, diff), or one for each line of it (diff_id, at, line); diffs are
independent. Only Java files count, binary ones do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import class_of_path

#: fixed values: line patterns
FILE = r"^diff --git a/(.*) b/(.*)$"
OLD, NEW = r"^--- (?:a/(.*)|/dev/null)$", r"^\+\+\+ (?:b/(.*)|/dev/null)$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
BINARY = r"^Binary files .* differ$"
METHOD = r"\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+(?:\w+(?:\[\])?\s+)*(\w+)\s*\("
TRIVIAL = r"^[+-]\s*(import\s+.*|(//|/\*|\*|\*/).*|)$"


#: lines that one window holds
SEGMENT = 100_000


def diff_lines(diffs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """diff_id, at, line, file (number of the file section, 0 before the first) and hunk (number in the file).

    diffs: diff_id and either the whole diff, or one row for each line (at, line), as a diff of any length is read. Lines are numbered within segments; the
    segments' counts, one row for each, are carried on along the diff and added, so no window holds more than a segment.
    """
    if "diff" in diffs.columns:
        diffs = diffs.select("diff_id", F.posexplode(F.split("diff", "\n", -1)).alias("at", "line"))
    lines = diffs.select("diff_id", "at", "line", F.floor(F.col("at") / segment).alias("seg"))
    within = Window.partitionBy("diff_id", "seg").orderBy("at")
    lines = lines.withColumn("_f", F.sum(F.col("line").rlike(FILE).cast("int")).over(within))
    lines = lines.withColumn("_h", F.sum(F.col("line").rlike(HUNK).cast("int")).over(Window.partitionBy("diff_id", "seg", "_f").orderBy("at")))
    # of each segment: its files, and the hunks since the last of them or since its beginning
    counts = lines.groupBy("diff_id", "seg").agg(F.max("_f").alias("files"), F.max_by("_h", "at").alias("hunks"))
    along = Window.partitionBy("diff_id").orderBy("seg")
    counts = counts.withColumn("upto", F.sum("files").over(along)).withColumn("open", F.sum("hunks").over(Window.partitionBy("diff_id", "upto").orderBy("seg")))
    state = counts.select("diff_id", "seg", (F.col("upto") - F.col("files")).alias("_files"), F.coalesce(F.lag("open").over(along), F.lit(0)).alias("_open"))
    out = lines.join(state, ["diff_id", "seg"])
    return out.select("diff_id", "at", "line", (F.col("_files") + F.col("_f")).alias("file"), (F.col("_h") + F.when(F.col("_f") == 0, F.col("_open")).otherwise(0)).alias("hunk"))


def changed_files(diffs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """diff_id, file_path, class_name, change_type, significance, changed_methods.

    A file whose every changed line is an import, a comment or blank is of LOW significance; one without changed
    lines too. Modified files name at most one method for each hunk: the first declared in it.
    """
    lines = diff_lines(diffs, segment).filter("file > 0")
    content = (F.col("hunk") > 0) & F.col("line").rlike(r"^[+\- ]") & ~F.col("line").rlike(HUNK)
    header = F.col("hunk") == 0
    named = lambda pattern: F.max(F.when(header, F.col("line").rlike(pattern)))
    first = lambda pattern, g: F.max(F.when(header & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, g)))
    touched = content & F.col("line").rlike(r"^[+-]")
    files = lines.groupBy("diff_id", "file").agg(
        first(FILE, 1).alias("old_path"), first(FILE, 2).alias("new_path"), named(r"^--- /dev/null$").alias("added"), named(r"^\+\+\+ /dev/null$").alias("deleted"),
        F.max(F.when(F.col("line").rlike(r"^new file mode"), True)).alias("new_mode"), F.max(F.when(F.col("line").rlike(r"^deleted file mode"), True)).alias("old_mode"),
        F.max(F.col("line").rlike(BINARY)).alias("binary"), F.coalesce(F.bool_and(F.when(touched, F.col("line").rlike(TRIVIAL))), F.lit(True)).alias("low"),
    )
    hunks = lines.filter("hunk > 0").groupBy("diff_id", "file", "hunk").agg(
        F.min(F.when(F.col("line").rlike(HUNK), F.struct("at", F.regexp_extract("line", HUNK, 1).cast("int").alias("old"), F.regexp_extract("line", HUNK, 3).cast("int").alias("new")))).alias("start"),
        F.min(F.when(content & F.regexp_like(F.substring("line", 2, 1 << 20), F.lit(METHOD)), F.struct("at", F.regexp_extract(F.substring("line", 2, 1 << 20), METHOD, 1).alias("name")))).alias("method"),
    )
    methods = hunks.filter("method.name is not null").groupBy("diff_id", "file").agg(F.array_sort(F.collect_list(F.struct("hunk", "method.name", "start.old", "start.new"))).alias("ms"))
    kind = F.when(F.coalesce("added", F.lit(False)) | F.coalesce("new_mode", F.lit(False)), "ADDED").when(F.coalesce("deleted", F.lit(False)) | F.coalesce("old_mode", F.lit(False)), "DELETED").otherwise("MODIFIED")
    out = files.filter(~F.col("binary") & (F.col("old_path").endswith(".java") | F.col("new_path").endswith(".java"))).join(methods, ["diff_id", "file"], "left")
    path = F.when(kind == "DELETED", F.col("old_path")).otherwise(F.col("new_path"))
    cls = class_of_path(path)

    def method(m: Column) -> Column:
        return F.struct(cls.alias("class_name"), m["name"].alias("method_name"), m["name"].alias("signature"), F.lit("MODIFIED").alias("change_type"), F.lit(None).cast("string").alias("impact_scope"), m["old"].alias("old_start_line"), m["new"].alias("new_start_line"))

    of = F.when((kind == "MODIFIED") & ~F.col("low"), F.transform("ms", method))
    none = F.array().cast("array<struct<class_name:string,method_name:string,signature:string,change_type:string,impact_scope:string,old_start_line:int,new_start_line:int>>")
    return out.select("diff_id", path.alias("file_path"), cls.alias("class_name"), kind.alias("change_type"), F.when(F.col("low"), "LOW").otherwise("HIGH").alias("significance"), F.coalesce(of, none).alias("changed_methods"))
