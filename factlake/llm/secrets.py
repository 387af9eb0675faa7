"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table
partitioned by rule version, has a row for each scanned (blob, rule version) with the spans found, empty
ones included; only pairs that it lacks are scanned, each blob once however many versions hold it.
Findings are joined back to all paths.

Spans are (start, end) in code points, end exclusive. Matches are leftmost and non-overlapping for each
kind; those under the kind's least length are dropped afterwards.

Defined results: a null text is the empty one and has no spans; a null path keeps its row; repeated rows
each get theirs; empty tables give empty results; further columns, whatever their names, are kept by scan() and
without_secrets().
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, kept, shared_dir, table_or_none


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int
    least: int


#: fixed values: the kinds of the scan in their order, with the group that is measured and its least length
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES_VERSION = "2"
_SPANS = "array<struct<start:int,rule:int,end:int>>"
REDACTED = "[REDACTED]"
#: code points of a block that redaction cuts from
BLOCK = 1024


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, merge) -> Column:
    """What `merge` makes of each value and all before it, by doubling: n values take log n passes and no list grows by copies.

    `merge` is given a value and the one so many places before it, null before the first.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    fold = lambda acc, d: F.transform(acc, lambda v, i: merge(v, F.get(acc, i - d)))
    return F.aggregate(powers, values, lambda acc, d: F.when(d < F.size(acc), fold(acc, d)).otherwise(acc))


def _found(text: Column, k: int, rule: Rule) -> Column:
    """Spans of one rule: the text split at the matches gives what lies between them, and so their places."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    matches = F.zip_with(whole, measured, lambda w, m: F.struct(F.length(w).alias("w"), F.length(m).alias("m")))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["between"], 1, F.size(x["matches"])), x["matches"], lambda b, m: b + m["w"])
        ends = _running(steps, lambda v, before: v + F.coalesce(before, F.lit(0)))
        span = lambda m, e: F.struct((e - m["w"]).alias("start"), F.lit(k).alias("rule"), e.alias("end"), m["m"].alias("m"))
        long_enough = F.filter(F.zip_with(x["matches"], ends, span), lambda s: s["m"] >= rule.least)
        return F.transform(long_enough, lambda s: s.dropFields("m"))

    spans = _bound(F.struct(matches.alias("matches"), between.alias("between")), placed)
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPANS))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of all rules, by start, then by the rules' order."""
    return F.sort_array(F.concat(*[_found(text, k, r) for k, r in enumerate(rules)]))


def _seen(spark: SparkSession, ledger: str, version: str) -> DataFrame | None:
    table = table_or_none(spark, ledger, f"blob string, spans {_SPANS}, rule_version string")
    return None if table is None else table.filter(F.col("rule_version") == version)


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> None:
    """Scan the blobs of `versions` (column text) that the ledger at path `ledger` lacks for this rule version, and append them."""
    spark = versions.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("text"))
    seen = _seen(spark, ledger, version)
    if seen is not None:
        unseen = blobs.select("blob").distinct().join(seen.select("blob"), "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    once.select("blob", spans_of(F.col("text"), rules).alias("spans"), F.lit(version).alias("rule_version")).write.mode("append").partitionBy("rule_version").parquet(ledger)


def _scanned(own: Kept, ledger: str, rules: tuple[Rule, ...], version: str) -> DataFrame:
    """The rows of `own` with their spans; the ledger is brought up to date first.

    Blobs that hold no secret stay out of the join, which is a sort-merge join that adaptive execution
    splits where one blob holds many versions.
    """
    update_ledger(own.table.select(own["text"].alias("text")), ledger, rules, version)
    found = _seen(own.table.sparkSession, ledger, version).filter(F.size("spans") > 0).select("blob", "spans")
    addressed = own.table.withColumn("address", F.sha2(F.coalesce(own["text"].cast("string"), F.lit("")), 256))
    return addressed.join(found, F.col("address") == F.col("blob"), "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """Every row of `versions` with its spans as a last column `secret_spans`; the ledger at path `ledger` is brought up to date first."""
    own = kept(versions)
    return _scanned(own, ledger, rules, version).select(*own.table.columns, "spans").toDF(*own.names, "secret_spans")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined in the spans' order."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, as REDACTED.

    What is kept is cut out of blocks of BLOCK code points, so that no cut walks through the text before it.
    """

    def cut_out(blocks: Column, begin: Column, end: Column) -> Column:
        first, last = (F.floor(at / BLOCK).cast("int") for at in (begin, end))
        head = F.substring(F.get(blocks, first), begin % BLOCK + 1, F.least(F.lit(BLOCK), end - begin))
        body = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.concat_ws("", head, body, F.when(last > first, F.substring(F.get(blocks, last), F.lit(1), end % BLOCK)))

    def without(x: Column) -> Column:
        far, blocks = x["far"], x["blocks"]
        gaps = F.transform(x["spans"], lambda s, i: F.struct(F.coalesce(F.get(far, i - 1), F.lit(0)).alias("begin"), s["start"].alias("end")))
        tail = F.struct(F.coalesce(F.get(far, F.size(far) - 1), F.lit(0)).alias("begin"), F.length(text).alias("end"))
        kept_gaps = F.concat(F.filter(gaps, lambda g: g["end"] >= g["begin"]), F.array(tail))
        return F.array_join(F.transform(kept_gaps, lambda g: cut_out(blocks, g["begin"], g["end"])), REDACTED)

    far = _running(F.transform(spans, lambda s: s["end"]), lambda v, before: F.greatest(v, before))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _bound(F.struct(spans.alias("spans"), far.alias("far"), blocks.alias("blocks")), without)


def without_secrets(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """The documents with their secrets redacted and n_chars, if there is one, brought up to date; every document and column stays."""
    own = kept(documents)
    found = _scanned(own, ledger or new_ledger(documents.sparkSession), RULES, RULES_VERSION)
    text, hit = own["text"], F.size("spans") > 0
    name = lambda c: own.table.columns[own.names.index(c)]
    found = found.withColumn(name("text"), F.when(hit, redacted(text, F.col("spans"))).otherwise(text))
    if "n_chars" in own.names:
        found = found.withColumn(name("n_chars"), F.when(hit, F.length(text)).otherwise(own["n_chars"]).cast(documents.schema["n_chars"].dataType))
    return own.back(found)


def new_ledger(spark: SparkSession) -> str:
    """The path of an empty ledger in the shared folder."""
    return f"{shared_dir(spark)}/factlake/ledger-{uuid.uuid4().hex}"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(documents, new_ledger(spark))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), listed(F.col("secret_spans")).alias("spans"),
    ).withColumn("base_sha256", F.sha2("spans", 256))
