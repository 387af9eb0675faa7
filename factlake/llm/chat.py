"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation gets its own rendering: that speaker is the assistant, everyone else is a
user with a name, system turns stay system turns. Only the assistant's words (and the mark that ends them)
are to be learned; `mask` lists where they stand.

A conversation is rendered in parts of PART turn numbers, so that neither one task nor one row ever holds an
unbounded conversation; parts follow each other without a gap in turn order.

Defined results: a null role is the speaker `unknown`, a null text an empty turn; turns with a null number come
before all others; equal turn numbers are ordered by role, then text, and repeated rows are repeated turns; a
null conv_id is a conversation of its own; conversations of system turns only have no participants and no
rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 64
#: fixed values: marks of the rendering
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _head(role: Column, speaker: Column) -> Column:
    who = F.when(role == speaker, "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), who, F.lit("\n"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, part, text, mask (array of start, end in code points), n_turns, n_learned of every perspective."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    given = turns.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1 << 62)).alias("turn"),
        F.when(F.lower(role) == SYSTEM, SYSTEM).otherwise(role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.when(F.col("turn") > -1 << 62, F.floor(F.col("turn") / PART)).otherwise(F.lit(-1 << 57)).cast("long"))
    parts = given.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = given.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit(END)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t["role"], speaker))
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == speaker, F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    out = views.select("conv_id", "speaker", "part", F.array_join(pieces, "").alias("text"), F.aggregate("turns", start, step)["mask"].alias("mask"), F.size("turns").cast("long").alias("n_turns"))
    return out.withColumn("n_learned", F.aggregate("mask", F.lit(0), lambda a, m: a + m["end"] - m["start"]).cast("long"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("mask", mask)


ORACLE = f"""
WITH given AS (
  SELECT conv_id, turn, text, turn // {PART} AS part, CASE WHEN lower(role) = 'system' THEN 'system' ELSE role END AS role
  FROM (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM given WHERE role <> 'system'),
views AS (
  SELECT g.*, s.speaker, '{BEGIN}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM given g JOIN speakers s ON g.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, head || text || '{END.strip()}' || chr(10) AS piece,
    coalesce(sum(length(head) + length(text) + {len(END)}) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM views
)
SELECT conv_id, speaker, part, string_agg(piece, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(begins AS BIGINT)::VARCHAR || ':' || CAST(begins + length(text) + {len(END) - 1} AS BIGINT)::VARCHAR END, ',' ORDER BY turn, role, text), '') AS mask,
  count(*) AS n_turns, CAST(coalesce(sum(CASE WHEN role = speaker THEN length(text) + {len(END) - 1} END), 0) AS BIGINT) AS n_learned
FROM placed GROUP BY conv_id, speaker, part
"""
