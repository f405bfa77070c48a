"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Each conversation is rendered once for every participant: that speaker's turns
become the assistant's, all others are users named after their role, and only
the assistant's text and end marker are learned (the mask).  Context roles
("system") are kept as such and take no perspective.

The result has one row per perspective and message, in order: the rendered
segment, where it starts in the rendered dialogue, and the span to learn.  A
conversation of any length is thus never gathered in one task: positions are
running sums inside blocks of 64 turns, plus the sums of the blocks before.

Cases: a null text is empty; a null role is the speaker "unknown"; null turns
come first; a null conv_id is one conversation; messages of the same turn are
ordered by role, then text; rows equal in all four columns are one row with
``copies`` above 1 that stands ``copies`` times in the dialogue.  A
conversation of context roles alone has one rendering, of perspective null.
``<|`` inside a text becomes ``<\\|``, so that no text can forge a marker.  A very
long text is one segment.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("system",)
BLOCK = 64


def segments(conversations: DataFrame, context: tuple[str, ...] = CONTEXT, block: int = BLOCK) -> DataFrame:
    """One row per perspective and message."""
    c = F.col
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("said"),
    )
    speaks = F.when(~c("role").isin(*context), c("role"))
    speakers = rows.where(speaks.isNotNull()).select(c("conv_id").alias("of"), c("role").alias("perspective")).distinct()
    said = rows.groupBy("conv_id", "turn", "role", "said").agg(F.count("*").alias("copies"))
    # a conversation without speakers has one rendering
    seen = said.join(speakers, c("conv_id").eqNullSafe(c("of")), "left").select("conv_id", "turn", "role", "said", "copies", "perspective")
    own = c("perspective").isNotNull() & (c("role") == c("perspective"))
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(c("role").isin(*context), F.concat(F.lit("<|"), c("role"), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), c("role"), F.lit("|>\n")))
    )
    seen = seen.select(
        "conv_id", "turn", "role", "said", "copies", "perspective",
        F.floor(F.coalesce(c("turn"), F.lit(-1)) / block).alias("block"),
        own.alias("learned"),
        F.length(head).cast("long").alias("head_chars"),
        F.concat(head, c("said"), F.lit("<|end|>\n")).alias("segment"),
    ).withColumn("chars", F.length("segment").cast("long"))
    by = ["conv_id", "perspective"]
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        seen.groupBy(*by, "block")
        .agg(F.sum(c("chars") * c("copies")).alias("chars"), F.sum("copies").alias("copies"))
        .select(
            *(c(k).alias(f"b_{k}") for k in (*by, "block")),
            F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
            F.coalesce(F.sum("copies").over(before), F.lit(0)).alias("rows_before"),
        )
    )
    inside = Window.partitionBy(*by, "block").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.select(
        "*",
        F.coalesce(F.sum(c("chars") * c("copies")).over(inside), F.lit(0)).alias("chars_inside"),
        F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("rows_inside"),
    )
    on = [c(k).eqNullSafe(c(f"b_{k}")) for k in (*by, "block")]
    start = c("chars_before") + c("chars_inside")
    return placed.join(blocks, on).select(
        "conv_id", "perspective", "turn", "role",
        (c("rows_before") + c("rows_inside")).alias("position"),
        "copies", "segment",
        start.alias("char_start"),
        "chars", "learned",
        F.when(c("learned"), start + c("head_chars")).alias("mask_start"),
        F.when(c("learned"), c("chars") - c("head_chars") - 1).alias("mask_chars"),
    )


def dialogues(found: DataFrame) -> DataFrame:
    """Whole dialogues as single texts, for conversations short enough to be one value."""
    ordered = F.sort_array(F.collect_list(F.struct("position", F.expr("repeat(segment, cast(copies as int))").alias("s"))))
    return found.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("text"))


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS said FROM conversations),
p AS (SELECT conv_id, list(DISTINCT role) FILTER (WHERE role NOT IN ('system')) AS party FROM r GROUP BY conv_id),
s AS (SELECT conv_id, turn, role, said, count(*) AS copies FROM r GROUP BY ALL),
x AS (
  SELECT s.*, q.perspective FROM s JOIN (
    SELECT conv_id, unnest(CASE WHEN party IS NULL OR len(party) = 0 THEN [NULL] ELSE party END) AS perspective FROM p) q
  ON s.conv_id IS NOT DISTINCT FROM q.conv_id),
h AS (
  SELECT *, coalesce(role = perspective, false) AS learned,
    CASE WHEN coalesce(role = perspective, false) THEN '<|assistant|>' || chr(10)
         WHEN role IN ('system') THEN '<|' || role || '|>' || chr(10)
         ELSE '<|user name=' || role || '|>' || chr(10) END AS head FROM x),
g AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM h),
w AS (
  SELECT *, length(segment) AS chars,
    coalesce(sum(length(segment) * copies) OVER v, 0) AS char_start, coalesce(sum(copies) OVER v, 0) AS position FROM g
  WINDOW v AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, turn, role, cast(position AS bigint) AS position, copies, segment, cast(char_start AS bigint) AS char_start,
  chars, learned, CASE WHEN learned THEN cast(char_start + length(head) AS bigint) END AS mask_start,
  CASE WHEN learned THEN chars - length(head) - 1 END AS mask_chars
FROM w
"""
