"""Preference formatting: a chosen and a rejected conversation become one prompt and two completions.

The prompt is the longest common prefix of turns (same role and text), rendered once.  Each
completion is the rest of its conversation; its mask lists the character spans of assistant turns, the
only ones to learn from.  Rendered turns look like ``<|im_start|>role\\ntext<|im_end|>\\n``; a marker
inside a text is broken with a backslash, so no text can open or close a turn.

Only built-in functions; one aggregate gathers the turns of a conversation, which is one training row
by nature.  Defined results: null texts and roles are empty, turns of equal number are ordered by role and
text, repeated rows are turns of their own; a null conversation id names no conversation; pairs
whose conversation is absent are left out; equal conversations have two empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): an array of role and text in order."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y)
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(shorter).cast("int")


def rendered(turn: Column) -> Column:
    safe = F.replace(turn["text"], F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), safe, F.lit(CLOSE), F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    """Spans (first, end) of the assistant texts, with their closing mark, in the rendered turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        size = F.length(rendered(turn))
        head = len(OPEN) + 1
        span = F.struct((state["at"] + head + F.length(turn["role"])).cast("int").alias("first"), (state["at"] + size - 1).cast("int").alias("end"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def formatted(chosen: DataFrame, rejected: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per pair (pair_id, chosen_id, rejected_id) of conversations as made by ``conversations``."""
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    sides = sides.join(chosen.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("good")), "chosen_id")
    sides = sides.join(rejected.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("bad")), "rejected_id")
    return completions(sides)


def completions(sides: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, completions and masks of rows (pair_id, good, bad)."""
    both = sides.withColumn("n", common_turns(F.col("good"), F.col("bad")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumn("rest_good", rest("good")).withColumn("rest_bad", rest("bad"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.slice("good", 1, F.col("n"))).alias("prompt"),
        render(F.col("rest_good")).alias("chosen"), render(F.col("rest_bad")).alias("rejected"),
        mask(F.col("rest_good")).alias("chosen_mask"), mask(F.col("rest_bad")).alias("rejected_mask"),
    )


def with_other_ending(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, good, bad): every conversation against itself with another's last reply.

    The reply is the last assistant text of the conversation whose id differs in the last bit; where
    that has none, the last reply is cut off.
    """
    is_reply = lambda t: t["role"] == "assistant"
    table = turns.withColumn("last", F.try_element_at(F.filter("turns", is_reply), F.lit(-1))["text"])
    other = table.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last").alias("reply"))
    joined = table.join(other, "conv_id", "left")
    at = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), is_reply), True)
    reply = F.when(F.col("reply").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.array(F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("text"))))
    bad = F.concat(F.slice("turns", 1, at.cast("int")), reply)
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("good"), bad.alias("bad"))


def op6_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversations(spark.read.parquet(f"{folder}/conversations.parquet"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["first"], s["end"])), ",")
    found = completions(with_other_ending(turns))
    return found.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, max(k) FILTER (role = 'assistant') AS cut, max(k) AS n FROM t GROUP BY 1),
reply AS (SELECT xor(t.conv_id, 1) AS conv_id, t.text FROM t JOIN ends USING (conv_id) WHERE t.k = ends.cut),
bad AS (SELECT conv_id, k, role, text FROM t JOIN ends USING (conv_id) WHERE k < coalesce(cut, n + 1)
        UNION ALL SELECT conv_id, coalesce(cut, n + 1), 'assistant', text FROM ends JOIN reply USING (conv_id)),
size AS (SELECT conv_id, (SELECT count(*) FROM bad WHERE bad.conv_id = ends.conv_id) AS m, n FROM ends),
diff AS (SELECT t.conv_id, min(t.k) AS k FROM t JOIN bad USING (conv_id, k)
         WHERE t.role <> bad.role OR t.text <> bad.text GROUP BY 1),
lcp AS (SELECT conv_id, coalesce(diff.k - 1, least(n, m)) AS p FROM size LEFT JOIN diff USING (conv_id)),
drawn AS (
  SELECT side, conv_id, k, p, role, '<|im_start|>' || role || chr(10) || replace(text, '<|', '<\\|') || '<|im_end|>' || chr(10) AS r
  FROM (SELECT 'good' AS side, * FROM t UNION ALL SELECT 'bad', conv_id, role, text, k FROM bad) JOIN lcp USING (conv_id)),
placed AS (SELECT *, k > p AS later, sum(length(r)) OVER (PARTITION BY side, conv_id, k > p ORDER BY k) AS upto FROM drawn),
parts AS (SELECT side, conv_id,
    coalesce(string_agg(r, '' ORDER BY k) FILTER (NOT later), '') AS head,
    coalesce(string_agg(r, '' ORDER BY k) FILTER (later), '') AS rest,
    coalesce(string_agg((upto - length(r) + 13 + length(role))::BIGINT || '-' || (upto - 1)::BIGINT, ',' ORDER BY k)
             FILTER (later AND role = 'assistant'), '') AS spans
  FROM placed GROUP BY 1, 2)
SELECT lcp.conv_id AS pair_id, p AS n_prompt_turns, coalesce(g.head, '') AS prompt, coalesce(g.rest, '') AS chosen,
       coalesce(b.rest, '') AS rejected, coalesce(g.spans, '') AS chosen_mask, coalesce(b.spans, '') AS rejected_mask
FROM lcp LEFT JOIN parts g ON g.conv_id = lcp.conv_id AND g.side = 'good' LEFT JOIN parts b ON b.conv_id = lcp.conv_id AND b.side = 'bad'"""
