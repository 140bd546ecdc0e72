"""Preference pairs: one prompt, a chosen and a rejected completion, and what to train on.

The prompt is the longest run of first turns that both conversations share. It is rendered
once; the turns that follow on either side become the completions. Of a completion only what
an assistant says, with its end mark, is trained on: the masks are character ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.registry import query

TURN_START, TURN_END = "<|{role}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (role, text); a conversation is one output value."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col("conv_id").isNotNull()).select("conv_id", said.alias("t")).groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn lists."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(a.isNull() | b.isNull(), 0).when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def _start(turn: Column) -> Column:
    before, after = TURN_START.split("{role}")
    return F.concat(F.lit(before), turn["role"], F.lit(after))


def _rendered(turn: Column) -> Column:
    return F.concat(_start(turn), turn["text"], F.lit(TURN_END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _ranges(turns: Column) -> tuple[Column, Column]:
    """Starts and ends of the trained characters of a rendered completion."""
    sizes = F.transform(turns, lambda t: F.length(_rendered(t)).cast("long"))
    placed = F.transform(turns, lambda t, i: F.struct(
        t["role"].alias("role"), F.length(_start(t)).alias("skip"), F.length(_rendered(t)).alias("size"),
        F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x).alias("at")))
    own = F.filter(placed, lambda p: p["role"] == "assistant")
    return F.transform(own, lambda p: p["at"] + p["skip"]), F.transform(own, lambda p: p["at"] + p["size"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id): prompt, completions and masks.

    ``turns`` has conv_id, turn, role and text. Null roles and texts count as empty; turns
    with the same number are ordered by role and text; turns without conversation belong to
    no pair. A side without turns, or without partner, has null completion and masks, and
    the other side then has no common prompt. Identical conversations give two empty
    completions. Other columns are ignored, and empty tables give an empty result.
    """
    listed = conversations(turns)
    side = lambda name: listed.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(
        side("rejected"), "rejected_id", "left")
    shared = F.coalesce(common_turns(F.col("chosen_turns"), F.col("rejected_turns")), F.lit(0))
    both = both.withColumn("prompt_turns", shared)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    both = both.withColumns({
        "prompt": F.coalesce(_text(F.slice("chosen_turns", F.lit(1), F.col("prompt_turns"))), F.lit("")),
        "_chosen": rest(F.col("chosen_turns")), "_rejected": rest(F.col("rejected_turns"))})
    out = {}
    for name in ("chosen", "rejected"):
        starts, ends = _ranges(F.col(f"_{name}"))
        out |= {name: _text(F.col(f"_{name}")), f"{name}_mask_starts": starts, f"{name}_mask_ends": ends}
    return both.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt",
                       *[c.alias(n) for n, c in out.items()])


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of the conversations with ids 2k (chosen) and 2k + 1 (rejected)."""
    ids = turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    return ids.groupBy(F.expr("conv_id - pmod(conv_id, 2)").alias("pair_id")).agg(
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"))


def _side_sql(name: str) -> str:
    turn = "'<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)"
    own = f"list_filter(range(1, len({name}) + 1), lambda i: {name}[i].role = 'assistant')"
    upto = f"coalesce(list_sum(list_transform({name}[1:i - 1], lambda t: length({turn}))), 0)"
    return f"""array_to_string(list_transform({name}, lambda t: {turn}), '') AS {name}_text,
      list_transform({own}, lambda i: CAST({upto} + length({name}[i].role) + 5 AS BIGINT)) AS {name}_mask_starts,
      list_transform({own}, lambda i: CAST({upto} + length({name}[i].role) + 5 + length({name}[i].text) + 8 AS BIGINT)) AS {name}_mask_ends"""


_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (
  SELECT pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id
  FROM (SELECT conv_id, conv_id - conv_id % 2 AS pair_id FROM c) GROUP BY pair_id),
b AS (
  SELECT p.*, a.turns AS a, r.turns AS r, coalesce(list_min(list_filter(range(1, least(len(a.turns), len(r.turns)) + 1),
      lambda i: a.turns[i] <> r.turns[i])) - 1, least(len(a.turns), len(r.turns)), 0) AS n
  FROM p LEFT JOIN c a ON a.conv_id = chosen_id LEFT JOIN c r ON r.conv_id = rejected_id),
s AS (
  SELECT pair_id, chosen_id, rejected_id, CASE WHEN a IS NULL OR r IS NULL THEN 0 ELSE n END AS n, a,
    a[(CASE WHEN r IS NULL THEN 0 ELSE n END) + 1:] AS chosen, r[(CASE WHEN a IS NULL THEN 0 ELSE n END) + 1:] AS rejected FROM b),
w AS (
  SELECT pair_id, chosen_id, rejected_id, CAST(n AS INTEGER) AS prompt_turns,
    coalesce(array_to_string(list_transform(a[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
    {_side_sql('chosen')}, {_side_sql('rejected')} FROM s)
SELECT pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen_text AS chosen, chosen_mask_starts, chosen_mask_ends,
  rejected_text AS rejected, rejected_mask_starts, rejected_mask_ends FROM w
"""


@query("op8_preference_pairs", _SQL)
def op8(t):
    return preference_pairs(t.conversations, neighbours(t.conversations))
