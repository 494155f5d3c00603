"""Operator 6: one rendering of a dialogue for the perspective of each participant.

Every role of a dialogue but `system` is a participant. In a participant's
rendering its own messages are the assistant's, those of all others are a
user's with the role as name, and system messages stay so. The mask lists the
character ranges, from 0 and without the end, that are to be learned: the
participant's messages with their end marks.

Cases: messages go by (turn, role, text), nulls first; a null text is empty; a
null role is the participant `unknown`; a null conv_id is a dialogue of its own;
repeated rows are repeated messages; a dialogue with system messages only gives
no row, as does an empty table; other columns are ignored. Offsets come from a
running window, so long dialogues cost in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, participant, n_messages, n_own, text, mask); mask as `start:end,start:end`."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    roles = F.collect_set("role").over(Window.partitionBy("conv_id"))
    c = c.withColumn("roles", roles).withColumn("participant", F.explode(F.filter("roles", lambda r: r != "system"))).drop("roles")
    own = F.col("role") == F.col("participant")
    head = F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise(F.concat(F.lit("user name="), "role"))
    c = c.withColumns({"open": F.concat(F.lit("<|im_start|>"), head, F.lit("\n")), "own": own, "rest": F.concat("body", F.lit("<|im_end|>"))})
    w = Window.partitionBy("conv_id", "participant").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    c = c.withColumns({"at": F.row_number().over(w), "upto": F.sum(F.length("open") + F.length("rest") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    end = F.col("upto") - 1
    span = F.when(F.col("own"), F.concat(end - F.length("rest"), F.lit(":"), end))
    c = c.select("conv_id", "participant", "own", F.struct("at", F.concat("open", "rest", F.lit("\n")).alias("piece"), span.alias("span")).alias("m"))
    g = c.groupBy("conv_id", "participant").agg(F.count("*").alias("n_messages"), F.count_if("own").alias("n_own"), F.sort_array(F.collect_list("m")).alias("m"))
    return g.select("conv_id", "participant", "n_messages", "n_own", F.array_join("m.piece", "").alias("text"), F.array_join("m.span", ",").alias("mask"))


PERSPECTIVES_SQL = """
with c as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as body from conversations),
p as (select distinct conv_id, role as participant from c where role <> 'system'),
x as (select c.*, p.participant, role = participant as own,
  '<|im_start|>' || case when role = 'system' then 'system' when role = participant then 'assistant' else 'user name=' || role end || chr(10) as opening,
  body || '<|im_end|>' as rest from c join p on c.conv_id is not distinct from p.conv_id),
y as (select *, row_number() over w as pos, sum(length(opening) + length(rest) + 1) over w as upto from x
  window w as (partition by conv_id, participant order by turn nulls first, role, body rows between unbounded preceding and current row))
select conv_id, participant, count(*) as n_messages, count(*) filter (where own) as n_own,
  string_agg(opening || rest || chr(10), '' order by pos) as text,
  coalesce(string_agg((upto - 1 - length(rest))::BIGINT::VARCHAR || ':' || (upto - 1)::BIGINT::VARCHAR, ',' order by pos) filter (where own), '') as mask
from y group by conv_id, participant"""
