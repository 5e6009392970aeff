"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again and again as it grows. Each turn gets the hash of the whole prefix up to it: a running
pair of sums over hashes of (position, role, text). A conversation whose full hash is some longer one's prefix hash is
a snapshot of it and goes (an anti-join); of equal conversations the one with the least id stays. Those left are rendered.

Turns are ordered by turn (nulls first), then role, then text. A null role is "unknown", a null text is empty;
rows with a null conv_id form one conversation; columns other than conv_id, turn, role and text are ignored; an empty table
gives no rows; texts of any length are taken whole. Repeated rows are turns of their own. "<|" inside texts becomes "< |",
so a text can't close its turn. A conversation is one output row, so its turns must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _clean(conversations: DataFrame) -> DataFrame:
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.withColumn("h", F.xxhash64("role", "text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def prefixes(clean: DataFrame) -> DataFrame:
    """conv_id, pos, s1, s2: the rolling hash after each turn, in two sums that can't overflow."""
    turns = clean.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*_order())))
    mixed = turns.withColumn("m", F.xxhash64("pos", "h"))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.col("m").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("m", 32)
    return mixed.select("conv_id", "pos", F.sum(low).over(so_far).alias("s1"), F.sum(high).over(so_far).alias("s2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each distinct conversation that no longer one begins with."""
    pre = prefixes(_clean(conversations))
    full = pre.groupBy("conv_id").agg(F.max(F.struct("pos", "s1", "s2")).alias("f")).select("conv_id", "f.*")
    ones = full.groupBy("pos", "s1", "s2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # A prefix that ends before its conversation does: the last turn's hash is no proper prefix.
    last = Window.partitionBy("conv_id").orderBy("pos")
    proper = pre.withColumn("more", F.lead("pos").over(last)).where("more is not null").select("pos", "s1", "s2").distinct()
    return ones.join(proper, ["pos", "s1", "s2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat, the rendered text, of each maximal conversation."""
    kept = maximal(conversations).withColumnRenamed("conv_id", "kept_id")
    clean = _clean(conversations)
    rows = clean.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    grouped = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(turn)).alias("turns"))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    chat = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n"))), "")
    return grouped.select("conv_id", "n_turns", "n_copies", chat.alias("chat"))


#: DuckDB SQL for the rows of chat_format.
SQL = """
with t as (
    select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as pos
    from conversations),
p as (
    select conv_id, pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|')
        over (partition by conv_id order by pos rows between unbounded preceding and current row) as pre,
        count(*) over (partition by conv_id) as n
    from t),
o as (select min(conv_id) as conv_id, pre, n, count(*) as n_copies from p where pos = n group by pre, n),
k as (select * from o where not exists (select 1 from p where p.pos < p.n and p.pos = o.n and p.pre = o.pre))
select k.conv_id, k.n as n_turns, k.n_copies,
    string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by t.pos) as chat
from k join t on k.conv_id is not distinct from t.conv_id
group by k.conv_id, k.n, k.n_copies
"""
