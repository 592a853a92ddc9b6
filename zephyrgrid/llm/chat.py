"""Chat formatting: logged snapshots collapse into their longest conversation, which is rendered.

A chat that is logged again after each turn leaves rows under many conversation ids, each a prefix of
the next. Every turn gets the hash of its whole prefix; a conversation whose last prefix hash is an
inner prefix hash of another one is dropped by an anti-join, and equal conversations keep their smallest id.
Only hashes are shuffled for that; texts move once, for the conversations that stay.

Defined cases: rows without a conversation id belong to no conversation and are left out; a null turn
comes first; equal turns are ordered by a hash of role and text, so repeated rows stay as repeated
turns; a null or empty role is ``unknown``, a null text is empty. Further columns are ignored. An empty
table gives no rows. Prefixes are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.session import stable

START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("_tie"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, n, h1, h2): the rolling hash of the first ``k`` of a conversation's ``n`` turns."""
    narrow = _turns(conversations).select(
        "conv_id", "turn", "_tie", F.xxhash64(F.lit("second"), "role", "text").alias("_other"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "_tie", "_other")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = narrow.withColumns({"k": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    # the position is part of each turn's hash, so the order of turns counts
    return placed.select(
        "conv_id", "k", "n",
        F.bit_xor(F.xxhash64("k", "_tie", "_other")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64("_other", "_tie", "k", F.lit(7))).over(upto).alias("h2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that prefix no longer one."""
    hashed = stable(prefixes(conversations))
    full = (hashed.filter("k = n").groupBy("n", "h1", "h2")
            .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    inner = hashed.filter("k < n").select(F.col("k").cast("bigint").alias("n"), "h1", "h2").distinct()
    return full.join(inner, ["n", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_copies")


def _plain(c: Column) -> Column:
    """Text in which no template marker can be read."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): maximal conversations in the chat template."""
    turn = F.concat(F.lit(START), _plain(F.col("role")), F.lit("\n"), _plain(F.col("text")), F.lit(END + "\n"))
    kept = maximal(conversations)
    lines = _turns(conversations).join(kept, "conv_id").select(
        "conv_id", "n_turns", "n_copies", F.struct(
            F.col("turn"), F.col("_tie"), F.xxhash64(F.lit("second"), "role", "text").alias("_other"),
            turn.alias("line")).alias("_turn"))
    return lines.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_turn")), lambda t: t["line"]), "").alias("rendered"))


ORACLE = """
WITH r AS (
  SELECT conv_id, list({'r': coalesce(nullif(role, ''), 'unknown'), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
u AS (SELECT l, len(l) AS n, l[1] AS head, min(conv_id) AS conv_id, count(*) AS n_copies FROM r GROUP BY l),
kept AS (
  SELECT * FROM u AS a
  WHERE NOT EXISTS (SELECT 1 FROM u AS b WHERE b.head = a.head AND b.n > a.n AND b.l[1:a.n] = a.l))
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies, array_to_string(list_transform(l, lambda x:
    '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS rendered
FROM kept
"""
