"""Chat formatting (operator 2): cumulative snapshots collapse before rendering.

A logged conversation that is a prefix of a longer one is a snapshot of it. Every turn gets a
rolling hash of the turns up to it; a conversation whose last hash is an inner prefix hash of
another one goes (anti-join), and of equal conversations the smallest id stays. The rest is
rendered with chat markers. A conversation's turns are one row and are never cut; a task needs
memory in proportion to its longest conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _logs(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns, hashes): turns in order, and the hash of each prefix."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t")).where("conv_id is not null")
    logs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    part = lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
    rolled = F.aggregate("turns", F.array().cast("array<string>"), lambda acc, t: F.concat(acc, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), part(t))))))
    return logs.withColumn("hashes", rolled)


def render(turns):
    """One text with a marked block for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations: (conv_id, n_turns, n_equal, n_chars, rendered).

    n_equal counts the logged conversations with the same turns. Turns are ordered by (turn, role,
    text), null turns first; repeated rows of a turn count once; null roles and texts are
    empty; rows with a null id are left out; empty tables give no rows. One conversation is
    one result row, so its turns meet in one task; equal ones and shared prefixes are reduced
    to one row per hash before they are joined. Other columns are ignored."""
    logs = _logs(turns, conv_col, turn_col, role_col, text_col)
    whole = logs.select("conv_id", F.element_at("hashes", -1).alias("hash"))
    chosen = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = logs.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("hash")).distinct()
    maximal = chosen.join(inner, "hash", "left_anti").select("conv_id", "n_equal")
    kept = logs.select("conv_id", "turns").join(maximal, "conv_id")
    out = kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"), render(F.col("turns")).alias("rendered"))
    return out.select("conv_id", "n_turns", "n_equal", F.length("rendered").cast("long").alias("n_chars"), "rendered")


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, ROW_NUMBER() OVER w AS k, COUNT(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT prefix, MIN(conv_id) AS conv_id, COUNT(*) AS n_equal FROM p WHERE k = n GROUP BY prefix),
top AS (SELECT conv_id, n_equal FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n)),
r AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_equal AS BIGINT) AS n_equal, CAST(length(rendered) AS BIGINT) AS n_chars, rendered FROM r JOIN top USING (conv_id)
"""
