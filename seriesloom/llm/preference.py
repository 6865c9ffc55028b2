"""Chat formatting of preference pairs, with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is found, rendered once as the
prompt, and each remainder is rendered as a completion with a loss mask: assistant turns train, others do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn markup. Fixed values.
OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def pair_by_parity(conversations: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """Turns with pair_id and side: of two neighbouring ids the even one is chosen, the odd one rejected."""
    return conversations.withColumns({"pair_id": F.floor(F.col(conv) / 2).cast("long"), "side": F.pmod(F.col(conv), F.lit(2)).cast("int")})


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MID), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column, trained: str) -> Column:
    """start:end of trained text in the rendered completion, in code points and with the closing mark, comma-joined."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["role"]) + F.length(t["text"]) + len(OPEN + MID + CLOSE)).cast("long").alias("at"),
            F.when(
                t["role"] == trained,
                F.concat(a["spans"], F.array(F.concat_ws(":", (a["at"] + len(OPEN + MID) + F.length(t["role"])).cast("string"), (a["at"] + len(OPEN + MID + CLOSE) + F.length(t["role"]) + F.length(t["text"])).cast("string")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def preference_pairs(turns: DataFrame, *, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", escape: bool = False) -> DataFrame:
    """One row per pair that has both sides: prompt, chosen and rejected completions and their masks.

    side: 0 chosen, 1 rejected. Turns are ordered by turn number, then role, then text, so repeated numbers have one
    order; exactly repeated rows all stay. Null roles and texts count as empty. Identical conversations give two empty
    completions; if one side is a prefix of the other its completion is empty. Rows with a null pair, side or turn are
    left out, pairs with one side only too, and an empty table gives no rows. One conversation is one output value, so
    a task holds single conversations, never a group of them: a text shared by many pairs is no common key.

    Turn marks that stand in a role or text are left as they are, so that what is rendered is what was said; where texts
    are not trusted, escape puts a space into them, as a text could otherwise pass for turns of its own.
    """
    said_as = lambda c: F.regexp_replace(c, r"<\|im_(start|end)\|>", "<| im_$1 |>") if escape else c
    t = turns.select(
        F.col(pair).cast("long").alias("pair_id"), F.col(side).cast("int").alias("side"),
        F.struct(F.col(turn).cast("long").alias("turn"), said_as(F.coalesce(F.col(role), F.lit(""))).alias("role"), said_as(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"),
    ).where(F.col("pair_id").isNotNull() & F.col("side").isin(0, 1) & F.col("t.turn").isNotNull())
    said = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t"))))
    both = t.groupBy("pair_id").agg(said(0).alias("c"), said(1).alias("r")).where((F.size("c") > 0) & (F.size("r") > 0))
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"])
    shorter = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)), lambda i: ~same(i))
    both = both.withColumn("n", F.coalesce(F.get(differ, 0), shorter))
    rest = lambda a: F.slice(F.col(a), F.col("n") + 1, F.greatest(F.size(a) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _mask(F.col("c"), trained).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("r"), trained).alias("rejected_mask"),
    )


SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT pair_id FROM t GROUP BY 1 HAVING count(DISTINCT side) = 2),
d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS at
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
n AS (SELECT p.pair_id, coalesce(d.at, (SELECT count(*) + 1 FROM t WHERE t.pair_id = p.pair_id AND t.side = 0)) - 1 AS n FROM p LEFT JOIN d USING (pair_id)),
u AS (SELECT t.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)),
v AS (SELECT *, sum(CASE WHEN i > n THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i) AS upto FROM u)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen,
  coalesce(string_agg((upto - length(text) - 11)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg((upto - length(text) - 11)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM v GROUP BY pair_id
"""
