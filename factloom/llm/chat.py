"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store a conversation again after every exchange, so that many
logged conversations are only the beginning of a longer one. Each turn hashes
to 128 bits together with its place; the running exclusive-or over a
conversation is a rolling hash of each of its prefixes. A conversation whose
whole hash is the hash of a proper prefix of another one is dropped by an
anti-join; of conversations that are equal turn by turn, the one of the
smallest conv_id stays. What is left is rendered.

Both sides of the anti-join are reduced to distinct hashes before their
shuffle, so a first turn that a third of all conversations share is one row.

Defined results: turns are ordered by turn, then role and text, nulls first; a
turn logged twice in a conversation with all three alike counts once; null role
or text counts as empty; nothing says which rows of a null conv_id belong together,
so each is a conversation of one turn. No rows give no conversations. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, own, turns, n): the turns of each conversation in order, as structs (turn, role, text).

    Without a conv_id, own tells conversations apart, and n counts equal ones; else own is null and n is 1.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    each = turns.select(F.col(conv_col).alias("conv_id"), one.alias("t"))
    known = each.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    known = known.select("conv_id", F.lit(None).cast("string").alias("own"), "turns", F.lit(1).cast("long").alias("n"))
    loose = each.where("conv_id IS NULL").withColumn("own", F.sha2(F.to_json(F.struct("t.role", "t.text")), 256))
    loose = loose.groupBy("conv_id", "own").agg(F.array(F.min("t")).alias("turns"), F.count("*").alias("n"))
    return known.unionByName(loose)


def prefixes(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, own, copies, k, n, a, b): hashes of the first k of n turns."""
    each = convs.select("conv_id", "own", F.col("n").alias("copies"), F.size("turns").alias("n"), F.posexplode("turns").alias("at", "t"))

    def hashed(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), F.col("at"), F.col("t.role"), F.col("t.text"))

    each = each.select("conv_id", "own", "copies", "n", (F.col("at") + 1).alias("k"), hashed(1).alias("x"), hashed(2).alias("y"))
    run = W.partitionBy("conv_id", "own").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select("conv_id", "own", "copies", "k", "n", F.bit_xor("x").over(run).alias("a"), F.bit_xor("y").over(run).alias("b"))


def maximal(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, own, n_turns, n_copies): one for each conversation that no longer one begins with; n_copies counts equal ones."""
    rolled = materialize(prefixes(convs), "prefixes")
    whole = rolled.where("k = n").groupBy("k", "a", "b").agg(F.min("conv_id").alias("keep"), F.min("own").alias("own"), F.sum("copies").alias("n_copies"))
    inner = rolled.where("k < n").select("k", "a", "b").distinct()
    own = F.when(F.col("keep").isNull(), F.col("own")).alias("own")
    return whole.join(inner, ["k", "a", "b"], "left_anti").select(F.col("keep").alias("conv_id"), own, F.col("k").alias("n_turns"), "n_copies")


def rendered(turns: Column) -> Column:
    """One text: each turn as <|role|>, a line break, its text, <|end|> and a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE + "\n"), t["text"], F.lit(END + "\n"))), "")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, n_turns, n_copies, text), one for each maximal conversation."""
    convs = conversations(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal(convs).withColumnsRenamed({"conv_id": "kept_id", "own": "kept_own"})
    both = convs.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("own").eqNullSafe(F.col("kept_own")))
    return both.select(F.col("conv_id").alias(conv_col), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("text"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS turns,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM turns WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL
  SELECT NULL, [struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))], '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)
  FROM conversations WHERE conv_id IS NULL),
inner_parts AS (
  SELECT DISTINCT turns[1:k] AS part FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM convs)),
whole AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(text) AS text FROM convs GROUP BY turns)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies, text
FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_parts WHERE part = whole.turns)
"""
