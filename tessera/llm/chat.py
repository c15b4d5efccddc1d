"""Chat formatting after collapsing cumulative snapshots.

A conversation log often holds the same conversation several times, each longer
than the one before. Every turn has a hash of its number, role and text; the
running xor of these hashes up to a turn identifies the prefix ending there. A
conversation whose whole hash equals a proper prefix of another one, or the whole
of one with a smaller conv_id, is dropped (anti-join), after its turns have been
compared with the other's. The rest is rendered. DataFrame functions only.

A conversation of many turns is hashed and rendered in parts of ``PART_TURNS``
turn numbers, so no task needs all of a very long one; the parts in order are the
whole.

Defined results: null roles and texts are empty; rows that repeat all of conv_id,
turn, role and text count once; several texts of one turn are rendered in order of
role and text; a row with a null conv_id or turn is a conversation of its own
(turn 0), equal ones collapse. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

PART_TURNS = 256
KEY = ["conv_id", "_solo"]
BEGIN, END = "<|", "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns: KEY, _turn, role, text. ``_solo`` is empty, or the identity of a row that stands alone."""
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), role, text).cast("binary"), 256)
    return conversations.select(
        F.when(F.col("turn").isNotNull(), F.col("conv_id")).alias("conv_id"), F.when(alone, mark).otherwise(F.lit("")).alias("_solo"),
        F.when(alone, F.lit(0)).otherwise(F.col("turn")).cast("long").alias("_turn"), role.alias("role"), text.alias("text")).distinct()


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes of the prefix ending at each turn, and of each whole conversation: (_n, _x, _y)."""
    steps = turns.groupBy(*KEY, "_turn").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_turn", "role", "text")).alias("_x"),
        F.bit_xor(F.xxhash64("text", "_turn", "role", F.lit(17))).alias("_y"))
    steps = written(steps.withColumn("_part", F.floor(F.col("_turn") / PART_TURNS)), "chat-steps")
    sums = [F.sum("_n").alias("_n"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y")]
    parts = steps.groupBy(*KEY, "_part").agg(*sums)
    whole = written(parts.groupBy(*KEY).agg(*sums), "chat-whole")
    before = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*KEY, "_part", *[
        F.coalesce(f(c).over(before), F.lit(0)).alias(f"{c}0") for c, f in (("_n", F.sum), ("_x", F.bit_xor), ("_y", F.bit_xor))])
    within = Window.partitionBy(*KEY, "_part").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select(*KEY, "_part", F.sum("_n").over(within).alias("_n"), F.bit_xor("_x").over(within).alias("_x"),
                         F.bit_xor("_y").over(within).alias("_y"))
    same = [local[c].eqNullSafe(base[c]) for c in (*KEY, "_part")]
    return local.join(base, same[0] & same[1] & same[2]).select(
        local["conv_id"], local["_solo"], (F.col("_n") + F.col("_n0")).alias("_n"), F.col("_x").bitwiseXOR(F.col("_x0")).alias("_x"),
        F.col("_y").bitwiseXOR(F.col("_y0")).alias("_y")), whole


def dropped(turns: DataFrame) -> DataFrame:
    """Conversations that are a prefix of another one, or equal to one with a smaller key; compared turn by turn."""
    at, whole = prefixes(turns)
    keyed = F.struct("conv_id", "_solo")
    # At its last turn a conversation is not a proper prefix of itself: only smaller counts than its own are.
    longest = whole.select(F.col("conv_id").alias("_c"), F.col("_solo").alias("_s"), F.col("_n").alias("_all"))
    proper = at.join(longest, at["conv_id"].eqNullSafe(longest["_c"]) & (at["_solo"] == longest["_s"])).where("_n < _all")
    holder = proper.groupBy("_n", "_x", "_y").agg(F.min(keyed).alias("_longer"))
    equal = whole.groupBy("_n", "_x", "_y").agg(F.min(keyed).alias("_first"))
    found = (whole.join(equal, ["_n", "_x", "_y"]).join(holder, ["_n", "_x", "_y"], "left")
             .withColumn("_in", F.coalesce("_longer", "_first")).where(F.col("_in") != keyed)
             .select(*KEY, F.col("_in.conv_id").alias("_in_c"), F.col("_in._solo").alias("_in_s")))
    found = written(found, "chat-found")
    own = turns.join(found, turns["conv_id"].eqNullSafe(found["conv_id"]) & (turns["_solo"] == found["_solo"])).select(
        turns["*"], "_in_c", "_in_s")
    other = turns.select(F.col("conv_id").alias("_c"), F.col("_solo").alias("_s"), F.col("_turn").alias("_t"),
                         F.col("role").alias("_r"), F.col("text").alias("_x"))
    missing = own.join(other, F.col("_in_c").eqNullSafe(F.col("_c")) & (F.col("_in_s") == F.col("_s")) & (F.col("_turn") == F.col("_t"))
                       & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_x")), "left_anti").select(*KEY).distinct()
    return found.join(missing, found["conv_id"].eqNullSafe(missing["conv_id"]) & (found["_solo"] == missing["_solo"]), "left_anti").select(*KEY)


def chat_format(conversations: DataFrame) -> DataFrame:
    """Per retained conversation and part: conv_id, part, n_turns (of the part), text (rendered turns in order)."""
    turns = written(turns_of(conversations), "chat-turns")
    out = dropped(turns)
    kept = turns.join(out, turns["conv_id"].eqNullSafe(out["conv_id"]) & (turns["_solo"] == out["_solo"]), "left_anti")
    piece = F.concat(F.lit(BEGIN), "role", F.lit("|>\n"), "text", F.lit(END))
    parts = kept.groupBy(*KEY, F.floor(F.col("_turn") / PART_TURNS).alias("part")).agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("_turn", "role", "text", piece.alias("_piece")))).alias("_pieces"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("_pieces._piece"), "").alias("text"))
