"""Running context: earlier formulas or turns shown to the model with the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from formulary.functions.text import PHI, _col
from formulary.operators.prompts import message
from formulary.plans import fixed_texts as t
from formulary.session import store


BLOCK = 256  # positions per block of a running context


def numbered(formulas, after: Column | None = None) -> Column:
    """'𝜙1 = ...', '𝜙2 = ...' one per line, counting on from `after`."""
    start = F.lit(1) if after is None else after + 1
    lines = F.transform(
        _col(formulas), lambda f, k: F.concat(F.lit(PHI), (start + k).cast("string"), F.lit(" = "), f)
    )
    return F.array_join(lines, "\n")


def _heads(rows: DataFrame, many: DataFrame, group: str, order: str) -> DataFrame:
    """(group, _block, _n, _head): how many rows stand in earlier blocks of the group, and their lines.

    `many` lists the blocks of groups that have several: group, _block, _n and _k, its place in the group.
    """
    blocks = rows.join(many, [group, "_block"]).groupBy(group, "_block", "_n", "_k").agg(
        F.sort_array(F.collect_list(F.struct(order, "_value"))).alias("v")
    )
    lines = blocks.select(group, F.col("_k").alias("_j"), numbered(F.col("v._value"), F.col("_n")).alias("_lines"))
    each = F.explode(F.sequence(F.lit(1), F.col("_k") - 1)).alias("_j")
    later = many.filter("_k > 1").select(group, "_block", "_n", each)
    heads = later.join(lines, [group, "_j"]).groupBy(group, "_block", "_n").agg(
        F.sort_array(F.collect_list(F.struct("_j", "_lines"))).alias("_h")
    )
    return heads.select(group, "_block", "_n", F.array_join("_h._lines", "\n").alias("_head"))


def _running(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds `before`: the numbered earlier values of the row's group as lines, '' for the first row.

    Rows are cut into blocks of BLOCK positions, and one exchange brings the rows of a block together. The
    blocks of every group are counted first, from two narrow columns, when this is called: only groups of
    several blocks go on to give the lines of each block to the blocks behind it, in an equi-join. The result
    itself grows with the square of a group; the blocks spread that writing. Within a whole group only one number
    per block is ordered. Group and position identify a row and are never NULL.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn(
        "_value", F.coalesce(F.col(value), F.lit(""))
    )
    in_group = Window.partitionBy(group)
    in_order = in_group.orderBy("_block")
    earlier = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_rows"))
    placed = sizes.select(
        group,
        "_block",
        F.coalesce(earlier, F.lit(0)).alias("_n"),
        F.row_number().over(in_order).alias("_k"),
        F.count("*").over(in_group).alias("_all"),
    )
    many = store(placed.filter("_all > 1").drop("_all"), "long-groups")
    in_block = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_tail", F.collect_list("_value").over(in_block))
    if many.isEmpty():
        return own.withColumn("before", numbered("_tail")).drop("_block", "_value", "_tail")
    joined = own.join(_heads(rows, many, group, order), [group, "_block"], "left")
    between = F.when(F.col("_head").isNotNull() & (F.size("_tail") > 0), "\n").otherwise("")
    tail = numbered("_tail", F.coalesce("_n", F.lit(0)))
    before = F.concat(F.coalesce("_head", F.lit("")), between, tail)
    return joined.withColumn("before", before).drop("_block", "_value", "_tail", "_n", "_head")


def premise_context(premises: DataFrame) -> DataFrame:
    """(example_id, idx, context): the formulas of all earlier premises; empty for the first."""
    rows = premises.filter(F.col("kind") == "premise").select("example_id", "idx", "fol")
    return _running(rows, "example_id", "idx", "fol").select("example_id", "idx", F.col("before").alias("context"))


def conclusion_context(examples: DataFrame, formulas: str = "premises_fol") -> DataFrame:
    """Adds `context`: header line and all premises. Built inside the row, without a shuffle."""
    return examples.withColumn("context", F.concat(F.lit(t.CHAIN_HEADER), numbered(formulas)))


def chain_messages(text: Column, context: Column) -> Column:
    """System, assistant (what was translated so far), user."""
    return F.array(
        message("system", F.lit(t.CHAIN_SYSTEM)), message("assistant", context), message("user", text)
    )


def running_chat_context(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, messages): earlier turns of a conversation as context of the current one."""
    turns = _running(conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    context = F.when(F.col("before") == "", "").otherwise(F.concat(F.lit(t.CHAIN_HEADER), F.col("before")))
    return turns.select("conv_id", "turn", chain_messages(F.col("text"), context).alias("messages"))
