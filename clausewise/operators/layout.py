"""Reading order of page blocks: columns by two means over block centres, then top to bottom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# When a page counts as having two columns.
BLOCKS, SIDE, ROUNDS, STILL = 8, 3, 12, 1e-2


def column_edge(centres: Column) -> Column:
    """The x that parts two columns, or null: two means from the extremes, ties to the left one."""
    start = F.struct(F.array_min(centres).alias("a"), F.array_max(centres).alias("b"), F.lit(False).alias("done"))
    mean = lambda xs, old: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)).otherwise(old)

    def step(s: Column, _: Column) -> Column:
        left = F.filter(centres, lambda x: F.abs(x - s["a"]) <= F.abs(x - s["b"]))
        right = F.filter(centres, lambda x: F.abs(x - s["a"]) > F.abs(x - s["b"]))
        moved = F.struct(mean(left, s["a"]).alias("a"), mean(right, s["b"]).alias("b"))
        still = lambda m: (F.abs(m["a"] - s["a"]) < STILL) & (F.abs(m["b"] - s["b"]) < STILL)
        settled = lambda m: F.when(still(m), s.withField("done", F.lit(True))).otherwise(m.withField("done", F.lit(False)))
        return F.when(s["done"], s).otherwise(let(moved, settled))

    def judge(s: Column) -> Column:
        edge = (s["a"] + s["b"]) / 2
        left = F.size(F.filter(centres, lambda x: x < edge))
        return F.when((left >= SIDE) & (F.size(centres) - left >= SIDE) & (edge != 0), edge)

    return F.when(F.size(centres) >= BLOCKS, let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), judge))


def reading_order(blocks: DataFrame, page: list[str], ties: list[str] | None = None) -> DataFrame:
    """blocks (page columns, x0, y0, x1, y1, text) with col (0 or 1) and pos (from 0) within the page. Blank blocks are left out;
    blocks with equal places and texts go by the columns of ties, such as their number on the page, so that every run has one order."""
    sound = blocks.filter(F.trim("text") != "").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    edges = sound.groupBy(*page).agg(column_edge(F.array_sort(F.collect_list("cx"))).alias("edge"))
    placed = sound.join(edges, page).withColumn("col", F.when(F.col("cx") < F.col("edge"), 0).when(F.col("edge").isNull(), 0).otherwise(1))
    order = Window.partitionBy(*page).orderBy("col", "y0", "x0", "text", *(ties or []))
    return placed.withColumn("pos", F.row_number().over(order) - 1).drop("cx", "edge")
