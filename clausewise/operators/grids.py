"""Tables of pages from placed words: rows from gaps between lines, columns from gaps that most lines share.

Works on words with their boxes, as a page reader gives them. All steps are windows over one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest gap between words of one cell, least width of the gap between columns, share of the lines that may cross it
#: (headings and cells that span columns), least number of rows with two cells.
JOIN, GAP, CROSSING, ROWS = 7.0, 10.0, 0.25, 2


def _new(start: Column, reach: Column, order: Window, gap: float) -> Column:
    """The running number of the groups of intervals that lie more than gap apart, in order of their starts."""
    before = F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(before.isNull() | (start - before > gap), 1).otherwise(0)


def segments(words: DataFrame, page: list[str], join: float = JOIN) -> DataFrame:
    """page columns, band (line, from 1), x0, x1, text: words of a line that stand close together, as one."""
    sound = words.filter((F.trim("text") != "") & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))).select(*page, "x0", "y0", "x1", "y1", F.trim("text").alias("text"))
    down = Window.partitionBy(*page).orderBy("y0", "y1", "x0", "x1", "text")
    lined = sound.withColumn("new", F.when(F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1)) > F.col("y0"), 0).otherwise(1))
    lined = lined.withColumn("band", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    across = Window.partitionBy(*page, "band").orderBy("x0", "x1", "y0", "text")
    cut = lined.withColumn("new", _new(F.col("x0"), F.col("x1"), across, join)).withColumn("seg", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "y0", "text")))
    return cut.groupBy(*page, "band", "seg").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(parts, lambda w: w["text"]), " ").alias("text")).drop("seg")


def column_cuts(segs: DataFrame, page: list[str], gap: float = GAP, crossing: float = CROSSING) -> DataFrame:
    """page columns and cuts, the sorted x between columns; pages without any have no row."""
    lines = segs.groupBy(*page).agg(F.max("band").alias("lines"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    edge = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))))
    edges = segs.select(*page, edge.alias("e")).groupBy(*page, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    sweep = Window.partitionBy(*page).orderBy("x")
    covered = edges.withColumns({"cover": F.sum("d").over(sweep), "end": F.lead("x").over(sweep)}).filter("end IS NOT NULL").join(lines, page)
    covered = covered.withColumn("busy", F.when(F.col("cover") > crossing * F.col("lines"), 1).otherwise(0)).withColumn("run", F.sum("busy").over(sweep))
    gaps = covered.filter("busy = 0").groupBy(*page, "run").agg(F.min("x").alias("a"), F.max("end").alias("b"), F.first("left").alias("left"), F.first("right").alias("right"))
    inner = gaps.filter((F.col("b") - F.col("a") >= gap) & (F.col("a") > F.col("left")) & (F.col("b") < F.col("right")))
    return inner.groupBy(*page).agg(F.array_sort(F.collect_list((F.col("a") + F.col("b")) / 2)).alias("cuts"))


def _column(cuts: Column, x0: Column, x1: Column) -> Column:
    """The column (from 0) that covers most of [x0, x1]; the left one of two that cover as much."""
    edges = F.concat(F.array(F.lit(float("-inf"))), cuts, F.array(F.lit(float("inf"))))
    shared = F.transform(F.sequence(F.lit(1), F.size(cuts) + 1), lambda k: F.struct((F.least(x1, F.element_at(edges, k + 1)) - F.greatest(x0, F.element_at(edges, k))).alias("w"), (-k).alias("k")))
    return -F.array_max(shared)["k"] - 1


def tables(words: DataFrame, page: list[str], join: float = JOIN, gap: float = GAP, crossing: float = CROSSING, rows: int = ROWS) -> DataFrame:
    """page columns, n_rows, n_cols, text of the pages that hold a grid: cells parted by tabs, rows by line feeds.

    words: page columns, x0, y0, x1, y1, text; blank words and boxes without a size are left out, other columns ignored.
    A line that crosses the gaps stands in the column it covers most. A page of fewer columns than two, or of fewer than
    rows lines with two cells, has no grid and no row.
    """
    segs = segments(words, page, join)
    placed = segs.join(column_cuts(segs, page, gap, crossing), page).withColumn("col", _column(F.col("cuts"), F.col("x0"), F.col("x1")))
    inside = F.array_sort(F.collect_list(F.struct("x0", "x1", "text")))
    cells = placed.groupBy(*page, "band", "col").agg(F.array_join(F.transform(inside, lambda s: s["text"]), " ").alias("text"), F.first(F.size("cuts") + 1).alias("n_cols"))
    lines = cells.groupBy(*page, "band").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"), F.first("n_cols").alias("n_cols"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda k: F.coalesce(F.element_at("cells", k), F.lit(""))), "\t")
    joined = lines.select(*page, "band", "n_cols", F.size("cells").alias("n"), text.alias("text")).groupBy(*page)
    found = joined.agg(F.count("*").alias("n_rows"), F.first("n_cols").cast("bigint").alias("n_cols"), F.count_if(F.col("n") > 1).alias("full"), F.array_sort(F.collect_list(F.struct("band", "text"))).alias("lines"))
    return found.filter(F.col("full") >= rows).select(*page, "n_rows", "n_cols", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
