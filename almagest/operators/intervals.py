"""Joins of intervals with intervals, and of boxes with boxes, by shared cells instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_overlap_join(left: DataFrame, right: DataFrame, *, start: str = "s", end: str = "e", levels: tuple[int, ...] = (86_400_000, 32 * 86_400_000, 1024 * 86_400_000, 32768 * 86_400_000)) -> DataFrame:
    """Pairs of rows whose half-open intervals [start, end) overlap; the columns of left and right are prefixed l_ and r_.

    An interval is kept under cells of the smallest width in ``levels`` that is no less than its own, so it has at most
    two of them; it meets the intervals of every level under the cells it touches there only if they are wider, so no
    interval is ever copied more often than levels times two. Null or empty intervals overlap nothing.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]).filter(F.col(f"{p}{start}") < F.col(f"{p}{end}"))
        w = F.col(f"{p}{end}") - F.col(f"{p}{start}")
        level = F.lit(len(levels))
        for i in range(len(levels) - 1, -1, -1):
            level = F.when(w <= levels[i], i).otherwise(level)
        return d.withColumn(f"_{p}level", level.cast("int"))

    def keyed(i: int):  # noqa: ANN202
        return lambda c: F.struct(F.lit(i).alias("lv"), c.cast("bigint").alias("c"))

    def spread(d: DataFrame, p: str, at_least: bool) -> DataFrame:
        """Own level's cells, or those of all levels from the own one (for meeting wider intervals)."""
        per = []
        for i in range(len(levels) + 1):
            if i == len(levels):
                span = F.array(F.lit(0).cast("bigint"))
            else:
                span = F.sequence(F.floor(F.col(f"{p}{start}") / levels[i]), F.floor((F.col(f"{p}{end}") - 1) / levels[i]))
            mine = F.col(f"_{p}level") <= i if at_least else F.col(f"_{p}level") == i
            per.append(F.when(mine, F.transform(span, keyed(i))).otherwise(F.array().cast("array<struct<lv:int,c:bigint>>")))
        return d.withColumn("_c", F.explode(F.flatten(F.array(*per)))).select("*", F.col("_c.lv").alias("_lv"), F.col("_c.c").alias("_cell")).drop("_c")

    a, b = cells(left, "l_"), cells(right, "r_")
    ls, le, rs, re = (F.col(f"{p}{x}") for p in ("l_", "r_") for x in (start, end))
    overlap = (ls < re) & (rs < le)
    width = F.lit(1)
    for i in range(len(levels) - 1, -1, -1):
        width = F.when(F.col("_lv") == i, levels[i]).otherwise(width)
    # a pair may share two cells: it counts in the one where the later start lies
    once = (F.col("_lv") == len(levels)) | (F.floor(F.greatest(ls, rs) / width) == F.col("_cell"))
    wider_right = spread(a, "l_", True).join(spread(b, "r_", False), ["_lv", "_cell"]).filter(overlap & once)
    wider_left = spread(a, "l_", False).join(spread(b, "r_", True), ["_lv", "_cell"]).filter(overlap & once & (F.col("_r_level") < F.col("_l_level")))
    cols = [f"l_{c}" for c in left.columns] + [f"r_{c}" for c in right.columns]
    return wider_right.select(*cols).unionByName(wider_left.select(*cols))


def overlap_counts(left: DataFrame, right: DataFrame, *, start: str = "s", end: str = "e") -> DataFrame:
    """Rows of right with n, the number of left's intervals [start, end) that overlap theirs, if any: those started before its end less those ended by its start.

    The running counts go over the different times only. Null or empty intervals overlap nothing.
    """
    left, right = (d.filter(F.col(start) < F.col(end)) for d in (left, right))
    no = F.lit(0).cast("bigint")
    marks = left.groupBy(F.col(start).alias("_t")).agg(F.count("*").alias("_in"), no.alias("_out"))
    marks = marks.unionByName(left.groupBy(F.col(end).alias("_t")).agg(no.alias("_in"), F.count("*").alias("_out")))
    for c in (start, end):
        marks = marks.unionByName(right.select(F.col(c).alias("_t")).distinct().select("_t", no.alias("_in"), no.alias("_out")))
    w = W.orderBy("_t")
    at = marks.groupBy("_t").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    at = at.select("_t", (F.sum("_in").over(w) - F.col("_in")).alias("_started"), F.sum("_out").over(w).alias("_ended"))
    n = right.join(at.select(F.col("_t").alias(end), "_started"), end).join(at.select(F.col("_t").alias(start), "_ended"), start)
    return n.withColumn("n", F.col("_started") - F.col("_ended")).filter("n > 0").drop("_started", "_ended")


def grid_overlap_join(left: DataFrame, right: DataFrame, *, cell: float) -> DataFrame:
    """Pairs of rows whose boxes (minx, miny, maxx, maxy) meet, edges included; columns are prefixed l_ and r_.

    Boxes are kept under the grid cells they touch; a pair counts in the cell that holds the lower left corner of their
    common part. Choose ``cell`` near the size of the larger boxes. Boxes with a null meet nothing.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]).filter(" and ".join(f"{p}{c} is not null" for c in ("minx", "miny", "maxx", "maxy")))
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{p}{lo}") / cell), F.floor(F.col(f"{p}{hi}") / cell))
        return d.withColumn("_x", F.explode(span("minx", "maxx"))).withColumn("_y", F.explode(span("miny", "maxy")))

    j = cells(left, "l_").join(cells(right, "r_"), ["_x", "_y"])
    meet = (F.col("l_minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy"))
    once = (F.floor(F.greatest("l_minx", "r_minx") / cell) == F.col("_x")) & (F.floor(F.greatest("l_miny", "r_miny") / cell) == F.col("_y"))
    return j.filter(meet & once).drop("_x", "_y")
