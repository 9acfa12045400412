"""Overlap join of boxes by a grid of several levels.

A box stands at the level whose cells are at least as wide as its longer side, so it lies in four cells there at most. Two
boxes meet at the level of the larger one, in the cell that holds the upper left corner of what they share; so a pair is
found once, and only boxes that lie in one cell are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area as a share of the smaller box; 0 without any. Boxes are structs x0, y0, x1, y1."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    smaller = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (smaller > 0), w * h / smaller).otherwise(0.0)


def _levelled(boxes: DataFrame, by: list[str], box: str) -> DataFrame:
    """(by, row, box, level) of the boxes that have an area; the others overlap nothing."""
    b = F.col(box)
    out = boxes.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.struct(*[F.col(f"`{c}`") for c in boxes.columns]).alias("row"), F.struct(*[b[s].cast("double").alias(s) for s in SIDES]).alias("box"))
    side = F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0"))
    return out.where(area(F.col("box")) > 0).withColumn("level", F.ceil(F.log2(side)).cast("int"))


def _in_cells(boxes: DataFrame, levels: Column) -> DataFrame:
    """A row for each of ``levels`` and each cell there that the box touches."""
    out = boxes.select("*", F.explode(levels).alias("at"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("at"))).cast("long")
    for axis in ("x", "y"):
        out = out.withColumn(f"c{axis}", F.explode(F.sequence(cell(f"box.{axis}0"), cell(f"box.{axis}1"))))
    return out.drop("level")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], least: float, box: str = "box") -> DataFrame:
    """(l, r, overlap): structs of rows of both sides under the same ``by`` whose boxes share ``least`` of the smaller one's area or more.

    Both have a column ``box``, a struct x0, y0, x1, y1. Boxes with a null side or without an area overlap nothing; rows
    with a null in ``by`` have no partner. Levels are as many as orders of size occur.
    """
    a, b = _levelled(left, by, box), _levelled(right, by, box)
    levels = F.array(*[F.lit(r[0]) for r in a.select("level").union(b.select("level")).distinct().orderBy("level").collect()])  # exponents of doubles: a few, 2100 at most
    levels = levels.cast("array<int>")
    on = [*[f"_by{i}" for i in range(len(by))], "at", "cx", "cy"]

    def met(small: DataFrame, large: DataFrame, strictly: bool, names: tuple[str, str]) -> DataFrame:
        above = F.filter(levels, lambda x: (x > F.col("level")) if strictly else (x >= F.col("level")))
        s = _in_cells(small, above).withColumnsRenamed({"row": names[0], "box": f"_{names[0]}"})
        m = _in_cells(large, F.array("level")).withColumnsRenamed({"row": names[1], "box": f"_{names[1]}"})
        corner = lambda axis: F.floor(F.greatest(F.col(f"_l.{axis}0"), F.col(f"_r.{axis}0")) / F.pow(F.lit(2.0), F.col("at"))).cast("long") == F.col(f"c{axis}")
        return s.join(m, on).where(corner("x") & corner("y")).select("l", "r", overlap_ratio(F.col("_l"), F.col("_r")).alias("overlap"))

    return met(a, b, False, ("l", "r")).unionByName(met(b, a, True, ("r", "l"))).where(F.col("overlap") >= least)
