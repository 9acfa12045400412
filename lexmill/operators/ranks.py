"""Values at given ranks of long groups, by narrowing ranges instead of gathering a group's values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ordered import checkpointed

#: Parts of a range in each round; distinct values that a group's last range is put in order at.
PARTS, FEW = 1_024, 4_096


def values_at(rows: DataFrame, by: str, value: str, ranks: Mapping[str, Column], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """``by`` and, for each name in ``ranks``, the group's value at that rank (1 for the least), as a double.

    A rank is a column of ``n``, the group's values that aren't null. Equal values are counted first. Then each rank's range
    is cut in equal parts, whose counts tell the part that holds the rank, until few distinct values are left in it. So what
    is gathered of a group is bounded, and a round is one count. A group without values, or a rank outside 1 to n, gives
    nulls; a null group is a group.
    """
    v = F.col(f"`{value}`").cast("double")
    counted = checkpointed(rows.select(F.col(f"`{by}`").alias("by"), v.alias("v")).groupBy("by", "v").agg(F.count("*").alias("k")).where("v IS NOT NULL"))
    groups = rows.select(F.col(f"`{by}`").alias("by")).distinct()
    whole = counted.groupBy("by").agg(F.sum("k").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    picks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    wanted = whole.select("*", picks.alias("p")).select("by", F.col("p.name").alias("name"), F.col("p.rank").alias("rank"), "distinct", "lo", "hi", "n").where("rank BETWEEN 1 AND n").drop("n")
    wanted = checkpointed(wanted)
    while not wanted.where(F.col("distinct") > few).isEmpty():
        broad = wanted.where(F.col("distinct") > few)
        inside = _inside(counted, broad)
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts).cast("int"))
        part = F.when(F.col("hi") - F.col("lo") < float("inf"), part).otherwise((F.col("v") > 0).cast("int"))
        cut = inside.groupBy("by", "name", "rank", part.alias("part")).agg(F.sum("k").alias("k"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy("by", "name").orderBy("part"))
        cut = cut.withColumn("upto", upto).where("rank <= upto AND rank > upto - k")
        narrowed = cut.select("by", "name", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "distinct", "lo", "hi")
        wanted = checkpointed(wanted.where(F.col("distinct") <= few).unionByName(narrowed))
    upto = F.sum("k").over(Window.partitionBy("by", "name").orderBy("v"))
    found = _inside(counted, wanted).withColumn("upto", upto).where("rank <= upto AND rank > upto - k")
    found = found.groupBy("by").pivot("name", list(ranks)).agg(F.first("v"))
    found = found.withColumnRenamed("by", "_by")
    return groups.join(found, F.col("by").eqNullSafe(F.col("_by")), "left").select(F.col("by").alias(by), *ranks)


def _inside(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.withColumnRenamed("by", "_by")
    return counted.join(w, F.col("by").eqNullSafe(F.col("_by")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("_by")
