"""Greedy packing of ordered arrays, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import let


def greedy_pack(items: Column, size: Callable[[Column], Column], capacity: int, most: int | None = None, item_type: str = "string") -> Column:
    """Consecutive items in bins: a bin is closed when the next item would exceed the capacity or the count.

    An item larger than the capacity gets a bin of its own. Returns array<array<item>>.
    """
    kind = f"struct<bins: array<array<{item_type}>>, open: array<{item_type}>, size: bigint>"
    zero = F.from_json(F.lit('{"bins": [], "open": [], "size": 0}'), kind)

    def step(a: Column, x: Column) -> Column:
        n = size(x).cast("bigint")
        full = (F.size(a["open"]) > 0) & ((a["size"] + n > capacity) | (F.size(a["open"]) >= (most or 1 << 30)))
        return F.struct(
            F.when(full, F.concat(a["bins"], F.array(a["open"]))).otherwise(a["bins"]).alias("bins"),
            F.when(full, F.array(x)).otherwise(F.concat(a["open"], F.array(x))).alias("open"),
            F.when(full, n).otherwise(a["size"] + n).alias("size"),
        )

    return F.aggregate(items, zero, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["bins"], F.array(a["open"]))).otherwise(a["bins"]))


def pack_windows(units: Column, target: int, overlap: int = 1) -> Column:
    """Strings in windows of about ``target`` characters, joined by newlines; each repeats the last window's last units.

    Only the units' characters count. The tail isn't repeated if it is longer than half the target.
    """
    kind = "struct<windows: array<string>, open: array<string>, size: int>"
    zero = F.from_json(F.lit('{"windows": [], "open": [], "size": 0}'), kind)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def turned(a: Column, x: Column) -> Column:
        """The open window is done; the next begins with its tail and ``x``."""
        tail = F.slice(a["open"], F.greatest(F.lit(1), F.size(a["open"]) - overlap + 1), overlap) if overlap else F.slice(a["open"], 1, 0)
        begun = F.concat(F.when(total(tail) <= target // 2, tail).otherwise(F.slice(a["open"], 1, 0)), F.array(x))
        done = F.concat(a["windows"], F.array(F.array_join(a["open"], "\n")))
        return let(begun, lambda o: F.struct(done.alias("windows"), o.alias("open"), total(o).cast("int").alias("size")))

    def step(a: Column, x: Column) -> Column:
        grown = F.struct(a["windows"].alias("windows"), F.concat(a["open"], F.array(x)).alias("open"), (a["size"] + F.length(x)).cast("int").alias("size"))
        return F.when((F.size(a["open"]) > 0) & (a["size"] + F.length(x) > target), turned(a, x)).otherwise(grown)

    return F.aggregate(units, zero, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["windows"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["windows"]))
