"""Quantiles of groups of any size: a mergeable sketch of counts on a logarithmic grid, with a stated relative error, and exact ranks found through
it. No task holds a group's values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of grid cells of positive values are counted from here, so that zero and negative values keep their order. Above the number of cells
#: of all doubles at the least error.
SHIFT = 1 << 20
LEAST_ERROR = 0.001


def grid_step(error: float) -> float:
    if not LEAST_ERROR <= error < 1:
        raise ValueError(f"the relative error is at least {LEAST_ERROR} and below 1")
    return math.log((1 + error) / (1 - error))


def grid_cell(value: Column, error: float) -> Column:
    """The number of a value's cell; its middle is off by the error at most, relative to the value."""
    v = value.cast("double")
    k = F.ceil(F.log(F.abs(v)) / grid_step(error)).cast("long") + SHIFT
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, k).otherwise(-k)


def cell_middle(cell: Column, error: float) -> Column:
    size = F.exp((F.abs(cell) - SHIFT) * grid_step(error)) * (1 - error)
    return F.when(cell == 0, 0.0).when(cell > 0, size).otherwise(-size)


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def quantile_sketch(rows: DataFrame, keys: list[str], value: Column, error: float = 0.01) -> DataFrame:
    """keys, cell, n: how many finite values of each group fall in each cell. Null, NaN and infinite values take no part; a null key is a group.

    Counts are combined before the shuffle, so a group that holds most rows sends a few thousand counts from each task.
    """
    return rows.filter(finite(value)).groupBy(*keys, grid_cell(value, error).alias("cell")).agg(F.count("*").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of the rows of all: those of days or feeds, all with one error, are kept and added up later."""
    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy(*(c for c in both.columns if c != "n")).agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float], error: float = 0.01) -> DataFrame:
    """keys, values, and a column for each name of shares: the value of nearest rank (the least whose rank is at least that share of the group's
    values), off by the error at most. Windows see cells, not rows."""
    mine = Window.partitionBy(*keys)
    s = sketch.withColumn("upto", F.sum("n").over(mine.orderBy("cell"))).withColumn("values", F.sum("n").over(mine))
    reached = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("values") * F.lit(q)), F.lit(1)), F.col("cell")))
    return s.groupBy(*keys).agg(F.max("values").alias("values"), *(cell_middle(reached(q), error).alias(name) for name, q in shares.items()))


def exact_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float], error: float = 0.01) -> DataFrame:
    """keys, values, and a column for each name of shares: the exact quantile, between two ranks by straight line, as percentile gives it.

    A first pass counts cells and finds those that hold the wanted ranks; a second one ranks the distinct values of these cells alone. Rows are
    read twice and must be the same both times. Null, NaN and infinite values take no part; groups without any are left out.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    own = rows.filter(finite(value)).select(key.alias("key"), grid_cell(value, error).alias("cell"), value.cast("double").alias("value"))
    cells = own.groupBy("key", "cell").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("key")
    cells = cells.withColumn("before", F.sum("n").over(mine.orderBy("cell")) - F.col("n")).withColumn("values", F.sum("n").over(mine))
    place = lambda q: F.lit(float(q)) * (F.col("values") - 1)
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(upper).alias("upper"), ((F.ceil if upper else F.floor)(place(q)) + 1).alias("rank")) for name, q in shares.items() for upper in (False, True)]
    wanted = cells.select("key", "cell", "before", "n", "values", F.explode(F.array(*ranks)).alias("w")).filter((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("n")))
    wanted = wanted.select("key", "cell", "values", "w.name", "w.upper", (F.col("w.rank") - F.col("before")).alias("rank"))
    held = own.join(wanted.select("key", "cell").distinct(), ["key", "cell"], "left_semi").groupBy("key", "cell", "value").agg(F.count("*").alias("n"))
    held = held.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "cell").orderBy("value")))
    found = held.join(wanted, ["key", "cell"]).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    at = lambda name, upper: F.max(F.when((F.col("name") == name) & (F.col("upper") == upper), F.col("value")))
    between = lambda name, q: at(name, False) + (at(name, True) - at(name, False)) * (place(q) - F.floor(place(q)))
    out = found.groupBy("key", "values").agg(*(between(name, q).alias(name) for name, q in shares.items()))
    return out.select(*(F.col("key")[k].alias(k) for k in keys), "values", *shares)
