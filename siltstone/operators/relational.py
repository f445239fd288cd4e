"""Relational operators: conditioned selects, aggregates, joins, pages, as-of and range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def running(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with name (long): the sum of amount over the rows before, within by, in order (nulls last); 1 as the amount numbers the rows from 0.

    Ranges of rows are summed on their own and then start at the sums of the ranges before, so no group has to fit in one task.
    """
    keys = [*by, *[F.col(c).asc_nulls_last() for c in order]]
    dealt = settled(df.withColumn("_amount", amount.cast("long")).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part"))), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum("_amount").over(earlier(Window.partitionBy(*by, "_part").orderBy(*keys[len(by):]))), F.lit(0))
    at = base.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_of_part"), "_base")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    met = dealt.withColumn(name, own).join(at, reduce(lambda a, b: a & b, on, F.col("_part") == F.col("_of_part")))
    return met.select(*df.columns, (F.col(name) + F.col("_base")).alias(name))


def select_where(df: DataFrame, conditions: dict[str, object], limit: int, key: str) -> DataFrame:
    """Rows that equal all conditions, in key order, at most limit."""
    ok = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in conditions.items()), F.lit(True))
    return df.filter(ok).orderBy(key).limit(limit)


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """Page number (from 1) of size rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def aggregate_by(df: DataFrame, group: str, how: str, name: str) -> DataFrame:
    """One aggregate a group, largest first, ties by group."""
    return df.groupBy(group).agg(F.expr(how).alias(name)).orderBy(F.desc(name), group)


def join_where(a: DataFrame, b: DataFrame, condition: str, columns: list[str], where: str = "true", limit: int | None = None, order: list = ()) -> DataFrame:
    """Inner join of a and b (aliased a, b) on any condition, with a filter and the given output expressions."""
    out = a.alias("a").join(b.alias("b"), F.expr(condition)).filter(where).selectExpr(*columns)
    return out.orderBy(*order).limit(limit) if limit is not None else out


def missing_keys(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Wanted rows whose key isn't stored."""
    return wanted.join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key isn't in new, and all of new."""
    return stored.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, columns: list[str]) -> DataFrame:
    """Each left row with columns of the last right row of its key not after it: one shuffle of the union, one window.

    Of right rows with one key and time, the one whose columns compare largest counts.
    """
    none = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    l = left.select(by, time, F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"), *none)  # noqa: E741
    r = right.select(by, time, F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), *columns)
    w = Window.partitionBy(by).orderBy(time, "_side", *columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*columns)), True).over(w)
    return r.unionByName(l).withColumn("_last", last).filter("_side = 1").select("_row.*", *[F.col("_last")[c].alias(f"right_{c}") for c in columns])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): both sides are cut into cells of width, so that this is an equi-join with a residual filter."""
    cell = lambda c: F.floor(F.col(c).cast("double") / width)
    p = points.withColumn("_cell", cell(at))
    r = ranges.withColumn("_cell", F.explode(F.sequence(cell(low), F.greatest(cell(low), F.ceil(F.col(high).cast("double") / width) - 1))))
    return p.join(r, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def salted_count(df: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Rows a key in two steps, so that one hot key is spread over several tasks."""
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    return df.groupBy(key, salt.alias("_s")).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"))


def coalesced(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))
