"""Running sums over an order of any length.

A window without a partition key would bring all rows to one task. Here rows are dealt by ranges of the key, each range
sums its own rows, the few range totals are summed among themselves, and each row adds the total of the ranges before its
own. A row's range follows from its key and a list of bounds alone: the bounds are every so-manieth of the keys with the
least hashes, so that all branches of a plan, and all attempts of a task, put a row into the same range.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.shared import kept

#: Keys looked at for each range.
PER_RANGE = 20


def _bounds(keys: DataFrame, ranges: int, step: int) -> DataFrame:
    """One row: ``_fine``, the sorted bounds in lists of ``step``, and ``_coarse``, the first of each list but the first."""
    some = keys.orderBy(F.xxhash64("_key"), "_key").limit(PER_RANGE * ranges)  # the tasks' own least go to the driver, no more
    found = some.agg(F.sort_array(F.collect_list("_key")).alias("all")).select(F.filter("all", lambda x, i: (i + 1) % PER_RANGE == 0).alias("b"))
    lists = F.greatest(F.ceil(F.size("b") / step), F.lit(1)).cast("int")
    found = found.select(F.transform(F.sequence(F.lit(0), lists - 1), lambda i: F.slice("b", i * step + 1, F.lit(step))).alias("_fine"))
    return found.select("_fine", F.transform(F.slice("_fine", F.lit(2), F.size("_fine")), lambda x: x[0]).alias("_coarse"))


def _range(step: int) -> Column:
    """How many bounds are at most the row's key: first among the lists, then in one of them."""
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("_key")))
    at = upto(F.col("_coarse"))
    return at * step + upto(F.element_at("_fine", at + 1))


def running(df: DataFrame, key: str, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` (one row for each ``key`` within ``by``) with ``sums``: the total of a column over keys less than the row's.

    The number of ranges is that of ``spark.sql.shuffle.partitions``.
    """
    by = by or []
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, isqrt(ranges))
    keyed = df.withColumn("_key", F.struct(*by, key) if by else F.col(key))
    dealt = keyed.join(F.broadcast(_bounds(keyed.select("_key"), ranges, step))).withColumn("_range", _range(step)).drop("_key", "_fine", "_coarse")
    inside = W.partitionBy(*by, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = dealt.select("*", *[zero(F.sum(c).over(inside)).alias(f"_own_{name}") for name, c in sums.items()])
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(*by, "_range", *[zero(F.sum(f"_sum_{name}").over(before)).alias(f"_before_{name}") for name in sums])
    out = own.join(F.broadcast(totals) if not by else totals, [*by, "_range"])
    return out.select(*df.columns, *[(F.col(f"_own_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in an order that no two rows share."""
    rows = df.select(F.struct(*order).alias("_order"), F.struct(*df.columns).alias("_row"), F.lit(1).cast("long").alias("_one"))
    return running(rows, "_order", {name: "_one"}).select("_row.*", name)


def at_places(counts: DataFrame, by: list[str], value: str, n: str, places: Column) -> DataFrame:
    """``by.., size, place, value``: the values at some places (from 0) of each group's order, from how often each value occurs.

    places: an array of places from the group's columns and its ``size``. Ranges of values are counted, so a group may have
    any number of values; a row keeps the places that fall to it, and none meets a place that doesn't.
    """
    counts = kept(counts.where(F.col(value).isNotNull()).select(*by, value, n))
    rows = running(counts, value, {"_below": n}, by=by)
    sizes = counts.groupBy(*by).agg(F.sum(n).alias("size")).withColumn("_places", places)
    both = rows.join(sizes, by) if by else rows.join(F.broadcast(sizes))  # one row without groups
    mine = F.filter(F.array_distinct("_places"), lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col(n)))
    return both.select(*by, "size", F.explode(mine).alias("place"), F.col(value).alias("value"))


def order_statistics(counts: DataFrame, by: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """``by.., share, value``: exact quantiles of each group by linear interpolation, from how often each value occurs.

    The quantile is at ``share * (size - 1)``; between two places it lies on the line from one value to the other. So a
    share of 0.5 is the median. Nulls don't count; a group without values has no row.
    """
    at = lambda s: F.lit(float(s)) * (F.col("size") - 1)
    low = lambda s: F.floor(at(s))
    found = at_places(counts, by, value, n, F.array(*[p for s in shares for p in (low(s), F.least(low(s) + 1, F.col("size") - 1))]))
    # a place says by itself which shares it serves, and at which end
    ends = [F.struct(F.lit(float(s)).alias("share"), (at(s) - low(s)).alias("part"), (F.col("place") == low(s)).alias("first"), (F.col("place") == F.least(low(s) + 1, F.col("size") - 1)).alias("last")) for s in shares]
    read = found.select(*by, "value", F.explode(F.array(*ends)).alias("q")).where("q.first OR q.last").groupBy(*by, "q.share", "q.part").agg(F.max(F.when(F.col("q.first"), F.col("value"))).alias("a"), F.max(F.when(F.col("q.last"), F.col("value"))).alias("b"))
    return read.select(*by, "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
