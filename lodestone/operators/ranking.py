"""Ranks inside groups of any size.

A window function puts a whole group into one task. Here rows are range-partitioned by group *and* order, each
partition ranks its own part of a group, and the numbers of rows in the partitions before it are added. A group that
holds a third of all rows is spread over many tasks. Where ties share a place, equal rows are counted first and only
distinct values are ranked, so a value that most rows have (nulls, say) is one row as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut


def grouped_rank(df: DataFrame, by: list[str], order: list[tuple[str, str]], out: str, ties: bool = True) -> DataFrame:
    """Add ``out``: the place of each row in its group.

    ``order``: pairs of an SQL expression and ``asc`` or ``desc``; nulls come last in either direction.
    ``ties``: equal rows share 1 + the number of rows before them; else rows are numbered in ``order``, which must then
    be total for a defined result. Null group keys form a group. Rows in, rows out: nothing is dropped. An empty input
    gives an empty output.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *[F.expr(e).alias(n) for n, (e, _) in zip(names, order, strict=True)])
    rows = keyed.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n")) if ties else keyed.withColumn("__n", F.lit(1))
    sort_cols = [*[F.col(c).asc_nulls_first() for c in by], *[_by(n, d) for n, (_, d) in zip(names, order, strict=True)]]
    ranged = cut(rows.repartitionByRange(*sort_cols).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part", *by).agg(F.sum("__n").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__part").alias("__p"),
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    ).where("__before > 0")
    inside = Window.partitionBy("__part", *by).orderBy(*[_by(n, d) for n, (_, d) in zip(names, order, strict=True)])
    local = ranged.withColumn("__local", F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    match = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(offsets, match, "left")
    place = (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("bigint").alias(out)
    if not ties:
        return joined.select(*df.columns, place)
    places = joined.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[F.col(n).alias(f"__v{n}") for n in names], place)
    same = None
    for left, right in [*[(c, f"__g{i}") for i, c in enumerate(by)], *[(n, f"__v{n}") for n in names]]:
        one = F.col(left).eqNullSafe(F.col(right))
        same = one if same is None else same & one
    return keyed.join(places, same).select(*df.columns, out)


def in_order(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows range-partitioned by group and ``order``, each with its ``__part``; equal rows are in one."""
    return cut(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))


def _beside(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with what ``small`` has for their partition and group."""
    named = small.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], *[c for c in small.columns if c not in ("__part", *by)])
    match = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(named, match, "left").drop("__p", *[f"__g{i}" for i in range(len(by))])


def with_previous(ordered: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row before in the group, null for its first; ``ordered`` as ``in_order`` gives it."""
    inside = Window.partitionBy("__part", *by).orderBy(order)
    last = ordered.groupBy("__part", *by).agg(F.max_by(value, order).alias("__last"))
    carry = last.select("__part", *by, F.lag("__last").over(Window.partitionBy(*by).orderBy("__part")).alias("__carry"))
    rows = ordered.withColumn("__lag", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    return _beside(rows, carry, by).withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag"))).drop("__lag", "__first", "__carry")


def with_running_sum(ordered: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group up to the row and those equal to it in ``order``."""
    inside = Window.partitionBy("__part", *by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))
    base = sums.select("__part", *by, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    rows = ordered.withColumn("__local", F.sum(value).over(inside))
    return _beside(rows, base, by).withColumn(out, F.col("__base") + F.col("__local")).drop("__base", "__local")


def _by(name: str, direction: str) -> Column:
    return {"asc": F.col(name).asc_nulls_last(), "desc": F.col(name).desc_nulls_last()}[direction]
