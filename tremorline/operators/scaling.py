"""Joins and running totals that hold when one repository owns much of the data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorline.session import materialize


def attach(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``lookup`` (narrow, one row per ``on``) to ``df``; the engine picks the way.

    A lookup that was stored before (see ``materialize``) has a known size: if small, it is sent to the rows of ``df``, which
    are not moved at all. Of others the size is known only once both sides were shuffled by their keys, all rows of a hot
    repository to one task; store those with few keys.
    The first key is joined under a derived name. A lookup that was just grouped by it is then
    shuffled once more, small as it is, and both sides of the join are plain exchanges: those the engine can
    broadcast, or split where one key holds much of ``df``.
    """
    key = F.concat(F.col(on[0]), F.lit("."))
    return df.withColumn("_key", key).join(lookup.withColumn("_key", key).drop(on[0]), ["_key", *on[1:]], how).select(
        *df.columns, *[c for c in lookup.columns if c not in on]
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Running totals within ``group`` along ``order``, with no group confined to one task.

    Rows are range-partitioned on (group, order) and written, so each group is a run of slices.
    A slice is totalled on its own and starts from the sum of the group's earlier slices.
    For every entry ``name: column`` the result has ``name`` (this row included) and
    ``name_total`` (the whole group). ``order`` has to be unique within a group for row-exact totals.
    """
    group = list(group)
    inputs = {name: f"_in_{name}" for name in sums}
    df = df.select("*", *[column.alias(inputs[name]) for name, column in sums.items()])
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "sliced")

    slice_sums = sliced.groupBy(*group, "_slice").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in inputs.items()])
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    starts = slice_sums.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    within = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = [c for c in df.columns if c not in inputs.values()]
    return sliced.join(starts, [*group, "_slice"]).select(
        *kept,
        *[(F.col(f"_start_{n}") + F.sum(c).over(within)).alias(n) for n, c in inputs.items()],
        *[f"{n}_total" for n in sums],
    )
