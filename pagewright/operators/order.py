"""Ranks inside a group without putting the group in one task.

``row_number() OVER (PARTITION BY site ORDER BY ...)`` sorts a whole site in
one task; a site holding a third of all rows would serialise the job. The
two-pass form below gives the same numbers:

1. range-partition on (group, order) so a large group spreads over many
   partitions, number rows inside each (partition, group) slice;
2. count rows per (partition, group) -- at most partitions + groups rows --
   and turn the counts into per-slice offsets with a running sum over the
   partition index;
3. rank = offset of the slice + local row number.

A running total of any value goes the same way; a rank is that of ones.

The slice assignment depends on sampled range bounds, so the numbered slices
are written before the offsets are joined back. The input is written first:
sampling the bounds and dealing the rows would run its plan twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import scratch_table


def _sort_cols(order: list[tuple[str, bool]]):
    return [F.col(c).asc() if a else F.col(c).desc() for c, a in order]


def in_slices(df: DataFrame, part: list[str], order: list[tuple[str, bool]], num_partitions: int | None = None) -> DataFrame:
    """``df`` dealt to range partitions of (part, order), ``_pid`` the
    partition's number, written to the shared folder. Slices of a group follow
    one another by ``_pid``."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in part] + _sort_cols(order)
    dealt = scratch_table(df, "ordered").repartitionByRange(n, *cols)
    return scratch_table(dealt.withColumn("_pid", F.spark_partition_id()), "slices")


def slice_offsets(sums: DataFrame, part: list[str], names: list[str]) -> DataFrame:
    """``sums(_pid, part..., names...)`` with the sums of the earlier slices
    of the same group in place of its own; one row per slice and group."""
    before = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_pid", *part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names])


def running_totals(df: DataFrame, part: list[str], order: list[tuple[str, bool]], totals: dict[str, str],
                   num_partitions: int | None = None) -> DataFrame:
    """``df`` with every ``out`` of ``totals`` = sum of its value column up to
    and with each row in ``order`` inside ``part``; the order must be total
    inside a group."""
    sliced = in_slices(df, part, order, num_partitions)
    so_far = Window.partitionBy("_pid", *part).orderBy(*_sort_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(so_far).alias(f"_l_{out}") for out, v in totals.items()])
    sums = sliced.groupBy("_pid", *part).agg(*[F.sum(v).alias(f"_o_{out}") for out, v in totals.items()])
    offsets = slice_offsets(sums, part, [f"_o_{out}" for out in totals])
    offsets = offsets.select(F.col("_pid").alias("_kp"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(part)],
                             *[f"_o_{out}" for out in totals])
    same = F.col("_pid") == F.col("_kp")
    for k, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return (local.join(offsets, same, "left")
            .select(*df.columns, *[(F.col(f"_o_{out}") + F.col(f"_l_{out}")).alias(out) for out in totals]))


def running_total(df: DataFrame, part: list[str], order: list[tuple[str, bool]], value: str, out: str,
                  num_partitions: int | None = None) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, part, order, {out: value}, num_partitions)


def rank_within(df: DataFrame, part: list[str], order: list[tuple[str, bool]], out: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out`` = row_number over (``part``, ``order``); the order
    must be total inside a group."""
    return running_total(df.withColumn("_one", F.lit(1)), part, order, "_one", out,
                         num_partitions).drop("_one")
