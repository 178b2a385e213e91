"""Tokens, cost and the budget.

Costs are computed as (summed integer tokens) x (rate) so totals never
depend on floating-point summation order. The budget operators work on the
narrow ``(site, order..., tokens, ok)`` table only.

Budget cut without a whole-site sort: the rows are dealt to range partitions of
(site, order), so a large site spreads over many tasks. Sums per slice tell in
which slice of a site the stop threshold is reached, and only that slice is
totalled row by row. Its first row that reaches the threshold is the per-site
stop key, which is joined back on ``site``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pagewright import fixed
from pagewright.operators.dedup import order_struct
from pagewright.operators.order import in_slices, running_total, running_totals, slice_offsets
from pagewright.session import maybe_broadcast, scratch_table, ship_package


def rates_frame(spark: SparkSession, rates=None) -> DataFrame:
    """A4: ``(model, input_rate, output_rate)`` in USD per token."""
    return spark.createDataFrame(list(rates or fixed.MODEL_RATES),
                                 "model string, input_rate double, output_rate double")


def price_usage(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """E2 + F2: per call cost. Unknown models add nothing (inner join with
    the broadcast price table); see ``unmatched_usage`` for the report."""
    return (usage.join(rates, "model")
            .withColumn("input_cost", F.col("prompt_tokens") * F.col("input_rate"))
            .withColumn("output_cost", F.col("completion_tokens") * F.col("output_rate"))
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")))


def unmatched_usage(usage: DataFrame, rates: DataFrame) -> DataFrame:
    return usage.join(rates.select("model"), "model", "left_anti")


def usage_summary(usage: DataFrame, rates: DataFrame, by=("site",)) -> DataFrame:
    """input, output, total tokens and cost per group (known models)."""
    priced = usage.join(rates, "model")
    per_model = (priced.groupBy(*by, "model", "input_rate", "output_rate")
                 .agg(F.sum("prompt_tokens").alias("input_tokens"),
                      F.sum("completion_tokens").alias("output_tokens")))
    return (per_model.groupBy(*by)
            .agg(F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"),
                 F.sum(F.col("input_tokens") * F.col("input_rate")
                       + F.col("output_tokens") * F.col("output_rate")).alias("total_cost"))
            .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


def _stop_keys(sliced: DataFrame, order: list[tuple[str, bool]], limits: DataFrame,
               stop_fraction: float) -> DataFrame:
    """Per site: order key of the first positive row at which the running
    total reaches the stop threshold (absent when never reached). ``sliced``
    are the rows in range partitions (``order.in_slices``)."""
    pos = sliced.where(F.col("tokens") > 0)
    sums = pos.groupBy("_pid", "site").agg(F.sum("tokens").alias("own"), F.sum("tokens").alias("before"))
    before = slice_offsets(sums.drop("own"), ["site"], ["before"])
    reached = F.col("before") + F.col("own") >= F.col("stop")
    first = (sums.select("_pid", "site", "own").join(before, ["_pid", "site"])
             .join(limits.select("site", (F.col("max_tokens") * stop_fraction).alias("stop")), "site").where(reached)
             .groupBy("site", "stop").agg(F.min(F.struct("_pid", "before")).alias("at"))
             .select("site", "stop", F.col("at._pid").alias("_pid"), F.col("at.before").alias("before")))
    so_far = (Window.partitionBy("_pid", "site").orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in order])
              .rowsBetween(Window.unboundedPreceding, 0))
    return (pos.join(first, ["site", "_pid"]).withColumn("_cum", F.col("before") + F.sum("tokens").over(so_far))
            .where(F.col("_cum") >= F.col("stop")).groupBy("site").agg(F.min(order_struct(order)).alias("_stop")))


def budget_cut(ranked: DataFrame, seeds: DataFrame, order: list[tuple[str, bool]],
               stop_fraction: float = fixed.STOP_FRACTION) -> DataFrame:
    """G1, batch-of-one form: a row is kept while the tokens used before it
    are below ``stop_fraction * max_tokens`` of its site. ``ranked`` is a narrow
    table with ``site``, the order columns and ``tokens``, written once;
    ``seeds`` holds ``(site, max_tokens)``; a site without a seed has no budget
    and no row of it is kept."""
    limits = maybe_broadcast(seeds.select("site", "max_tokens"))
    sliced = in_slices(ranked, ["site"], order)
    stops = maybe_broadcast(limits.select("site").join(_stop_keys(sliced, order, limits, stop_fraction), "site", "left"))
    return (sliced.join(stops, "site")
            .where(F.col("_stop").isNull() | (order_struct(order) <= F.col("_stop")))
            .select(*ranked.columns))


def running_usage(kept: DataFrame, seeds: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """G3 over the rows kept by the budget: tokens used before each row,
    remaining capacity ``1 - used/max`` and the warning flag
    (remaining <= 0.85)."""
    limits = maybe_broadcast(seeds.select("site", "max_tokens"))
    return (running_total(kept, ["site"], order, "tokens", "_cum")
            .withColumn("used_before", F.col("_cum") - F.col("tokens")).drop("_cum")
            .join(limits, "site")
            .withColumn("remaining", 1 - F.col("used_before") / F.col("max_tokens"))
            .withColumn("warning", F.col("remaining") <= fixed.WARNING_REMAINING)
            .drop("max_tokens"))


def _batch_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows in order (site, index, size of a batch starting here): how many
    rows after each row the next batch starts (0: at this row), and how many
    have started, for every state (0, 1, 2) in which the slice may begin. Rows
    stream through; nothing but the states of the current site is held."""
    site, now, started = None, [0, 1, 2], [0, 0, 0]
    for batch in batches:
        sites, sizes = batch.column("site").to_pylist(), batch.column("size").to_pylist()
        state, count, after = [], [], []
        for s, size in zip(sites, sizes, strict=True):
            if s != site:
                site, now, started = s, [0, 1, 2], [0, 0, 0]
            started = [n + (x == 0) for n, x in zip(started, now, strict=True)]
            state.append(now)
            count.append(started)
            now = [size - 1 if x == 0 else x - 1 for x in now]
            after.append(now)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, kind), pa.array(count, kind), pa.array(after, kind)],
                                         names=[*batch.schema.names, "state", "count", "after"])


def budget_batches(ranked: DataFrame, seeds: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Adaptive batches of 1-3 pages; the limit test happens before each
    batch, so the last batch may overshoot. Rejected-after-generation pages
    count in ``used`` but not in the successes behind the average.

    The size of a batch that would start at a row depends on the totals before
    that row alone, so whether one does start there is a function of the
    distance to the next start, and such functions compose: every range slice
    of a site composes its own (three states), slices are composed in order, and
    the state in which a slice begins picks the answer of each row. No site is
    ever one group. Only rows that can still be reached are looked at: a row
    more than MAX_BATCH - 1 rows past the last one below the stop never is."""
    limits = maybe_broadcast(seeds.select("site", "max_tokens"))
    narrow = ranked.select("site", "rank", *dict.fromkeys(c for c, _ in order if c not in ("site", "rank")), "tokens",
                           F.coalesce(F.col("ok").cast("long"), F.lit(0)).alias("_ok"), F.lit(1).alias("_one"))
    totals = running_totals(narrow, ["site"], order, {"_used": "tokens", "_oks": "_ok", "_i": "_one"})
    used, oks = F.col("_used") - F.col("tokens"), F.col("_oks") - F.col("_ok")
    most = F.col("max_tokens").cast("double")
    average = used / F.greatest(F.lit(1), oks)
    fits = ((most - used) / F.greatest(average, F.lit(float(fixed.MIN_TOKENS_PER_PAGE)))).cast("long")
    rows = scratch_table(totals.join(limits, "site").select(
        "site", "rank", "_i", F.greatest(F.lit(1), F.least(F.lit(fixed.MAX_BATCH), fits)).cast("long").alias("size"),
        (used < most * fixed.STOP_FRACTION).alias("open")), "batch-sizes")
    last = rows.where("open").groupBy("site").agg(F.max("_i").alias("last"))
    near = rows.join(maybe_broadcast(last), "site").where(F.col("_i") < F.col("last") + fixed.MAX_BATCH).drop("last")
    ship_package(ranked.sparkSession)
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = near.repartitionByRange(n, "site", "_i").sortWithinPartitions("site", "_i").withColumn("_pid", F.spark_partition_id())
    states = StructType([*dealt.schema.fields, *[StructField(c, ArrayType(LongType())) for c in ("state", "count", "after")]])
    local = scratch_table(dealt.mapInArrow(_batch_states, states), "batch-states")
    ends = local.groupBy("_pid", "site").agg(F.max_by(F.struct("after", "count"), "_i").alias("f"))
    earlier = Window.partitionBy("site").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)      # a row per slice
    begin = F.aggregate(F.collect_list("f").over(earlier), F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("c")),
                        lambda acc, f: F.struct(F.get(f["after"], acc["s"].cast("int")).alias("s"),
                                                (acc["c"] + F.get(f["count"], acc["s"].cast("int"))).alias("c")))
    entry = ends.select("_pid", "site", begin.alias("entry"))
    at = F.col("entry.s").cast("int")
    placed = local.join(entry, ["_pid", "site"]).select("site", "rank", "open", (F.get("state", at) == 0).alias("starts"),
                                                        (F.col("entry.c") + F.get("count", at)).alias("batch_no"))
    run = placed.where("starts and open").groupBy("site").agg(F.count(F.lit(1)).alias("n"))     # open starts come first
    taken = placed.join(run, "site").where("batch_no <= n").select("site", "rank", "batch_no")
    return (ranked.select("site", "rank").join(taken, ["site", "rank"], "left")
            .withColumn("included", F.col("batch_no").isNotNull()))


def progress_report(ranked_kept: DataFrame, seeds: DataFrame) -> DataFrame:
    """F4 + F5: pages, tokens, % of limit, remaining, average tokens per
    successful page, per site."""
    agg = ranked_kept.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("ok").cast("int")).alias("successes"),
        F.sum("tokens").alias("tokens"))
    return (agg.join(maybe_broadcast(seeds.select("site", "max_tokens")), "site")
            .withColumn("pct_of_limit", F.round(100.0 * F.col("tokens") / F.col("max_tokens"), 1))
            .withColumn("remaining", F.col("max_tokens") - F.col("tokens"))
            .withColumn("avg_tokens_per_page",
                        F.col("tokens") / F.greatest(F.lit(1), F.col("successes"))))
