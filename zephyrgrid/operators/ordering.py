"""Order-dependent work on long series, without one task per key.

A plain window over (key, time) puts every row of a key into one task. Three plants or
seventeen turbines would then be three or seventeen tasks, whatever the size of the cluster.
Here a row first gets its absolute position in its key from counts per slice (a slice is a
piece of the order, so the counts are few), and is then sent to a block of fixed length.
A block carries the neighbours its frame needs, so bounded frames give the same values as
over the whole key while no task holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.functions.scalars import seconds_since_epoch
from zephyrgrid.session import attach, stable

BLOCK_ROWS = 50_000
SLICE_SECONDS = 30 * 86_400


def time_slice(ts, seconds: int = SLICE_SECONDS) -> Column:
    """A monotone piece of the time axis; bounds rows where (key, time) is unique."""
    return F.floor(seconds_since_epoch(ts) / F.lit(seconds))


def tick(ts, seconds: int) -> Column:
    """The number of a stamp on a complete regular axis."""
    return F.floor(seconds_since_epoch(ts) / F.lit(seconds))


def numbered(df: DataFrame, keys: list[str], order: list, slice_by: Column | None = None,
             running: dict[str, Column] | None = None, position: str = "pos",
             total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in its key, optional running sums and the key's size.

    ``slice_by`` must grow with ``order`` and hold a bounded number of rows per key, as
    :func:`time_slice` does for series with one row per key and stamp. Without it the rows
    are range-partitioned over (keys, order) and written with their partition number, which is
    then a slice that stays the same when a lost executor is replaced; equal
    stamps may then be any share of the data as long as ``order`` ends in a tie-break.

    The join with the slice offsets uses the partitioning of the window before it, so the
    rows are shuffled once.
    """
    if slice_by is None:
        # no fixed number: adaptive execution may merge neighbours, which keeps the order
        ranged = df.repartitionByRange(*keys, *order)
        sliced = stable(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint")))
    else:
        sliced = df.withColumn("_slice", slice_by)
    sums = running or {}
    part = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    upto_slice = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = part.select(
        *keys, "_slice", upto_slice("_rows").alias("_before"),
        *[upto_slice(f"_sum_{n}").alias(f"_before_{n}") for n in sums],
        *([F.sum("_rows").over(whole).alias(total)] if total else []))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sliced.withColumns({
        "_local": F.row_number().over(local),
        **{f"_local_{n}": F.sum(c).over(upto) for n, c in sums.items()}})
    return counted.join(offsets, [*keys, "_slice"], "inner").withColumns({
        position: F.col("_before") + F.col("_local"),
        **{n: F.col(f"_before_{n}") + F.col(f"_local_{n}") for n in sums},
    }).drop("_slice", "_local", "_before",
            *[f"_local_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def framed(df: DataFrame, keys: list[str], order: list, *stages, before: int = 0, after: int = 0,
           slice_by: Column | None = None, position: Column | None = None,
           block: int = BLOCK_ROWS, keep: Column | None = None) -> DataFrame:
    """Evaluate window columns whose frames reach ``before`` rows back and ``after`` ahead.

    Each stage maps a window specification to new columns; later stages may use those of
    earlier ones and the position ``_pos``. They see blocks of ``block`` rows plus the
    neighbours, which are dropped again afterwards.

    On a complete regular axis ``position`` is the tick itself and nothing has to be counted;
    otherwise positions come from :func:`numbered`, which reads the keys and stamps once more.
    """
    block = max(block, before, after, 1)
    if position is not None:
        placed = df.withColumn("_pos", position)
    else:
        placed = numbered(df, keys, order, slice_by, position="_pos")
    home = F.floor((F.col("_pos") - 1) / F.lit(block))
    inside = (F.col("_pos") - 1) % block
    homes = [home]
    if before:
        homes.append(F.when(inside >= block - before, home + 1))
    if after:
        homes.append(F.when(inside < after, home - 1))
    spread = placed.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    for stage in stages:
        spread = spread.withColumns(stage(w))
    result = spread.filter(F.col("_block") == F.col("_home"))
    if keep is not None:
        result = result.filter(keep)
    return result.drop("_pos", "_home", "_block")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated quantiles of a column of any size: (keys, share, n, quantile).

    Equal values are counted first (map-side), the distinct values are ranged over the
    cluster, and only the slices that hold a wanted rank are sorted. ``percentile`` would
    build one map of all distinct values per key in one task.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    ranged = stable(counts.repartitionByRange(*keys, "_v").withColumn(
        "_slice", F.spark_partition_id().cast("bigint")))
    part = ranged.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_rows"))
    key = Window.partitionBy(*keys)
    bounds = part.select(
        *keys, "_slice", F.sum("_rows").over(key).alias("_n"),
        (F.sum("_rows").over(key.orderBy("_slice")) - F.col("_rows")).alias("_before"), "_rows")
    wanted = bounds.withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = (F.col("_n") - 1) * F.col("_share")
    wanted = wanted.withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_rank": rank})
    end = F.col("_before") + F.col("_rows")
    hit = lambda c: (F.col(c) >= F.col("_before")) & (F.col(c) < end)
    hits = wanted.filter(hit("_low") | hit("_high"))
    slices = hits.select(*keys, "_slice", "_before").distinct()
    inside = attach(ranged, slices, [*keys, "_slice"], "inner")
    local = Window.partitionBy(*keys, "_slice").orderBy("_v")
    ordered = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(
        local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ordered = ordered.select(*keys, "_slice", "_v", "_upto", (F.col("_upto") - F.col("_c")).alias("_from"))
    # a slice is asked for a handful of shares, which travel as one array per slice
    asks = hits.groupBy(*keys, "_slice").agg(
        F.collect_list(F.struct("_share", "_n", "_low", "_high", "_rank")).alias("_asks"))
    picked = attach(ordered, asks, [*keys, "_slice"], "inner").select(
        *keys, "_v", "_from", "_upto", F.inline("_asks"))
    at = lambda c: (F.col(c) >= F.col("_from")) & (F.col(c) < F.col("_upto"))
    ends = picked.filter(at("_low") | at("_high")).groupBy(*keys, "_share").agg(
        F.max(F.when(at("_low"), F.col("_v"))).alias("_a"),
        F.max(F.when(at("_high"), F.col("_v"))).alias("_b"),
        F.first("_rank").alias("_rank"), F.first("_low").alias("_low"), F.first("_n").alias("n"))
    return ends.select(
        *keys, F.col("_share").alias("share"), "n",
        (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.col("_low"))).alias("quantile"))


def average_ranks(counts: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """(keys, value, rank, n) of distinct values with their ``count``: the mean rank of each among all rows of its key, and their number.

    Values are ranged over the cluster; a slice needs the rows before it only, so no key is sorted in one task.
    """
    ranged = stable(counts.select(*keys, F.col(value).alias("_v"), F.col(count).alias("_c")).repartitionByRange(*keys, "_v").withColumn(
        "_slice", F.spark_partition_id().cast("bigint")))
    key = Window.partitionBy(*keys)
    part = ranged.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_rows"))
    bounds = part.select(*keys, "_slice", F.sum("_rows").over(key).alias("n"),
                         (F.sum("_rows").over(key.orderBy("_slice")) - F.col("_rows")).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return attach(ranged.withColumn("_upto", upto), bounds, [*keys, "_slice"], "inner").select(
        *keys, F.col("_v").alias(value), (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2.0).alias("rank"), "n")


def long_form(df: DataFrame, columns: list[str], keys: list[str] = (), name: str = "column",
              value: str = "value") -> DataFrame:
    """One row per (row, column) with a double value."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*keys, F.inline(cells))
