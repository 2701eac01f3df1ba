"""Row positions and block-wise window functions.

A window partitioned by the series key alone puts a whole series into one task.
Everything ordered therefore works in two steps: number the rows of each series
(``pos``, 0-based), then cut the series into blocks of ``block`` positions and
run the window per ``(series, block)``. Rows a neighbouring block needs for its
look-back or look-ahead are copied into it and dropped again afterwards, so the
result is the same as with one window over the series.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.operators.keys import join_on
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

BLOCK_ROWS = 65_536

# Bucket that holds a bounded number of grid steps: a year has at most 366 days.
BUCKET_OF_GRID = {"month": "year", "day": "year", "hour": "month", "minute": "day", "second": "hour"}


def with_pos(df: DataFrame, spec: SeriesSpec, grid: str | None = None) -> DataFrame:
    """Add ``pos`` (0-based rank in the series) and ``n`` (rows of the series).

    With ``grid`` the caller states that a series has at most one row per day,
    hour, ... Then rows are ranked inside calendar buckets of bounded size and
    shifted by the running bucket counts. Without it rows may repeat a time, and
    any one time may be arbitrarily frequent: the rows are range-partitioned by
    the full order, so no key value can overfill a task.
    """
    return _pos_by_bucket(df, spec, grid) if grid else _pos_by_range(df, spec)


def _pos_by_bucket(df: DataFrame, spec: SeriesSpec, grid: str) -> DataFrame:
    keys = list(spec.keys)
    rows = df.withColumn("_bucket", F.date_trunc(BUCKET_OF_GRID[grid], spec.time))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    in_series = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_rows").over(in_series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*spec.order))
    placed = join_on(rows.withColumn("_rank", rank), offsets, [*keys, "_bucket"])
    return placed.withColumn("pos", (F.col("_rank") - 1 + F.col("_before")).cast("bigint")).drop("_bucket", "_rank", "_before")


def _pos_by_range(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    keys = list(spec.keys)
    order = [*keys, *spec.order]
    # Both passes below must see the same partitions, hence the written table.
    ranged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    pieces = ranged.groupBy(*keys, "_part").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_rows"))
    by_part = pieces.groupBy("_part").agg(F.sum("_rows").alias("_part_rows"))
    # One row per partition: a single-task running sum over it stays small.
    shift = by_part.select(
        "_part",
        F.coalesce(
            F.sum("_part_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
    )
    series = Window.partitionBy(*keys)
    # One row per series and partition it touches.
    offsets = cut_lineage(
        pieces.join(shift, "_part").select(
            *keys, "_part",
            (F.col("_shift") - F.min(F.col("_shift") + F.col("_row")).over(series)).alias("_add"),
            F.sum("_rows").over(series).alias("n"),
        )
    )
    placed = join_on(ranged, offsets, [*keys, "_part"])
    return placed.withColumn("pos", (F.col("_row") + F.col("_add")).cast("bigint")).drop("_part", "_row", "_add")


def block_of(block: int = BLOCK_ROWS, shift: int = 0) -> Column:
    """Block of the position ``shift`` rows further on."""
    return F.expr(f"greatest(pos + {shift}, 0L) div {block}")


Stage = Callable[[WindowSpec], Mapping[str, Column]]


def over_blocks(
    df: DataFrame,
    spec: SeriesSpec,
    *stages: Stage,
    before: int = 0,
    after: int = 0,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Each stage maps the block's window to new columns and may use the columns of
    the stages before it; ``before`` and ``after`` count over all stages together.
    ``df`` needs ``pos``.
    """
    keys = list(spec.keys)
    here = block_of(block)
    if before or after:
        rows = df.withColumn("_block", F.explode(F.sequence(block_of(block, -after), block_of(block, before))))
    else:
        rows = df.withColumn("_block", here)
    window = Window.partitionBy(*keys, "_block").orderBy("pos")
    for stage in stages:
        rows = rows.withColumns(dict(stage(window)))
    return rows.where(F.col("_block") == here).drop("_block")


def _carried(df: DataFrame, spec: SeriesSpec, summary: Mapping[str, Column], window: WindowSpec,
             carry: Callable[[str], Column], block: int) -> DataFrame:
    """Join to each row what the other blocks of its series contribute."""
    keys = list(spec.keys)
    rows = df.withColumn("_block", block_of(block))
    blocks = rows.groupBy(*keys, "_block").agg(*[c.alias(name) for name, c in summary.items()])
    edges = blocks.select(*keys, "_block", *[carry(name).over(window).alias(name) for name in summary])
    return join_on(rows, edges, [*keys, "_block"])


def fill_forward(df: DataFrame, spec: SeriesSpec, columns: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """Replace nulls by the last value before them in the series."""
    return _fill(df, spec, columns, block, forward=True)


def fill_backward(df: DataFrame, spec: SeriesSpec, columns: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """Replace nulls by the next value after them in the series."""
    return _fill(df, spec, columns, block, forward=False)


def _fill(df: DataFrame, spec: SeriesSpec, columns: list[str], block: int, forward: bool) -> DataFrame:
    pick = F.max_by if forward else F.min_by
    summary = {f"_edge_{c}": pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos"))) for c in columns}
    side = F.col("_block").asc() if forward else F.col("_block").desc()
    earlier = Window.partitionBy(*spec.keys).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    joined = _carried(df, spec, summary, earlier, lambda c: F.last(c, ignorenulls=True), block)
    order = F.col("pos").asc() if forward else F.col("pos").desc()
    inside = Window.partitionBy(*spec.keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_edge_{c}")) for c in columns}
    return joined.withColumns(filled).drop("_block", *summary)


def running_sum(df: DataFrame, spec: SeriesSpec, column: Column | str, name: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Cumulative sum along the series, as sums in blocks plus the sums of earlier blocks."""
    amount = F.col(column) if isinstance(column, str) else column
    rows = df.withColumn("_amount", amount)
    earlier = Window.partitionBy(*spec.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    joined = _carried(rows, spec, {"_sum": F.sum("_amount")}, earlier, lambda c: F.sum(c), block)
    inside = Window.partitionBy(*spec.keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_amount").over(inside) + F.coalesce(F.col("_sum"), F.lit(0.0))
    return joined.withColumn(name, total).drop("_block", "_amount", "_sum")


def first_rows(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The first ``k`` rows of each series; needs ``pos``."""
    return df.where(F.col("pos") < k)


def last_rows(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """The last ``k`` rows of each series; needs ``pos`` and ``n``."""
    return df.where(F.col("pos") >= F.col("n") - k)
