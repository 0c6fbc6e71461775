"""Exact global ranks, running totals and quantiles without a one-task sort.

Rows are range-partitioned by value and key into slices, written once with the
number of their slice, and only the totals of the slices (one row a task) meet
in one task. The key splits copies of one value, and the ranges are drawn from
the values themselves, so neither a value that fills a third of the table nor
an outlier makes a large slice. The input is read once, whatever is built on
the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize


def _sliced(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in ranges of the keys, with the number of each row's range in ``_slice``."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *[F.col(k).asc_nulls_last() for k in keys])
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def running(
    df: DataFrame,
    order_by: str,
    key: str,
    descending: bool = False,
    rank: str | None = "rn",
    total_of: str | None = None,
    total: str = "running_total",
) -> DataFrame:
    """Add the 1-based rank of each row and, on request, a running total.

    Ties are broken by ``key``, a unique integer column, ascending. Rows whose
    ``order_by`` is NULL get NULL.
    """
    value = F.col(order_by).cast("double")
    value = F.when(value == 0, F.lit(0.0)).otherwise(-value if descending else value)
    placed = _sliced(df.withColumn("_v", value), "_v", key)
    present = placed.where(F.col("_v").isNotNull())
    measure = F.sum(F.col(total_of)) if total_of else F.lit(None).cast("double")
    slices = present.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"), measure.alias("_m"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_m").over(before), F.lit(0.0)).alias("_start_m"),
    )
    within = Window.partitionBy("_slice").orderBy(F.col("_v").asc_nulls_last(), key)
    out = {}
    if rank:
        out[rank] = F.when(F.col("_v").isNotNull(), F.col("_start") + F.row_number().over(within))
    if total_of:
        so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out[total] = F.when(
            F.col("_v").isNotNull(), F.col("_start_m") + F.sum(total_of).over(so_far)
        )
    return placed.join(slices, "_slice", "left").withColumns(out).drop("_v", "_slice", "_start", "_start_m")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with exact, linearly interpolated quantiles.

    ``wanted`` maps an output name to (column, probability). All of them come
    from a single pass: values are counted (so copies of one value collapse
    before the shuffle) and cut into slices; only the slices that hold an order
    statistic asked for are opened. NULLs are left out.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    tagged = F.array(
        *[
            F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"))
            for i, c in enumerate(columns)
        ]
    )
    counts = (
        df.select(F.inline(tagged))
        .where(F.col("_v").isNotNull())
        .groupBy("_c", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = _sliced(counts, "_c", "_v")
    slices = placed.groupBy("_c", "_slice").agg(F.sum("_n").alias("_sn"))
    own = Window.partitionBy("_c")
    before = own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_c",
        "_slice",
        "_sn",
        F.sum("_sn").over(own).alias("_all"),
        F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_first"),
    )

    def place(column: str, q: float) -> Column:
        return F.when(F.col("_c") == columns.index(column), F.lit(float(q)) * (F.col("_all") - 1))

    def holds(k: Column, first: str, n: str) -> Column:
        return (F.col(first) <= k) & (k < F.col(first) + F.col(n))

    asked = F.lit(False)
    for column, q in wanted.values():
        for end in (F.floor, F.ceil):
            asked = asked | F.coalesce(holds(end(place(column, q)), "_first", "_sn"), F.lit(False))
    inside = Window.partitionBy("_c", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    opened = placed.join(slices.where(asked), ["_c", "_slice"]).withColumn(
        "_start", F.col("_first") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    picks = []
    for name, (column, q) in wanted.items():
        position = place(column, q)
        low = F.max(F.when(holds(F.floor(position), "_start", "_n"), F.col("_v")))
        high = F.max(F.when(holds(F.ceil(position), "_start", "_n"), F.col("_v")))
        picks.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return materialize(opened.agg(*picks), "quantiles")


def as_scalar(one_row: DataFrame) -> Column:
    """The single row of ``one_row`` as a struct-valued scalar subquery."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()


def decile_group(
    df: DataFrame, order_by: str, key: str, groups: int = 10, out: str = "group"
) -> DataFrame:
    """Equal-count groups of the rank, with the edges a quantile cut puts.

    The edges lie at i/groups of the way from rank 1 to rank n and a value on
    an edge belongs below it; ``ntile`` puts its edges elsewhere.
    """
    ranked = running(df, order_by, key, rank="_rank")
    n = ranked.agg(F.max("_rank").alias("n")).scalar()
    step = F.expr(f"(_rank - 1) * {groups}")
    span = F.greatest(n - 1, F.lit(1))
    return ranked.withColumn(
        out, F.greatest(F.lit(1), F.ceil(step / span)).cast("int")
    ).drop("_rank")


def equal_area_cuts(
    df: DataFrame, position: str, area: str, key: str, shares=(0.25, 0.5, 0.75)
) -> DataFrame:
    """First position at which the running area reaches each share of the total."""
    run = running(df, position, key, rank=None, total_of=area, total="_cum")
    whole = run.agg(F.max("_cum").alias("t")).scalar()
    reached = run.withColumn("_share", F.col("_cum") / whole)
    return reached.agg(
        *[
            F.min(F.when(F.col("_share") >= s, F.col(position))).alias(f"cut_{int(100 * s)}")
            for s in shares
        ]
    )
