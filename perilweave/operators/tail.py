"""Expected loss, tail measures and capital allocation on a year-loss table.

The table is (district_id, year_id, peril, loss); rows without a loss may be
missing and the number of years is passed along. Claims are rare, so sums and
order statistics run over positive rows only: missing ranks are zeros.
"""

from __future__ import annotations

from math import ceil, exp, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.draws import uniform
from ..session import materialize
from .ordering import as_scalar, quantiles, running
from .years import worst_years

KEY, YEAR = "district_id", "year_id"
INSURED = ("sub", "wx", "fl", "gw")


def tail_count(n: int, q: float) -> int:
    """How many of n draws lie in the tail beyond q."""
    return max(int(n * (1 - q)), 1)


def expected_loss(ylt: DataFrame, districts: DataFrame, n_years: int, perils=INSURED) -> DataFrame:
    """Mean annual loss per peril and in total."""
    sums = ylt.groupBy(KEY).agg(
        *[F.sum(F.when(F.col("peril") == p, F.col("loss")).otherwise(0.0)).alias(f"el_{p}") for p in perils]
    )
    out = districts.select(KEY).join(sums, KEY, "left").fillna(0.0)
    out = out.withColumns({f"el_{p}": F.col(f"el_{p}") / n_years for p in perils})
    return out.withColumn("el_total", sum((F.col(f"el_{p}") for p in perils), F.lit(0.0)))


def district_years(ylt: DataFrame, perils=INSURED, loss: str = "loss") -> DataFrame:
    """Total over the given perils, positive district-years only."""
    return (
        ylt.where(F.col("peril").isin(*perils) & (F.col(loss) > 0))
        .groupBy(KEY, YEAR)
        .agg(F.sum(loss).alias("loss"))
    )


def peril_totals(ylt: DataFrame, insured=INSURED, extra: str = "er") -> DataFrame:
    """Insured total and total with the extra peril, per district-year, in one pass."""
    total = lambda keep: F.sum(F.when(F.col("peril").isin(*keep), F.col("loss")).otherwise(0.0))
    return (
        ylt.where("loss > 0")
        .groupBy(KEY, YEAR)
        .agg(total(insured).alias("total4"), total((*insured, extra)).alias("total5"))
    )


def tail_measures(
    years: DataFrame, districts: DataFrame, n_years: int, loss: str = "loss",
    tvar_q: float = 0.99, var_q: float = 0.995, names: tuple[str, str] = ("tvar99", "var995"),
    by: str | None = None,
) -> DataFrame:
    """Tail mean and interpolated quantile per district from positive district-years.

    Each district has at most ``n_years`` rows here, and the rank filter keeps
    only the top few of them before the sort (Spark's window group limit).
    With ``by``, several totals are measured at once, one row per value.
    """
    k = tail_count(n_years, tvar_q)
    position = var_q * (n_years - 1)
    below, above = n_years - floor(position), n_years - ceil(position)
    keys = [KEY, by] if by else [KEY]
    largest = Window.partitionBy(*keys).orderBy(F.desc("_l"), F.asc(YEAR))
    top = (
        years.where(F.col(loss) > 0)
        .select(*keys, YEAR, F.col(loss).alias("_l"))
        .withColumn("_rn", F.row_number().over(largest))
        .where(F.col("_rn") <= max(k, below))
    )
    at = lambda r: F.coalesce(F.max(F.when(F.col("_rn") == r, F.col("_l"))), F.lit(0.0))
    stats = top.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col("_l"))), F.lit(0.0)) / k).alias(names[0]),
        (at(below) + (at(above) - at(below)) * (position - floor(position))).alias(names[1]),
    )
    if by:
        return stats
    return districts.select(KEY).join(stats, KEY, "left").fillna(0.0, list(names))


def tail_uplift_pct(dependent: Column, independent: Column) -> Column:
    return 100 * (dependent - independent) / F.greatest(independent, F.lit(1e-9))


def portfolio_total(years: DataFrame, exposure: DataFrame, loss: str = "loss") -> DataFrame:
    """Exposure-weighted loss per year, rounded before it is ranked."""
    return (
        years.join(exposure.select(KEY, "households"), KEY)
        .groupBy(YEAR)
        .agg(F.round(F.sum(F.col(loss) * F.col("households")), 4).alias("total"))
    )


def euler_allocation(
    years: DataFrame, exposure: DataFrame, n_years: int, q: float = 0.99, loss: str = "loss"
) -> DataFrame:
    """Mean loss of each district over the portfolio's worst years.

    Weighted by exposure the allocations add up to the portfolio's tail mean.
    The worst years are a list of (1 - q) * n_years keys, so the second pass
    reads the table with a semi-join and shuffles only that share of it.
    """
    k = tail_count(n_years, q)
    worst = worst_years(portfolio_total(years, exposure, loss), "total", YEAR, k).select(YEAR)
    shares = years.join(worst, YEAR, "left_semi").groupBy(KEY).agg((F.sum(loss) / k).alias("euler"))
    return exposure.select(KEY).join(shares, KEY, "left").fillna(0.0, ["euler"])


def portfolio_tvar(years: DataFrame, exposure: DataFrame, n_years: int, q: float = 0.99, loss: str = "loss") -> DataFrame:
    """One row: tail mean of the portfolio per unit of exposure."""
    k = tail_count(n_years, q)
    whole = exposure.agg(F.sum("households").alias("w")).scalar()
    return worst_years(portfolio_total(years, exposure, loss), "total", YEAR, k).agg(
        (F.sum("total") / k / whole).alias("portfolio_tvar")
    )


def diversification_credit(rated: DataFrame, standalone: str = "tvar99", allocated: str = "euler") -> DataFrame:
    """One row: how much less capital the portfolio needs than its districts alone."""
    mean = lambda c: F.sum(F.col(c) * F.col("households")) / F.sum("households")
    return rated.agg(
        mean(allocated).alias("portfolio"),
        mean(standalone).alias("standalone"),
        (1 - mean(allocated) / mean(standalone)).alias("credit"),
    )


def tail_concentration(rated: DataFrame, allocated: str = "euler", head: float = 0.10) -> DataFrame:
    """One row: share of capital held by the top tenth of districts by capital."""
    weighted = rated.withColumn("_cap", F.round(F.col(allocated) * F.col("households"), 6))
    ranked = running(weighted, "_cap", KEY, descending=True, rank="_rn")
    n = rated.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.greatest(F.floor(n * head), F.lit(1))
    return ranked.agg(
        (F.sum(F.when(F.col("_rn") <= cut, F.col("_cap"))) / F.greatest(F.sum("_cap"), F.lit(1e-9))).alias("share"),
        F.count_if(F.col("_rn") <= cut).alias("districts"),
    )


def cumulative_share(df: DataFrame, value: str, key: str) -> DataFrame:
    """Running share of the total, largest first."""
    run = running(df, value, key, descending=True, rank="rank", total_of=value, total="_cum")
    whole = df.agg(F.sum(value).alias("t")).scalar()
    return run.withColumn("cum_share", F.col("_cum") / F.greatest(whole, F.lit(1e-9))).drop("_cum")


def joint_peril_probability(ylt: DataFrame, n_districts: Column | int, n_years: int, perils=INSURED) -> DataFrame:
    """One row: share of district-years with at least two insured perils claiming."""
    n = F.lit(n_districts) if isinstance(n_districts, int) else n_districts
    hits = (
        ylt.where(F.col("peril").isin(*perils) & (F.col("loss") > 0))
        .groupBy(KEY, YEAR)
        .agg(F.count_distinct("peril").alias("perils"))
    )
    return hits.agg(
        F.count_if(F.col("perils") >= 2).alias("multi"),
        (F.count_if(F.col("perils") >= 2) / (n * n_years)).alias("probability"),
    )


def rank_agreement(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: correlation and median relative move of a value between two runs."""
    both = a.select(KEY, F.col(value).alias("_a")).join(b.select(KEY, F.col(value).alias("_b")), KEY)
    both = both.withColumn("_move", F.abs(F.col("_b") - F.col("_a")) / F.greatest("_a", F.lit(1e-9)))
    move = as_scalar(quantiles(both, {"m": ("_move", 0.5)}))["m"]
    return both.agg(F.corr("_a", "_b").alias("corr")).select("corr", move.alias("median_move"))


def uniformity_ks(df: DataFrame, u: str, key: str) -> DataFrame:
    """One row: largest gap between the empirical distribution and the uniform one."""
    ranked = running(df, u, key, rank="_rn")
    n = df.agg(F.count(u).alias("n")).scalar()
    gap = F.greatest(F.col("_rn") / n - F.col(u), F.col(u) - (F.col("_rn") - 1) / n)
    return ranked.agg(F.max(gap).alias("ks"), F.count(u).alias("n"))


def _concordant_within(df: DataFrame, group: list[str], by: str, other: str, width: int) -> Column:
    """Pairs inside a group that rise in both ranks, as a scalar.

    Ranks are split bit by bit, so each pair meets once: where ``by`` first
    differs. There the lower half is counted up in the order of ``other``.
    """
    bits = max(width.bit_length() - 1, 0)
    if bits == 0:
        return F.lit(0)
    rows = df.select(*group, by, other, F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    rows = rows.withColumns(
        {
            "span": F.expr(f"shiftright({by} - 1, bit + 1)"),
            "upper": F.expr(f"shiftright({by} - 1, bit) % 2"),
        }
    )
    so_far = (
        Window.partitionBy(*group, "bit", "span").orderBy(other)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = rows.withColumn("lower", F.sum(1 - F.col("upper")).over(so_far))
    return met.agg(F.coalesce(F.sum(F.expr("upper * lower")), F.lit(0)).alias("s")).scalar()


def kendall_tau(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: rank correlation of two continuous columns, without listing pairs.

    Ranks are cut into about sqrt(n) blocks each way. Pairs in different
    blocks both ways are counted from the grid of block counts; pairs that
    share a block are counted inside it.
    """
    n = df.count()
    side = 1 << max((max(n, 1) - 1).bit_length() // 2, 0)
    ranked = running(running(df.select(key, x, y), x, key, rank="rx"), y, key, rank="ry")
    cut = ranked.select(
        "rx", "ry",
        F.floor((F.col("rx") - 1) / side).alias("bx"), F.floor((F.col("ry") - 1) / side).alias("by"),
    )
    spark, blocks = df.sparkSession, -(-n // side)
    grid = cut.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("c"))
    dense = (
        spark.range(blocks).select(F.col("id").alias("bx"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("by"))
        .join(grid, ["bx", "by"], "left")
        .fillna(0, ["c"])
    )
    down = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    under = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    corner = dense.withColumn("left", F.coalesce(F.sum("c").over(down), F.lit(0))).withColumn(
        "corner", F.coalesce(F.sum("left").over(under), F.lit(0))
    )
    far = corner.agg(F.sum(F.col("c") * F.col("corner")).alias("s")).scalar()
    in_x = _concordant_within(cut, ["bx"], "rx", "ry", side)
    in_y = _concordant_within(cut, ["by"], "ry", "rx", side)
    in_both = _concordant_within(cut, ["bx", "by"], "rx", "ry", side)
    pairs = max(n * (n - 1) / 2, 1)
    return spark.range(1).select(
        (2 * (far + in_x + in_y - in_both) / F.lit(float(pairs)) - 1).alias("tau"),
        F.lit(n).cast("long").alias("n"),
    )


def poisson_one() -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean 1, as far as a 52-bit draw can tell."""
    term, total, out = exp(-1.0), 0.0, []
    while total < 1 - 2.0**-53:
        total += term
        out.append(total)
        term /= len(out)
    return out


def with_resampling_weight(df: DataFrame, seed: int, replicate: str = "rep") -> DataFrame:
    """Add ``w``, the Poisson(1) weight of a district-year in a replicate, from a digest of its key."""
    u = uniform(seed, "boot", F.col(replicate), F.col(KEY), F.col(YEAR))
    above = sum((F.when(F.col("_u") > c, 1).otherwise(0) for c in poisson_one()), F.lit(0))
    return df.withColumn("_u", u).withColumn("w", above).drop("_u")


# Ranks whose weights are summed before replicates meet.
RANK_BLOCK = 1024


def ranked_runs(dependent: DataFrame, independent: DataFrame) -> DataFrame:
    """District-years of both runs by their rank, largest loss first, written once with the block of the rank."""
    runs = []
    for name, run in (("dep", dependent), ("ind", independent)):
        run = run.select(F.lit(name).alias("run"), KEY, YEAR, "loss").withColumn("_id", F.xxhash64(KEY, YEAR))
        runs.append(running(run, "loss", "_id", descending=True, rank="rn"))
    block = F.floor((F.col("rn") - 1) / RANK_BLOCK).alias("block")
    return materialize(runs[0].unionByName(runs[1]).select("run", KEY, YEAR, "loss", "rn", block), "ranked")


def pooled_tail(ranked: DataFrame, n_total: int, q: float = 0.99) -> DataFrame:
    """One row: mean of the largest (1 - q) of all district-years in either of the ``ranked_runs``."""
    k = tail_count(n_total, q)
    return ranked.where(F.col("rn") <= k).agg(
        *[(F.sum(F.when(F.col("run") == r, F.col("loss"))) / k).alias(r) for r in ("dep", "ind")]
    )


def bootstrap_ci(
    dependent: DataFrame, independent: DataFrame, n_total: int, replicates: int = 120,
    q: float = 0.99, seed: int = 3, ranked: DataFrame | None = None,
) -> DataFrame:
    """One row: interval of the pooled tail uplift over resampled district-years.

    A district-year enters a replicate with a Poisson(1) weight from a digest
    of its key, the same in both runs. Rows are ranked once (``ranked``, if the
    caller has them). Only the head that can hold the tail of some replicate is
    drawn: as long as the weights of a replicate do not fill its tail, the head
    doubles. The head lies in few slices of the ranks, so its blocks are dealt
    to all tasks before they are drawn.

    The weights of a replicate are summed by blocks of RANK_BLOCK ranks before
    they meet; running sums go over blocks, and only the block in which a
    replicate's tail ends is opened.
    """
    k = tail_count(n_total, q)
    if ranked is None:
        ranked = ranked_runs(dependent, independent)
    parts = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    head = int(k + 8 * sqrt(k) + 64)
    replicate = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    while True:
        dealt = ranked.where(F.col("rn") <= head).repartition(parts, "run", "block")
        # No filter on the weight: it would work out the digest once for every threshold.
        draws = with_resampling_weight(dealt.select("*", replicate), seed)
        sums = draws.groupBy("run", "rep", "block").agg(F.sum("w").alias("drawn"), F.sum(F.expr("w * loss")).alias("lost"))
        blocks = materialize(sums.where("drawn > 0"), "blocks")
        filled = blocks.groupBy("run", "rep").agg(F.sum("drawn").alias("drawn"))
        short = filled.where(F.col("drawn") < k).select("run").distinct()
        longer = ranked.join(short, "run", "left_semi").where(F.col("rn") > head)
        if longer.isEmpty():
            break
        head *= 2
    upto = Window.partitionBy("run", "rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = blocks.withColumn("held", F.coalesce(F.sum("drawn").over(upto), F.lit(0))).where(F.col("held") < k)
    whole = held.where(F.col("held") + F.col("drawn") <= k).select("run", "rep", F.col("lost").alias("part"))
    ends = held.where(F.col("held") + F.col("drawn") > k).select("run", "rep", "block", "held")
    opened = with_resampling_weight(ranked.where(F.col("rn") <= head).join(ends, ["run", "block"]), seed).where("w > 0")
    inside = Window.partitionBy("run", "rep", "block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("held") + F.coalesce(F.sum("w").over(inside), F.lit(0))
    last = opened.withColumn("before", before).select(
        "run", "rep", (F.least(F.col("w"), F.greatest(F.lit(k) - F.col("before"), F.lit(0))) * F.col("loss")).alias("part")
    )
    tails = whole.unionByName(last).groupBy("run", "rep").agg(F.sum("part").alias("tail"))
    uplift = tails.groupBy("rep").agg(
        *[F.sum(F.when(F.col("run") == r, F.col("tail"))).alias(r) for r in ("dep", "ind")]
    ).withColumn("uplift", 100 * (F.col("dep") / F.col("ind") - 1))
    return quantiles(uplift, {"ci_low": ("uplift", 0.025), "ci_high": ("uplift", 0.975)})
