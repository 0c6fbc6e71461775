"""Mixing sources to target weights, on a curriculum of weights that change over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
# A cut behind a word: what follows is white space, what stands before is not.
BEHIND_WORD = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"
BUCKETS = 1024


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, null last, and repeat.

    ``share`` is the size of the mix against all sizes, ``most`` the most often
    that a source may be repeated. ``schedules`` gives each weight a piecewise
    linear intensity over training time 0..1, as (time, intensity) knots.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: tuple[int, int] = (3, 2)
    most: int = 2
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    )


def invert(knots: tuple[tuple[float, float], ...], demand: Column) -> Column:
    """The time at which the integral of the intensity reaches ``demand`` (0..1 of the whole)."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[:-1], knots[1:])]
    whole, below, time = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    steps = []
    for (t0, w0), (t1, w1), area in zip(knots[:-1], knots[1:], areas):
        slope, rest = (w1 - w0) / (t1 - t0), demand * whole - below
        # w0 * x + slope / 2 * x^2 = rest, in the form that does not cancel
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        steps.append(((below + area) / whole, t0 + 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-12))))
        below += area
    for end, inside in reversed(steps):
        time = F.when(demand <= end, F.least(inside, F.lit(float(knots[-1][0])))).otherwise(time)
    return time


def _source_key(source: str) -> Column:
    """A key in code point order, null after everything else."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def source_targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """source_key, source_size, weight_no, target of every source.

    ``totals(source_key, n)`` has the sizes in any parts. Targets are
    min(cap, level * weight); the level at which they use up the whole mix is
    found by raising it from below, each time with the sources already at their
    cap taken out, which ends exactly. Only sums over all sources reach the
    driver.
    """
    per_source = materialize(totals.groupBy("source_key").agg(F.sum("n").alias("source_size")), "sources")
    # Ranks of the sources: counts of the groups that start alike, then ranks inside a group.
    head = F.substring("source_key", 1, 3)
    groups = per_source.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("head").orderBy("source_key")
    weights = F.array(*[F.lit(w) for w in mix.weights])
    numbered = (
        per_source.withColumn("head", head)
        .join(groups, "head")
        .withColumn("weight_no", ((F.col("first") + F.row_number().over(inside) - 1) % len(mix.weights)).cast("int"))
        .select("source_key", "source_size", "weight_no", F.element_at(weights, F.col("weight_no") + 1).alias("weight"))
    )
    numbered = materialize(numbered, "numbered")
    total = numbered.agg(F.sum("source_size").alias("s")).first().s or 0
    budget, level = total * mix.share[0] / mix.share[1], 0.0
    cap = mix.most * F.col("source_size")
    while True:
        full = cap <= level * F.col("weight")
        state = numbered.agg(
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not state.open:
            break
        raised = (budget - (state.capped or 0)) / state.open
        if raised <= level:
            break
        level = raised
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return numbered.withColumn("target", target).drop("weight")


def mixture(docs: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of every row of ``docs(doc_id, source, text)``.

    Columns: doc_id, size (words), source_size, target (of its source), taken
    (words, repeats counted), position_1 and position_2 (places of the first and
    second copy in the training sequence, null if not taken), and ``keep``.

    A source's documents stand in the order of a digest of doc_id (ties: doc_id,
    digest of the text), the whole row of them repeated up to the target; the
    last document is cut where the target is reached. A word at place p of a
    source's row is due when the source's schedule has asked for a share
    p / target of its words. Null and empty texts have size 0 and take part
    with nothing taken; a null source is one source; repeated rows are taken
    separately; an empty table gives no rows.

    A source may hold any share of the rows: its running sums go through
    digest buckets, whose totals (at most BUCKETS a source) are summed first.
    """
    sized = docs.select(
        "doc_id",
        _source_key("source").alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"),
        F.xxhash64("text").alias("tie"),
        *keep,
    )
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", (number % BUCKETS).cast("int"))
    if not keep:
        sized = materialize(sized, "sized")
    # The order of documents is by (bucket, digest): any fixed order of digests will do.
    totals = materialize(sized.groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("n")), "totals")
    targets = source_targets(totals, mix)
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source_key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = materialize(bases.join(targets, "source_key"), "bases")
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("digest", "doc_id", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, ["source_key", "bucket"]).withColumn("start", F.col("base") + F.col("before"))
    whole = F.floor("target").cast("long")
    out, taken = {}, F.lit(0).cast("long")
    for copy in range(mix.most):
        begin = F.col("start") + copy * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - begin)).cast("long")
        demand = begin / F.col("target")
        due = F.coalesce(
            *[F.when(F.col("weight_no") == i, invert(s, demand)) for i, s in enumerate(mix.schedules)]
        )
        out[f"words_{copy + 1}"] = words
        out[f"position_{copy + 1}"] = F.when(words > 0, due)
        taken = taken + words
    return placed.withColumns(out).withColumn("taken", taken)


def mix_table(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the copies' positions, sorted by position."""
    copies = [c for k in range(mix.most) for c in (f"words_{k + 1}", f"position_{k + 1}")]
    return (
        mixture(docs, mix)
        .select("doc_id", "size", "source_size", "target", "taken", *copies)
        .orderBy(F.col("position_1").asc_nulls_last(), "doc_id")
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, a row a copy, sorted by position.

    A document that is cut keeps its first words, with the white space before
    them, and n_chars, where the table has it, is that of the text kept.
    """
    columns = docs.columns
    names = [f"_kept_{i}" for i in range(len(columns))]
    held = docs.select(
        "doc_id", "source", "text", *[F.col(c).alias(n) for c, n in zip(columns, names)]
    )
    mixed = mixture(held, mix, keep=tuple(names))
    copies = F.array(
        *[F.struct(F.col(f"words_{k + 1}").alias("w"), F.col(f"position_{k + 1}").alias("p")) for k in range(mix.most)]
    )
    rows = mixed.select("size", *names, F.explode(F.filter(copies, lambda c: c["w"] > 0)).alias("copy"))
    text = F.col(names[columns.index("text")])
    start = F.array_join(F.slice(F.split(text, BEHIND_WORD, F.col("copy.w") + 1), F.lit(1), F.col("copy.w")), "")
    whole = F.col("copy.w") >= F.col("size")
    final = {"text": F.when(whole, text).otherwise(start)}
    if "n_chars" in columns:
        counted = F.col(names[columns.index("n_chars")])
        final["n_chars"] = F.when(whole, counted).otherwise(F.length(start).cast(docs.schema["n_chars"].dataType))
    return rows.orderBy("copy.p", names[columns.index("doc_id")]).select(
        *[final.get(c, F.col(n)).alias(c) for c, n in zip(columns, names)]
    )
