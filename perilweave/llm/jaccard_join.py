"""Similarity join of shingle sets by Jaccard, with partition-and-enumerate signatures."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from perilweave.session import materialize

from .batches import mix64, row_sums, slices, word_hashes, words
from .components import connected_components, joined_components

DEALINGS = 3
KEYS_REMEMBERED = 200_000
SKETCH_PARTS = 64
FINE_PARTS = 1024
BLOCK_ROWS = 512


# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all rows, row offsets).

    A shingle is ``n`` words in a row, A-Z folded; a row with fewer words has
    its whole sequence as its one shingle, a row without words has none.
    """
    offsets, codes, known = words(texts, lower=True)
    hashed = mix64(word_hashes(known))[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), grams)
    first = np.repeat(offsets[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    length = np.minimum(size, n)[row]
    value = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = k < length
        step = mix64(value[inside] + np.uint64(k + 1)) + hashed[first[inside] + k]
        value[inside] = mix64(step)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    counts = np.bincount(row[fresh], minlength=len(size))
    return value[fresh], np.concatenate([[0], np.cumsum(counts)])


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's set, the same for equal sets."""
    total = row_sums(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), offsets)
    return mix64(total ^ mix64(np.diff(offsets).astype(np.uint64))).view(np.int64)


# ---------------------------------------------------------------- signatures


class Bands:
    """Size bands for a threshold, and the scheme each band needs.

    Band i takes the sizes from its lower edge up to the next one's. Two sets
    with Jaccard similarity of at least the threshold either lie in one band or
    in neighbouring ones; then the smaller is close enough to the edge to take
    part in the upper band too.
    """

    def __init__(self, threshold: Fraction, steps: int):
        self.threshold, self.steps = threshold, steps
        self.edges = [1]

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            edge = self.edges[-1]
            for _ in range(self.steps):
                edge = int(edge / self.threshold) + 1
            self.edges.append(edge)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own band, whether the next band is joined too)."""
        self._grow(int(sizes.max(initial=1)) * 4)
        edges = np.array(self.edges)
        own = np.searchsorted(edges, sizes, "right") - 1
        num, den = self.threshold.numerator, self.threshold.denominator
        return own, sizes * den >= edges[own + 1] * num

    def distance(self, band: int) -> int:
        """Largest size of a symmetric difference in a band: sets up to its upper end."""
        largest = self.edges[band + 1] - 1
        gap = (1 - self.threshold) / (1 + self.threshold)
        return int(gap * 2 * largest)

    def smallest(self, band: int) -> int:
        """Smallest size that takes part in a band, sets from the band below included."""
        return max(1, int(self.threshold * self.edges[band]))


@lru_cache(maxsize=None)
def scheme(distance: int, smallest: int) -> tuple[int, int, int, int]:
    """(first-level parts, second-level parts in each, parts that may differ, slack).

    A difference of at most ``distance`` elements leaves more than ``slack`` of
    the first-level parts with at most ``spare`` of them, by the pigeonhole
    principle; in each of those some choice of all but ``spare`` second-level
    parts is free of them. So sets that hold nothing in choices of up to
    ``slack`` first-level parts still share a choice in which they hold
    something. The slack is what sets of the ``smallest`` size hardly exceed.
    """
    if distance <= 2:
        return 1, distance + 2 if distance else 1, distance, 0
    for second, spare in ((3, 1), (2, 1), (1, 0)):
        least = distance // (spare + 1) + 1
        for slack in range(least // 2 + 1):
            first = least + slack
            empty = first * second * exp(-smallest / first * (second - spare) / second)
            if slack >= (empty + sqrt(empty) if empty > 0.02 else 0):
                return first, second, spare, slack
    return distance // 2 + 1, 3, 1, 0


def signatures(values: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every row with a set.

    The domain of shingles is dealt to the second-level parts by hash, the same
    way for all sets of a band; a signature stands for what a set holds in one
    choice of parts. A choice in which a set holds nothing would put unrelated
    sets into one bucket, so it is left out. A set with more such parts than
    the scheme's slack gets the signatures of another dealing as well: a similar
    set either has fewer, and shares a signature of this dealing, or gets them
    too. The last dealing keeps its empty choices, so the guarantee holds.
    """
    rows_out, sigs_out = [], []
    sizes = np.diff(offsets)
    own, joins_next = bands.of(sizes)
    for band in np.unique(np.concatenate([own[sizes > 0], own[joins_next & (sizes > 0)] + 1])):
        rows = np.flatnonzero((sizes > 0) & ((own == band) | (joins_next & (own + 1 == band))))
        for dealing in range(DEALINGS):
            plan = scheme(bands.distance(int(band)), bands.smallest(int(band)))
            sig, empty = _dealt(values, offsets, rows, plan, int(band), dealing)
            last = dealing == DEALINGS - 1
            keep = np.ones_like(empty) if last else ~empty
            rows_out.append(np.broadcast_to(rows[:, None], sig.shape)[keep])
            sigs_out.append(sig[keep])
            first, slack = plan[0], plan[3]
            rows = rows[empty.reshape(len(rows), -1, first).any(axis=1).sum(axis=1) > slack]
            if last or not len(rows):
                break
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(sigs_out).view(np.int64)


def _dealt(values, offsets, rows, plan, band: int, dealing: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the rows (rows x choices of all first-level parts) in one dealing, and which hold nothing."""
    first, second, spare, _ = plan
    parts, size = first * second, np.diff(offsets)[rows]
    at = np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    members = values[at]
    spread = mix64(members ^ np.uint64((dealing + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    slot = np.repeat(np.arange(len(rows)) * parts, size) + (spread % np.uint64(parts)).astype(np.int64)
    order = np.argsort(slot)
    held, begin = np.unique(slot[order], return_index=True)
    sums = np.zeros(len(rows) * parts, np.uint64)
    sums[held] = np.add.reduceat(mix64(members ^ np.uint64(0xD1B54A32D192ED03))[order], begin)
    full = np.zeros(len(sums), bool)
    full[held] = True
    sums, full = sums.reshape(len(rows), first, second), full.reshape(len(rows), first, second)
    sigs, empty = [], []
    place = np.arange(first, dtype=np.uint64) * np.uint64(64) + np.uint64(band << 40)
    for number, chosen in enumerate(combinations(range(second), second - spare)):
        value = np.zeros((len(rows), first), np.uint64)
        for part in chosen:
            value = mix64(value ^ (sums[:, :, part] + np.uint64(part + 1)))
        sigs.append(mix64(value + mix64(place + np.uint64(number * 8 + dealing))))
        empty.append(~full[:, :, list(chosen)].any(axis=2))
    return np.concatenate(sigs, axis=1), np.concatenate(empty, axis=1)


def sketches(values: np.ndarray, offsets: np.ndarray, parts: int = SKETCH_PARTS) -> np.ndarray:
    """How many members of each set fall into each of the parts (a power of two), up to 255.

    The differences of two sketches add up to no more than the sets' symmetric
    difference, so they rule out pairs and never a similar one.
    """
    rows = len(offsets) - 1
    shift = np.uint64(64 - parts.bit_length() + 1)
    cell = np.repeat(np.arange(rows) * parts, np.diff(offsets)) + (mix64(values) >> shift).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=rows * parts), 255).astype(np.uint8)


# ---------------------------------------------------------------- join


def _keyed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tie, n_shingles, set_key and sketch of every row; null key for an empty set."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                values, offsets = shingle_sets(part.column("text"), n)
                keys, sizes = set_keys(values, offsets), np.diff(offsets)
                counts = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(SKETCH_PARTS), len(sizes), [None, pa.py_buffer(sketches(values, offsets))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tie"),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.int64(), mask=sizes == 0),
                        counts,
                    ],
                    ["doc_id", "tie", "n_shingles", "set_key", "sketch"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(
        run, "doc_id long, tie long, n_shingles long, set_key long, sketch binary"
    )


def _signed(docs: DataFrame, n: int, threshold: Fraction, steps: int) -> DataFrame:
    """(sig, set_key): the signatures of every set, of copies met in one task once."""

    def run(batches):
        bands, met = Bands(threshold, steps), set()
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                values, offsets = shingle_sets(batch.column("text").slice(start, stop - start), n)
                keys = set_keys(values, offsets)
                fresh = [i for i, k in enumerate(keys.tolist()) if k not in met and not met.add(k)]
                if len(met) > KEYS_REMEMBERED:
                    met.clear()
                chosen = np.zeros(len(keys), bool)
                chosen[fresh] = True
                member = np.repeat(chosen, np.diff(offsets))
                sizes = np.where(chosen, np.diff(offsets), 0)
                row, sig = signatures(values[member], np.concatenate([[0], np.cumsum(sizes)]), bands)
                for at in range(0, len(row), 1 << 18):
                    end = at + (1 << 18)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at:end]), pa.array(keys[row[at:end]])], ["sig", "set_key"])

    return docs.select("text").mapInArrow(run, "sig long, set_key long")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """set_key and packed set of the documents in ``wanted(doc_id)``, one row a key."""
    found = docs.select("doc_id", "text").join(
        wanted.select(F.col("doc_id").alias("_wanted")), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi"
    )

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts):
                values, offsets = shingle_sets(texts.slice(start, stop - start), n)
                data = pa.Array.from_buffers(
                    pa.binary(),
                    len(offsets) - 1,
                    [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(values)],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(values, offsets), pa.int64()), data], ["set_key", "members"]
                )

    found = found.select("text").mapInArrow(run, "set_key long, members binary")
    return found.groupBy("set_key").agg(F.first("members").alias("members"))


class _Comparison:
    """Exact comparison of pairs of set keys; sets are read from the texts when first needed."""

    def __init__(self, docs: DataFrame, signed: DataFrame, n: int, threshold: Fraction):
        self.docs, self.n, self.threshold, self.sets = docs, n, threshold, None
        keyed = signed.where("set_key is not null")
        self.owners = materialize(
            keyed.groupBy("set_key").agg(
                F.min("doc_id").alias("doc_id"),
                F.min("n_shingles").alias("n"),
                F.min("sketch").alias("sketch"),
            ),
            "owners",
        )

    def _possible(self, pairs: DataFrame) -> DataFrame:
        num, den = self.threshold.numerator, self.threshold.denominator

        @F.arrow_udf("long")
        def gap(a: pa.Array, b: pa.Array) -> pa.Array:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), SKETCH_PARTS) for c in (a, b))
            return pa.array(np.abs(x.astype(np.int16) - y).sum(axis=1), pa.int64())

        side = lambda key, n, sketch: self.owners.select(
            F.col("set_key").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch)
        )
        return (
            pairs.join(side("a", "na", "sa"), "a")
            .join(side("b", "nb", "sb"), "b")
            .where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
            .where(gap("sa", "sb") * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
            .select("a", "b")
        )

    def load(self, keys: DataFrame) -> None:
        """Read the sets of ``keys(set_key)`` that are not there yet."""
        if self.sets is not None:
            keys = keys.join(self.sets.select("set_key"), "set_key", "left_anti")
        wanted = materialize(keys.join(self.owners, "set_key").select("doc_id").distinct(), "wanted")
        if self.sets is None or not wanted.isEmpty():
            found = _sets_of(self.docs, wanted, self.n)
            if self.sets is not None:
                found = found.join(self.sets.select("set_key"), "set_key", "left_anti")
            found = materialize(found, "sets")
            self.sets = found if self.sets is None else self.sets.union(found)

    def similar(self, pairs: DataFrame, sketched: bool = False) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold; ``sketched`` if sketches have been compared."""
        num, den = self.threshold.numerator, self.threshold.denominator
        pairs = materialize(pairs if sketched else self._possible(pairs), "possible")
        self.load(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())

        @F.arrow_udf("boolean")
        def reaches(a: pa.Array, b: pa.Array) -> pa.Array:
            out = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = den * both >= num * (len(x) + len(y) - both)
            return pa.array(out)

        left = self.sets.select(F.col("set_key").alias("a"), F.col("members").alias("set_a"))
        right = self.sets.select(F.col("set_key").alias("b"), F.col("members").alias("set_b"))
        return pairs.join(left, "a").join(right, "b").where(reaches("set_a", "set_b")).select("a", "b")


def jaccard_components(
    docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), band_steps: int = 1
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``.

    Rows are linked when the Jaccard similarity of their sets of distinct
    ``n``-word shingles is at least ``threshold`` (a fraction, compared in
    integers); component_id is the smallest doc_id reachable by links. A null,
    empty or blank text has an empty set, is linked with nothing and is its own
    component; repeated rows are equal sets and so linked; a null doc_id takes
    part but never names a component unless alone, when it stays null. Other
    columns are ignored.

    Equal sets collapse to one key first. Sets that share a signature form a
    bucket. Each bucket is first compared with one member only (its hub), which
    settles groups of copies in as many comparisons as rows; where members are
    still in different components, with a second one. What then is still apart
    is compared completely, in blocks of BLOCK_ROWS by finer sketches, so no
    pairs but those that may be similar leave a block, and exactly after that:
    no similar pair stays unlinked. Very long texts are whole sets.
    """
    return _components(docs, n, threshold, band_steps).select("doc_id", "n_shingles", "component_id")


def representatives(
    docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), band_steps: int = 1
) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that with the smallest doc_id.

    Repeated rows of one doc_id and text are one. Rows without a doc_id stay if
    no row of their component has one.
    """
    groups = _components(docs, n, threshold, band_steps)
    key = {"_row_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_row_tie": F.xxhash64("text")}
    gone = groups.where("component_id is not null and not (doc_id <=> component_id)")
    gone = gone.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_row_id"), F.col("tie").alias("_row_tie")).distinct()
    kept = docs.withColumns(key).join(gone, list(key), "left_anti")
    return kept.dropDuplicates(list(key)).drop(*key)


def _apart(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the buckets whose members lie in different components.

    sig, set_key, root (its component), major (the bucket's largest component),
    members and outside (rows in all and outside of the largest), and a hub and
    its hub_root. Near copies share many buckets with the same members; one of
    each will do.
    """
    root = F.coalesce("component", "set_key").alias("root")
    rows = buckets.join(nodes.withColumnRenamed("node", "set_key"), "set_key", "left").select("sig", "set_key", root)
    by_root = rows.groupBy("sig", "root").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("digest"),
        F.min(F.struct(F.xxhash64(F.lit("hub"), "set_key").alias("h"), F.col("set_key").alias("hub"))).alias("pick"),
    )
    mixed = by_root.groupBy("sig").agg(
        F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("major"),
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor("digest").alias("digest"),
        F.min_by(F.struct("pick.hub", F.col("root").alias("hub_root")), "pick.h").alias("pick"),
    ).where("lo <> hi")
    mixed = mixed.groupBy("members", "digest", "lo", "hi").agg(
        F.min("sig").alias("sig"), *[F.first(c).alias(c) for c in ("most", "major", "pick")]
    )
    mixed = mixed.select("sig", "members", (F.col("members") - F.col("most")).alias("outside"), "major", "pick.hub", "pick.hub_root")
    return materialize(rows.join(mixed, "sig"), "apart")


def _blocked(apart: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that may be similar, by fine sketches.

    Of two such members one at least is outside the bucket's largest component.
    Outside rows meet all rows of the bucket, both in blocks of about BLOCK_ROWS
    rows, so a bucket of any size is many small groups; a group leaves only the
    pairs that its sketches do not rule out.
    """
    num, den = threshold.numerator, threshold.denominator

    def sketched(batches):
        for batch in batches:
            members = batch.column("members").to_pylist()
            for begin in range(0, len(members), 256):
                part = members[begin : begin + 256]
                offsets = np.concatenate([[0], np.cumsum([len(m) // 8 for m in part])]).astype(np.int64)
                fine = sketches(np.frombuffer(b"".join(part), np.uint64), offsets, FINE_PARTS).reshape(-1, FINE_PARTS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set_key").slice(begin, len(part)), pa.array(np.diff(offsets)), pa.array([r.tobytes() for r in fine], pa.binary())],
                    ["set_key", "n", "sketch"],
                )

    fine = sets.join(apart.select("set_key").distinct(), "set_key", "left_semi")
    fine = fine.select("set_key", "members").mapInArrow(sketched, "set_key long, n long, sketch binary")
    rows = apart.join(fine, "set_key")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    own = lambda c: F.pmod(F.xxhash64("set_key"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    columns = ["sig", "i", "j", "whole", "set_key", "root", "n", "sketch"]
    one = rows.where("root <> major").withColumns({"whole": F.lit(False), "i": own("outside"), "j": every("members")})
    two = rows.withColumns({"whole": F.lit(True), "j": own("members"), "i": every("outside")})
    dealt = one.select(*columns).union(two.select(*columns)).repartition("sig", "i", "j")

    def compare(group: pa.Table):
        whole = group.column("whole").to_numpy()
        keys, roots, sizes = (group.column(c).to_numpy() for c in ("set_key", "root", "n"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, FINE_PARTS).astype(np.int16)
        others = np.flatnonzero(whole)
        for x in np.flatnonzero(~whole):
            small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
            y = others[(roots[others] != roots[x]) & (den * small >= num * large)]
            gap = np.abs(sketch[y] - sketch[x]).sum(axis=1, dtype=np.int64)
            y = y[gap * (den + num) <= (sizes[y] + sizes[x]) * (den - num)]
            if len(y):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(keys[x], keys[y])), pa.array(np.maximum(keys[x], keys[y]))], ["a", "b"]
                )

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("sig", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts[:-1]], cuts):
                yield from compare(table.slice(begin, end - begin))
            kept = table.slice(cuts[-1] if len(cuts) else 0)
        if kept is not None and len(kept):
            yield from compare(kept)

    found = dealt.sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long")
    return found.distinct()


def _components(docs: DataFrame, n: int, threshold: Fraction, band_steps: int) -> DataFrame:
    """doc_id, tie (a digest of the text), n_shingles and component_id of every row."""
    signed = materialize(_keyed(docs, n), "keyed")
    # One shuffle, by signature, serves the removal of copies and the window.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = _signed(docs, n, threshold, band_steps).repartition(parts, "sig").dropDuplicates(["sig", "set_key"])
    ordered = Window.partitionBy("sig").orderBy("set_key")
    buckets = buckets.select(
        "sig",
        "set_key",
        F.first("set_key").over(ordered).alias("hub"),
        F.lead("set_key").over(ordered).alias("following"),
    ).where("set_key <> hub or following is not null")
    buckets = materialize(buckets.select("sig", "set_key", "hub"), "buckets")

    comparison = _Comparison(docs, signed, n, threshold)
    pairs = buckets.where("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b"))
    tried = materialize(pairs.distinct(), "tried")
    nodes = materialize(connected_components(materialize(comparison.similar(tried), "links")), "nodes")
    apart = _apart(buckets, nodes)
    if not apart.isEmpty():
        pairs = apart.where("root <> hub_root").select(F.least("hub", "set_key").alias("a"), F.greatest("hub", "set_key").alias("b"))
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(comparison.similar(pairs), "links")
        nodes = materialize(joined_components(nodes, links), "nodes")
        apart = _apart(apart.select("sig", "set_key"), nodes)
        comparison.load(apart.select("set_key").distinct())
        pairs = _blocked(apart, comparison.sets, threshold).join(tried.union(pairs), ["a", "b"], "left_anti")
        links = materialize(comparison.similar(pairs, sketched=True), "links")
        nodes = materialize(joined_components(nodes, links), "nodes")

    of_key = comparison.owners.join(nodes.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "set_key", "doc_id", F.coalesce("component", "set_key").alias("root")
    )
    of_key = materialize(of_key, "keys")
    named = of_key.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = of_key.join(named, "root").select("set_key", "component_id")
    return (
        signed.select("doc_id", "tie", "n_shingles", "set_key")
        .join(labels, "set_key", "left")
        .select(
            "doc_id",
            "tie",
            "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
