"""Links within regions of rows that share a key, without emitting pairs, and connected components over links."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import discard, materialize

#: Leaders in all blocks of a large region, and rows that one task compares with a block afterwards.
LEADERS, ASKED = 8, 8192
#: Ranges into which a large region's sorted order is cut at most, and the share of a region outside its largest component up to which it is settled by comparing them with all.
RANGES, APART = 64, 8
#: Links that a task contracts.
LINKS = 1 << 20
LINK = "a bigint, b bigint"


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of equal keys."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        last = np.ones(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            last &= v == v[-1]
        cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def starts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = np.any([np.diff(t.column(k).to_numpy()) != 0 for k in keys], axis=0)
    return np.append(np.flatnonzero(new), t.num_rows)


def settle(g: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of g hangs together with by the links a - b."""
    label = np.arange(g)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_batch(v: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Links of each row to the smallest ``v`` of its label (places of rows), where that is another."""
    least = v.copy()
    np.minimum.at(least, label, v)
    a = least[label]
    other = a != v
    return pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(v[other])], names=["a", "b"])


def by_order(large: DataFrame) -> DataFrame:
    """Add ``home``, the block of a row in its region: ranges of the sorted order ``o``, cut at the region's quantiles; ranges with more rows than a block should have are dealt by hash."""
    cuts = large.groupBy("key").agg(F.percentile_approx("o", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c <= F.col("o")))
    shares = F.ceil(F.col("blocks") / RANGES).cast("int")
    home = F.floor(place * F.least(F.col("blocks"), F.lit(RANGES)) / RANGES).cast("int") * shares + F.pmod(F.xxhash64("v", "key"), shares).cast("int")
    return large.join(cuts, "key").withColumn("home", home).withColumn("blocks", F.least(F.col("blocks"), F.lit(RANGES)) * shares).drop("cuts")


def region_links(
    rows: DataFrame, dense: int, within: Callable[[pa.Table, np.ndarray], np.ndarray], cross: Callable[[pa.Table, pa.Table], np.ndarray], attach: Callable[[DataFrame], DataFrame] = lambda df: df, deeper: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Links (a, b) that connect whatever is alike among rows (key, v, o) of one key, a region; ``o`` sorts a region such that what is alike stands together.

    Regions of up to ``dense`` are compared whole: ``within`` labels the rows of a table by groups (given their starts). Larger ones are
    compared in blocks of neighbours in sorted order, which share a few leaders. Then, where no more than one in ``APART`` is outside its region's largest component, these
    meet all its blocks (``cross`` gives a matrix for two tables), so every pair of the region has met or hangs together anyway. Other regions hold much that is unlike: their rows (v) are
    given to ``deeper``, which links them by finer regions, or, where there is none, handled alike. ``attach`` adds what the comparisons need to rows with ``v``.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("first")).filter("size > 1")
    blocks = F.ceil(F.col("size") / dense).cast("int")
    leads = (F.col("v") == F.col("first")) | (F.pmod(F.xxhash64(F.lit(3), "v", "key"), F.col("size")) < LEADERS)
    placed = materialize(rows.join(sizes, "key").select("key", "v", "o", "size", blocks.alias("blocks"), leads.alias("leads")))
    large = placed.filter("blocks > 1")
    small = placed.filter("blocks = 1").select("key", "v", "o", F.lit(0).alias("part"))
    any_large = not large.isEmpty()
    if any_large:
        large = materialize(by_order(large))
        to = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
        small = small.unionByName(large.select("key", "v", "o", F.explode(to).alias("part")))
    dealt = attach(small).repartition("key", "part").sortWithinPartitions("key", "part", "o")

    def link(batches):
        for t in groups(batches, ["key", "part"]):
            yield linked_batch(t.column("v").to_numpy(), within(t, starts_of(t, ["key", "part"])))

    links = materialize(dealt.mapInArrow(link, LINK).distinct())
    if not any_large:
        return links
    inside = materialize(large.join(components(links).select("v", "label"), "v", "left").select("key", "v", "home", "blocks", "size", F.coalesce("label", "v").alias("label")))
    main = inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"))
    apart = inside.join(main, "key").filter("label <> main")
    if deeper:
        unlike = APART * (F.col("size") - F.col("most")) > F.col("size")
        open_ = materialize(inside.join(main.drop("main"), "key").filter(unlike).select("v").distinct())
        if not open_.isEmpty():
            links = links.unionByName(deeper(open_))
        apart = apart.filter(~unlike)
    apart = materialize(apart.drop("most"))
    if apart.isEmpty():
        return links
    shares = apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64(F.lit(5), "v"), F.col("shares")).cast("int")
    base = inside.join(shares, "key").select("key", "v", "label", "home", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("asked"))
    asked = apart.join(shares, "key").select("key", "v", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("home"), share.alias("share"), F.lit(True).alias("asked"))
    met = attach(base.unionByName(asked)).repartition("key", "home", "share").sortWithinPartitions("key", "home", "share")

    def meet(batches):
        for t in groups(batches, ["key", "home", "share"]):
            at = starts_of(t, ["key", "home", "share"])
            asks = t.column("asked").to_numpy()
            pairs = [np.zeros((0, 2), np.int64)]
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                own, there = t.take(x + np.flatnonzero(asks[x:y])), t.take(x + np.flatnonzero(~asks[x:y]))
                label, others = own.column("label").to_numpy(), there.column("label").to_numpy()
                for k in range(0, own.num_rows, 512):
                    i, j = np.nonzero(cross(own.slice(k, 512), there) & (label[k : k + 512, None] != others[None]))
                    pairs.append(np.unique(np.stack([label[k + i], others[j]], axis=1), axis=0))
            a, b = np.concatenate(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return links.unionByName(materialize(met.mapInArrow(meet, LINK).distinct()))


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each vertex of a partition's links to the smallest one that it is connected with by them."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        v, place = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        label = settle(len(v), place[: t.num_rows], place[t.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(v[label]), pa.array(v)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the links is connected with.

    Tasks of up to ``LINKS`` links contract what they hold; where there are several, rounds of smallest neighbour and shortcut connect the rest.
    """
    given = materialize(links.select("a", "b"))
    parts = max(1, -(-given.count() // LINKS))
    stars = materialize(given.repartition(parts).mapInArrow(contracted, LINK))
    discard(given)
    if parts == 1:
        return stars.select(F.col("b").alias("v"), F.col("a").alias("label"))
    both = materialize(stars.union(stars.select("b", "a")))
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    table = labels
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("root"))
        new = materialize(step.join(up, "label").select("v", "old", F.least("label", "root").alias("label")))
        changed = not new.filter("label <> old").isEmpty()
        discard(table)
        table, labels = new, new.select("v", "label")
        if not changed:
            discard(both)
            return labels
