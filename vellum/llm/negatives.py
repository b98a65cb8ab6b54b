"""Hard-negative mining with exact integer scores from a GEMM in a residue number system.

Vectors become integers, floor(256 * x). A score is an integer inner product. Both component matrices are taken modulo several small primes,
with residues around zero, and multiplied in float32: a product of at most ``SPAN`` components stays under 2 ** 24, so float32 is exact; longer vectors go
span by span. The residues of a score give it back, with its sign, by Chinese remaindering in mixed radix. There are as many primes as the
largest component asks for; scores that may leave 63 bits are refused.

Anchors are one in ``EVERY`` ids. Anchors and rows are dealt to blocks by hash of the id; each block of anchors meets each block of rows once, so a
task holds one of either. Two passes select by window: first the best rows of the anchor's label (its positives), then, with their scores known, for each positive the best
rows of other labels whose score lies in its band. In a task every block gives at most as many rows per anchor (or positive) as may be wanted, which go to the windows
instead of scores.

Rows with a null label, vector or id, or with a null or non-finite component take no part; a vector is padded with zeros to the longest. Full repeats of a row
(id, label and vector) are one row. Rows that share an id but not the rest are several; ties between them are broken by label, then vector. Where such rows are
anchors, each one's positives are found and mined, and the first of equal results stays. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.regions import groups, starts_of
from vellum.llm.shared import materialize

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LEAST percent of the positive's and at most MOST.
LEAST, MOST = 80, 100
#: Every so manieth id is mislabelled on purpose, to see what mining finds.
RELABEL, LABELS = 7, 10
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
#: With residues of at most 125, sums of so many products stay under 2 ** 24.
SPAN = 1024
#: Anchors and rows of a block.
ANCHORS, ROWS = 1024, 16384
#: Scores that a task holds at once.
SCORES = 1 << 21


def primes_for(bound: int) -> list[int]:
    """As many primes as hold scores of at most ``bound`` with their sign."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 1 and bound < 1 << 63:
            return list(PRIMES[:n])
    raise ValueError(f"scores of up to {bound} do not fit in a long")


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Integers modulo each prime, around zero, as float32."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their residues: mixed radix digits around zero, from the first prime up."""
    total = np.zeros(parts[0].shape, np.int64)
    radix, digits = 1, []
    for k, (part, p) in enumerate(zip(parts, primes, strict=True)):
        known, r = np.zeros(part.shape, np.int64), 1
        for d, q in zip(digits, primes[:k], strict=True):
            known += d * (r % p)
            r = r * q % p
        digit = (part - known) % p * pow(radix % p, -1, p) % p
        digit -= np.where(digit > p // 2, p, 0)
        digits.append(digit)
        total += digit * radix
        radix *= p
    return total


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of one with all of the other, given by their residues."""
    parts = []
    for x, y, p in zip(a, b, primes, strict=True):
        sums = 0
        for k in range(0, x.shape[1], SPAN):
            sums = sums + (x[:, k : k + SPAN] @ y[:, k : k + SPAN].T).astype(np.int64) % p
        parts.append(np.asarray(sums) % p)
    return reconstruct(parts, primes)


def vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part: whole components, labels changed where ``RELABEL`` divides the id."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    i, name = F.col(f"`{vec_id}`").cast("bigint"), F.col(f"`{label}`").cast("bigint")
    taken = rows.filter(i.isNotNull() & name.isNotNull() & F.col(f"`{vector}`").isNotNull() & F.coalesce(sound, F.lit(False)))
    changed = F.when(F.pmod(i, F.lit(RELABEL)) == 0, (name + 1) % LABELS).otherwise(name)
    return taken.select(i.alias("vec_id"), changed.alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


class Block:
    """Rows (vec_id, label, v) of an Arrow table in order of id, label and vector, full repeats once."""

    def __init__(self, t: pa.Table, width: int, primes: list[int], more: tuple[str, ...] = ()):
        lists = t.column("v").combine_chunks()
        size, at = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
        v = np.zeros((t.num_rows, width), np.int64)
        rows = np.repeat(np.arange(t.num_rows), size)
        v[rows, np.arange(len(rows)) - (at - at[0])[rows]] = lists.flatten().to_numpy()
        whole = lambda c: t.column(c).to_numpy().astype(np.int64)  # noqa: E731  (a table without rows has no type)
        ids, labels, extra = whole("vec_id"), whole("label"), [whole(c) for c in more]
        order = np.lexsort((labels, ids))
        if len(order) > 1 and (np.diff(ids[order]) == 0).any():
            order = np.lexsort((*v.T[::-1], *extra, labels, ids))
            new = np.ones(len(order), bool)
            new[1:] = np.any([np.diff(c[order]) != 0 for c in (ids, labels, *extra)], axis=0) | (v[order][1:] != v[order][:-1]).any(axis=1)
            order = order[new]
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.more = [c[order] for c in extra]
        self.parts = residues(self.v, primes)


def best(score: np.ndarray, take: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores among ``take``, earlier places first on ties."""
    at = np.flatnonzero(take)
    if len(at) > 4 * k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def meetings(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Each block of anchors with each block of rows: (a, r, is_anchor, ...) sorted by block."""
    parts = lambda n, most: max(1, -(-n // most))
    a, r = parts(n_anchors, ANCHORS), parts(n_rows, ROWS)
    home = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.select("*", home(a).alias("a"), every(r).alias("r"), F.lit(True).alias("is_anchor"))
    given = rows.select("*", every(a).alias("a"), home(r).alias("r"), F.lit(False).alias("is_anchor"))
    return asked.unionByName(given, allowMissingColumns=True).repartition("a", "r").sortWithinPartitions("a", "r")


def mine(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(vectors(table, vec_id, vector, label))
    is_anchor = F.pmod("vec_id", F.lit(EVERY)) == 0
    least, most = F.array_min("v"), F.array_max("v")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width"), F.max(F.greatest(-least.cast("decimal(20,0)"), most.cast("decimal(20,0)"))).alias("top")).first()
    width, n, n_anchors = facts["width"] or 0, facts["n"], facts["anchors"]
    primes = primes_for(width * int(facts["top"] or 0) ** 2)
    anchors = rows.filter(is_anchor)

    def positives(batches):
        for t in groups(batches, ["a", "r"]):
            at = starts_of(t, ["a", "r"])
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                part = t.slice(x, y - x)
                asks = part.column("is_anchor")
                own, there = Block(part.filter(asks), width, primes), Block(part.filter(pc.invert(asks)), width, primes)
                found = [[], [], []]
                step = max(1, SCORES // max(1, len(there.ids)))
                for k in range(0, len(own.ids), step):
                    score = products([p[k : k + step] for p in own.parts], there.parts, primes)
                    for j, s in enumerate(score, k):
                        same = there.labels == own.labels[j]
                        self_at = np.flatnonzero(same & (there.ids == own.ids[j]))
                        same[[i for i in self_at.tolist() if (there.v[i] == own.v[j]).all()]] = False
                        b = best(s, same, POSITIVES)
                        found[0].append(np.full(len(b), j))
                        found[1].append(b)
                        found[2].append(s[b])
                if found[0]:
                    j, b, s = map(np.concatenate, found)
                    vs = pa.array(list(own.v[j]), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own.ids[j]), pa.array(own.labels[j]), vs, pa.array(there.ids[b]), pa.array(s)], names=["vec_id", "label", "v", "positive_id", "positive_score"])

    met = meetings(rows, anchors, n, n_anchors).mapInArrow(positives, "vec_id bigint, label bigint, v array<bigint>, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("vec_id", "label", "v").orderBy(F.desc("positive_score"), "positive_id")
    pairs = materialize(met.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= POSITIVES).drop("place"))

    def negatives(batches):
        for t in groups(batches, ["a", "r"]):
            at = starts_of(t, ["a", "r"])
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                part = t.slice(x, y - x)
                asks = part.column("is_anchor")
                own = Block(part.filter(asks), width, primes, ("positive_id", "positive_score"))
                there = Block(part.filter(pc.invert(asks)), width, primes)
                # The positives of one anchor follow each other: they share its scores.
                new = np.ones(len(own.ids), bool)
                new[1:] = (np.diff(own.ids) != 0) | (np.diff(own.labels) != 0) | (own.v[1:] != own.v[:-1]).any(axis=1)
                anchor, of = np.flatnonzero(new), np.cumsum(new) - 1
                ends = np.append(anchor, len(new))
                positive_id, positive_score = own.more
                found = [[], [], []]
                step = max(1, SCORES // max(1, len(there.ids)))
                for k in range(0, len(anchor), step):
                    score = products([p[anchor[k : k + step]] for p in own.parts], there.parts, primes)
                    for j, s in enumerate(score, k):
                        other = there.labels != own.labels[anchor[j]]
                        for i in range(ends[j], ends[j + 1]):
                            band = other & (LEAST * int(positive_score[i]) <= 100 * s) & (100 * s <= MOST * int(positive_score[i]))
                            b = best(s, band, NEGATIVES)
                            found[0].append(np.full(len(b), i))
                            found[1].append(b)
                            found[2].append(s[b])
                if found[0]:
                    i, b, s = map(np.concatenate, found)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own.ids[i], positive_id[i], there.ids[b], positive_score[i], s, of[i])], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score", "of"])

    met = meetings(rows, pairs, n, n_anchors).mapInArrow(negatives, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint, of bigint")
    each = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = met.drop("of").withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The contract's query for DuckDB.
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
