"""Vector search by blocks: matrix products in tasks, whose best rows are merged, so that no pair of a query and a row is ever a row of a table.

Vectors come as (id, own, embedding), queries as (query_id, not_own, embedding): a query does not meet rows whose ``own`` equals its ``not_own``. Scores are cosines in
double arithmetic; rows and queries with a null, a null component or no length have none. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries and rows of a block, and scores that a task holds at once.
QUERIES, ROWS, SCORES = 1024, 16384, 1 << 21
HITS = "query_id bigint, id bigint, own bigint, score double"
#: Vectors that lists are fitted on at most, rounds of fitting, and rows of a list on the average.
FITTED, ROUNDS, LISTED = 20_000, 8, 1000


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, of nan where there is none."""
    out = np.full((len(lists), width), np.nan)
    size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    full = np.flatnonzero(size == width)
    if len(full):
        out[full] = np.asarray(lists.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, out / norm, np.nan)


def whole_groups(batches, keys: list[str]):
    """Tables of the rows of each value of ``keys``, from sorted batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        columns = np.stack([t.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((np.diff(columns) != 0).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def hits_batch(query_id: np.ndarray, id_: np.ndarray, own: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    whole = [pa.array(c.astype(np.int64)) for c in (query_id, id_, own)]
    return pa.RecordBatch.from_arrays([*whole, pa.array(score.astype(np.float64))], names=["query_id", "id", "own", "score"])


def meet(t: pa.Table, width: int, k: int, threshold: float) -> pa.RecordBatch:
    """The best ``k`` rows of a block for each query of it."""
    t = t.combine_chunks()
    asks = t.column("asks").to_numpy(zero_copy_only=False)
    asked, given = t.filter(pa.array(asks)).combine_chunks(), t.filter(pa.array(~asks)).combine_chunks()
    order = np.argsort(given.column("id").to_numpy(), kind="stable")
    ids, own = given.column("id").to_numpy()[order], given.column("own").to_numpy()[order]
    rows, queries = matrix(given.column("embedding").combine_chunks(), width)[order], matrix(asked.column("embedding").combine_chunks(), width)
    query_id, not_own = asked.column("id").to_numpy(), asked.column("own").to_numpy()
    of, at, scores = [], [], []
    step = max(1, SCORES // max(1, len(ids)))
    for first in range(0, len(queries), step):
        for j, s in enumerate(queries[first : first + step] @ rows.T, first):
            good = np.flatnonzero((s >= threshold) & (own != not_own[j]))
            if len(good) > 4 * k:
                good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
            best = good[np.argsort(-s[good], kind="stable")[:k]]
            of.append(np.full(len(best), j))
            at.append(best)
            scores.append(s[best])
    of, at, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, at, scores))
    return hits_batch(query_id[of], ids[at], own[at], scores)


def meet_groups(t: pa.Table, width: int, threshold: float) -> pa.RecordBatch:
    """The best row of each ``own`` of a block for each query of it."""
    t = t.combine_chunks()
    asks = t.column("asks").to_numpy(zero_copy_only=False)
    asked, given = t.filter(pa.array(asks)).combine_chunks(), t.filter(pa.array(~asks)).combine_chunks()
    order = np.lexsort((given.column("id").to_numpy(), given.column("own").to_numpy()))
    ids, own = given.column("id").to_numpy()[order], given.column("own").to_numpy()[order]
    rows, queries = matrix(given.column("embedding").combine_chunks(), width)[order], matrix(asked.column("embedding").combine_chunks(), width)
    query_id, not_id = asked.column("id").to_numpy(), asked.column("own").to_numpy()
    first = np.append(np.flatnonzero(np.diff(own, prepend=own[0] - 1)), len(own)) if len(own) else np.zeros(1, np.int64)
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for j in range(len(queries) if len(own) else 0):
        s = np.where(ids == not_id[j], -np.inf, np.nan_to_num(queries[j] @ rows.T, nan=-np.inf))
        most = np.maximum.reduceat(s, first[:-1])
        at = np.flatnonzero(s == most[group])
        at = at[np.unique(group[at], return_index=True)[1]]  # the smallest id of equals
        at = at[s[at] >= threshold]
        out.append((np.full(len(at), query_id[j]), ids[at], own[at], s[at]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    return hits_batch(*columns)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each query, of the best of each block; Spark drops what is not among the best before it shuffles."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def sides(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    row = lambda i, own, asks: (F.col(i).cast("bigint").alias("id"), F.col(own).cast("bigint").alias("own"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(asks).alias("asks"))
    return vectors.filter("id is not null and embedding is not null").select(*row("id", "own", False)), queries.filter("query_id is not null and embedding is not null").select(*row("query_id", "not_own", True))


def in_blocks(vectors: DataFrame, queries: DataFrame, work) -> DataFrame:
    """What ``work`` (table, width) finds where each block of queries meets each block of rows."""
    rows, asked = sides(vectors, queries)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width, r, q = n["width"] or 0, max(1, -(-n["n"] // ROWS)), max(1, -(-asked.count() // QUERIES))
    home = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = asked.select("*", home("id", q).alias("a"), every(r).alias("r")).unionByName(rows.select("*", every(q).alias("a"), home("id", r).alias("r")))
    dealt = dealt.repartition("a", "r").sortWithinPartitions("a", "r")
    return dealt.mapInArrow(lambda batches: (work(t, width) for t in whole_groups(batches, ["a", "r"])), HITS)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, own, score) of the ``k`` nearest rows at or above the threshold."""
    return merged(in_blocks(vectors, queries, lambda t, width: meet(t, width, k, threshold)), k)


def best_of_each(vectors: DataFrame, queries: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(query_id, own, id, score): the nearest row of every ``own``, where it is at or above the threshold; here a query (query_id, not_own, embedding) does not meet the row
    whose id is its ``not_own``."""
    hits = in_blocks(vectors, queries, lambda t, width: meet_groups(t, width, threshold))
    best = hits.groupBy("query_id", "own").agg(F.max(F.struct("score", (-F.col("id")).alias("order"))).alias("b"))
    return best.select("query_id", "own", (-F.col("b.order")).alias("id"), F.col("b.score").alias("score"))


def best_products(chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, product_id, score) of the ``k`` nearest products, from candidate chunks (query_id, id, product_id, score), of which the best of each product counts. The
    score is rounded last."""
    best = chunks.groupBy("query_id", "product_id").agg(F.max(F.struct("score", (-F.col("id")).alias("order"))).alias("b"))
    best = best.select("query_id", "product_id", (-F.col("b.order")).alias("id"), F.col("b.score").alias("score"))
    return merged(best, k).select("query_id", "product_id", F.round("score", 4).alias("score"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(own, embedding) of the mean vector of each ``own``, from sums that tasks add up by place."""
    parts = vectors.select("own", F.posexplode("embedding").alias("pos", "x")).groupBy("own", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return parts.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("pos", "mean")))["mean"].alias("embedding"))


def similar_products(vectors: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(product_id, similar_id, score): each product's mean vector against the chunks (id, own, embedding) of all others; candidates are the best ``3 * k`` chunks."""
    asked = centroids(vectors).select(F.col("own").alias("query_id"), F.col("own").alias("not_own"), "embedding")
    found = best_products(nearest(vectors, asked, 3 * k, threshold).withColumnRenamed("own", "product_id"), k)
    return found.select(F.col("query_id").alias("product_id"), F.col("product_id").alias("similar_id"), "score")


def fit_lists(vectors: DataFrame, lists: int) -> np.ndarray:
    """Unit centers of ``lists`` lists, fitted on at most ``FITTED`` vectors, chosen by hash of the id."""
    sample = vectors.filter("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(FITTED).select(F.col("embedding").cast("array<double>").alias("embedding"))
    found = pa.Table.from_batches(sample.toArrow().to_batches()) if not sample.isEmpty() else None
    if found is None:
        return np.zeros((1, 0))
    column = found.column("embedding").combine_chunks()
    x = matrix(column, int(pc.max(pc.list_value_length(column)).as_py()))
    x = x[~np.isnan(x).any(axis=1)]
    centers = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        best = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, best, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


def write_lists(vectors: DataFrame, root: str, lists: int | None = None) -> None:
    """Store vectors (id, own, embedding) by the list of the nearest center: inverted lists. All rows are stored; those without a vector are in list -1."""
    n = vectors.count()
    centers = fit_lists(vectors, lists or max(1, min(4096, -(-n // LISTED))))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centers)  # at most 4096 vectors

    def place(batches):
        c = shared.value
        for b in batches:
            x = matrix(b.column("embedding"), c.shape[1])
            s = x @ c.T
            best = np.where(np.isnan(s).any(axis=1), -1, s.argmax(axis=1)) if c.size else np.full(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32))], names=["id", "own", "embedding", "list"])

    given = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("own").cast("bigint").alias("own"), F.col("embedding").cast("array<double>").alias("embedding"))
    placed = given.mapInArrow(place, "id bigint, own bigint, embedding array<double>, list int")
    placed.repartitionByRange("list", "id").write.partitionBy("list").parquet(f"{root}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").write.parquet(f"{root}/centers")


def search_lists(spark: SparkSession, root: str, queries: DataFrame, k: int, threshold: float = 0.0, probes: int = 8) -> DataFrame:
    """(query_id, id, own, score) of the nearest rows in the ``probes`` lists whose centers are nearest to each query: most of the nearest ``k``, not always all."""
    centers = np.array([r["center"] for r in spark.read.parquet(f"{root}/centers").orderBy("list").collect()])  # at most 4096 vectors
    stored = spark.read.schema("id bigint, own bigint, embedding array<double>, list int").parquet(f"{root}/rows").filter("list >= 0")
    shared, width = spark.sparkContext.broadcast(centers), centers.shape[1] if centers.size else 0

    def choose(batches):
        c = shared.value
        for b in batches:
            s = np.nan_to_num(matrix(b.column("embedding"), c.shape[1]) @ c.T, nan=-2)
            best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([*(x.take(row) for x in b.columns), pa.array(best.ravel().astype(np.int32))], names=["id", "own", "embedding", "asks", "list"])

    rows, asked = sides(stored.select("id", "own", "embedding"), queries)
    asked = asked.mapInArrow(choose, "id bigint, own bigint, embedding array<double>, asks boolean, list int")
    # A list with more rows than a block is dealt in shares by hash; queries meet each share.
    shares = stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("shares"))
    given = stored.select("id", "own", "embedding", F.lit(False).alias("asks"), "list").join(shares, "list").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).drop("shares")
    met = asked.join(shares, "list").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = given.join(asked.select("list").distinct(), "list", "left_semi").unionByName(met).repartition("list", "share").sortWithinPartitions("list", "share")
    return merged(dealt.mapInArrow(lambda batches: (meet(t, width, k, threshold) for t in whole_groups(batches, ["list", "share"])), HITS), k)
