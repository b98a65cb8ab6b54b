"""Keyword and vector search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import cosine, dot, unit
from vellum.functions.text import tokens
from vellum.operators.catalog import facet
from vellum.sources.shared import new_folder

K1, B = 1.2, 0.75


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(docs: DataFrame, fields: list[str], query: str) -> DataFrame:
    """(id, score) without an index: every word of the query is a prefix, words are alternatives. Counts stay in the rows of their
    documents, so nothing but totals is shuffled. Texts are cut to words once: the counts are written, and totals and hits come from them."""
    words = query_words(query)
    text = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    begins = lambda word: F.size(F.filter("t", lambda x: F.startswith(x, F.lit(word))))
    counted = docs.select("id", tokens(text).alias("t")).select("id", F.size("t").alias("len"), *(begins(w).alias(f"tf{i}") for i, w in enumerate(words)))
    at = new_folder(docs.sparkSession, "counts")
    counted.write.parquet(at)
    counts = docs.sparkSession.read.schema(counted.schema).parquet(at).filter("len > 0")
    totals = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    parts = [idf(F.col("n_docs"), F.col(f"df{i}")) * weight(F.col(f"tf{i}"), F.col("len"), F.col("avg_len")) for i in range(len(words))]
    hits = counts.filter(reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(words))), F.lit(False)))
    return hits.crossJoin(F.broadcast(totals)).select("id", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"))  # one row of totals


def visible(products: DataFrame, **facets: str | None) -> DataFrame:
    """Products without duplicates and missing ones, by facets."""
    return facet(products.filter("duplicate_of is null and not is_missing"), **facets)


def visible_hits(hits: DataFrame, products: DataFrame, **facets: str | None) -> DataFrame:
    """Hits (id, score) with the columns of their visible products."""
    return hits.join(visible(products, **facets), "id")


def best_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by score, to six decimals so that equal scores tie, then by id."""
    return hits.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(n)


def matching_lines(docs: DataFrame, query: str, most: int = 3, longest: int = 300, around: int = 100) -> DataFrame:
    """The first lines of each text that hold the query, with the line before and after; a context of over ``longest`` characters is cut to
    what is up to ``around`` characters from the hit in its line. Only texts that hold the query are split, and only hits leave their row."""
    low = query.lower()
    lines = docs.filter(F.contains(F.lower("text"), F.lit(low))).select("id", F.split("text", "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.when(F.contains(F.lower(x), F.lit(low)), i))
    hits = lines.withColumn("at", F.slice(F.array_compact(numbered), 1, most))
    near = lambda i: F.array_join(F.slice("lines", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), "\n")
    cut = hits.select("id", F.explode(F.transform("at", lambda i: F.struct(i.alias("line_no"), F.get("lines", i).alias("line"), near(i).alias("near")))).alias("h")).select("id", "h.*")
    at = F.locate(low, F.lower("line"))
    begin = F.greatest(at - around, F.lit(1))
    context = F.when(F.length("near") > longest, F.substr("line", begin, at + len(query) + around - begin)).otherwise(F.col("near"))
    return cut.select("id", "line_no", context.alias("context"))


def similar(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.0) -> DataFrame:
    """The ``k`` nearest vectors by cosine at or above the threshold."""
    q = F.array(*map(F.lit, query))
    scored = vectors.withColumn("score", cosine(F.col("embedding"), q)).filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def scores(vectors: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every row of ``queries`` (query_id and a vector) against every row of ``vectors``, with ``score``, the cosine.

    Spark compares blocks of the one with blocks of the other, or sends the queries to all tasks where they are small.
    """
    asked = queries.select("query_id", unit(F.col(vector)).alias("__q"))
    pairs = vectors.withColumn("__v", unit(F.col(vector))).drop(vector).crossJoin(asked)
    return pairs.withColumn("score", dot(F.col("__v"), F.col("__q"))).drop("__v", "__q")


def best_chunks(scored: DataFrame, *by: str) -> DataFrame:
    """Best chunk per product (and per value of the columns ``by``)."""
    best = scored.groupBy(*by, "product_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select(*by, "product_id", F.col("b.id").alias("id"), F.col("b.score").alias("score"))


def centroids(vectors: DataFrame) -> DataFrame:
    """(product_id, pos, mean) of the vectors of each product."""
    return vectors.select("product_id", F.posexplode("embedding").alias("pos", "x")).groupBy("product_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def top(scored: DataFrame, k: int, *by: str, threshold: float = 0.0) -> DataFrame:
    """The ``k`` best rows by score, at or above the threshold, of each value of the columns ``by``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.filter(F.col("score") >= threshold).withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def without_product(vectors: DataFrame, product_id: int) -> DataFrame:
    return vectors.filter(F.col("product_id") != product_id)


def snippets(docs: DataFrame, query: str, width: int = 32, mark: bool = True, around: int = 4) -> DataFrame:
    """(id, snippet) of texts with a word that begins with the query: ``width`` words from ``around`` before the first hit of the densest such window,
    the earliest of equals; hits are marked and cuts shown by dots."""
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    hit = lambda w: F.startswith(F.lower(w), F.lit(query.lower()))
    rows = docs.select("id", words.alias("words")).withColumn("hits", F.filter(F.transform("words", lambda w, i: F.when(hit(w), i + 1)), lambda i: i.isNotNull())).filter("size(hits) > 0")
    # One pass over the hits: the window of hits grows where a hit fits and moves on by one where it does not, so it never shrinks below the best.
    nth = lambda i: F.get(F.col("hits"), i)
    state = F.struct(F.lit(0).alias("low"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def step(acc: Column, k: Column) -> Column:
        low = acc["low"] + F.when(nth(k) - nth(acc["low"]) >= width, 1).otherwise(0)
        more = k - low + 1 > acc["best"]
        return F.struct(low.alias("low"), F.when(more, k - low + 1).otherwise(acc["best"]).alias("best"), F.when(more, low).otherwise(acc["at"]).alias("at"))

    densest = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), state, step, lambda acc: acc["at"])
    rows = rows.withColumn("at", nth(densest)).drop("hits")
    start = F.greatest(F.col("at") - around, F.lit(1))
    cut = F.slice("words", start, F.lit(width))
    if not mark:
        return rows.select("id", F.array_join(cut, " ").alias("snippet"))
    marked = F.array_join(F.transform(cut, lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
    return rows.select("id", F.concat(F.when(start > 1, "...").otherwise(""), marked, F.when(start + width <= F.size("words"), "...").otherwise("")).alias("snippet"))
