"""Queries of keyword and vector search, each with the same query in SQL. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import keyword_index, search, substrings
from vellum.operators import vectors as vec
from vellum.plans.catalog import query
from vellum.sources import catalog as src
from vellum.sources.shared import new_folder, stored_once

FIELDS = ["title", "publisher", "text"]


def hits_sql(words: list[str], source: str = "products") -> str:
    """CTEs ending in ``hits`` (id, score)."""
    return f"""t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || publisher || ' ' || text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM {source}),
    l AS (SELECT id, count(*) AS len FROM t GROUP BY id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
    h AS (SELECT id, w, count(*) AS tf FROM t, (VALUES {', '.join(f"('{w}')" for w in words)}) q(w) WHERE starts_with(term, w) GROUP BY id, w), f AS (SELECT w, count(*) AS df FROM h GROUP BY w),
    hits AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM h JOIN f USING (w) JOIN l USING (id), c GROUP BY id)"""


def index(s, d, asked):
    """A search in the stored index of the catalog, which the first one builds."""
    root = stored_once(src.read(s, d, "documents"), f"keyword-index-{keyword_index.LAYOUT}", lambda at: keyword_index.write(src.products(s, d), FIELDS, at))
    return keyword_index.Search(s, root, asked)


def texts(s, d):
    """The folder of stored texts with bitmaps, which the first search fills."""
    return stored_once(src.read(s, d, "documents"), f"texts-{substrings.LAYOUT}", lambda at: substrings.write(src.products(s, d), at))


VISIBLE = "shown AS (SELECT id, title, system FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, id) AS k FROM products WHERE NOT is_missing) WHERE k = 1)"


def shown(s, d):
    from vellum.operators.catalog import canonical

    return canonical(src.products(s, d))


@query("jn18_visible_hits", f", {hits_sql(['ein'])}, {VISIBLE} SELECT id, score, title FROM hits JOIN shown USING (id) WHERE system = 'de'", "products")
def jn18(s, d):
    return search.visible_hits(index(s, d, "ein").hits(), shown(s, d), system="de").select("id", F.round("score", 6).alias("score"), "title")


@query("srt06_best_hits", f", {hits_sql(['th', 'a'])} SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 20", "products")
def srt06(s, d):
    return search.best_hits(index(s, d, "th a").hits(), 20)


@query("fts07_membership", f", {hits_sql(['en'])} SELECT id, title FROM products WHERE text_extracted AND id IN (SELECT id FROM hits)", "products")
def fts07(s, d):
    p = src.products(s, d)
    return p.filter("text_extracted").join(index(s, d, "en").hits().select("id"), "id", "left_semi").select("id", "title")


def front_door_sql(word: str) -> str:
    return f""", {hits_sql([word.lower()])} SELECT id, 'keyword' AS how FROM hits UNION ALL SELECT id, CASE WHEN contains(lower(title), '{word.lower()}') OR contains(lower(publisher), '{word.lower()}') THEN 'metadata' ELSE 'content' END
    FROM products WHERE (SELECT count(*) FROM hits) = 0 AND (contains(lower(title), '{word.lower()}') OR contains(lower(publisher), '{word.lower()}') OR contains(lower(text), '{word.lower()}'))"""


@query("fts06_front_door", front_door_sql("Tion"), "products")
def fts06(s, d):
    return keyword_index.find(src.products(s, d), index(s, d, "Tion"), substrings.holding(s, texts(s, d), "Tion"), ["title", "publisher"])


@query("fts06_substring", front_door_sql("hing"), "products")
def fts06_substring(s, d):
    return keyword_index.find(src.products(s, d), index(s, d, "hing"), substrings.holding(s, texts(s, d), "hing"), ["title", "publisher"])


@query("fts01_stored_index", f", {hits_sql(['the', 'ein', 'q'])} SELECT id, score FROM hits", "products")
def fts01(s, d):
    at = new_folder(s, "index")
    keyword_index.write(src.products(s, d), FIELDS, at)
    return keyword_index.Search(s, at, "the ein q").hits().select("id", F.round("score", 6).alias("score"))


@query("fts03_ranked", f", {hits_sql(['th', 'ei', 'qu'])}, {VISIBLE} SELECT id, score, title FROM hits JOIN shown USING (id) WHERE system = 'en' ORDER BY score DESC, id LIMIT 25", "products")
def fts03_ranked(s, d):
    """The best visible hits of one system; blocks that cannot hold one are left out."""
    best, _ = index(s, d, "th ei qu").top(25, search.visible(shown(s, d), system="en").select("id", "title"))
    return best


@query("fts03_long_words", f", {hits_sql(['verantwortungsvolle', 'x' * 20, 'de'])} SELECT id, score FROM hits", "products")
def fts03_long_words(s, d):
    return index(s, d, f"verantwortungsvolle {'x' * 20} de").hits().select("id", F.round("score", 6).alias("score"))


LATER = "later AS (SELECT id, title, publisher, text || CASE WHEN id % 10 = 2 THEN ' zebra' ELSE '' END AS text FROM products WHERE id % 10 <> 1)"


@query("fts02_incremental", f", {LATER}, {hits_sql(['zebra', 'the'], 'later')} SELECT id, score FROM hits", "products")
def fts02(s, d):
    """An index of the catalog without some documents; then these are added, changed ones replaced and others taken out."""
    p, old, new = src.products(s, d).select("id", *FIELDS), new_folder(s, "index"), new_folder(s, "index")
    keyword_index.write(p.filter("id % 10 <> 0"), FIELDS, old)
    text = F.concat("text", F.when(F.col("id") % 10 == 2, " zebra").otherwise(""))
    keyword_index.update(s, old, new, p.filter("id % 10 in (0, 2)").withColumn("text", text), FIELDS, p.filter("id % 10 = 1"))
    return keyword_index.Search(s, new, "zebra the").hits().select("id", F.round("score", 6).alias("score"))


VECTORS = "v AS (SELECT vec_id AS id, label AS product_id, embedding::DOUBLE[] AS e FROM embeddings)"


def nearest_sql(k: int, threshold: float, candidates: int) -> str:
    return f"""pairs AS (SELECT q.id AS query_id, v.id, v.product_id, list_cosine_similarity(v.e, q.e) AS score FROM v JOIN v q ON q.id % 100 = 0 AND q.id <> v.id),
    best AS (SELECT * FROM pairs WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {candidates * k}),
    chunk AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, id) = 1),
    nearest AS (SELECT query_id, product_id, round(score, 4) AS score FROM chunk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


def vectors(s, d):
    return src.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("own"), "embedding")


def asked(v):
    """Every row whose id is divisible by 100, as a query that does not meet itself."""
    return v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("not_own"), "embedding")


def by_id(v):
    return v.select("id", F.col("id").alias("own"), "embedding")


def products_of(near, v):
    """Products of the nearest chunks by their ids."""
    return near.join(v.select("id", F.col("own").alias("product_id")), "id")


@query("vec02_top", f"WITH {VECTORS}, {nearest_sql(3, 0.2, 2)} SELECT * FROM nearest")
def vec02(s, d):
    v = vectors(s, d)
    return vec.best_products(products_of(vec.nearest(by_id(v), asked(v), 6, 0.2), v), 3)


@query("vec02_inverted_lists")
def vec02_inverted_lists(s, d):
    """The nearest three rows of each query from inverted lists, most but not always all of the true ones."""
    v, at = vectors(s, d), new_folder(s, "lists")
    vec.write_lists(v, at)
    return vec.search_lists(s, at, asked(v).withColumn("not_own", F.lit(-1)), 3).select("query_id", "id", F.round("score", 4).alias("score"))


@query("vec03_products", """WITH e AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
    c AS (SELECT label, list(m ORDER BY pos) AS v FROM e GROUP BY label),
    s AS (SELECT c.label AS product_id, b.label AS similar_id, b.vec_id AS id, list_cosine_similarity(c.v, b.embedding::DOUBLE[]) AS score FROM c JOIN embeddings b ON c.label <> b.label),
    best AS (SELECT * FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, id) <= 15),
    chunk AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY product_id, similar_id ORDER BY score DESC, id) = 1)
    SELECT product_id, similar_id, round(score, 4) AS score FROM chunk QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, id) <= 5""")
def vec03_products(s, d):
    """Each product's mean vector against the chunks of all others."""
    return vec.similar_products(vectors(s, d), 5, 0.1)


@query("vec04_top", f", {VECTORS}, {nearest_sql(9, 0.2, 3)} SELECT query_id, product_id, score FROM nearest JOIN items i ON i.id = product_id WHERE (level_max >= 2 OR level_max IS NULL) AND (publisher IS NULL OR contains(lower(publisher), 'd#1'))", "items")
def vec04(s, d):
    """Filters apply after ranking: a text that has to be contained, where null passes, and a level range."""
    from vellum.operators.catalog import overlaps

    v = vectors(s, d)
    near = vec.best_products(products_of(vec.nearest(by_id(v), asked(v), 27, 0.2), v), 9)
    wanted = overlaps(src.items(s, d), "level_min", "level_max", low=2).filter(F.coalesce(F.contains(F.lower("publisher"), F.lit("d#1")), F.lit(True)))
    return near.join(wanted.select(F.col("id").cast("int").alias("product_id")), "product_id", "left_semi").select("query_id", "product_id", "score")


@query("srt04_similar", f"WITH {VECTORS}, pairs AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(v.e, q.e) AS score FROM v JOIN v q ON q.id % 100 = 0) SELECT query_id, id FROM pairs WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def srt04(s, d):
    v = by_id(vectors(s, d))
    return vec.nearest(v, asked(v).withColumn("not_own", F.lit(-1)), 5, 0.3).select("query_id", "id")


@query("vec05_without", "SELECT label AS product_id, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1")
def vec05(s, d):
    return search.without_product(vectors(s, d).withColumnRenamed("own", "product_id"), 0).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
