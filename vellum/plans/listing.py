"""Queries of listings, views, summaries and images, each with the same query in SQL. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import numeric
from vellum.operators import catalog as ops
from vellum.operators import documents as docs
from vellum.operators import ingest, listing, registry
from vellum.plans.catalog import query
from vellum.sources import catalog as src


@query("srt01_sorted", "SELECT id, title, total, pages FROM (SELECT id, title, count(*) OVER () AS total, CAST(greatest(ceil(count(*) OVER () / 30), 1) AS BIGINT) AS pages FROM items) ORDER BY title DESC NULLS LAST, id LIMIT 30 OFFSET 60", "items")
def srt01(s, d):
    return listing.page_of(src.items(s, d).select("id", "title"), listing.order_by("title", descending=True), 3, 30)


@query("srt02_pages", "SELECT id, level_min, total, pages FROM (SELECT id, level_min, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 7) AS BIGINT) AS pages FROM items) ORDER BY level_min NULLS FIRST, id LIMIT 7", "items")
def srt02(s, d):
    return listing.page_of(src.items(s, d).select("id", "level_min"), listing.order_by("level_min", among=["level_min"]), 0, 7)


@query("flt14_type_ahead", "SELECT publisher AS value, count(*) AS n FROM products WHERE contains(lower(publisher), 'c1') GROUP BY 1 ORDER BY n DESC, value LIMIT 10", "products")
def flt14(s, d):
    return listing.type_ahead(src.products(s, d), "publisher", "C1")


@query("srt05_top", "SELECT publisher AS value, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, value LIMIT 20", "items")
def srt05(s, d):
    return ops.facet_counts(src.items(s, d), "publisher", top=20)


@query("srt07_latest", "SELECT o_orderkey AS id, o_orderdate::VARCHAR AS ordered_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def srt07(s, d):
    found = listing.latest(src.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", 20)
    return found.select("id", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered_at"))


@query("srt08_lists", "SELECT r_name AS category, n_name AS name, row_number() OVER (PARTITION BY r_name ORDER BY n_name, n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def srt08(s, d):
    rows = src.read(s, d, "nation").join(src.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category"), F.col("n_name").alias("name"), "n_nationkey")
    return listing.placed(rows, "category", "name", "n_nationkey").drop("n_nationkey")


@query("srt09_samples", "SELECT id, title FROM items WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) ORDER BY id LIMIT 20", "items")
def srt09(s, d):
    matched = src.read(s, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return listing.sample_of(src.items(s, d).select("id", "title").join(matched, "id", "left_anti"), 20)


@query("set03_missing_ids", "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def set03(s, d):
    there = src.read(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return listing.missing_ids(src.read(s, d, "events").select(F.col("user_id").alias("id")), there)


@query("set04_distinct", "SELECT DISTINCT user_id FROM events")
def set04(s, d):
    return src.read(s, d, "events").select("user_id").distinct()


@query("agg20_outcomes", """, o AS (SELECT id, CASE id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'synced' END AS outcome FROM products)
    SELECT outcome, count(*) AS n, array_to_string(list(id ORDER BY id)[1:20], ',') AS details FROM o GROUP BY outcome UNION ALL SELECT 'refused', 0, ''""", "products")  # fmt: skip
def agg20(s, d):
    outcome = F.when(F.col("id") % 5 == 0, "failed").when(F.col("id") % 5 == 1, "skipped").otherwise("synced")
    return listing.outcome_summary(src.products(s, d).select("id", outcome.alias("state")), "state", ["synced", "failed", "skipped", "refused"], F.col("id").cast("string"))


ENTRIES_SQL = "entries AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE p_brand END AS publisher, p_size % 4 AS files FROM part)"


def entries(s, d):
    blank = F.when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.col("p_brand"))
    files = F.when(F.col("p_size") % 4 > 0, F.array_repeat(F.lit("f"), (F.col("p_size") % 4).cast("int"))).otherwise(F.array().cast("array<string>"))
    return src.read(s, d, "part").select(F.col("p_partkey").alias("id"), blank.alias("publisher"), files.alias("filenames"))


@query("agg11_exports", f"WITH {ENTRIES_SQL} SELECT count(*) AS products, CAST(sum(files) AS BIGINT) AS files, count(DISTINCT nullif(trim(publisher), '')) AS publishers FROM entries")
def agg11(s, d):
    return listing.export_totals(entries(s, d))


@query("agg11_publishers", f"WITH {ENTRIES_SQL} SELECT coalesce(nullif(trim(publisher), ''), 'Unknown') AS value, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def agg11_publishers(s, d):
    named = entries(s, d).select(F.nullif(F.trim("publisher"), F.lit("")).alias("publisher"))
    return ops.facet_counts(named, "publisher", keep_null=True, top=20)


@query(
    "prj01_product_view",
    """, t AS (SELECT product_id AS id, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id::VARCHAR) AS tags FROM links GROUP BY 1),
    v AS (SELECT *, CASE WHEN size % 3 = 0 THEN '/c/' || id END AS cover_url, CASE WHEN size % 5 = 0 THEN 'completed' END AS run_state, CASE WHEN size % 7 = 0 THEN size % 5 + 1 END AS run_rating FROM items)
    SELECT id, title, CASE WHEN level_min IS NOT NULL OR level_max IS NOT NULL THEN coalesce(level_min::VARCHAR, '?') || '-' || coalesce(level_max::VARCHAR, '?') END AS levels, cover_url IS NOT NULL AS has_cover, size % 2 = 0 AS has_text, size % 4 = 0 AS in_search,
      run_state IS NOT NULL OR run_rating IS NOT NULL AS has_run, run_state, run_rating, coalesce(tags, '') AS tags, coalesce(cover_url, '/covers/' || id || '.jpg') AS cover FROM v LEFT JOIN t USING (id)""",
    "items", "links",
)
def prj01(s, d):
    size = F.col("size")
    cover, rating = F.when(size % 3 == 0, F.concat(F.lit("/c/"), "id")), F.when(size % 7 == 0, size % 5 + 1)
    i = src.items(s, d).withColumns({"cover_url": cover, "text_extracted": size % 2 == 0, "indexed": size % 4 == 0, "run_state": F.when(size % 5 == 0, "completed"), "run_rating": rating, "run_at": F.lit(None).cast("timestamp")})
    names = src.read(s, d, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.col("s_suppkey").cast("string").alias("name"))
    tags = ops.tags_of(i.select("id"), src.links(s, d), names).select("id", "tags")
    st, run = "processing_status", F.col("run_status")
    return listing.product_view(i, tags).select(
        "id", "title", "levels", F.col(f"{st}.cover").alias("has_cover"), F.col(f"{st}.text").alias("has_text"), F.col(f"{st}.search").alias("in_search"), run.isNotNull().alias("has_run"),
        run["state"].alias("run_state"), run["rating"].alias("run_rating"), F.array_join("tags", ",").alias("tags"), "cover",
    )


@query("prj06_progress", "SELECT product_id, CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (status = 'completed') / count(*), 1) END AS percent FROM queue GROUP BY 1", "queue")
def prj06(s, d):
    return listing.progress(src.queue(s, d), "product_id", F.col("status") == "completed")


IMAGES_SQL = """images AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_suppkey AS pos, l_partkey % 3 AS hash, l_quantity * 30 + 0.371 AS width, l_partkey % 600 + 50 AS height, ['png', 'jpeg'][l_suppkey % 2 + 1] AS format, l_tax * 12 AS page_share FROM lineitem),
  inv AS (SELECT * FROM images WHERE width >= 100 AND height >= 100 QUALIFY row_number() OVER (PARTITION BY doc, hash ORDER BY page, pos, width, height, page_share) = 1)"""
MAP_SQL = "width >= 200 AND height >= 200 AND width / height BETWEEN 0.5 AND 3 AND width * height >= 100000"


def images(s, d):
    fmt = F.element_at(F.array(F.lit("png"), F.lit("jpeg")), (F.col("l_suppkey") % 2 + 1).cast("int"))
    return src.read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("pos"), (F.col("l_partkey") % 3).alias("hash"), (F.col("l_quantity") * 30 + 0.371).alias("width"),
        (F.col("l_partkey") % 600 + 50).alias("height"), fmt.alias("format"), (F.col("l_tax") * 12).alias("page_share"),
    )


@query("win05_first_images", f"WITH {IMAGES_SQL} SELECT doc, hash, page, pos FROM inv")
def win05(s, d):
    return listing.image_inventory(images(s, d)).select("doc", "hash", "page", "pos")


@query("txt15_images", f"WITH {IMAGES_SQL} SELECT doc, hash, round(width / height, 2) AS aspect, {MAP_SQL} AS likely_map, page_share >= 0.8 AS full_page FROM inv")
def txt15(s, d):
    return listing.image_inventory(images(s, d)).select("doc", "hash", "aspect", "likely_map", "full_page")


@query(
    "agg17_statistics",
    f"""WITH {IMAGES_SQL}, f AS (SELECT doc, string_agg(format || ':' || n, ',' ORDER BY format) AS formats FROM (SELECT doc, format, count(*) AS n FROM inv GROUP BY ALL) GROUP BY doc)
    SELECT doc, count(*) AS n, count(*) FILTER ({MAP_SQL}) AS maps, count(*) FILTER (page_share >= 0.8) AS full_pages, CAST(floor(avg(width)) AS BIGINT) AS width, CAST(floor(avg(height)) AS BIGINT) AS height, any_value(formats) AS formats
    FROM inv JOIN f USING (doc) GROUP BY doc""",
)
def agg17(s, d):
    return listing.image_statistics(listing.image_inventory(images(s, d))).withColumn("formats", F.array_join("formats", ","))


@query("str10_codes", """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'med' WHEN 1 THEN 'lg' WHEN 2 THEN 'tiny' ELSE 'med' END AS size,
    CASE WHEN contains(lower(p_type), 'large') THEN 'weapon' WHEN contains(lower(p_type), 'small') THEN 'trinket' ELSE 'loot' END AS kind FROM part""")  # fmt: skip
def str10(s, d):
    raw = F.element_at(F.array(*map(F.lit, ("Medium", " LARGE ", "tiny", "vast"))), F.col("p_size") % 4 + 1)
    kind = registry.code_by_word(F.col("p_type"), {"large": "weapon", "small": "trinket"}, "loot")
    return src.read(s, d, "part").select(F.col("p_partkey").alias("id"), registry.code_of(raw, docs.SIZE_CODES, "med").alias("size"), kind.alias("kind"))


@query("dte01_property_year", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 AND year(o_orderdate) + (o_orderkey % 3) * 20 BETWEEN 1970 AND 2030 THEN CAST(year(o_orderdate) + (o_orderkey % 3) * 20 AS INTEGER) END AS year FROM orders")
def dte01(s, d):
    year = (F.year("o_orderdate") + F.col("o_orderkey") % 3 * 20).cast("string")
    raw = F.when(F.col("o_orderkey") % 4 < 2, F.concat(F.lit("D:"), year, F.lit("0102"))).when(F.col("o_orderkey") % 4 == 2, "D:none")
    return src.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), registry.property_year(raw).alias("year"))


@query("dte03_first_day", "SELECT o_orderkey AS id, year(o_orderdate) || '-01-01' AS day FROM orders")
def dte03(s, d):
    return src.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), registry.first_of_year(F.year("o_orderdate")).alias("day"))


@query("arr02_suggested", "SELECT p_partkey AS id, p_name || CASE WHEN p_size % 2 = 0 THEN ',' || p_brand ELSE '' END || ',' || p_type AS tags FROM part")
def arr02(s, d):
    none = F.lit(None).cast("array<string>")
    answer = F.struct(F.array("p_name").alias("themes"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("content_types"), none.alias("settings"), F.array("p_type").alias("tone"))
    return src.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(registry.suggested(answer), ",").alias("tags"))


@query("map01_merged", "SELECT p_partkey AS id, p_name AS a, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS b, CASE WHEN p_size % 2 = 0 THEN 'c' END AS c FROM part")
def map01(s, d):
    first = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_brand"))
    second = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("b"), F.col("p_type"), F.lit("c"), F.lit("c")))
    both = src.read(s, d, "part").select(F.col("p_partkey").alias("id"), registry.merged_maps(first, second).alias("m"))
    return both.select("id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("flt10_stuck_rows", "SELECT id FROM queue WHERE status = 'processing' AND (started_at < TIMESTAMP '2024-01-15' OR started_at IS NULL)", "queue")
def flt10(s, d):
    return ingest.stuck(src.queue(s, d), F.expr("timestamp'2024-01-15 00:00:00'")).select("id")


@query("flt13_next_batch", "SELECT id FROM queue WHERE status = 'pending' AND attempts < 4 ORDER BY created_at, id LIMIT 50", "queue")
def flt13(s, d):
    return ingest.retry_eligible(src.queue(s, d), most=4).select("id")


@query("mth06_aspect", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE round(p_partkey / (p_size % 5), 2) END AS aspect FROM part")
def mth06(s, d):
    return src.read(s, d, "part").select(F.col("p_partkey").alias("id"), numeric.aspect_ratio(F.col("p_partkey"), F.col("p_size") % 5).alias("aspect"))
