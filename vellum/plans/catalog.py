"""Queries of the catalog operators over the given tables, each with the same query in SQL.

Names begin with the inventory's ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import numeric, text
from vellum.operators import catalog as ops
from vellum.operators import search, substrings
from vellum.sources import catalog as src
from vellum.sources.catalog import ITEMS_SQL, LINKS_SQL, PRODUCTS_SQL, QUEUE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VIEWS = {"products": PRODUCTS_SQL, "items": ITEMS_SQL, "queue": QUEUE_SQL, "links": LINKS_SQL}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function (spark, sf_dir) and its SQL, which may use the named stand-in views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (f"WITH {', '.join(VIEWS[v] for v in views)}{'' if sql[0] == ',' else ' '}" if views else "") + sql
        return f

    return add


@query("src02_fingerprint", "SELECT doc_id, sha256(encode(strlen(text)::VARCHAR) || array_slice(encode(text), 1, 1048576)) AS fingerprint, sha256(text) AS content_sha256 FROM documents")
def fingerprint(s, d):
    content = F.col("text").cast("binary")
    return src.read(s, d, "documents").select("doc_id", src.fingerprint(content, F.octet_length("text")).alias("fingerprint"), F.sha2(content, 256).alias("content_sha256"))


@query("flt01_facet", "SELECT id, publisher FROM products WHERE system IS NULL AND publisher = 'src3'", "products")
def facet(s, d):
    return ops.facet(src.products(s, d), system="Unknown", publisher="src3").select("id", "publisher")


@query("flt02_flags", "SELECT id FROM products WHERE text_extracted AND NOT is_missing", "products")
def flags(s, d):
    return ops.flags(src.products(s, d), text_extracted=True, is_missing=False).select("id")


@query("flt03_range", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def year_range(s, d):
    return ops.in_range(src.read(s, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year")), "year", 1994, 1996)


@query("flt04_overlap", "SELECT id FROM items WHERE (level_max >= 3 OR level_max IS NULL) AND (level_min <= 5 OR level_min IS NULL)", "items")
def overlap(s, d):
    return ops.overlaps(src.items(s, d), "level_min", "level_max", 3, 5).select("id")


@query("flt05_substring", "SELECT id, title FROM items WHERE title ILIKE '%WID%' OR publisher ILIKE '%WID%'", "items")
def substring(s, d):
    return ops.contains_any(src.items(s, d), "WID", "title", "publisher").select("id", "title")


@query("flt06_ordinal", "SELECT o_orderkey FROM orders WHERE CAST(o_orderpriority[1] AS INTEGER) <= 2")
def ordinal(s, d):
    return src.read(s, d, "orders").filter(F.substring("o_orderpriority", 1, 1).cast("int") <= 2).select("o_orderkey")


#: (id, kind, pattern, priority)
RULES = [(1, "folder_name", "blog", 5), (2, "filename", "*[0-9]", 1), (3, "size_min", "900", 9), (4, "regex", r"/(en|de)/", 5), (5, "size_max", "6000", 7), (6, "size_min", "x", 99)]


@query(
    "flt08_first_rule",
    """SELECT page_id, CASE WHEN length(html) < 900 THEN 3 WHEN length(html) > 6000 THEN 5 WHEN list_contains(string_split(url, '/'), 'blog') THEN 1
    WHEN regexp_matches(url, '/(en|de)/') THEN 4 WHEN regexp_matches(string_split(url, '/')[-1], '^.*[0-9]$', 's') THEN 2 END AS rule_id FROM pages""",
)
def first_rule(s, d):
    return src.read(s, d, "pages").select("page_id", ops.first_rule(RULES, F.col("url"), F.length("html")).alias("rule_id"))


@query("agg21_rule_counts", f"SELECT rule_id, count(*) AS n FROM ({ORACLE_SQL['flt08_first_rule']}) WHERE rule_id IS NOT NULL GROUP BY rule_id")
def rule_counts(s, d):
    return first_rule(s, d).filter("rule_id is not null").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_stuck", "SELECT id FROM queue WHERE status = 'processing' AND (started_at < TIMESTAMP '2024-01-15 00:30:00' - INTERVAL 30 MINUTE OR started_at IS NULL)", "queue")
def stuck(s, d):
    return src.queue(s, d).filter((F.col("status") == "processing") & ((F.col("started_at") < F.expr("timestamp'2024-01-15 00:30:00' - interval 30 minutes")) | F.col("started_at").isNull())).select("id")


@query("flt11_length_gates", "SELECT id, n_chars >= 200 AS batch, n_chars >= 100 AS queued FROM (SELECT doc_id AS id, length(text) AS n_chars FROM documents)")
def gates(s, d):
    return src.read(s, d, "documents").select(F.col("doc_id").alias("id"), (F.length("text") >= 200).alias("batch"), (F.length("text") >= 100).alias("queued"))


@query("flt12_violations", """SELECT id, violations FROM (SELECT id, array_to_string(list_filter([CASE WHEN size > 30 THEN 'size' END, CASE WHEN msrp < 905 THEN 'price' END,
    CASE WHEN level_min IS NULL THEN 'level' END], lambda x: x IS NOT NULL), ',') AS violations FROM items) WHERE violations <> ''""", "items")  # fmt: skip
def violations(s, d):
    bad = F.array_compact(F.array(F.when(F.col("size") > 30, "size"), F.when(F.col("msrp") < 905, "price"), F.when(F.col("level_min").isNull(), "level")))
    return src.items(s, d).select("id", F.array_join(bad, ",").alias("violations")).filter("violations <> ''")


@query("flt13_retry", "SELECT id, attempts FROM queue WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, id LIMIT 50", "queue")
def retry(s, d):
    return src.queue(s, d).filter("status = 'pending' and attempts < 3").orderBy("created_at", "id").limit(50).select("id", "attempts")


@query("flt15_equality", "SELECT id FROM queue WHERE status = 'failed' AND task_type = 'click'", "queue")
def equality(s, d):
    return ops.facet(src.queue(s, d), status="failed", task_type="click").select("id")


@query("prj02_titles", """SELECT id, coalesce(nullif(title, ''), file_name) AS shown, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview,
    regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM products""", "products")  # fmt: skip
def titles(s, d):
    return src.products(s, d).select("id", text.display_title(F.col("title"), F.col("file_name")).alias("shown"), text.preview(F.col("text"), 200).alias("preview"), text.stem(F.col("file_name")).alias("stem"))


@query("prj04_levels", "SELECT id, CASE WHEN level_min IS NOT NULL OR level_max IS NOT NULL THEN coalesce(level_min::VARCHAR, '?') || '-' || coalesce(level_max::VARCHAR, '?') END AS levels FROM items", "items")
def levels(s, d):
    return src.items(s, d).select("id", text.level_label(F.col("level_min"), F.col("level_max")).alias("levels"))


@query("jn01_queue_order", "SELECT q.id, c_acctbal FROM queue q JOIN customer ON product_id = c_custkey WHERE status = 'pending'", "queue")
def queue_order(s, d):
    c = src.read(s, d, "customer").select(F.col("c_custkey").alias("product_id"), "c_acctbal")
    return src.queue(s, d).filter("status = 'pending'").join(c, "product_id").select("id", "c_acctbal")


@query("jn02_lookup", "SELECT q.id, c_name FROM queue q LEFT JOIN customer ON product_id = c_custkey", "queue")
def lookup(s, d):
    c = src.read(s, d, "customer").select(F.col("c_custkey").alias("product_id"), "c_name")
    return src.queue(s, d).join(c, "product_id", "left").select("id", "c_name")


def supplier_tags(s, d):
    return src.read(s, d, "supplier").select(F.col("s_suppkey").alias("tag_id"), F.col("s_name").alias("name"))


@query("jn03_tags", """SELECT id, coalesce(array_to_string(list_sort(t), ','), '') AS tags FROM items LEFT JOIN
    (SELECT product_id, list(s_name) AS t FROM links JOIN supplier ON tag_id = s_suppkey GROUP BY 1) ON id = product_id""", "items", "links")  # fmt: skip
def tags(s, d):
    return ops.tags_of(src.items(s, d).select("id"), src.links(s, d), supplier_tags(s, d)).select("id", F.array_join("tags", ",").alias("tags"))


@query("jn04_any_tag", "SELECT id FROM items WHERE id IN (SELECT product_id FROM links WHERE tag_id IN (1, 2, 3))", "items", "links")
def any_tag(s, d):
    return ops.with_any_tag(src.items(s, d), src.links(s, d), [1, 2, 3]).select("id")


@query("jn05_collection", "SELECT product_id, title, sort_order FROM links JOIN items ON product_id = id WHERE tag_id = 5", "items", "links")
def collection(s, d):
    return src.links(s, d).filter("tag_id = 5").join(src.items(s, d).withColumnRenamed("id", "product_id"), "product_id").select("product_id", "title", "sort_order").orderBy("sort_order", "product_id")


@query("jn06_no_open_task", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM queue WHERE product_id = c_custkey AND task_type = 'view' AND status IN ('pending', 'processing'))", "queue")
def no_open_task(s, d):
    return ops.without_open_task(src.read(s, d, "customer").select(F.col("c_custkey").alias("id")), src.queue(s, d), "view")


@query("jn07_not_embedded", "SELECT doc_id FROM documents WHERE n_chars >= 100 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_embedded(s, d):
    return src.read(s, d, "documents").filter("n_chars >= 100").join(src.read(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn13_missing_links", "SELECT id AS product_id, r_regionkey AS tag_id FROM items, region WHERE (id, r_regionkey) NOT IN (SELECT (product_id, tag_id) FROM links)", "items", "links")
def missing_links(s, d):
    # Regions stand for the tags of a request: every product is asked for every one of them, so the result itself is the product of both.
    tags = src.read(s, d, "region").agg(F.collect_list(F.col("r_regionkey").cast("long")).alias("tag_ids"))  # one row
    asked = src.items(s, d).select(F.col("id").alias("product_id")).crossJoin(F.broadcast(tags)).select("product_id", F.explode("tag_ids").alias("tag_id"))
    return asked.join(src.links(s, d), ["product_id", "tag_id"], "left_anti").select("product_id", F.col("tag_id").cast("int").alias("tag_id"))


@query("jn14_campaigns", """SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS sessions, 'Session ' || (max(turn) + 2) AS next FROM conversations GROUP BY conv_id""")
def campaigns(s, d):
    turns = src.read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), ",").alias("roles"), F.size("t").cast("long").alias("sessions"), F.concat(F.lit("Session "), F.element_at("t", -1)["turn"] + 2).alias("next"))


PATTERNS = [("cold", 0.6, 1), ("widget", 0.95, 2), ("hot gadget", 0.8, 3), ("zz", 0.4, 4)]


@query("jn16_fuzzy", """SELECT i.id, p.i AS pattern_id, p.c AS confidence, CASE WHEN p.c > 0.9 THEN 'exact' ELSE 'fuzzy' END AS match_kind
    FROM items i, (VALUES ('cold', 0.6::DOUBLE, 1), ('widget', 0.95::DOUBLE, 2), ('hot gadget', 0.8::DOUBLE, 3)) p(t, c, i)
    WHERE contains(lower(title), p.t) OR contains(p.t, lower(title)) QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY p.c DESC, p.i) = 1""", "items")  # fmt: skip
def fuzzy(s, d):
    patterns = s.createDataFrame(PATTERNS, "pattern string, confidence double, pattern_id int")
    return ops.fuzzy_titles(src.items(s, d).select("id", "title"), "title", patterns).select("id", "pattern_id", "confidence", "match_kind")


@query("jn16_many_patterns", """, p AS (SELECT substr(p_name, CAST(p_partkey % 4 + 1 AS BIGINT), CAST(p_partkey % 9 + 1 AS BIGINT)) AS t, round(0.3 + p_size / 60, 4) AS c, p_partkey AS i FROM part)
    SELECT i.id, p.i AS pattern_id, p.c AS confidence, CASE WHEN p.c > 0.9 THEN 'exact' ELSE 'fuzzy' END AS match_kind
    FROM items i JOIN p ON p.c > 0.5 AND (contains(lower(title), lower(p.t)) OR contains(lower(p.t), lower(title))) QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY p.c DESC, p.i) = 1""", "items")  # fmt: skip
def many_patterns(s, d):
    """As many patterns as titles: pieces of names, of one character to nine."""
    k = F.col("p_partkey")
    patterns = src.read(s, d, "part").select(F.substr("p_name", k % 4 + 1, k % 9 + 1).alias("pattern"), F.round(0.3 + F.col("p_size") / 60, 4).alias("confidence"), k.alias("pattern_id"))
    return ops.fuzzy_titles(src.items(s, d).select("id", "title"), "title", patterns).select("id", "pattern_id", "confidence", "match_kind")


@query("jn17_name_match", """SELECT a.id, count(*) AS copies FROM items a JOIN items b ON
    trim(regexp_replace(lower(regexp_replace(a.file_name, '\\.[^.]*$', '')), '[-_. ]+', ' ', 'g')) = trim(regexp_replace(lower(b.title), '[-_. ]+', ' ', 'g')) GROUP BY a.id""", "items")  # fmt: skip
def name_match(s, d):
    i = src.items(s, d)
    counted = i.groupBy(text.normalize_name(F.concat("title", F.lit(".pdf"))).alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    return i.select("id", text.normalize_name(F.col("file_name")).alias("k")).join(counted, "k").select("id", "copies")


@query("jn19_child_counts", "SELECT r_regionkey AS id, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 = 1 GROUP BY 1")
def child_counts(s, d):
    n = src.read(s, d, "nation").filter("n_nationkey % 4 = 1").select(F.col("n_regionkey").alias("id"))
    return ops.child_counts(src.read(s, d, "region").select(F.col("r_regionkey").alias("id")), n, "id")


@query("agg01_dashboard", """SELECT count(*) AS n, count(*) FILTER (is_missing) AS missing, count(*) FILTER (text_extracted) AS extracted,
    CAST(sum(file_size) AS BIGINT) AS bytes, round(sum(file_size) / 1048576.0, 2) AS mb FROM products""", "products")  # fmt: skip
def dashboard(s, d):
    return src.products(s, d).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_missing").alias("missing"), F.count_if("text_extracted").alias("extracted"), F.sum("file_size").alias("bytes"), numeric.megabytes(F.sum("file_size")).alias("mb")
    )


@query("agg02_facets", "SELECT coalesce(system, 'Unknown') AS value, count(*) AS n FROM products WHERE NOT is_missing GROUP BY 1", "products")
def facets(s, d):
    return ops.facet_counts(src.products(s, d).filter("not is_missing"), "system", keep_null=True)


@query("agg03_facet_table", "SELECT 'publisher' AS dim, publisher AS value, count(*) AS n FROM items GROUP BY 2 UNION ALL SELECT 'product_type', product_type, count(*) FROM items GROUP BY 2", "items")
def facet_table(s, d):
    return ops.facet_table(src.items(s, d), "publisher", "product_type")


DUP_SQL = "SELECT file_hash, arg_min(id, (created_at, id)) AS keep_id, count(*) AS copies, CAST(sum(file_size) - arg_min(file_size, (created_at, id)) AS BIGINT) AS wasted FROM products WHERE NOT is_missing GROUP BY file_hash HAVING count(*) > 1"


@query("agg04_duplicate_groups", DUP_SQL, "products")
def duplicate_groups(s, d):
    return ops.duplicate_groups(src.products(s, d))


@query("agg05_duplicate_stats", f"SELECT count(*) AS groups, CAST(sum(copies - 1) AS BIGINT) AS extra, CAST(sum(wasted) AS BIGINT) AS wasted FROM ({DUP_SQL})", "products")
def duplicate_stats(s, d):
    return duplicate_groups(s, d).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("copies") - 1).alias("extra"), F.sum("wasted").alias("wasted"))


@query("agg06_status", "SELECT " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("pending", "processing", "completed", "failed", "cancelled")) + ", count(*) AS total FROM queue", "queue")
def status(s, d):
    return ops.status_counts(src.queue(s, d), ["pending", "processing", "completed", "failed", "cancelled"])


@query("agg08_coverage", "SELECT count(DISTINCT l.doc_id) AS embedded, count(DISTINCT d.doc_id) - count(DISTINCT l.doc_id) AS missing, round(100.0 * count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 1) AS percent FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(s, d):
    j = src.read(s, d, "documents").select("doc_id").join(src.read(s, d, "labels").select(F.col("doc_id").alias("e")), F.col("doc_id") == F.col("e"), "left")
    c = j.agg(F.countDistinct("e").alias("embedded"), F.countDistinct("doc_id").alias("all"))
    return c.select("embedded", (F.col("all") - F.col("embedded")).alias("missing"), numeric.percent(F.col("embedded"), F.col("all")).alias("percent"))


@query("agg10_removable", "SELECT id FROM queue WHERE status = 'pending' QUALIFY id > min(id) OVER (PARTITION BY product_id, task_type)", "queue")
def removable(s, d):
    q = src.queue(s, d).filter("status = 'pending'")
    return q.join(q.groupBy("product_id", "task_type").agg(F.min("id").alias("kept")), ["product_id", "task_type"]).filter("id > kept").select("id")


@query("agg14_frequent_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND length(line) < 100 GROUP BY line HAVING count(*) > 2")
def frequent_lines(s, d):
    lines = src.read(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter((F.trim("line") != "") & (F.length("line") < 100)).groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


@query("agg16_centroids", "SELECT label AS product_id, pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY ALL")
def centroids(s, d):
    v = src.read(s, d, "embeddings").select(F.col("label").alias("product_id"), "embedding")
    return search.centroids(v).select("product_id", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("agg17_images", """SELECT count(*) AS n, count(*) FILTER (w >= 200 AND h >= 200 AND w / h BETWEEN 0.5 AND 3 AND w * h >= 100000) AS maps, CAST(floor(avg(w)) AS BIGINT) AS width
    FROM (SELECT p_size * 20.0 AS w, p_partkey % 600 + 50.0 AS h FROM part)""")  # fmt: skip
def images(s, d):
    w, h = F.col("p_size") * 20.0, F.col("p_partkey") % 600 + 50.0
    return src.read(s, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(numeric.likely_map(w, h)).alias("maps"), F.floor(F.avg(w)).alias("width"))


@query("mth04_costs", "SELECT doc_id, round((floor(least(length(text), 4000) / 4) + 200) * 0.15 / 1e6 + 150 * 0.6 / 1e6, 8) AS cost, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def costs(s, d):
    return src.read(s, d, "documents").select("doc_id", F.round(numeric.estimate_cost(F.col("text"), "small"), 8).alias("cost"), numeric.estimate_tokens(F.length("text")).alias("tokens"))


@query("mth01_modifiers", "SELECT p_partkey, CAST(floor((p_size - 10) / 2) AS INTEGER) AS modifier, printf('%+d', CAST(floor((p_size - 10) / 2) AS INTEGER)) AS shown FROM part")
def modifiers(s, d):
    m = numeric.ability_modifier(F.col("p_size"))
    return src.read(s, d, "part").select("p_partkey", m.alias("modifier"), numeric.signed(m).alias("shown"))


@query("win01_canonical", """SELECT id, id <> keep AS is_duplicate, CASE WHEN id <> keep THEN keep END AS duplicate_of FROM
    (SELECT id, first_value(id) OVER (PARTITION BY file_hash ORDER BY created_at, id) AS keep FROM products WHERE NOT is_missing)""", "products")  # fmt: skip
def canonical(s, d):
    return ops.canonical(src.products(s, d)).select("id", "is_duplicate", "duplicate_of")


@query("win02_keep_policy", """SELECT id, k = 1 AS keep, CASE WHEN k = 1 THEN CASE WHEN sot THEN 'source of truth' WHEN modified_at IS NOT NULL THEN 'newest' ELSE 'oldest' END END AS reason FROM
    (SELECT *, publisher = 'src2' AS sot, count(*) OVER (PARTITION BY file_hash) AS c,
      row_number() OVER (PARTITION BY file_hash ORDER BY publisher = 'src2' DESC, modified_at DESC NULLS LAST, created_at, id) AS k FROM products) WHERE c > 1""", "products")  # fmt: skip
def keep_policy(s, d):
    return ops.keep_policy(src.products(s, d), "src2").select("id", "keep", "reason")


@query("win03_latest", "SELECT product_id, arg_max(id, (created_at, id)) AS id FROM queue GROUP BY product_id", "queue")
def latest(s, d):
    return src.queue(s, d).groupBy("product_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def outline(s, d):
    rows = src.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    page = F.when(F.col("supp") % 4 != 0, F.col("seq") * 3)
    return rows.select("doc", "seq", (1 + F.col("part") % 4).cast("int").alias("level"), F.concat(F.lit("S"), "part").alias("title"), page.alias("page"))


OUTLINE_SQL = """o AS (SELECT l_orderkey AS doc, l_linenumber AS seq, 1 + min(l_partkey) % 4 AS level, 'S' || min(l_partkey) AS title,
    CASE WHEN min(l_suppkey) % 4 <> 0 THEN l_linenumber * 3 END AS page FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query("win06_chapter_ends", f"WITH {OUTLINE_SQL} SELECT doc, seq, min(page) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS end_page FROM o")
def chapter_ends(s, d):
    return ops.chapter_ends(outline(s, d)).select("doc", "seq", "end_page")


@query(
    "win07_parents",
    f"""WITH {OUTLINE_SQL}, p AS (SELECT a.doc, a.seq, max(b.seq) AS parent_seq FROM o a LEFT JOIN o b ON a.doc = b.doc AND b.seq < a.seq AND b.level < a.level GROUP BY ALL),
    r AS (SELECT o.doc, o.seq, parent_seq, title FROM o JOIN p ON o.doc = p.doc AND o.seq = p.seq)
    SELECT a.doc, a.seq, a.parent_seq, coalesce(coalesce(coalesce(d.title || '/', '') || c.title || '/', '') || b.title || '/', '') || a.title AS path FROM r a LEFT JOIN r b ON b.doc = a.doc AND b.seq = a.parent_seq
      LEFT JOIN r c ON c.doc = b.doc AND c.seq = b.parent_seq LEFT JOIN r d ON d.doc = c.doc AND d.seq = c.parent_seq""",
)
def parents(s, d):
    return ops.outline_parents(outline(s, d)).select("doc", "seq", "parent_seq", "path")


@query("win09_session_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations")
def session_numbers(s, d):
    return src.read(s, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("number"))


@query("srt02_page", "SELECT id, title FROM items ORDER BY title NULLS FIRST, id LIMIT 25 OFFSET 50", "items")
def page(s, d):
    return ops.page(src.items(s, d).select("id", "title"), [F.asc_nulls_first("title"), F.col("id")], 3, 25)


@query("srt03_work_order", "SELECT id, priority FROM queue WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 100", "queue")
def work_order(s, d):
    return src.queue(s, d).filter("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(100).select("id", "priority")


@query("set01_union_hits", """SELECT id, min(src) AS source FROM (SELECT id, 0 AS src FROM products WHERE title ILIKE '%then%' UNION ALL SELECT id, 1 FROM products WHERE text ILIKE '%then%') GROUP BY id""", "products")
def union_hits(s, d):
    p = src.products(s, d)
    hits = ops.contains_any(p, "then", "title").select("id", F.lit(0).alias("source")).unionByName(ops.contains_any(p, "then", "text").select("id", F.lit(1).alias("source")))
    return hits.groupBy("id").agg(F.min("source").alias("source"))


@query("str01_names", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[-_.]', ' ', 'g'), ' +', ' ', 'g')) AS name, regexp_replace(p_name, ' ', '_', 'g') AS safe FROM part")
def names(s, d):
    return src.read(s, d, "part").select("p_partkey", text.normalize_name(F.concat("p_name", F.lit(".pdf"))).alias("name"), text.sanitize(F.col("p_name")).alias("safe"))


@query("str03_clean", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'),
    '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '([a-z,;])\n([a-z])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM pages""")  # fmt: skip
def clean(s, d):
    return src.read(s, d, "pages").select("page_id", F.sha2(text.clean_text(F.col("html")), 256).alias("cleaned"))


@query("dte02_years", """SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE o_orderkey % 4 <> 2""")
def years(s, d):
    o = src.read(s, d, "orders")
    prefix = F.element_at(F.array(*map(F.lit, ("© ", "Published: spring ", "year ", "Copyright "))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    built = F.concat(prefix, F.year("o_orderdate"), F.lit(" text"))
    return o.select("o_orderkey", text.year_of_text(built).cast("long").alias("year")).filter("year is not null")


@query("jsn01_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props(s, d):
    noisy = F.concat(F.lit("reply: "), "props", F.lit(" end"))
    return src.read(s, d, "events").select("event_id", F.get_json_object(text.outermost_json(noisy), "$.k").cast("int").alias("k"))


@query("arr01_lists", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS parts FROM part")
def lists(s, d):
    return src.read(s, d, "part").select("p_partkey", F.array_join(text.parse_list(F.replace("p_name", F.lit(" "), F.lit(" , "))), "|").alias("parts"))


@query("ing02_snapshot_diff", """WITH o AS (SELECT doc_id, n_chars AS size, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0),
    n AS (SELECT doc_id, n_chars AS size, sha256(CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 1)
    SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'missing' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS action
    FROM o FULL JOIN n USING (doc_id)""")  # fmt: skip
def snapshot(s, d):
    rows = src.read(s, d, "documents")
    of = lambda r, t: r.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.sha2(t, 256).alias("hash"))
    return ops.snapshot_diff(of(rows.filter("doc_id % 10 <> 0"), F.col("text")), of(rows.filter("doc_id % 10 <> 1"), F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))


@query("ing02_snapshot_states", """, o AS (SELECT id, file_size AS size, modified_at AS at, is_missing, file_hash AS h FROM products WHERE id % 10 <> 0),
    n AS (SELECT id, file_size AS size, coalesce(modified_at, created_at) + to_days((id % 10 = 3)::INTEGER) AS at, sha256(CASE WHEN id % 10 = 2 THEN text || 'x' ELSE text END) AS h FROM products WHERE id % 10 <> 1)
    SELECT id AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'missing' WHEN o.h <> n.h THEN 'changed' WHEN is_missing THEN 'reappeared' WHEN o.at IS NULL OR n.at > o.at THEN 'touched' ELSE 'unchanged' END AS action
    FROM o FULL JOIN n USING (id)""", "products")  # fmt: skip
def snapshot_states(s, d):
    """The same with times and with rows that were missing: some files are only touched, some are back."""
    p = src.products(s, d).withColumnRenamed("id", "path")
    k = F.col("path") % 10
    old = p.filter(k != 0).select("path", F.col("file_size").alias("size"), F.col("file_hash").alias("hash"), "modified_at", "is_missing")
    later = F.coalesce("modified_at", "created_at") + F.when(k == 3, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    new = p.filter(k != 1).select("path", F.col("file_size").alias("size"), F.sha2(F.when(k == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"), later.alias("modified_at"))
    return ops.snapshot_diff(old, new)


@query("txt10_applied", """SELECT id, CASE WHEN id % 4 < 2 THEN 'found' ELSE title || '!' END AS title, CASE WHEN id % 2 = 0 THEN 'p' ELSE publisher END AS publisher,
    concat_ws(',', CASE WHEN id % 4 < 2 THEN 'title' END, CASE WHEN id % 2 = 0 THEN 'publisher' END) AS changed FROM items""", "items")  # fmt: skip
def applied(s, d):
    """Metadata onto products: a missing title and one that only repeats the file's name are filled, others stay."""
    i, k = src.items(s, d), F.col("id") % 4
    target = i.select("id", "file_name", F.when(k == 1, F.col("title")).when(k > 1, F.concat("title", F.lit("!"))).alias("title"), F.when(k % 2 == 1, F.col("publisher")).alias("publisher"))
    out = ops.fill_fields(target, i.select("id", F.lit("found").alias("title"), F.lit("p").alias("publisher")), "id", ["title", "publisher"], named_by="file_name")
    return out.select("id", "title", "publisher", F.array_join("changed", ",").alias("changed"))


@query("cnd01_fill", """SELECT id, CASE WHEN id % 3 = 0 THEN 'filled' ELSE title END AS title, msrp, CASE WHEN id % 3 = 0 THEN 'title' ELSE '' END AS changed FROM items""", "items")
def fill(s, d):
    i = src.items(s, d)
    target = i.select("id", F.when(F.col("id") % 3 != 0, F.col("title")).alias("title"), "msrp")
    out = ops.fill_fields(target, i.select("id", F.lit("filled").alias("title"), F.lit(None).cast("double").alias("msrp")), "id", ["title", "msrp"])
    return out.withColumn("changed", F.array_join("changed", ","))


@query("src06_marketplace", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS publisher, p_name || '.pdf' AS filenames FROM part WHERE p_partkey % 5 <> 0")
def marketplace(s, d):
    p = src.read(s, d, "part")
    key, name, none = F.col("p_partkey").cast("string"), F.col("p_name"), F.lit(None).cast("string")
    files = F.array(F.struct(F.concat(F.lit(" "), name, F.lit(".pdf")).alias("filename")))
    flat = F.struct(key.alias("products_id"), name.alias("products_name"), F.col("p_brand").alias("publishers_name"), files.alias("files"))
    nested = F.struct(key.alias("p_id"), F.struct(name.alias("title"), F.array(F.struct(F.concat(name, F.lit(".pdf")).alias("title"))).alias("files")).alias("product"), F.struct(F.col("p_brand").alias("title")).alias("publisher"))
    status = F.when(F.col("p_partkey") % 5 == 0, "error").otherwise("success")
    pack = lambda x: F.to_json(F.struct(status.alias("status"), F.array(x).alias("data")))
    exports = p.select(F.when(F.col("p_partkey") % 2 == 0, pack(flat)).otherwise(pack(nested)).alias("json"))
    return src.marketplace(exports).withColumn("filenames", F.array_join("filenames", ","))


@query("fts03_bm25", """, t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || publisher || ' ' || text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM products),
    l AS (SELECT id, count(*) AS len FROM t GROUP BY id), c AS (SELECT count(*) AS n, avg(len) AS a FROM l),
    h AS (SELECT id, w, count(*) AS tf FROM t, (VALUES ('the'), ('ein')) q(w) WHERE starts_with(term, w) GROUP BY id, w), f AS (SELECT w, count(*) AS df FROM h GROUP BY w)
    SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM h JOIN f USING (w) JOIN l USING (id), c GROUP BY id""", "products")  # fmt: skip
def bm25(s, d):
    from vellum.plans.search import index

    return index(s, d, "the ein").hits().select("id", F.round("score", 6).alias("score"))


@query("fts03_scan", f""", t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM products), l AS (SELECT id, count(*) AS len FROM t GROUP BY id),
    c AS (SELECT count(*) AS n, avg(len) AS a FROM l), h AS (SELECT id, count(*) AS tf FROM t WHERE starts_with(term, 'que') GROUP BY id), f AS (SELECT count(*) AS df FROM h)
    SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)), 6) AS score FROM h JOIN l USING (id), c, f""", "products")  # fmt: skip
def bm25_scan(s, d):
    """Without an index, over two of the fields."""
    return search.bm25(src.products(s, d), ["title", "text"], "que").select("id", F.round("score", 6).alias("score"))


@query("fts05_lines", """SELECT id, line_no, CASE WHEN length(near) > 300 THEN line[greatest(p - 100, 1):p + 103] ELSE near END AS context FROM (
    SELECT id, line_no, line, strpos(lower(line), 'tion') AS p, array_to_string(lines[greatest(line_no, 1):line_no + 2], chr(10)) AS near
    FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS lines, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents) WHERE contains(lower(line), 'tion'))
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) <= 3""")  # fmt: skip
def lines(s, d):
    from vellum.plans.search import texts

    return search.matching_lines(substrings.holding(s, texts(s, d), "tion"), "tion").select("id", F.col("line_no").cast("long").alias("line_no"), "context")


@query("src08_vectors", "SELECT vec_id, len(embedding) * 4 AS bytes, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings")
def blobs(s, d):
    """Vectors become blobs and are decoded again."""
    v = src.encode_vectors(src.read(s, d, "embeddings").select("vec_id", "embedding"), "embedding").drop("embedding")
    back = src.decode_vectors(v, "blob").select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), F.posexplode("embedding").alias("place", "x"))
    return back.select("vec_id", "bytes", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"))


@query("vec02_search", """WITH s AS (SELECT q.vec_id AS query_id, e.label AS product_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, product_id, round(max(score), 4) AS score FROM s WHERE score >= 0.1 GROUP BY ALL""")  # fmt: skip
def vector_search(s, d):
    from vellum.operators import vectors as vec
    from vellum.plans.search import asked, vectors

    v = vectors(s, d)
    return vec.best_of_each(v, asked(v), 0.1).select("query_id", F.col("own").alias("product_id"), F.round("score", 4).alias("score"))


@query("stm04_trailing_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS recent FROM events")
def trailing_rate(s, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-60, 0)
    return src.read(s, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("recent"))


@query("blk05_queue_retry", "SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM queue WHERE status <> 'completed'", "queue")
def queue_retry(s, d):
    failed = F.col("status") == "failed"
    return src.queue(s, d).filter("status <> 'completed'").select("id", F.when(failed, "pending").otherwise(F.col("status")).alias("status"), F.when(failed, F.lit(0)).otherwise(F.col("attempts")).alias("attempts"))
