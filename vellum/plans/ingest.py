"""Queries of the way of files into the catalog, each with the same query in SQL. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import catalog as ops
from vellum.operators import changes, ingest
from vellum.plans.catalog import query
from vellum.sources import catalog as src
from vellum.sources.shared import new_folder

#: (id, kind, pattern, priority)
RULES = [(1, "folder_name", "src7", 5), (2, "size_max", "20000", 1), (3, "filename", "*[05]9.pdf", 9), (4, "regex", "(", 99), (5, "folder_path", "/lib/src1[0-2]", 7)]

#: The catalog before, a listing after, buried paths, and what each rule says. One path in ten is new, one gone, one changed, one touched.
FILES_SQL = """stored AS (SELECT id, file_path AS path, file_size AS size, modified_at, is_missing,
    sha256(encode(file_size::VARCHAR) || array_slice(encode(text), 1, 1048576)) AS file_hash FROM products WHERE id % 10 <> 0),
  listed AS (SELECT id AS file_id, file_path AS path, file_size + (id % 10 = 2)::INTEGER AS size, coalesce(modified_at, created_at) + to_days((id % 10 = 3)::INTEGER) AS modified_at,
    text || CASE WHEN id % 10 = 2 THEN 'x' ELSE '' END AS content FROM products WHERE id % 10 <> 1),
  ruled AS (SELECT *, CASE WHEN regexp_matches(path, '[05]9\\.pdf$') THEN 3 WHEN regexp_matches(path, '^/lib/src1[0-2]/') THEN 5 WHEN contains(path, '/src7/') THEN 1 WHEN size > 20000 THEN 2 END AS rule_id,
    sha256(encode(size::VARCHAR) || array_slice(encode(content), 1, 1048576)) AS new_hash FROM listed),
  planned AS (SELECT coalesce(l.path, s.path) AS path, s.id, l.size, l.new_hash, s.file_hash AS old_hash, s.is_missing, CASE WHEN l.path IS NULL THEN 'missing' WHEN rule_id IS NOT NULL THEN 'excluded'
    WHEN file_id % 29 = 0 THEN 'buried' WHEN s.id IS NULL THEN 'new' WHEN coalesce(s.size = l.size AND s.modified_at >= l.modified_at, false) AND NOT s.is_missing THEN 'unchanged' ELSE 'read' END AS step
    FROM ruled l FULL JOIN stored s ON l.path = s.path),
  done AS (SELECT path, CASE WHEN step <> 'read' THEN step WHEN old_hash <> new_hash THEN 'updated' WHEN is_missing THEN 'reappeared' ELSE 'touched' END AS action,
    CASE WHEN step IN ('new', 'read') THEN new_hash ELSE old_hash END AS file_hash FROM planned),
  firsts AS (SELECT file_hash, arg_min(path, (arriving, path)) AS first_path FROM (SELECT file_hash, path, 0 AS arriving FROM stored WHERE NOT is_missing
    UNION ALL SELECT file_hash, path, 1 FROM done WHERE action = 'new') GROUP BY file_hash),
  ingested AS (SELECT path, action, file_hash, CASE WHEN action = 'new' AND first_path <> path THEN first_path END AS duplicate_of FROM done LEFT JOIN firsts USING (file_hash))"""


def files(s, d):
    """(stored, listed, tombstones, contents) of the query."""
    p = src.products(s, d)
    text = F.col("text").cast("binary")
    stored = p.filter("id % 10 <> 0").select("id", F.col("file_path").alias("path"), F.col("file_size").alias("size"), "modified_at", src.fingerprint(text, F.col("file_size")).alias("file_hash"), "is_missing")
    later = F.when(F.col("id") % 10 == 3, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    now = p.filter("id % 10 <> 1").withColumn("path", F.col("file_path"))
    listed = now.select("path", (F.col("file_size") + (F.col("id") % 10 == 2).cast("int")).alias("size"), (F.coalesce("modified_at", "created_at") + later).alias("modified_at"))
    contents = now.select("path", F.concat("text", F.when(F.col("id") % 10 == 2, "x").otherwise("")).cast("binary").alias("content"))
    return stored, listed, p.filter("id % 29 = 0").select(F.col("file_path").alias("path")), contents


def ingested(s, d):
    stored, listed, tombstones, contents = files(s, d)
    return ingest.ingest(stored, listed, tombstones, RULES, contents)


@query("ing01_ingest", f", {FILES_SQL} SELECT path, action, file_hash, duplicate_of FROM ingested", "products")
def ing01(s, d):
    return ingested(s, d)


@query("agg19_counters", f", {FILES_SQL} SELECT action, count(*) AS n, count(duplicate_of) AS duplicates FROM ingested GROUP BY action", "products")
def agg19(s, d):
    return ingest.counters(ingested(s, d))


@query("flt07_rules", f", {FILES_SQL} SELECT path, rule_id FROM ruled WHERE rule_id IS NOT NULL", "products")
def flt07(s, d):
    listed = files(s, d)[1]
    return listed.select("path", ops.first_rule(RULES, F.col("path"), F.col("size")).alias("rule_id")).filter("rule_id is not null")


@query("jn11_first_rules", f", {FILES_SQL} SELECT path, rule_id FROM ruled WHERE rule_id IS NOT NULL", "products")
def jn11(s, d):
    return ingest.first_rules(files(s, d)[1], RULES)


@query("blk11_preview", f", {FILES_SQL} SELECT path FROM listed WHERE contains(path, '/src7/') ORDER BY path LIMIT 50", "products")
def blk11(s, d):
    listed = files(s, d)[1]
    return listed.filter(ops.rule_predicate("folder_name", "src7", F.col("path"), F.col("size"))).orderBy("path").limit(50).select("path")


@query("flt09_unchanged", "SELECT id, coalesce(id % 10 <> 2 AND modified_at >= created_at + to_days((id % 3)::INTEGER), false) AS same FROM products WHERE id % 10 <> 0", "products")
def flt09(s, d):
    p = src.products(s, d).filter("id % 10 <> 0")
    size = F.col("file_size") + (F.col("id") % 10 == 2).cast("int")
    return p.select("id", ingest.unchanged(F.col("file_size"), size, F.col("modified_at"), F.col("created_at") + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("same"))


@query("jn08_tombstones", "SELECT id FROM products WHERE id % 29 <> 0", "products")
def jn08(s, d):
    p = src.products(s, d).select("id", F.col("file_path").alias("path"))
    return ingest.without_tombstones(p, p.filter("id % 29 = 0")).select("id")


@query("ing04_purge", "SELECT id FROM products WHERE NOT (publisher = 'src3' AND is_missing)", "products")
def ing04(s, d):
    return ingest.purge_missing(src.products(s, d), F.col("publisher") == "src3").select("id")


@query(
    "ing06_backlog",
    """, asked AS (SELECT id AS product_id, unnest(list_filter([CASE WHEN NOT text_extracted OR id % 2 = 0 THEN 'view' END, CASE WHEN id % 3 = 0 THEN 'click' END, CASE WHEN id % 4 = 0 THEN 'embed' END], lambda x: x IS NOT NULL)) AS task_type,
    file_size FROM products) SELECT * FROM asked a WHERE NOT EXISTS (FROM queue q WHERE q.product_id = a.product_id AND q.task_type = a.task_type AND status IN ('pending', 'processing'))""",
    "products", "queue",
)
def ing06(s, d):
    needs = {"view": ~F.col("text_extracted") | (F.col("id") % 2 == 0), "click": F.col("id") % 3 == 0, "embed": F.col("id") % 4 == 0}
    return ingest.backlog(src.products(s, d), src.queue(s, d), needs)


RULE_ROWS = "rules AS (SELECT n_nationkey AS id, ['folder_path', 'folder_name', 'filename', 'size_min', 'size_max'][n_nationkey % 5 + 1] AS kind, n_nationkey % 2 = 0 AS enabled, n_regionkey = 0 AS is_default FROM nation)"


def rules(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("folder_path", "folder_name", "filename", "size_min", "size_max"))), F.col("n_nationkey") % 5 + 1)
    return src.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), kind.alias("kind"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), (F.col("n_regionkey") == 0).alias("is_default"))


@query(
    "agg09_rule_statistics",
    f"""WITH {RULE_ROWS}, figures AS (SELECT kind, count(*) AS n, count(*) FILTER (enabled) AS enabled, count(*) FILTER (is_default) AS builtin FROM rules GROUP BY kind
    UNION ALL SELECT 'all', count(*), count(*) FILTER (enabled), count(*) FILTER (is_default) FROM rules) SELECT * FROM figures UNION ALL SELECT 'regex', 0, 0, 0""",
)
def agg09(s, d):
    return ingest.rule_statistics(rules(s, d), ["folder_path", "folder_name", "filename", "size_min", "size_max", "regex"])


@query("blk10_seed", f"WITH {RULE_ROWS} SELECT id, kind, false AS again FROM rules UNION ALL SELECT id + 100, kind, true FROM rules WHERE is_default UNION ALL SELECT id, kind, true FROM rules WHERE NOT is_default")
def blk10(s, d):
    r = rules(s, d)
    defaults, own = r.filter("is_default"), r.filter("not is_default")
    once = ingest.seed(r, defaults.withColumn("id", F.col("id") + 100)).withColumn("again", F.lit(False))
    return once.unionByName(ingest.seed(own, defaults.withColumn("id", F.col("id") + 100)).withColumn("again", F.lit(True))).select("id", "kind", "again")


@query(
    "dup05_resolution",
    """, ranked AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY file_hash) > 1 THEN row_number() OVER (PARTITION BY file_hash ORDER BY publisher = 'src2' DESC, modified_at DESC NULLS LAST, created_at, id) END AS k FROM products)
    SELECT id, NULL::BIGINT AS duplicate_of FROM ranked WHERE coalesce(k, 1) = 1""",
    "products",
)
def dup05(s, d):
    p = src.products(s, d)
    return ingest.resolve_duplicates(p.join(ops.keep_policy(p, "src2").select("id", "keep"), "id", "left"))[0].select("id", "duplicate_of")


@query(
    "dup05_totals",
    """, ranked AS (SELECT file_size, count(*) OVER (PARTITION BY file_hash) AS c, row_number() OVER (PARTITION BY file_hash ORDER BY publisher = 'src2' DESC, modified_at DESC NULLS LAST, created_at, id) AS k FROM products)
    SELECT count(*) AS deleted, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS freed FROM ranked WHERE c > 1 AND k > 1""",
    "products",
)
def dup05_totals(s, d):
    p = src.products(s, d)
    return ingest.resolve_duplicates(p.join(ops.keep_policy(p, "src2").select("id", "keep"), "id", "left"))[1]


@query("dup04_delete_list", """, r AS (SELECT file_hash, id, file_size, count(*) OVER w AS c, row_number() OVER o AS k, first_value(id) OVER o AS keep_id FROM products
    WINDOW w AS (PARTITION BY file_hash), o AS (PARTITION BY file_hash ORDER BY publisher = 'src2' DESC, modified_at DESC NULLS LAST, created_at, id)) SELECT file_hash, keep_id, id, file_size FROM r WHERE c > 1 AND k > 1""", "products")  # fmt: skip
def dup04(s, d):
    return ingest.delete_list(ops.keep_policy(src.products(s, d), "src2"))


@query("dup03_members", """, m AS (SELECT file_hash, id, first_value(id) OVER (PARTITION BY file_hash ORDER BY created_at, id) AS keep_id FROM products WHERE NOT is_missing)
    SELECT file_hash, keep_id, id FROM m WHERE id <> keep_id""", "products")  # fmt: skip
def dup03(s, d):
    return ops.duplicate_members(src.products(s, d))


@query("dup09_source_of_truth", "SELECT s_suppkey, s_suppkey = 7 AS is_source FROM supplier")
def dup09(s, d):
    return ingest.only_flag(src.read(s, d, "supplier").select("s_suppkey"), "is_source", F.col("s_suppkey") == 7)


@query("dup08_clear", "SELECT file_path AS path FROM products WHERE id % 29 = 0 AND id % 2 = 0", "products")
def dup08(s, d):
    p = src.products(s, d).select("id", F.col("file_path").alias("path")).filter("id % 29 = 0")
    return ingest.clear_tombstones(p, p.filter("id % 2 = 1")).select("path")


@query(
    "dup07_bulk_delete",
    """, m AS (SELECT id, file_path, first_value(id) OVER (PARTITION BY file_hash ORDER BY created_at, id) AS keep_id FROM products WHERE NOT is_missing)
    SELECT file_path AS path, 'tombstone' AS what FROM m WHERE id <> keep_id AND id % 3 = 0 UNION ALL SELECT '/old/1', 'tombstone'
    UNION ALL SELECT file_path, 'orphan' FROM m WHERE id <> keep_id AND id % 3 <> 0 AND keep_id % 5 = 0""",
    "products",
)
def dup07(s, d):
    """Marked duplicates that are asked for go and leave tombstones; copies whose canonical row is gone are orphans."""
    marked = ops.canonical(src.products(s, d)).select("id", F.col("file_path").alias("path"), "duplicate_of")
    done = changes.delete_duplicates(marked, marked.filter("id % 3 = 0")).filter("outcome = 'deleted'")
    gone = marked.join(done, "id", "left_semi")
    graves = changes.bury(s.createDataFrame([("/old/1",)], "path string"), gone.select("path"))
    rest = marked.join(done, "id", "left_anti").filter("duplicate_of is null or id <> duplicate_of")
    lost = changes.orphans(rest.select("id", "path", "duplicate_of"), rest.filter("id % 5 <> 0 or duplicate_of is not null").select("id"))
    return graves.select("path", F.lit("tombstone").alias("what")).unionByName(lost.select("path", F.lit("orphan").alias("what")))


@query(
    "blk05_queue_edits",
    """SELECT id, CASE WHEN status = 'failed' OR late THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts,
    started_at IS NOT NULL AND NOT (status = 'failed' OR late) AS started FROM (SELECT *, status = 'processing' AND started_at < TIMESTAMP '2024-01-15' AS late FROM queue) WHERE status <> 'completed'""",
    "queue",
)
def blk05(s, d):
    edited = ingest.edit_queue(src.queue(s, d), retry=True, reset_stuck=F.expr("timestamp'2024-01-15 00:00:00'"), drop=["completed"])
    return edited.select("id", "status", "attempts", F.col("started_at").isNotNull().alias("started"))


@query(
    "blk05_dismissed",
    """, f AS (SELECT DISTINCT product_id FROM queue WHERE status = 'failed' AND task_type = 'click'), q AS (SELECT count(*) AS n FROM queue WHERE NOT (status = 'failed' AND task_type = 'click'))
    SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN system END, CASE WHEN product_id IS NOT NULL THEN 'Art/Maps' END) AS product_type, product_id IS NOT NULL OR text_extracted AS text_extracted, n AS queued FROM products LEFT JOIN f ON product_id = id, q""",
    "products", "queue",
)
def blk05_dismissed(s, d):
    """Failed clicks are dismissed and their products marked as art."""
    p = src.products(s, d).select("id", F.when(F.col("id") % 3 > 0, F.col("system")).alias("product_type"), "text_extracted")
    left, marked = ingest.dismiss_failed(src.queue(s, d), p, "click", "Art/Maps")
    return marked.crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("queued"))))  # one row


@query("src05_texts", "SELECT id, CASE WHEN id % 7 <> 0 AND id % 5 <> 0 THEN text END AS markdown FROM products", "products")
def src05(s, d):
    """Extracted texts are written as JSON in buckets and read back; a product without a file, or with an unreadable one, has none."""
    at = new_folder(s, "texts")
    doc = F.to_json(F.struct(F.col("text").alias("markdown"), F.length("text").alias("char_count")))
    written = src.products(s, d).filter("id % 7 <> 0").select("id", F.when(F.col("id") % 5 == 0, "{broken").otherwise(doc).alias("value"))
    src.write_texts(written, at)
    return src.with_text(src.products(s, d).select("id"), src.read_texts(s, at))
