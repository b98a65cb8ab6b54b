"""Queries of table changes, extraction and streaming jobs over the given tables. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import catalog as ops, scanner
from vellum.operators import changes, extraction
from vellum.plans.catalog import ORACLE_SQL, query
from vellum.sources import catalog as src
from vellum.streaming import jobs


@query("blk01_link", "SELECT product_id, tag_id FROM links UNION SELECT id, CAST(r_regionkey AS BIGINT) FROM items, region WHERE size > 40", "links", "items")
def link(s, d):
    wanted = src.items(s, d).filter("size > 40").select(F.col("id").alias("product_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("tag_id"))
    return changes.link(src.links(s, d).select("product_id", "tag_id"), wanted)


@query("blk02_unlink", "SELECT product_id, tag_id FROM links ANTI JOIN (SELECT id AS product_id FROM items WHERE size > 40) USING (product_id)", "links", "items")
def unlink(s, d):
    return changes.unlink(src.links(s, d), src.items(s, d).filter("size > 40").select(F.col("id").alias("product_id"))).select("product_id", "tag_id")


@query("blk03_update", "SELECT id, CASE WHEN size > 40 THEN 'new' ELSE publisher END AS publisher, msrp, size > 40 AS affected FROM items", "items")
def update(s, d):
    i = src.items(s, d)
    requests = i.filter("size > 40").select("id", F.lit("new").alias("publisher"), F.lit(None).cast("double").alias("msrp"))
    return changes.update_fields(i.select("id", "publisher", "msrp"), requests, "id", ["publisher", "msrp"])


@query("blk04_delete", "SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def delete(s, d):
    gone = src.read(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return changes.null_out(src.read(s, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("blk06_run_status", """SELECT id, CASE status WHEN 'completed' THEN CAST(floor(epoch(started_at)) AS BIGINT) WHEN 'processing' THEN epoch(TIMESTAMP '2024-02-01')::BIGINT END AS completed_at FROM queue""", "queue")
def run_status(s, d):
    q = src.queue(s, d).withColumn("stamp", F.when(F.col("status") == "completed", F.unix_timestamp("started_at")))
    status = F.when(F.col("status") == "processing", "completed").otherwise(F.col("status"))
    return q.select("id", changes.completion_stamp(status, F.col("stamp"), F.lit(1706745600)).cast("bigint").alias("completed_at"))


@query("blk07_insert", "SELECT DISTINCT title FROM items WHERE size > 25 AND title NOT IN (SELECT title FROM items WHERE size <= 25)", "items")
def insert(s, d):
    i = src.items(s, d).select("title", "size")
    return changes.insert_new(i.filter("size <= 25"), i.filter("size > 25").select("title"), "title")[0]


@query("blk08_share", """SELECT o_orderkey, CASE WHEN o_orderpriority[1] = '1' THEN 'private' WHEN o_orderstatus = 'F' THEN 'already shared' ELSE 'shared' END AS outcome,
    CASE WHEN o_orderpriority[1] <> '1' AND o_orderstatus <> 'F' THEN 'note-' || o_orderkey END AS shared_id FROM orders""")  # fmt: skip
def share(s, d):
    private, shared = F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "F"
    outcome = F.when(private, "private").when(shared, "already shared").otherwise("shared")
    return src.read(s, d, "orders").select("o_orderkey", outcome.alias("outcome"), F.when(~private & ~shared, F.concat(F.lit("note-"), "o_orderkey")).alias("shared_id"))


@query("blk09_folder_removal", "SELECT id FROM products WHERE publisher <> 'src3'", "products")
def folder_removal(s, d):
    p = src.products(s, d).select("id", "publisher")
    return changes.cascade(p, p.filter("publisher = 'src3'").select("publisher").distinct(), "publisher").select("id")


@query("ing05_enqueue", """SELECT id AS product_id, task_type FROM (SELECT id, unnest(list_filter(['view', CASE WHEN NOT text_extracted THEN 'click' END,
      CASE WHEN text_extracted AND system IS NULL THEN 'signup' END], lambda x: x IS NOT NULL)) AS task_type
      FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, id) AS k FROM products WHERE NOT is_missing) WHERE k = 1) t
    WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.product_id = t.id AND q.task_type = t.task_type AND q.status IN ('pending', 'processing'))""", "products", "queue")  # fmt: skip
def enqueue(s, d):
    p = ops.canonical(src.products(s, d)).filter("not is_duplicate")
    return changes.enqueue(p, src.queue(s, d), {"view": F.lit(True), "click": ~F.col("text_extracted"), "signup": F.col("text_extracted") & F.col("system").isNull()})


@query("dup02_arrivals", """SELECT id, CASE WHEN id <> k THEN k END AS duplicate_of FROM
    (SELECT id, publisher, first_value(id) OVER (PARTITION BY file_hash ORDER BY publisher > 'src4', id) AS k FROM products) WHERE publisher > 'src4'""", "products")  # fmt: skip
def arrivals(s, d):
    p = src.products(s, d).select("id", "file_hash", "publisher")
    return changes.mark_arrivals(p.filter("publisher <= 'src4'"), p.filter("publisher > 'src4'"))


@query("dup04_resolution", """SELECT count(*) AS removed, sum(file_size) AS freed FROM
    (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY publisher = 'src2' DESC, modified_at DESC NULLS LAST, created_at, id) AS k FROM products) WHERE k > 1""", "products")  # fmt: skip
def resolution(s, d):
    return ops.keep_policy(src.products(s, d), "src2").filter("not keep").agg(F.count(F.lit(1)).alias("removed"), F.sum("file_size").alias("freed"))


@query("jn10_orphans", """, m AS (SELECT id, publisher, first_value(id) OVER w AS k, first_value(publisher) OVER w AS kp FROM products WHERE NOT is_missing WINDOW w AS (PARTITION BY file_hash ORDER BY created_at, id))
    SELECT id, k AS duplicate_of FROM m WHERE id <> k AND kp = 'src1'""", "products")  # fmt: skip
def orphans(s, d):
    p = src.products(s, d)
    return changes.orphans(ops.canonical(p).select("id", "duplicate_of"), p.filter("publisher <> 'src1'")).select("id", "duplicate_of")


@query("idn01_cascade", """SELECT id, method, confidence, confidence < 0.8 AS confirm FROM (SELECT id, CASE WHEN known THEN 'hash' WHEN fuzzy > 0.5 THEN 'title' ELSE 'manual' END AS method,
      CASE WHEN known THEN 1.0 WHEN fuzzy > 0.5 THEN fuzzy ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT id, file_hash IN (SELECT sha256(text) FROM benchmark UNION SELECT file_hash FROM products WHERE publisher = 'src3') AS known,
      CASE WHEN contains(lower(title), 'the') OR contains('the', lower(title)) THEN 0.9 WHEN contains(lower(title), 'ein') OR contains('ein', lower(title)) THEN 0.6 END AS fuzzy FROM products))""", "products")  # fmt: skip
def identify(s, d):
    p = src.products(s, d)
    hashes = src.read(s, d, "benchmark").select(F.sha2("text", 256).alias("file_hash")).unionByName(p.filter("publisher = 'src3'").select("file_hash"))
    patterns = s.createDataFrame([("the", 0.9, 1), ("ein", 0.6, 2)], "pattern string, confidence double, pattern_id int")
    return changes.identify(p, hashes, ops.fuzzy_titles(p.select("id", "title"), "title", patterns))


@query("syn02_differences", "SELECT id, 'title' AS field, title AS ours, upper(title) AS theirs FROM items WHERE title <> upper(title) UNION ALL SELECT id, 'publisher', publisher, 'other' FROM items WHERE size > 20 AND publisher <> 'other'", "items")
def differences(s, d):
    i = src.items(s, d).select("id", "title", "publisher", "size")
    return changes.differences(i, i.select("id", F.upper("title").alias("title"), F.when(F.col("size") > 20, "other").alias("publisher")), "id", ["title", "publisher"])


@query("syn03_reasons", """SELECT id, CASE WHEN size > 30 THEN 'new_product' WHEN size > 20 AND publisher IS NOT NULL THEN 'has_publisher' WHEN size > 10 AND level_min IS NOT NULL THEN 'has_level_min' ELSE 'no_new_data' END AS reason FROM items""", "items")
def reasons(s, d):
    i = src.items(s, d)
    registry = i.filter("size <= 30").select("id", F.when(F.col("size") <= 20, F.col("publisher")).alias("publisher"), F.when(F.col("size") <= 10, F.col("level_min")).alias("level_min"))
    return changes.contribution_reason(i, registry, "id", ["publisher", "level_min"])


@query("syn05_submit", """SELECT id, CASE WHEN e THEN CASE WHEN task_type <> 'error' THEN 'submitted' ELSE 'failed' END ELSE status END AS status, attempts + e::INTEGER AS attempts
    FROM (SELECT *, status = 'pending' AND attempts < 3 AS e FROM queue)""", "queue")  # fmt: skip
def submit(s, d):
    return changes.submit(src.queue(s, d), F.col("task_type") != "error").select("id", "status", "attempts")


@query("mkt01_report", """SELECT count(*) AS total, count(*) FILTER (title IN (SELECT title FROM items WHERE size > 45)) AS matched,
    printf('%.1f%%', 100.0 * count(*) FILTER (title IN (SELECT title FROM items WHERE size > 45)) / count(*)) AS rate FROM items WHERE size <= 45""", "items")  # fmt: skip
def report(s, d):
    i = src.items(s, d)
    return changes.match_report(i.filter("size <= 45"), i.filter("size > 45").select("id", F.concat("title", F.lit(".pdf")).alias("title")))


@query("prj05_sparse", """SELECT id, '{"id":' || id || ',"title":"' || title || '"' || coalesce(',"level_min":' || level_min, '') || '}' AS json FROM items""", "items")
def sparse(s, d):
    return src.items(s, d).select("id", changes.sparse_json("id", "title", "level_min").alias("json"))


@query("snk04_vault", """SELECT 'items/' || replace(title, ' ', '_') || '.md' AS path, arg_max('# ' || title || chr(10) || product_type || ', level ' || coalesce(level_min::VARCHAR, '?') || chr(10), id) AS content FROM items GROUP BY 1""", "items")
def vault(s, d):
    content = F.concat(F.lit("# "), "title", F.lit("\n"), "product_type", F.lit(", level "), F.coalesce(F.col("level_min").cast("string"), F.lit("?")), F.lit("\n"))
    return changes.vault(src.items(s, d), "items", F.col("title"), content, "id")


DICE = "[4, 6, 8, 10, 12, 20][p_size % 6 + 1]"


def dice():
    return F.element_at(F.array(*map(F.lit, (4, 6, 8, 10, 12, 20))), F.col("p_size") % 6 + 1)


@query("txt13_tables", f"SELECT p_partkey AS id, 1 AS table_no, p_name AS title, {DICE} AS die, 4 AS entries FROM part")
def tables(s, d):
    body = F.concat(F.col("p_name"), F.lit(" (d"), dice(), F.lit(")\n1. one\n2. two\n3. three\n4. four\nend"))
    found = scanner.table_entries(src.read(s, d, "part").select(F.col("p_partkey").alias("id"), body.alias("text")))
    return found.groupBy("id", "table_no", "title", "die").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "txt13_entries",
    f"""SELECT p_partkey AS id, p_name AS title, low, high, CASE low WHEN 1 THEN 'one ' || p_brand || ' more of it' ELSE 'two ' || p_size || ' goes on after a blank line' END AS result
    FROM part, (VALUES (1, 2), (3, 3)) v(low, high)
    UNION ALL SELECT p_partkey, 'Roll ' || p_brand, n, n, 'x' || n FROM part, range(1, 4) r(n)
    UNION ALL SELECT p_partkey, p_name || ' of odds', n * 2 - 1, n * 2, 'y' || p_size FROM part, range(1, 51) r(n) WHERE p_partkey % 2 = 0""",
)
def entries(s, d):
    """A table with its die behind the title, one that begins with the roll, one of d%; ranges off the die, lines that end one, and tables with too few or too many entries."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda n: F.concat(n * 2 - 1, F.lit("-"), n * 2, F.lit(" y"), F.col("p_size"))), "\n")
    body = F.concat(
        F.lit("intro\n"), F.col("p_name"), F.lit(" (d"), dice(), F.lit(")\n1-2. one "), "p_brand", F.lit("\nmore of it\n3) two "), "p_size", F.lit("\n\ngoes on after a blank line\n99. too high\n4-3. backwards\n0: zero\n\n\nnot of it\n"),
        F.lit("roll d20: Roll "), "p_brand", F.lit("\n1. x1\n2: x2\n3  x3\nLonely d8\n1. only one\nToo many d4\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda n: F.concat(F.lit("1) again "), n)), "\n"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n\n"), F.col("p_name"), F.lit(" of odds d%:\n"), many)).otherwise(""),
    )
    return scanner.table_entries(src.read(s, d, "part").select(F.col("p_partkey").alias("id"), body.alias("text"))).select("id", "title", "low", "high", "result")


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    "txt01_chunks",
    f"""WITH RECURSIVE d AS (SELECT doc_id AS id, text AS t, length(text) AS n FROM documents WHERE trim(text, {BLANKS}) <> ''),
    c AS (SELECT id, 0 AS k, -1::BIGINT AS start, 0::BIGINT AS before, 0::BIGINT AS fin, n FROM d UNION ALL
      SELECT id, k + 1, s, fin, CASE WHEN e >= n THEN e WHEN contains(w, '. ') THEN e - length(list_last(string_split(w, '. '))) WHEN contains(w, '! ') THEN e - length(list_last(string_split(w, '! ')))
        WHEN contains(w, '? ') THEN e - length(list_last(string_split(w, '? '))) WHEN contains(w, chr(10) || chr(10)) THEN e - length(regexp_extract(w, '\n\n((?:[^\n]+\n)*[^\n]*)$', 1))
        WHEN contains(w, chr(10)) THEN e - length(list_last(string_split(w, chr(10)))) ELSE e END, n
      FROM (SELECT id, k, fin, n, s, least(s + 500, n) AS e, substring(t, least(s + 500, n) - 99, 100) AS w FROM (SELECT *, greatest(fin - 50, start + 1) AS s FROM c WHERE fin < n) JOIN (SELECT id, t FROM d) USING (id)))
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS chunk_index, CASE WHEN n <= 500 THEN 0 ELSE start + length(p) - length(ltrim(p, {BLANKS})) END AS start, CASE WHEN n <= 500 THEN p ELSE trim(p, {BLANKS}) END AS chunk
    FROM (SELECT c.*, substring(t, start + 1, fin - start) AS p FROM c JOIN (SELECT id, t FROM d) USING (id) WHERE k > 0 AND fin > before) WHERE trim(p, {BLANKS}) <> ''""",
)
def chunks(s, d):
    return extraction.chunks(src.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "txt01_strides",
    f"""SELECT id, (s / 450)::BIGINT AS chunk_index, s AS start, CASE WHEN n <= 500 THEN t ELSE trim(substring(t, s + 1, 500), {BLANKS}) END AS chunk
    FROM (SELECT doc_id AS id, text AS t, length(text) AS n, unnest(range(0, greatest(length(text) - 50, 1), 450)) AS s FROM documents) WHERE trim(t, {BLANKS}) <> '' AND (n > 500 OR s = 0) AND trim(substring(t, s + 1, 500), {BLANKS}) <> ''""",
)
def strides(s, d):
    return extraction.strides(src.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "vec01_embed",
    f"""WITH c AS ({ORACLE_SQL['txt01_chunks']}), w AS (SELECT id, chunk_index, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT id, chunk_index, unnest(regexp_split_to_array(lower(chunk), '\\s+')) AS w FROM c) WHERE w <> ''),
    v AS (SELECT id, chunk_index, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL), n AS (SELECT id, chunk_index, sqrt(sum(x * x)) AS n FROM v GROUP BY ALL)
    SELECT id, chunk_index, substring(chunk, 1, 1000) AS chunk_text, string_agg(coalesce(round((x / CASE WHEN n > 0 THEN n ELSE 1 END)::FLOAT::DOUBLE * 1000000)::BIGINT, 0), ',' ORDER BY place) AS embedding
    FROM c CROSS JOIN (SELECT unnest(range(64)) AS place) LEFT JOIN v USING (id, chunk_index, place) LEFT JOIN n USING (id, chunk_index) GROUP BY id, chunk_index, chunk""",
)
def embed(s, d):
    """Vectors are shown in millionths."""
    shown = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint")), ",")
    return extraction.encode(chunks(s, d)).select("id", "chunk_index", F.substring("chunk", 1, 1000).alias("chunk_text"), shown.alias("embedding"))


@query("stm01_changes", """SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS kind, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'""")
def last_changes(s, d):
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise(F.col("event_type"))
    feed = jobs.arriving(s, d, "events").select(F.col("user_id").alias("path"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return jobs.last_changes(s, feed)


@query("stm03_queue_state", """SELECT item, CASE WHEN f <= 3 THEN 'completed' WHEN n >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN f <= 3 THEN f WHEN n >= 3 THEN 3 ELSE n END AS attempts
    FROM (SELECT item, min(k) FILTER (ok) AS f, count(*) AS n FROM (SELECT user_id AS item, event_type <> 'error' AND event_type <> 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY item)""")  # fmt: skip
def queue_state(s, d):
    tries = src.read(s, d, "events").select(F.col("user_id").cast("bigint").alias("item"), F.coalesce(~F.col("event_type").isin("error", "click"), F.lit(False)).alias("ok"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    return jobs.queue_state(s, tries)


@query(
    "stm04_admission",
    """WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT id, client, k, true AS admitted, 0::BIGINT AS wait, [us] AS log FROM e WHERE k = 1 UNION ALL
      SELECT id, client, k, len(near) < 2, CASE WHEN len(near) < 2 THEN 0 ELSE near[1] + 86400000000 - us END, CASE WHEN len(near) < 2 THEN list_append(near, us) ELSE near END
      FROM (SELECT e.*, list_filter(s.log, lambda t: t > e.us - 86400000000) AS near FROM s JOIN e ON e.client = s.client AND e.k = s.k + 1))
    SELECT id, client, admitted, wait FROM s""",
)
def admission(s, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return jobs.admit(s, src.read(s, d, "events").select(F.col("event_id").cast("bigint").alias("id"), F.col("user_id").cast("bigint").alias("client"), at), 2, 86400)


@query("stm06_progress", "SELECT count(*) AS seen, count(*) FILTER (event_type = 'error') AS failed FROM events")
def progress(s, d):
    """What a listener was told of the batches, together."""
    _, told = jobs.watched(s, jobs.arriving(s, d, "events"), {"seen": F.count(F.lit(1)), "failed": F.count_if(F.col("event_type") == "error")})
    return told.agg(F.sum("seen").alias("seen"), F.sum("failed").alias("failed"))


@query("stm06_live_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def live_counts(s, d):
    return jobs.live_counts(s, jobs.arriving(s, d, "events"), "event_type")
