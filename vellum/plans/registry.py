"""Queries of the exchange with a registry and of model jobs, each with the same query in SQL where it has one. Names begin with the inventory's ids."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from vellum.functions.text import sanitize
from vellum.operators import changes, documents, entities, extraction, ingest, registry
from vellum.plans import catalog
from vellum.plans import changes as changes_plan
from vellum.plans.catalog import query
from vellum.sources import catalog as src
from vellum.sources import snapshots
from vellum.sources.shared import new_folder
from vellum.streaming import jobs


def entries(s, d):
    """Registry entries: each document whose id is divisible by three, with the hashes of its text and of a variant of it."""
    dd = src.read(s, d, "documents").filter("doc_id % 3 = 0")
    hashes = F.array(F.sha2("text", 256), F.sha2(F.concat("text", F.lit("x")), 256))
    return dd.select(F.col("doc_id").alias("id"), hashes.alias("file_hashes"), F.concat(F.lit("R-"), "source").alias("publisher"), F.col("lang").alias("system"))


@query(
    "jn15_registry",
    """SELECT d.doc_id, min(e.doc_id) AS entry_id FROM documents d JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, sha256(text || 'x') FROM documents WHERE doc_id % 3 = 0) e
    ON sha256(d.text) = e.h GROUP BY d.doc_id""",
)
def jn15(s, d):
    found = registry.entries_by_hash(entries(s, d), ["publisher"])
    return src.read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash")).join(found, "file_hash").select("doc_id", "entry_id")


@query("src07_seed", """SELECT id, '{"file_hashes":["h' || id || '"],"title":"' || title || '","publisher":"' || publisher || '"' || CASE WHEN coalesce(level_min, 0) <> 0 OR coalesce(level_max, 0) <> 0
    THEN ',"level_range":{"min":' || level_min || ',"max":' || level_max || '}' ELSE '' END || ',"external_links":{"shop":"/' || id || '"}}' AS json FROM items""", "items")  # fmt: skip
def src07(s, d):
    i = src.items(s, d).withColumn("file_hash", F.concat(F.lit("h"), "id")).withColumn("links", F.create_map(F.lit("shop"), F.concat(F.lit("/"), "id")))
    return registry.registry_json(i)


@query("src07_seed_entries", """SELECT hash, size::BIGINT AS file_size, CASE WHEN id % 7 <> 0 THEN size + 1 END AS page_count, title, publisher, (1990 + size % 30)::INTEGER AS publication_year, CASE WHEN id % 5 <> 0 THEN 'G' || id % 3 END AS game_system, product_type,
    CASE WHEN coalesce(level_min, 0) <> 0 OR coalesce(level_max, 0) <> 0 THEN level_min END AS low, CASE WHEN coalesce(level_min, 0) <> 0 OR coalesce(level_max, 0) <> 0 THEN level_max END AS high,
    CASE WHEN id % 2 = 1 THEN 'about "' || title || '"' || chr(10) || 'and more' END AS description, CASE WHEN id % 3 = 0 THEN '/' || id END AS shop, CASE WHEN id % 4 = 0 THEN publisher || '|' || product_type ELSE '' END AS tags, 1.0::DOUBLE AS confidence, 'manual' AS source, 'parts' AS seed_source
    FROM items, LATERAL (SELECT unnest(['h' || id, 'v' || id]) AS hash)""", "items")  # fmt: skip
def src07_entries(s, d):
    """Seed documents are written and read back, a row for each hash of an entry."""
    k, at = F.col("id"), new_folder(s, "seed")
    about = F.concat(F.lit('about "'), "title", F.lit('"\nand more'))
    i = src.items(s, d).select(
        "id", F.array(F.concat(F.lit("h"), k), F.concat(F.lit("v"), k)).alias("file_hashes"), F.col("size").alias("file_size"), F.when(k % 7 != 0, F.col("size") + 1).alias("page_count"), "title", "publisher",
        (1990 + F.col("size") % 30).alias("publication_year"), F.when(k % 5 != 0, F.concat(F.lit("G"), k % 3)).alias("game_system"), "product_type", "level_min", "level_max", F.when(k % 2 == 1, about).alias("description"),
        F.when(k % 3 == 0, F.create_map(F.lit("shop"), F.concat(F.lit("/"), k))).alias("external_links"), F.when(k % 4 == 0, F.array("publisher", "product_type")).alias("tags"),
    )
    registry.seed_documents(i, "parts", F.lit("2024-01-01T00:00:00Z")).write.text(at)
    plain = ["file_size", "page_count", "title", "publisher", "publication_year", "game_system", "product_type", "description", "confidence", "source", "seed_source"]
    return registry.read_seed(s, at).select(
        F.explode("file_hashes").alias("hash"), *plain, F.col("level_range.min").alias("low"), F.col("level_range.max").alias("high"), F.try_element_at("external_links", F.lit("shop")).alias("shop"), F.array_join("tags", "|").alias("tags"),
    )


#: Title patterns of the registry with what it knows of them.
TITLES = [("the", 0.6, 1, "T-the", "en"), ("ein", 0.7, 2, "T-ein", "de"), ("zzzz", 0.95, 3, "T-none", "xx"), ("a", 0.4, 4, "T-a", "xx")]


@query(
    "syn01_pull",
    """, own AS (SELECT id, file_hash, title, CASE WHEN id % 4 <> 0 THEN publisher END AS publisher, system, id % 5 = 0 AS identified FROM products),
    e AS (SELECT sha256(text) AS h, min(doc_id) AS i FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), x AS (SELECT h, 'R-' || source AS publisher, lang AS system FROM e JOIN documents ON doc_id = i),
    f AS (SELECT o.*, x.publisher AS p, x.system AS y, CASE WHEN x.h IS NOT NULL THEN 1.0 WHEN contains(lower(title), 'ein') OR contains('ein', lower(title)) THEN 0.7 WHEN contains(lower(title), 'the') OR contains('the', lower(title)) THEN 0.6 END AS sure
      FROM own o LEFT JOIN x ON x.h = file_hash AND NOT identified),
    g AS (SELECT id, publisher AS old_p, system AS old_s, CASE WHEN identified THEN NULL WHEN sure = 1.0 THEN p WHEN sure = 0.7 THEN 'T-ein' WHEN sure = 0.6 THEN 'T-the' END AS p,
      CASE WHEN identified THEN NULL WHEN sure = 1.0 THEN y WHEN sure = 0.7 THEN 'de' WHEN sure = 0.6 THEN 'en' END AS y, CASE WHEN NOT identified THEN sure END AS sure FROM f)
    SELECT id, coalesce(old_p, p) AS publisher, coalesce(old_s, y) AS system, concat_ws(',', CASE WHEN old_p IS NULL AND p IS NOT NULL THEN 'publisher' END, CASE WHEN old_s IS NULL AND y IS NOT NULL THEN 'system' END) AS changed,
      CASE WHEN (old_p IS NULL AND p IS NOT NULL) OR (old_s IS NULL AND y IS NOT NULL) THEN sure::DOUBLE END AS confidence FROM g""",
    "products",
)
def syn01(s, d):
    own = src.products(s, d).select("id", "file_hash", "title", F.when(F.col("id") % 4 != 0, F.col("publisher")).alias("publisher"), "system", (F.col("id") % 5 == 0).alias("identified"))
    patterns = s.createDataFrame(TITLES, "pattern string, confidence double, pattern_id int, publisher string, system string")
    only = entries(s, d).withColumn("file_hashes", F.slice("file_hashes", 1, 1))
    return registry.pull(own, only, patterns, ["publisher", "system"]).select("id", "publisher", "system", F.array_join("changed", ",").alias("changed"), "confidence")


@query(
    "syn04_contributions",
    """, busy AS (SELECT DISTINCT product_id FROM queue WHERE status = 'pending'), w AS (SELECT id, title, CASE WHEN size % 4 = 0 THEN 'edited' ELSE publisher END AS publisher, level_min FROM items WHERE size % 9 <> 0)
    SELECT id, '{"title":"' || title || '","publisher":"' || publisher || '"' || coalesce(',"level_min":"' || level_min || '"', '') || '}' AS payload FROM w WHERE id NOT IN (SELECT product_id FROM busy)""",
    "items", "queue",
)
def syn04(s, d):
    i = src.items(s, d).withColumn("title", F.when(F.col("size") % 9 != 0, F.col("title")).otherwise(" "))
    edits = i.filter("size % 4 = 0").select("id", F.create_map(F.lit("publisher"), F.lit("edited")).alias("edits"))
    busy = src.queue(s, d).filter("status = 'pending'").select(F.col("product_id").alias("id")).distinct()
    return registry.contributions(i, busy, ["title", "publisher", "level_min"], edits)


@query("syn02_five_fields", """SELECT id, c.f AS field, c.o AS ours, c.t AS theirs FROM (SELECT id, unnest([{f: 'title', o: title, t: upper(title)}, {f: 'publisher', o: publisher, t: CASE WHEN size % 3 > 0 THEN publisher || '!' END}, {f: 'level_min', o: level_min::VARCHAR, t: level_max::VARCHAR},
    {f: 'product_type', o: product_type, t: product_type}, {f: 'size', o: size::VARCHAR, t: (size + size % 2)::VARCHAR}]) AS c FROM items) WHERE c.o <> c.t""", "items")  # fmt: skip
def syn02(s, d):
    i, fields = src.items(s, d), ["title", "publisher", "level_min", "product_type", "size"]
    theirs = i.select("id", F.upper("title").alias("title"), F.when(F.col("size") % 3 > 0, F.concat("publisher", F.lit("!"))).alias("publisher"), F.col("level_max").alias("level_min"), "product_type", (F.col("size") + F.col("size") % 2).alias("size"))
    return changes.differences(i.select("id", *fields), theirs, "id", fields)


@query(
    "idn02_applied",
    """SELECT id, CASE WHEN ok AND size % 4 <> 0 THEN upper(title) ELSE title END AS title, CASE WHEN ok THEN 'found' ELSE publisher END AS publisher
    FROM (SELECT *, size % 3 = 0 OR (size % 3 = 1 AND size % 2 = 0) AS ok FROM items)""",
    "items",
)
def idn02(s, d):
    i = src.items(s, d)
    sure = F.when(F.col("size") % 3 == 0, 0.9).when(F.col("size") % 3 == 1, 0.6)
    found = i.filter("size % 3 < 2").select("id", sure.alias("confidence"), (F.col("size") % 2 == 0).alias("confirmed"), F.when(F.col("size") % 4 != 0, F.upper("title")).otherwise("").alias("title"), F.lit("found").alias("publisher"))
    return registry.apply_identification(i.select("id", "title", "publisher"), found, ["title", "publisher"]).select("id", "title", "publisher")


def tell(prompts: list[str]) -> list[str]:
    """A stand-in for a model: what the first letter and the number of words tell."""
    answers = []
    for p in prompts:
        words = len(re.findall(r"[^ \t\n\r\f\v]+", p))
        answers.append(f"Sure: {json.dumps({'first': p[:1], 'words': words})}" if words % 7 else "no idea")
    return answers


@query(
    "aij01_model_job",
    r"""SELECT id, CASE WHEN n % 7 <> 0 THEN p[1] END AS first, CASE WHEN n % 7 <> 0 THEN n END AS words, CASE WHEN n % 7 = 0 THEN 'no JSON in the answer' END AS error
    FROM (SELECT doc_id AS id, coalesce(text, '')[:4000] AS p, len(regexp_extract_all(coalesce(text, '')[:4000], '[^ \t\n\r\f\v]+')) AS n FROM documents)""",
)
def aij01(s, d):
    return registry.run_model(src.read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), tell, "first string, words bigint")


def bestiary(prompts: list[str]) -> list[str]:
    """A stand-in for a model that extracts: a creature for each line ``name|size|brand`` of a text; texts without one give no JSON."""
    out = []
    for p in prompts:
        found = [line.split("|") for line in p.split("\n") if line.count("|") == 2]
        each = [{"name": n, "armor_class": int(k), "abilities": {"strength": int(k) + 1}, "speed": {"walk": f"{k} ft."}, "traits": [{"name": "Keen", "description": b}, {"name": "Old"}], "senses": None, "more": 1} for n, k, b in found]
        out.append(f"Here: {json.dumps({'monsters': each})} Done." if each else "nothing")
    return out


@query(
    "aij01_extracted",
    """SELECT p_partkey AS id, CAST(v.k AS INTEGER) AS place, p_name || v.k AS name, CAST(p_size AS INTEGER) AS armor_class, CAST(p_size + 1 AS INTEGER) AS strength, p_size || ' ft.' AS walk, 'Keen:' || p_brand || ';Old:' AS traits, NULL AS error
    FROM part, (VALUES (0), (1)) v(k) WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'no JSON in the answer' FROM part WHERE p_partkey % 5 = 0""",
)
def extracted(s, d):
    """Creatures with nested fields from answers that are kept by prompt; a second run asks nothing."""
    p = src.read(s, d, "part")
    line = lambda k: F.concat("p_name", F.lit(f"{k}|"), "p_size", F.lit("|"), "p_brand")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.concat(line(0), F.lit("\n"), line(1))).otherwise(F.lit("none here")).alias("text"))
    store = new_folder(s, "answers")
    registry.extracted(rows, bestiary, store, "stand-in", "monsters")

    def never(prompts):
        raise ValueError("asked again")

    found, failed = registry.extracted(rows, never, store, "stand-in", "monsters")
    traits = F.array_join(F.transform("traits", lambda t: F.concat_ws(":", t["name"], F.coalesce(t["description"], F.lit("")))), ";")
    told = found.select("id", "place", "name", "armor_class", "abilities.strength", F.element_at("speed", "walk").alias("walk"), traits.alias("traits"), F.lit(None).cast("string").alias("error"))
    return told.unionByName(failed, allowMissingColumns=True)


@query(
    "aij02_tags",
    """SELECT DISTINCT product_id, lower(name) AS tag, lower(name) NOT IN (SELECT lower(r_name) FROM region) AS made FROM (SELECT product_id, trim(raw) AS name FROM (SELECT p_partkey AS product_id, unnest([p_brand, CASE WHEN p_size % 2 = 0 THEN 'Asia' END, ' europe ', '']) AS raw FROM part))
    WHERE name <> '' AND NOT (product_id % 2 = 0 AND lower(name) = 'asia')""",
)
def aij02(s, d):
    tags = src.read(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("tag_id"), F.col("r_name").alias("name"))
    p = src.read(s, d, "part")
    names = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, "Asia"), F.lit(" europe "), F.lit(""))
    asia = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("product_id")).crossJoin(F.broadcast(tags.filter("lower(name) = 'asia'").select("tag_id")))
    new_tags, new_links = registry.apply_tags(tags, asia, p.select(F.col("p_partkey").alias("product_id"), names.alias("names")))
    every = tags.withColumn("made", F.lit(False)).unionByName(new_tags.withColumn("made", F.lit(True)))
    return new_links.join(every, "tag_id").select("product_id", F.lower("name").alias("tag"), "made")


@query(
    "txt08_properties",
    """SELECT p_partkey AS id, nullif(trim(p_name), '') AS title, CASE WHEN p_size % 3 = 0 THEN 'Ann' END AS author, CASE WHEN p_size % 5 < 2 THEN p_brand END AS publisher,
    CASE WHEN 1960 + p_size BETWEEN 1970 AND 2030 THEN CAST(1960 + p_size AS INTEGER) END AS year FROM part""",
)
def txt08(s, d):
    p = src.read(s, d, "part")
    producers = [F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("made by "), "p_brand", F.lit(" press"))), F.when(F.col("p_size") % 5 == 1, F.upper("p_brand"))]
    author = F.when(F.col("p_size") % 3 == 0, " Ann ").otherwise(" ")
    created = F.concat(F.lit("D:"), (F.col("p_size") + 1960).cast("string"), F.lit("0101"))
    brands = {f"Brand#{k}": [f"brand#{k}"] for k in range(99, 0, -1)}
    found = registry.properties_metadata(F.concat(F.lit(" "), "p_name"), author, producers, created, brands)
    return p.select(F.col("p_partkey").alias("id"), found.alias("m")).select("id", "m.*")


@query("stm02_first_arrivals", "SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id FROM events GROUP BY ALL")
def stm02(s, d):
    rows = jobs.arriving(s, d, "events").select("user_id", "event_type", "event_id")
    return jobs.first_arrivals(s, rows, ["user_id", "event_type"], "event_id")


@query("stm02_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stm02_watermark(s, d):
    """The events span less than the time for which copies are known, so one of each kind comes through."""
    rows = jobs.arriving(s, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.arrivals(s, rows, ["user_id", "event_type"], "ts", "365 days").select("user_id", "event_type")


@query(
    "stm02_expiring",
    """WITH RECURSIVE e AS (SELECT event_id, coalesce(user_id::VARCHAR, '') || event_type AS f, epoch_ms(ts::TIMESTAMP) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT event_id, f, k, ms AS since, true AS first FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.f, e.k, CASE WHEN e.ms >= s.since + 864000000 THEN e.ms ELSE s.since END, e.ms >= s.since + 864000000 FROM s JOIN e ON e.f = s.f AND e.k = s.k + 1)
    SELECT event_id FROM s WHERE first""",
)
def stm02_expiring(s, d):
    """A kind of event of a user counts anew ten days after the last one that counted."""
    f = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), "event_type")
    rows = jobs.arriving(s, d, "events").select(F.col("event_id").alias("id"), f.alias("fingerprint"), F.col("ts").alias("at"))
    return jobs.expiring_arrivals(s, rows, 864000, "365 days").select(F.col("id").alias("event_id"))


@query(
    "stm05_drain",
    """, order_ AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS k FROM queue WHERE status = 'pending' AND attempts < 3)
    SELECT q.id, CASE WHEN k <= 50 THEN CASE WHEN q.id % 3 = 0 THEN 'submitted' WHEN q.attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE q.status END AS status, CAST(q.attempts + CASE WHEN k <= 50 THEN 1 ELSE 0 END AS BIGINT) AS attempts
    FROM queue q LEFT JOIN order_ o USING (id)""",
    "queue",
)
def stm05(s, d):
    q = src.queue(s, d).select("id", "status", "attempts", "created_at")
    return jobs.drain_contributions(s, q, lambda batch: batch.select("id", (F.col("id") % 3 == 0).alias("ok")), polls=1).select("id", "status", "attempts")


@query(
    "idn01_with_model",
    """SELECT id, method, confidence, confidence < CASE method WHEN 'model' THEN 0.9 ELSE 0.8 END AS confirm FROM (SELECT id,
      CASE WHEN known THEN 'hash' WHEN t IS NOT NULL THEN 'title' WHEN m IS NOT NULL THEN 'model' ELSE 'manual' END AS method, (CASE WHEN known THEN 1.0 ELSE coalesce(t, m, 0.0) END)::DOUBLE AS confidence
      FROM (SELECT id, file_hash IN (SELECT file_hash FROM products WHERE id % 5 = 0) AS known, CASE WHEN id % 3 = 0 THEN 0.75 END AS t,
        CASE WHEN id % 2 = 0 THEN CASE id % 4 WHEN 0 THEN 0.9 ELSE 0.6 END WHEN id % 7 = 0 THEN 0.5 END AS m FROM products))""",
    "products",
)
def idn01(s, d):
    p = src.products(s, d)
    k = F.col("id")
    answers = p.select("id", F.when(k % 4 == 0, "high").when(k % 2 == 0, "perhaps").when(k % 7 == 0, "low").alias("sure")).filter("sure is not null")
    return registry.cascade(p, p.filter(k % 5 == 0).select("file_hash"), p.filter(k % 3 == 0).select("id", F.lit(0.75).alias("confidence")), answers)


@query(
    "mkt01_filled",
    """, e AS (SELECT title AS name, arg_min(upper(title), id) AS t, arg_min('E' || publisher, id) AS p FROM items WHERE size > 25 GROUP BY title)
    SELECT id, CASE WHEN size % 2 = 0 AND t IS NOT NULL THEN t WHEN size % 2 = 0 THEN title ELSE 'own ' || title END AS title, CASE WHEN size % 3 = 0 THEN coalesce(p, '') ELSE publisher END AS publisher,
      concat_ws(',', CASE WHEN size % 2 = 0 AND t IS NOT NULL THEN 'title' END, CASE WHEN size % 3 = 0 AND p IS NOT NULL THEN 'publisher' END) AS changed FROM items LEFT JOIN e ON name = title WHERE size <= 25""",
    "items",
)
def mkt01(s, d):
    i = src.items(s, d)
    title = F.when(F.col("size") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("own "), "title"))
    ours = i.filter("size <= 25").select("id", "file_name", title.alias("title"), F.when(F.col("size") % 3 == 0, "").otherwise(F.col("publisher")).alias("publisher"))
    entries_ = i.filter("size > 25").select("id", F.upper("title").alias("title"), F.concat(F.lit("E"), "publisher").alias("publisher"))
    return registry.import_entries(ours, entries_).withColumn("changed", F.array_join("changed", ","))


@query(
    "syn05_bookkeeping",
    """SELECT id, CASE WHEN sent THEN CASE WHEN id % 3 = 0 THEN 'submitted' ELSE 'failed' END ELSE status END AS status, CAST(attempts + sent::INTEGER AS BIGINT) AS attempts, CASE WHEN sent AND id % 3 <> 0 THEN 'refused ' || id END AS message
    FROM (SELECT *, status = 'pending' AND attempts < 3 AND id % 5 <> 0 AS sent FROM queue)""",
    "queue",
)
def syn05(s, d):
    q = src.queue(s, d).select("id", "status", "attempts")
    k = F.col("id")
    results = q.filter(k % 5 != 0).select("id", (k % 3 == 0).alias("ok"), F.concat(F.lit("refused "), k).alias("message"))
    return registry.book_submissions(q, results)


@query("vec01_replaced", "SELECT vec_id AS id, CASE WHEN label = 3 THEN 0.0 ELSE embedding[1]::DOUBLE END AS first FROM embeddings WHERE label <> 3 OR vec_id % 2 = 0")
def vec01(s, d):
    v = src.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("product_id"), "embedding")
    new = v.filter("product_id = 3 and id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: F.lit(0).cast("float")))
    return registry.replace_rows(v, new, "product_id").select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("txt12_first_source", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS source FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def txt12(s, d):
    o = src.read(s, d, "orders").select(F.col("o_orderkey").alias("doc"))
    return registry.first_source(o.filter("doc % 2 = 0"), o.filter("doc % 3 = 0"))


@query(
    "txt12_outlines",
    f"""WITH {catalog.OUTLINE_SQL}, lines AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
    told AS (SELECT doc, n AS page, CASE WHEN n % 3 = 1 THEN k || '. ' ELSE '' END || 'Section ' || k AS title FROM lines QUALIFY n >= min(n) FILTER (n % 3 = 0) OVER (PARTITION BY doc)),
    rows AS (SELECT o.doc, 'outline' AS source, o.seq, o.level, o.title, CASE WHEN o.seq % 5 > 0 THEN o.page END AS page, max(b.seq) AS parent_seq FROM o LEFT JOIN o b ON b.doc = o.doc AND b.seq < o.seq AND b.level < o.level WHERE o.doc % 3 = 0 GROUP BY ALL
      UNION ALL SELECT doc, 'text', row_number() OVER (PARTITION BY doc ORDER BY page), 1, title, page, NULL FROM told WHERE doc % 3 = 1)
    SELECT DISTINCT lines.doc, coalesce(source, 'none') AS source, seq::BIGINT AS seq, level::INTEGER AS level, title, page::INTEGER AS page, end_page::INTEGER AS end_page, parent_seq::BIGINT AS parent_seq
    FROM lines LEFT JOIN (SELECT *, min(page) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS end_page FROM rows) USING (doc)""",
)
def txt12_outlines(s, d):
    """Every third document has an outline, with some pages that are none; the next has a contents in its text only, and one in three has neither."""
    marks = catalog.outline(s, d).filter("doc % 3 = 0").withColumn("title", F.concat(F.lit(" "), "title", F.lit(" "))).withColumn("page", F.when(F.col("seq") % 5 == 0, F.lit(-1)).otherwise(F.col("page")))
    lines = src.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("key"))
    n, key = F.col("page"), F.col("key")
    entry = F.when(n % 3 == 0, F.concat(F.lit("Section "), key, F.lit(" .... "), n)).when(n % 3 == 1, F.concat(key, F.lit(". Section "), key, F.lit(" "), n)).otherwise(F.concat(F.lit("Section "), key, F.lit("    "), n))
    text = F.when(F.col("doc") % 3 < 2, F.concat(F.when(n % 3 == 0, "Contents\n").otherwise(""), entry, F.lit("\nplain words"))).otherwise("plain words")
    return documents.whole_outlines(lines, marks, lines.select("doc", "page", text.alias("text")))


@query("snk02_versions", "SELECT p_partkey AS id, p_size + 1 AS size FROM part WHERE p_partkey % 2 = 0")
def snk02(s, d):
    """Two versions of a table are committed; the second is computed from the first and read back."""
    root = new_folder(s, "table")
    snapshots.commit(s, src.items(s, d).select("id", "size"), root)
    snapshots.commit(s, snapshots.current(s, root).filter("id % 2 = 0").withColumn("size", F.col("size") + 1), root)
    return snapshots.current(s, root)


@query("snk04_written", """SELECT 'monster' AS kind, p_partkey AS id, 'Monsters/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.md' AS path FROM part""")
def snk04(s, d):
    """Notes are stored by kind and read back."""
    at = new_folder(s, "vault")
    rows = src.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("creature_type"))
    path = F.concat(F.lit("Monsters/"), sanitize(F.concat("name", F.lit("-"), "id")), F.lit(".md"))
    entities.write_vault(entities.notes(rows, "monster").select("id", F.lit("monster").alias("kind"), path.alias("path"), "content"), at)
    return s.read.parquet(at).filter("content like '%type: monster%'").select("kind", "id", "path")


@query("snk04_contents", """SELECT 'monster' AS kind, 'Monsters/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.md' AS path,
    '---' || chr(10) || 'type: monster' || chr(10) || CASE WHEN p_size % 3 > 0 THEN 'size: Large' || chr(10) ELSE '' END || 'creature_type: ' || p_type || chr(10) || 'ac: ' || p_size || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name AS content FROM part
    UNION ALL SELECT 'location', 'Locations/' || n_name || '.md', '---' || chr(10) || 'type: location' || chr(10) || 'number: ' || n_nationkey || chr(10) || '---' || chr(10) || chr(10) || '# ' || n_name || chr(10) || chr(10) || '## Features' || chr(10) || '- one' || chr(10) || '- r' || n_regionkey FROM nation""")  # fmt: skip
def snk04_contents(s, d):
    """Notes of two kinds are stored and read back whole."""
    at, file = new_folder(s, "vault"), lambda name: F.concat(sanitize(name), F.lit(".md"))
    parts = src.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, "Large").alias("size"), F.col("p_type").alias("creature_type"), F.col("p_size").alias("armor_class"))
    places = src.read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("number"), F.array(F.lit("one"), F.concat(F.lit("r"), "n_regionkey")).alias("features"))
    monsters = entities.notes(parts, "monster").select(F.lit("monster").alias("kind"), F.concat(F.lit("Monsters/"), file(F.concat("name", F.lit("-"), "id"))).alias("path"), "content")
    locations = entities.notes(places, "location").select(F.lit("location").alias("kind"), F.concat(F.lit("Locations/"), file(F.col("name"))).alias("path"), "content")
    entities.write_vault(monsters.unionByName(locations), at)
    return s.read.parquet(at).select("kind", "path", "content")


@query(
    "snk01_extracted",
    f"""SELECT doc_id AS id, CASE WHEN pages > 0 THEN pages END AS total_pages, '1-' || pages AS pages_extracted, CASE WHEN doc_id % 2 = 0 THEN 'layout' ELSE 'plain' END AS method, length(text) AS char_count, sha256(text) AS sha, low AS is_low_text, low AS auto_marked_art,
      CASE WHEN doc_id % 5 = 0 THEN 'zine' WHEN low THEN 'Art/Maps' END AS product_type FROM (SELECT *, CASE WHEN c / greatest(pages, 1) < 100 AND c < 500 THEN true END AS low
      FROM (SELECT *, doc_id % 4 AS pages, length(trim(text, {changes_plan.BLANKS})) AS c FROM documents WHERE doc_id % 9 <> 0))""",
)
def snk01(s, d):
    """Extracted texts are written with what is known of their extraction, and read back; one in nine failed."""
    at, k = new_folder(s, "texts"), F.col("doc_id")
    pages = (k % 4).cast("int")
    given = src.read(s, d, "documents").select(
        k.alias("id"), F.when(k % 9 != 0, F.col("text")).alias("markdown"), F.struct(F.lit(1).alias("first"), pages.alias("last")).alias("pages"), F.when(pages > 0, pages).alias("total_pages"),
        F.when(k % 2 == 0, "layout").otherwise("plain").alias("method"), F.when(k % 5 == 0, "zine").otherwise("").alias("product_type"),
    )
    done = extraction.extracted(given)
    src.write_texts(done.select("id", "value"), at)
    told = F.from_json("value", "markdown string, total_pages bigint, pages_extracted string, method string, char_count bigint, is_low_text boolean, auto_marked_art boolean").alias("v")
    back = s.read.parquet(at).select("id", told).select("id", "v.*").withColumn("sha", F.sha2("markdown", 256)).drop("markdown")
    return back.join(done.select("id", "product_type"), "id")


@query("src01_listing")
def src01(s, d):
    return src.listing(s, d, "parquet").select("path", "file_size").filter("file_size > 0")


@query(
    "stm01_routed",
    """WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id),
    a AS (SELECT user_id, CASE WHEN kind = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'deleted' END WHEN user_id % 2 = 1 THEN 'added' WHEN kind <> 'view' THEN 'modified' END AS action FROM last)
    SELECT '/f' || user_id % 3 || '/sub/u' || user_id AS path, '/f' || user_id % 3 || CASE WHEN user_id % 3 = 1 THEN '/sub' ELSE '' END AS folder, action FROM a WHERE action IS NOT NULL""",
)
def stm01(s, d):
    path = F.concat(F.lit("/f"), F.col("user_id") % 3, F.lit("/sub/u"), "user_id")
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("changed")
    feed = jobs.arriving(s, d, "events").select(path.alias("path"), F.concat_ws(":", kind, "event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    seen = jobs.latest_changes(s, feed)
    last = seen.select("path", F.substring_index("kind", ":", 1).alias("kind"), F.substring_index("kind", ":", -1).alias("file_hash"))
    users = src.read(s, d, "events").select("user_id").distinct()
    stored = users.filter("user_id % 2 = 0").select(path.alias("path"), F.lit("view").alias("file_hash"))
    folders = users.select(F.explode(F.array(*map(F.lit, ("/f0", "/f1", "/f2", "/f1/sub")))).alias("folder")).distinct()
    return ingest.routed_changes(last, stored, folders)
