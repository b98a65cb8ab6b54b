"""Queries of entities, row checks and smaller views, each with the same query in SQL. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import numeric, text
from vellum.operators import catalog as ops
from vellum.operators import changes, checks, entities
from vellum.operators import documents as docs
from vellum.plans.catalog import query
from vellum.sources import catalog as src


def creatures(s, d):
    p = src.read(s, d, "part")
    size = F.element_at(F.array(*map(F.lit, ("Large", "tiny", None, "vast"))), F.col("p_size") % 4 + 1)
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), size.alias("size"), F.col("p_type").alias("creature_type"), F.col("p_size").alias("armor_class"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 2).alias("hit_points"), F.array(*(F.col("p_size") + k for k in range(6))).alias("abilities"),
    )


CREATURES_SQL = """creatures AS (SELECT p_partkey AS id, p_name AS name, ['Large', 'tiny', NULL, 'vast'][p_size % 4 + 1] AS size, p_type AS creature_type, p_size AS armor_class, CASE WHEN p_size % 3 > 0 THEN p_size * 2 END AS hit_points FROM part)"""


@query(
    "str13_actors",
    f"""WITH {CREATURES_SQL} SELECT id, name, armor_class AS ac, hit_points AS hp, creature_type AS kind, CASE armor_class % 4 WHEN 0 THEN 'lg' WHEN 1 THEN 'tiny' ELSE 'med' END AS size, armor_class + 5 AS cha FROM creatures""",
)
def actors(s, d):
    at = lambda path, kind="string": F.get_json_object("json", f"$.{path}").cast(kind)
    return entities.actors(creatures(s, d)).select(
        "id", at("name").alias("name"), at("system.attributes.ac.flat", "int").alias("ac"), at("system.attributes.hp.max", "int").alias("hp"), at("system.details.type.value").alias("kind"),
        at("system.traits.size").alias("size"), at("system.abilities.cha.value", "int").alias("cha"),
    )


@query(
    "str13_spells",
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'nec' ELSE 'evo' END AS school, CASE o_orderkey % 4 WHEN 0 THEN 'bonus' WHEN 1 THEN 'minute' ELSE 'action' END AS activation,
    CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 5 AS INTEGER) END AS duration, CASE WHEN o_orderkey % 5 < 4 THEN 'hour' ELSE 'inst' END AS units FROM orders""",
)
def spells(s, d):
    k = F.col("o_orderkey")
    rows = src.read(s, d, "orders").select(
        k.alias("id"), F.concat(F.lit("Spell "), k).alias("name"), F.when(k % 3 == 0, "Necromancy").when(k % 3 == 1, "unknown").alias("school"),
        F.when(k % 4 == 0, "1 Bonus action").when(k % 4 == 1, "10 minutes").when(k % 4 == 2, "1 action").alias("casting_time"),
        F.when(k % 5 < 4, F.concat(k % 5, F.lit(" hours"))).otherwise("Instantaneous").alias("duration"), F.when(k % 2 == 0, "60 feet").alias("range"), (k % 10).alias("level"),
    )
    at = lambda path, kind="string": F.get_json_object("json", f"$.system.{path}").cast(kind)
    return entities.spells(rows).select("id", at("school").alias("school"), at("activation.type").alias("activation"), at("duration.value", "int").alias("duration"), at("duration.units").alias("units"))


def whole_creatures(s, d):
    """Creatures with nested fields: speeds, senses, saves, resistances and parts, some of them missing."""
    k, size = F.col("id"), F.col("armor_class")
    part = lambda name, text: F.struct(F.lit(name).alias("name"), text.cast("string").alias("description"))
    return creatures(s, d).withColumns({
        "speed": F.create_map(F.lit("walk"), F.concat(size, F.lit(" ft.")), F.lit("fly"), F.when(k % 2 == 0, "60 ft.")), "senses": F.when(k % 3 > 0, F.create_map(F.lit("darkvision"), F.concat(size * 10, F.lit(" ft.")))),
        "saving_throws": F.create_map(F.lit("wis"), size, F.lit("dex"), size + 1), "damage_resistances": F.when(k % 4 > 0, F.array(F.lit("fire"), F.lit("cold"))),
        "traits": F.when(k % 5 > 0, F.array(part("Keen", F.lit("sees")))), "actions": F.array(part("Bite", size), part("Claw", F.lit(None))), "legendary_actions": F.when(k % 2 == 1, F.array(part("Roar", k))),
    })


@query(
    "str13_whole_actors",
    """SELECT p_partkey AS id, p_size || ' ft.' AS walk, CASE WHEN p_partkey % 2 = 0 THEN '60 ft.' END AS fly, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size * 10 AS INTEGER) END AS darkvision, CASE WHEN p_partkey % 4 > 0 THEN 'fire,cold' END AS resists,
    CASE WHEN p_partkey % 5 > 0 THEN 'Keen:sees:-;' ELSE '' END || 'Bite:' || p_size || ':action;Claw::action' || CASE WHEN p_partkey % 2 = 1 THEN ';Roar:' || p_partkey || ':legendary' ELSE '' END AS items FROM part""",
)
def whole_actors(s, d):
    schema = "system struct<attributes:struct<movement:struct<walk:string,fly:string>,senses:struct<darkvision:int>>,traits:struct<dr:struct<value:array<string>>>>, items array<struct<name:string,type:string,system:struct<description:struct<value:string>,activation:struct<type:string>>>>"
    at = entities.actors(whole_creatures(s, d)).select("id", F.from_json("json", schema).alias("a"))
    item = lambda i: F.concat_ws(":", i["name"], i["system"]["description"]["value"], F.coalesce(i["system"]["activation"]["type"], F.lit("-")))
    a = "a.system.attributes"
    return at.select("id", F.col(f"{a}.movement.walk").alias("walk"), F.col(f"{a}.movement.fly").alias("fly"), F.col(f"{a}.senses.darkvision").alias("darkvision"), F.array_join("a.system.traits.dr.value", ",").alias("resists"), F.array_join(F.transform("a.items", item), ";").alias("items"))


@query(
    "str12_whole_notes",
    """WITH c AS (SELECT p_partkey AS k, p_size AS s, [p_size, p_size + 1, p_size + 2, p_size + 3, p_size + 4, p_size + 5] AS scores FROM part)
    SELECT k AS id, '| STR | DEX | CON | INT | WIS | CHA |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || '| ' || array_to_string(list_transform(scores, lambda x: x || ' (' || CASE WHEN x >= 10 THEN '+' ELSE '' END || CAST(floor((x - 10) / 2) AS INTEGER) || ')'), ' | ') || ' |' AS abilities,
    CASE WHEN k % 2 = 0 THEN 'fly 60 ft., ' ELSE '' END || 'walk ' || s || ' ft.' AS speed, 'dex ' || (s + 1) || ', wis ' || s AS saves, '***Bite.*** ' || s || chr(10) || chr(10) || '***Claw.*** ' AS actions, CASE WHEN k % 5 > 0 THEN '***Keen.*** sees' END AS traits FROM c""",
)
def whole_notes(s, d):
    part = lambda title: F.nullif(F.regexp_extract("content", rf"(?s)\n## {title}\n(.*?)(?=\n\n## |$)", 1), F.lit(""))
    return entities.notes(whole_creatures(s, d), "monster").select("id", part("Abilities").alias("abilities"), part("Speed").alias("speed"), part("Saving throws").alias("saves"), part("Actions").alias("actions"), part("Traits").alias("traits"))


@query(
    "str12_monster_notes",
    f"""WITH {CREATURES_SQL} SELECT id, '---' || chr(10) || 'type: monster' || coalesce(chr(10) || 'size: ' || size, '') || chr(10) || 'creature_type: ' || creature_type || chr(10) || 'ac: ' || armor_class || coalesce(chr(10) || 'hp: ' || hit_points, '')
    || chr(10) || '---' || chr(10) || chr(10) || '# ' || name AS content FROM creatures""",
)
def monster_notes(s, d):
    return entities.notes(creatures(s, d).drop("abilities"), "monster").select("id", "content")


@query(
    "str12_table_notes",
    """SELECT l_orderkey AS id, '---' || chr(10) || 'type: table' || chr(10) || 'die: d20' || chr(10) || '---' || chr(10) || chr(10) || '# Order' || chr(10) || chr(10) || '## Entries' || chr(10) || '| Roll | Result |' || chr(10) || '| --- | --- |' || chr(10)
    || string_agg('| ' || l_linenumber || '-' || (l_linenumber + 1) || ' | a\\|' || l_partkey || ' |', chr(10) ORDER BY l_linenumber, l_partkey) AS content FROM lineitem GROUP BY 1""",
)
def table_notes(s, d):
    entry = F.struct(F.col("l_linenumber").alias("low"), (F.col("l_linenumber") + 1).alias("high"), F.col("l_partkey"), F.concat(F.lit("a|"), "l_partkey").alias("result"))
    rows = src.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return entities.notes(rows.withColumns({"name": F.lit("Order"), "die": F.lit("d20")}), "table").select("id", "content")


@query("snk03_blocks", """SELECT publisher AS source, 'actors' AS kind, count(*) AS n FROM items GROUP BY 1""", "items")
def snk03_blocks(s, d):
    rows = src.items(s, d).select(F.col("publisher").alias("source"), F.lit("actors").alias("kind"), "id", F.to_json(F.struct("title", "size")).alias("json"))
    return entities.compendium_rows(rows).groupBy("source", "kind").agg(F.sum(F.json_array_length("json")).alias("n"))


@query("flt06_at_most", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 < 3 AND o_orderkey % 5 <> 1")
def flt06(s, d):
    level = F.element_at(F.array(*map(F.lit, ("none", "endgame", "major", "minor_typo", None))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return checks.at_most(src.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level")), "level", "major").select("id")


@query("flt11_gates", "SELECT id, coalesce(length(text) >= 200, false) AS batch, coalesce(length(text) >= 100, false) AS queued FROM products", "products")
def flt11(s, d):
    return src.products(s, d).select("id", checks.long_enough(F.col("text"), 200).alias("batch"), checks.long_enough(F.col("text"), 100).alias("queued"))


@query(
    "flt12_notes",
    """SELECT * FROM (SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 'note_type' END, CASE WHEN o_orderkey % 3 = 1 THEN 'spoiler_level' END, CASE WHEN o_orderkey % 7 IN (0, 6) THEN 'rating' END, CASE WHEN o_orderkey % 4 > 1 THEN 'colour' END) AS violations FROM orders) WHERE violations <> ''""",
)
def flt12(s, d):
    k = F.col("o_orderkey")
    rows = src.read(s, d, "orders").select(
        k.alias("id"), F.when(k % 2 == 1, "rant").otherwise("review").alias("note_type"), F.when(k % 3 == 1, "all").when(k % 3 == 2, "minor").alias("spoiler_level"), (k % 7).alias("rating"),
        F.when(k % 4 == 0, "#12abEF").when(k % 4 == 2, "#12abEG").when(k % 4 == 3, "red").alias("colour"),
    )
    return checks.violations(rows).withColumn("violations", F.array_join("violations", ","))


@query(
    "jn14_both_folds",
    """SELECT c_custkey AS id, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS products,
    coalesce((SELECT string_agg(role, ',' ORDER BY turn, role) FROM conversations WHERE conv_id = c_custkey), '') AS sessions FROM customer""",
)
def jn14(s, d):
    parents = src.read(s, d, "customer").select(F.col("c_custkey").alias("id"))
    products = src.read(s, d, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("product_id"), F.col("o_orderkey").cast("string").alias("title"))
    sessions = src.read(s, d, "conversations").select(F.col("conv_id").alias("campaign"), F.col("turn").alias("number"), F.col("role").alias("title"))
    return checks.campaigns(parents, products, sessions).select("id", F.array_join("products", ",").alias("products"), F.array_join("sessions", ",").alias("sessions"))


@query("prp01_bundle", """SELECT c_custkey AS id, 'Session ' || ((SELECT count(*) FROM conversations WHERE conv_id = c_custkey) + 1) || ' of ' || c_name AS overview, 7 AS steps FROM customer""")
def prp01(s, d):
    parents = src.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    products = src.read(s, d, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("product_id"), F.col("o_orderkey").cast("string").alias("title"))
    sessions = src.read(s, d, "conversations").select(F.col("conv_id").alias("campaign"), F.col("turn").alias("number"), F.col("role").alias("title"))
    return checks.session_bundle(checks.campaigns(parents, products, sessions)).select("id", "overview", F.size("checklist").alias("steps"))


@query("win09_continued", "SELECT o_orderkey AS id, o_custkey % 10 + 0 AS base, coalesce((SELECT max(turn) FROM conversations WHERE conv_id = o_custkey), 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def win09(s, d):
    new = src.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("campaign"), "o_orderdate")
    existing = src.read(s, d, "conversations").select(F.col("conv_id").alias("campaign"), F.col("turn").alias("number"))
    return checks.numbered(new, existing, "campaign", "o_orderdate", "id").select("id", (F.col("campaign") % 10).alias("base"), "number")


@query("txt16_first_method", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'first' WHEN page_id % 3 = 1 THEN 'second' ELSE 'none' END AS method, CASE WHEN page_id % 3 < 2 THEN length(html) END AS chars FROM pages""")
def txt16(s, d):
    tries = {"first": F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(" "), "second": F.when(F.col("page_id") % 3 == 1, F.col("html"))}
    return src.read(s, d, "pages").select("page_id", checks.cascade(tries).alias("c")).select("page_id", "c.method", F.length("c.text").cast("long").alias("chars"))


@query("txt04_type", "SELECT id, CASE WHEN id % 5 = 0 THEN 'zine' WHEN length(text) / (id % 4 + 1) < 100 AND length(text) < 500 THEN 'Art/Maps' END AS type FROM products", "products")
def txt04(s, d):
    pages = F.col("id") % 4 + 1
    return src.products(s, d).select("id", checks.low_text_type(F.length("text"), pages, F.when(F.col("id") % 5 == 0, "zine").otherwise("")).alias("type"))


@query("blk08_notes", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'private' WHEN o_orderstatus = 'F' THEN 'already shared' ELSE 'note-' || o_orderkey END AS outcome FROM orders WHERE o_orderkey % 2 = 0")
def blk08(s, d):
    k = F.col("o_orderkey")
    notes = src.read(s, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "private").otherwise("public").alias("visibility"), F.when(F.col("o_orderstatus") == "F", "old").alias("shared_id"))
    shared, rejected = checks.share_notes(notes, notes.filter("id % 2 = 0"))
    return shared.select("id", F.col("shared_id").alias("outcome")).unionByName(rejected.select("id", F.col("reason").alias("outcome")))


@query("blk07_titles", "SELECT DISTINCT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '*' END AS name, n_nationkey % 2 = 1 AS accepted FROM nation")
def blk07(s, d):
    n = src.read(s, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    incoming = n.select(F.concat("name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("*")).alias("name"))
    accepted, conflicts = changes.insert_new(n.select("name"), incoming.unionByName(incoming), "name")
    return accepted.select("name", F.lit(True).alias("accepted")).unionByName(conflicts.select("name").distinct().withColumn("accepted", F.lit(False)))


@query("blk04_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def blk04(s, d):
    gone = src.read(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.cascade(src.read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("agg02_all_facets", """, shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, id) AS k FROM products WHERE NOT is_missing) WHERE k = 1)
    SELECT 'system' AS dim, coalesce(system, 'Unknown') AS value, count(*) AS n FROM shown GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'publisher', publisher, count(*) AS n FROM shown WHERE publisher IS NOT NULL GROUP BY 2 ORDER BY n DESC, publisher LIMIT 50)""", "products")  # fmt: skip
def agg02(s, d):
    shown = ops.canonical(src.products(s, d)).filter("not is_duplicate")
    by_system = ops.facet_counts(shown, "system", keep_null=True).select(F.lit("system").alias("dim"), "value", "n")
    return by_system.unionByName(ops.facet_counts(shown, "publisher", top=50).select(F.lit("publisher").alias("dim"), "value", "n"))


@query("agg18_means", "SELECT round(sum(c), 6) AS total, round(avg(c), 6) AS mean FROM (SELECT (floor(least(length(text), 4000) / 4) + 200) * 0.15 / 1e6 + 150 * 0.6 / 1e6 AS c FROM documents)")
def agg18(s, d):
    cost = numeric.estimate_cost(F.col("text"), "small")
    return src.read(s, d, "documents").agg(F.round(F.sum(cost), 6).alias("total"), F.round(F.avg(cost), 6).alias("mean"))


@query(
    "agg14_page_ends",
    """WITH p AS (SELECT o_orderkey AS doc, k AS page, 'body ' || k || chr(10) || CASE WHEN k % 2 = 0 THEN 'Footer ' || o_orderkey % 5 ELSE 'x' || k END || chr(10) || 'Page ' || k AS text FROM orders, (VALUES (1), (2), (4), (6), (8)) v(k)),
    l AS (SELECT doc, trim(unnest(list_reverse(string_split(text, chr(10)))[1:3])) AS line FROM p) SELECT doc, line FROM l WHERE line <> '' AND length(line) < 100 GROUP BY ALL HAVING count(*) > 2""",
)
def agg14(s, d):
    k = F.col("page")
    pages = src.read(s, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*map(F.lit, (1, 2, 4, 6, 8)))).alias("page"))
    body = F.concat(F.lit("body "), k, F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("Footer "), F.col("doc") % 5)).otherwise(F.concat(F.lit("x"), k)), F.lit("\nPage "), k)
    return docs.repeated_lines(pages.withColumn("text", body))


@query("str02_path_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, list_contains(string_split(url, '/'), 'blog') AS in_blog FROM pages")
def str02(s, d):
    name = text.base_name(F.col("url"))
    return src.read(s, d, "pages").select("page_id", name.alias("name"), text.stem(name).alias("stem"), text.has_part(F.col("url"), "blog").alias("in_blog"))


@query("str11_first_integer", "SELECT p_partkey AS id, CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INTEGER) AS number FROM part")
def str11(s, d):
    return src.read(s, d, "part").select(F.col("p_partkey").alias("id"), text.first_integer(F.col("p_brand")).alias("number"))


@query("txt06_author_year", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo Ray and Cy Dee' END AS author, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""")
def txt06(s, d):
    k = F.col("o_orderkey")
    credit = F.when(k % 3 == 0, "Written by: Ann Lee, Layout by Someone Else").when(k % 3 == 1, "Designer: Bo Ray and Cy Dee").otherwise("no credits here")
    body = F.concat(credit, F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("Copyright "), F.year("o_orderdate"))).otherwise("in 1850"))
    return src.read(s, d, "orders").select(k.alias("id"), docs.author_of(body).alias("author"), text.year_of_text(body).alias("year"))


CARD_SCORES = " || ' | ' || ".join(f"CASE WHEN armor_class + {k} = 0 THEN '—' ELSE (armor_class + {k}) || printf(' (%+d)', floor((armor_class + {k} - 10) / 2.0)::BIGINT) END" for k in range(6))


@query(
    "str12_encounter_cards",
    f"""WITH {CREATURES_SQL} SELECT id, chr(10) || '## ' || name || chr(10) || '**AC** ' || armor_class || ' | **HP** ' || coalesce(hit_points::VARCHAR, '?') || ' | **CR** ?' || chr(10) || chr(10) || '| STR | DEX | CON | INT | WIS | CHA |' || chr(10)
      || '|:---:|:---:|:---:|:---:|:---:|:---:|' || chr(10) || '| ' || {CARD_SCORES} || ' |' || chr(10) || CASE WHEN id % 4 > 0 THEN chr(10) || '### Actions' || chr(10) || (SELECT string_agg('- **' || CASE WHEN k = 2 THEN 'Action' ELSE 'A' || k END
      || '**: ' || repeat(name || ' ', 8)[:100] || '...' || chr(10), '' ORDER BY k) FROM range(1, least(id % 4 + 2, 4)) r(k)) ELSE '' END AS card FROM creatures""",
)
def encounter_cards(s, d):
    """Creatures with none to four actions, one of them without a name."""
    action = lambda k: F.struct(F.when(k != 2, F.concat(F.lit("A"), k)).alias("name"), F.repeat(F.concat("name", F.lit(" ")), 8).alias("description"))
    given = F.when(F.col("id") % 4 > 0, F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int")), action))
    return entities.encounter_cards(creatures(s, d).withColumn("actions", given))


@query(
    "str12_npc_cards",
    """SELECT c_custkey AS id, chr(10) || '## ' || c_name || chr(10) || '*' || CASE WHEN c_custkey % 2 = 0 THEN 'elf' ELSE '' END || ' smith* ' || CASE WHEN c_custkey % 3 > 0 THEN '(' || c_mktsegment || ')' ELSE '' END || chr(10) || chr(10)
      || CASE WHEN c_custkey % 5 > 0 THEN '**Appearance**: tall' || chr(10) || chr(10) ELSE '' END || '**Wants**: ' || c_nationkey || chr(10) || chr(10) || CASE WHEN c_custkey % 7 = 0 THEN '> **Secret**: none' || chr(10) ELSE '' END AS card FROM customer""",
)
def npc_cards(s, d):
    k = F.col("c_custkey")
    return entities.npc_cards(src.read(s, d, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "elf").otherwise("").alias("race"), F.lit("smith").alias("occupation"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("role"),
        F.when(k % 5 > 0, "tall").alias("description"), F.col("c_nationkey").alias("motivation"), F.when(k % 7 == 0, "none").alias("secret"),
    ))
