"""Catalog, ingest, search, registry and entity operators on small rows."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import catalog as ops
from vellum.operators import checks, entities, ingest, listing, registry, search
from vellum.operators import documents as docs
from vellum.sources import catalog as src
from vellum.streaming import jobs


def test_outlines_nest_to_any_depth(spark):
    rows = [(1, i, level, f"t{i}") for i, level in enumerate([1, 2, 3, 4, 4, 2, 6, 1])]
    found = ops.outline_parents(spark.createDataFrame(rows, "doc int, seq bigint, level int, title string")).orderBy("seq").collect()
    assert [r["parent_seq"] for r in found] == [None, 0, 1, 2, 2, 0, 5, None]
    assert found[4]["path"] == "t0/t1/t2/t4" and found[7]["path"] == "t7"


def test_equal_titles_are_matched_one_by_one(spark):
    patterns = spark.createDataFrame([("ab", 0.6, 1), ("abc", 0.95, 2), ("x", 0.2, 3)], "pattern string, confidence double, pattern_id int")
    df = spark.createDataFrame([("ABCD",), ("ABCD",), ("ab",), ("x",), (None,)], "title string")
    assert sorted((r["title"], r["pattern_id"]) for r in ops.fuzzy_titles(df, "title", patterns).collect()) == [("ABCD", 2), ("ABCD", 2), ("ab", 2)]


def test_rules_that_make_no_sense_never_match(spark):
    files = spark.createDataFrame([("/a/b/c.pdf", 5), ("/a/x.PDF", 50)], "path string, size bigint")
    rules = [(1, "regex", "(", 9), (2, "size_min", "many", 9), (3, "folder_path", "/a/?", 1), (4, "size_max", "40", 5), (5, "folder_name", "x.PDF", 5)]
    one = {r["path"]: r["rule_id"] for r in ingest.first_rules(files, rules).collect()}
    other = {r["path"]: r["r"] for r in files.select("path", ops.first_rule(rules, F.col("path"), F.col("size")).alias("r")).collect()}
    assert one == other == {"/a/b/c.pdf": 3, "/a/x.PDF": 4}


def test_an_ingest_reads_only_what_may_have_changed(spark):
    stored = spark.createDataFrame([("a", 1, 3, 10, "h", False), ("b", 2, 3, None, "h", False), ("c", 3, 3, 10, "h", True), ("d", 4, 3, 10, "h", False)], "path string, id bigint, size bigint, modified_at bigint, file_hash string, is_missing boolean")
    listed = spark.createDataFrame([("a", 3, 10), ("b", 3, 10), ("c", 3, 9), ("e", 3, 1), ("f", 3, 1), ("skip/x", 3, 1)], "path string, size bigint, modified_at bigint")
    graves, rules = spark.createDataFrame([("f",), ("f",)], "path string"), [(1, "folder_name", "skip", 1)]
    steps = {r["path"]: r["step"] for r in ingest.plan(stored, listed, graves, rules).collect()}
    assert steps == {"a": "unchanged", "b": "read", "c": "read", "d": "missing", "e": "new", "f": "buried", "skip/x": "excluded"}
    contents = spark.createDataFrame([(p, bytearray(b"abc")) for p in "bce"], "path string, content binary")
    found = {r["path"]: (r["action"], r["duplicate_of"]) for r in ingest.ingest(stored, listed, graves, rules, contents).collect()}
    assert found["b"] == ("updated", None) and found["c"][0] == "updated" and found["e"] == ("new", None) and found["d"][0] == "missing"
    assert {r["step"] for r in ingest.plan(stored, listed, graves, rules, force=True).filter("path = 'a'").collect()} == {"read"}


def test_seeding_happens_once(spark):
    rules = spark.createDataFrame([(1, False)], "id int, is_default boolean")
    defaults = spark.createDataFrame([(2, True), (3, True)], "id int, is_default boolean")
    once = ingest.seed(rules, defaults)
    assert once.count() == 3 and ingest.seed(once, defaults).count() == 3
    assert ingest.clear_tombstones(rules).count() == 0


def test_pages_of_nothing_and_unknown_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "id int, title string")
    assert [r["id"] for r in listing.page_of(df, listing.order_by("no such", True), 1, 2).collect()] == [3, 2] or [r["id"] for r in listing.page_of(df, listing.order_by("no such", True), 1, 2).collect()] == [2, 3]
    assert [r["pages"] for r in listing.page_of(df, listing.order_by(None), 1, 2).collect()] == [2, 2]
    assert listing.page_of(df.limit(0), listing.order_by(None), 1, 2).count() == 0


def test_snippets_take_the_densest_window(spark):
    words = ["hit"] + ["x"] * 20 + ["hit", "hit", "y", "hit"] + ["z"] * 9
    found = search.snippets(spark.createDataFrame([(1, " ".join(words))], "id int, text string"), "HI", 4, around=0).first()["snippet"]
    assert found == "...<mark>hit</mark> <mark>hit</mark> y <mark>hit</mark>..."


def test_long_lines_are_cut_around_the_hit(spark):
    line = "a" * 400 + "NEEDLE" + "b" * 400
    found = search.matching_lines(spark.createDataFrame([(1, f"x\n{line}\ny"), (2, "n needle")], "id int, text string"), "needle").orderBy("id").collect()
    assert found[0]["context"] == "a" * 100 + "NEEDLE" + "b" * 100 and found[1]["context"] == "n needle"


def test_model_jobs_keep_errors_to_their_rows(spark):
    def ask(prompts):
        if any("boom" in p for p in prompts):
            raise ValueError("no answer")
        return ['{"n": 1}' if p else "?" for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "boom"), (4, None)], "id bigint, text string").coalesce(1)
    found = {r["id"]: (r["n"], r["error"]) for r in registry.run_model(df, ask, "n int", batch=1).collect()}
    assert found == {1: (1, None), 2: (None, "no JSON in the answer"), 3: (None, "no answer"), 4: (None, "no JSON in the answer")}


def test_tags_are_found_or_made(spark):
    tags = spark.createDataFrame([(1, "Horror")], "tag_id bigint, name string")
    links = spark.createDataFrame([(7, 1)], "product_id bigint, tag_id bigint")
    asked = spark.createDataFrame([(7, ["horror", "New"]), (8, ["HORROR", " new ", ""]), (9, None)], "product_id bigint, names array<string>")
    made, new = registry.apply_tags(tags, links, asked)
    assert made.count() == 1 and {(r[0], r[1] == 1) for r in new.collect()} == {(7, False), (8, True), (8, False)}


def test_entities_by_hand(spark):
    row = spark.createDataFrame([(1, "Ogre", None, "Large", [19, 8, 16, 5, 7, 7], ["a", "b"])], "id int, name string, alignment string, size string, abilities array<int>, features array<string>")
    assert entities.actors(row).first()["json"] == '{"name":"Ogre","system":{"details":{},"traits":{"size":"lg"},"abilities":{"str":{"value":19},"dex":{"value":8},"con":{"value":16},"int":{"value":5},"wis":{"value":7},"cha":{"value":7}}},"type":"npc"}'
    assert entities.notes(row, "location").first()["content"].endswith("# Ogre\n\n## Features\n- a\n- b")


def test_vault_and_texts_are_stored(spark, tmp_path):
    files = spark.createDataFrame([("npc", "NPCs/A.md", "x"), ("spell", "Spells/B.md", "y")], "kind string, path string, content string")
    entities.write_vault(files, f"{tmp_path}/vault")
    assert spark.read.parquet(f"{tmp_path}/vault").filter("kind = 'npc'").first()["content"] == "x"
    src.write_texts(spark.createDataFrame([(1, '{"markdown": "hi"}'), (2, "{")], "id bigint, value string"), f"{tmp_path}/texts")
    found = src.with_text(spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), src.read_texts(spark, f"{tmp_path}/texts")).collect()
    assert {r["id"]: r["markdown"] for r in found} == {1: "hi", 2: None, 3: None}


def test_listing_of_files(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / name).write_bytes(b"12345")
    found = src.listing(spark, f"{tmp_path}/in").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == ["a.pdf", "b.PDF"] and {r["file_size"] for r in found} == {5}


def test_checks_by_hand(spark):
    df = spark.createDataFrame([(1, "review", "none", 5), (2, "x", "all", 0), (3, None, None, None)], "id int, note_type string, spoiler_level string, rating int")
    assert {r["id"]: r["violations"] for r in checks.violations(df).collect()} == {2: ["note_type", "spoiler_level", "rating"]}
    assert {r["id"] for r in checks.at_most(df, "spoiler_level", "minor").collect()} == {1}


def test_contents_lines_by_shape(spark):
    lines = ["One .... 3", "Two   12", "3. Three 9", "Four 4", "no page ....", ".... 5", "A--7", "12", ""]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(docs.contents_line(F.col("l")).alias("c"))
    assert [tuple(r["c"]) if r["c"] else None for r in df.collect()] == [("One", 3), ("Two", 12), ("3. Three", 9), None, None, None, ("A", 7), None, None]


def test_first_arrivals_over_batches(spark, tmp_path):
    for i, v in enumerate((5, 3, 9)):
        spark.createDataFrame([(1, v), (2, i)], "k bigint, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows.parquet")
    found = jobs.first_arrivals(spark, jobs.arriving(spark, str(tmp_path), "rows", 1), ["k"], "v")
    assert {r["k"]: r["v"] for r in found.collect()} == {1: 5, 2: 0}


def test_path_parts(spark):
    df = spark.createDataFrame([("/a/blog/x.tar.gz",), (None,)], "p string")
    assert [tuple(r) for r in df.select(text.has_part(F.col("p"), "blog"), text.stem(text.base_name(F.col("p")))).collect()] == [(True, "x.tar"), (None, None)]


def test_seed_documents_one_a_file_or_one_a_line(spark, tmp_path):
    import json

    entry = {"file_hashes": ["a", "b"], "file_size": 7, "page_count": None, "title": "T", "publisher": None, "level_range": {"min": None, "max": 3}, "external_links": {}, "tags": ["x"], "confidence": 1.0, "source": "manual", "more": 1}
    (tmp_path / "seed.json").write_text(json.dumps({"version": "1.0", "generated_at": "now", "source": "s", "products": [entry, entry | {"level_range": None}]}, indent=2))
    found = registry.read_seed(spark, str(tmp_path / "seed.json"), pretty=True).collect()
    assert [(r["seed_source"], r["title"], r["level_range"] and tuple(r["level_range"]), r["external_links"], r["game_system"]) for r in found] == [("s", "T", (None, 3), {}, None), ("s", "T", None, {}, None)]
    rows = spark.createDataFrame([(1, ["h"], "A", None, 0), (2, ["i"], None, None, 4)], "id int, file_hashes array<string>, title string, level_min int, level_max int")
    docs = registry.seed_documents(rows, "s", F.lit("now"), blocks=1)
    assert '"level_range":null' in docs.first()["json"] and '"level_range":{"min":null,"max":4}' in docs.first()["json"] and '"tags":[]' in docs.first()["json"]
    docs.write.text(f"{tmp_path}/lines")
    assert {r["title"]: (r["file_hashes"], r["confidence"], r["source"]) for r in registry.read_seed(spark, f"{tmp_path}/lines").collect()} == {"A": (["h"], 1.0, "manual"), None: (["i"], 1.0, "manual")}
    (tmp_path / "bad.json").write_text("{broken")
    assert registry.read_seed(spark, str(tmp_path / "bad.json")).count() == 0 and registry.seed_documents(rows.limit(0), "s", F.lit("now")).count() == 0


def test_extracted_texts(spark):
    from vellum.operators import extraction

    rows = [(1, "  short ", (1, 2), 2, "plain", ""), (2, "x" * 600, (1, 9), 9, "ocr", None), (3, None, (1, 1), 1, "plain", None), (4, "", None, None, None, "zine")]
    docs = spark.createDataFrame(rows, "id int, markdown string, pages struct<first:int,last:int>, total_pages int, method string, product_type string")
    found = {r["id"]: (r["value"], r["product_type"]) for r in extraction.extracted(docs).collect()}
    assert found[1] == ('{"markdown":"  short ","total_pages":2,"pages_extracted":"1-2","method":"plain","char_count":8,"is_low_text":true,"auto_marked_art":true}', "Art/Maps")
    assert "is_low_text" not in found[2][0] and found[2][1] is None and 3 not in found and found[4][1] == "zine"


def test_states_of_a_snapshot(spark):
    from vellum.operators import catalog as ops

    old = spark.createDataFrame([("a", 1, "h", 5, False), ("b", 1, "h", 5, True), ("c", 1, "h", None, None), ("d", 1, "h", 9, False), ("e", 1, "h", 5, True), ("f", 1, "h", 5, False)], "path string, size int, hash string, modified_at int, is_missing boolean")
    new = spark.createDataFrame([("a", 1, "h", 6), ("b", 1, "h", 5), ("c", 1, "h", 5), ("d", 1, "h", 9), ("e", 2, "h", 5), ("g", 1, "h", 1)], "path string, size int, hash string, modified_at int")
    assert {r[0]: r[1] for r in ops.snapshot_diff(old, new).collect()} == {"a": "touched", "b": "reappeared", "c": "touched", "d": "unchanged", "e": "changed", "f": "missing", "g": "new"}


def test_outlines_of_documents_without_any(spark):
    from vellum.operators import documents as docs

    marks = spark.createDataFrame([(1, 1, 1, " A ", 3), (1, 2, 2, "B", 0), (1, 3, 1, "C", 9)], "doc int, seq int, level int, title string, page int")
    pages = spark.createDataFrame([(1, 1, "Contents\nX .... 4"), (2, 1, "Contents\nX .... 4\nY .... 6"), (3, 1, None)], "doc int, page int, text string")
    found = docs.whole_outlines(pages.select("doc"), marks, pages).orderBy("doc", "seq").collect()
    assert [tuple(r) for r in found] == [(1, "outline", 1, 1, "A", 3, 8, None), (1, "outline", 2, 2, "B", None, 8, 1), (1, "outline", 3, 1, "C", 9, None, None), (2, "text", 1, 1, "X", 4, 5, None), (2, "text", 2, 1, "Y", 6, None, None), (3, "none", None, None, None, None, None, None)]
    assert docs.whole_outlines(pages.select("doc").limit(0), marks.limit(0), pages.limit(0)).count() == 0


def test_cards_of_what_is_unknown(spark):
    row = spark.createDataFrame([(1, None, None, [0, None, 9, 10, 11, 30], [("Bite", "x" * 120), (None, None)])], "id int, name string, armor_class int, abilities array<int>, actions array<struct<name:string,description:string>>")
    card = entities.encounter_cards(row).first()["card"]
    assert card == "\n## Unknown\n**AC** ? | **HP** ? | **CR** ?\n\n| STR | DEX | CON | INT | WIS | CHA |\n|:---:|:---:|:---:|:---:|:---:|:---:|\n| — | — | 9 (-1) | 10 (+0) | 11 (+0) | 30 (+10) |\n\n### Actions\n- **Bite**: " + "x" * 100 + "...\n- **Action**: ...\n"
    assert entities.encounter_cards(row.select("id")).first()["card"].endswith("| — | — | — | — | — | — |\n")
    assert entities.npc_cards(row.select("id", "name")).first()["card"] == "\n## Unknown\n* * \n\n"
