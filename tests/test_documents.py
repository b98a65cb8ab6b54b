"""Document structure, metadata and versions on small rows."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import changes, scanner, search
from vellum.operators import documents as docs
from vellum.sources import snapshots


def test_contents_end_after_two_pages_without_entries(spark):
    pages = [(1, 1, "Preface .... 9"), (1, 2, "Contents\nOne .... 1\nTwo   7"), (1, 3, "words"), (1, 4, "1. Three 12"), (1, 5, "words"), (1, 6, None), (1, 7, "more"), (1, 8, "Late .... 4"), (2, 1, "One .... 1")]
    found = docs.contents(spark.createDataFrame(pages, "doc int, page int, text string")).orderBy("page", "pos").collect()
    assert [(r["page"], r["title"], r["target"]) for r in found] == [(2, "One", 1), (2, "Two", 7), (4, "1. Three", 12)]


def test_reflow_by_hand(spark):
    text = "INTRO\nfirst line\nsecond line\n\n* one\nmore of one\n2) two\n\nlast"
    found = docs.reflow(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("block").collect()
    assert [(r["kind"], r["content"]) for r in found] == [("heading", "### INTRO"), ("text", "first line second line"), ("item", "- one more of one"), ("item", "2) two"), ("text", "last")]


def test_stat_blocks_by_hand(spark):
    beast = "Cave Bear\nLarge beast, unaligned\nArmor Class 12\nHit Points 42 (5d10 + 15)\nSpeed 40 ft.\nSTR DEX CON INT WIS CHA\n20 (+5) 10 (+0) 16 (+3) 2 (-4) 13 (+1) 7 (-2)\nChallenge 2 (450 XP)"
    second = "Rat King Creature 4\nPerception +9\nAC 20 HP 60\nSpeed 25 feet\nStrike"
    text = f"intro\n{beast}\n{second}\nmore\n\n\nafter"
    found = scanner.stat_blocks(spark.createDataFrame([(1, text), (2, "no block"), (3, None)], "id int, text string")).orderBy("start").collect()
    assert [(r["id"], r["name"], r["system"]) for r in found] == [(1, "Cave Bear", "5e"), (1, "Rat King", "pf2e")]
    a, b = found[0]["fields"], found[1]["fields"]
    assert (a["ac"], a["hp"], a["hit_dice"], a["cr"], a["abilities"]) == (12, 42, "5d10 + 15", "2", [20, 10, 16, 2, 13, 7])
    assert (b["ac"], b["hp"], b["level"], b["perception"], b["speed"]) == (20, 60, 4, 9, "25 feet")


def test_titles_close_to_a_start_do_not_open_a_block(spark):
    lines = ["Ape Creature 1", "x", "x", "x", "Bee Creature 2", "x", "x", "x", "Cat Creature 3", "x"]
    found = scanner.stat_blocks(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string")).orderBy("start").collect()
    assert [(r["start"], r["name"]) for r in found] == [(0, "Ape"), (8, "Cat")]


def test_metadata_of_names_and_texts(spark):
    systems, publishers = {"Alpha": ["alpha", "a1"]}, {"North": ["north press"]}
    rows = [("North Press - The Book.pdf",), ("A1 - Rules.pdf",), ("The_Book (north press).pdf",), ("Some - Other_thing.pdf",), (None,)]
    m = docs.name_metadata(F.col("n"), systems, publishers)
    found = [tuple(r) for r in spark.createDataFrame(rows, "n string").select(m.alias("m")).select("m.*").collect()]
    assert found == [("The Book", "North", None), ("Rules", None, "Alpha"), ("The_Book", "North", None), ("Some - Other thing", None, None), (None, None, None)]
    authors = spark.createDataFrame([("Written by: Ann Lee, Layout by X",), ("designer: Bo Ray",), ("nobody",), (None,)], "t string").select(docs.author_of(F.col("t"))).collect()
    assert [r[0] for r in authors] == ["Ann Lee", "Bo Ray", None, None]


def test_promotion_moves_the_whole_group(spark):
    marked = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None), (5, 4)], "id int, duplicate_of int")
    found = changes.promote(marked, spark.createDataFrame([(3,), (4,), (9,)], "id int")).collect()
    assert {r[0]: r[1] for r in found} == {1: 3, 2: 3, 3: None, 4: None, 5: 4}


def test_snippets_mark_hits(spark):
    df = spark.createDataFrame([(1, "a b c d e Find me f g"), (2, "nothing"), (3, None)], "id int, text string")
    assert [tuple(r) for r in search.snippets(df, "find", 4, around=1).collect()] == [(1, "...e <mark>Find</mark> me f...")]


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/table"
    with pytest.raises(ValueError, match="no version"):
        snapshots.current(spark, root)
    assert snapshots.commit(spark, spark.range(3), root) == 1
    assert snapshots.commit(spark, snapshots.current(spark, root).filter("id > 0"), root) == 2
    assert snapshots.current(spark, root).count() == 2 and snapshots.current(spark, root, 1).count() == 3


def test_missing_rows_keep_their_time_and_return(spark):
    p = spark.createDataFrame([(1, "a", False, None), (2, "b", True, 5), (3, "c", True, 6)], "id int, file_path string, is_missing boolean, missing_since int")
    found = changes.mark_missing(p, spark.createDataFrame([("c",), ("c",)], "path string"), F.lit(9)).collect()
    assert {r["id"]: (r["is_missing"], r["missing_since"]) for r in found} == {1: (True, 9), 2: (True, 5), 3: (False, None)}


def test_credits_of_a_text_are_told_once(spark, tmp_path):
    """txt06_text_metadata takes author and year from the line it adds, so a credit in the text itself is not told beside it."""
    from vellum.plans.documents import text_metadata

    rows = [(0, "the tale by Max Brod and others"), (1, "plain"), (3, "by Max Brod")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["id"]: (r["author"], r["told"]) for r in text_metadata(spark, str(tmp_path)).collect()}
    assert found == {0: ("Jane Doe", "system,author,year"), 1: ("Ann Lee and Bo Ray-Smith", "author"), 3: ("Jane Doe", "author")}


def test_contents_deal_pages_once(spark):
    """A page stays one row, dealt and sorted once; a header may end a page, and a page of blanks does not count."""
    pages = [(1, 1, "A .... 3\nTable of contents"), (1, 2, " \n\t\n"), (1, 3, " \n "), (1, 4, "B .... 4"), (2, 1, "contents"), (2, 2, "words\nC .... 5")]
    made = docs.contents(spark.createDataFrame(pages, "doc int, page int, text string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [tuple(r) for r in made.collect()] == []
    made = docs.contents(spark.createDataFrame([p for p in pages if p[1] != 2 or p[0] != 1], "doc int, page int, text string"))
    assert [tuple(r) for r in made.collect()] == [(1, 4, 0, "B", 4)]
