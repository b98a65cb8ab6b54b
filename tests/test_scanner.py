"""Scanners, the dictionary and containment joins against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import containment, dictionary, extraction, scanner
from vellum.operators import documents as docs


def test_words_that_are_no_labels_name_no_system():
    assert scanner.fields_of(["Plain Talk", "She hit several points of class armor"])[0] == "unknown"
    assert scanner.fields_of(["Plain Talk", "a creature with perception may strike"])[0] == "unknown"
    assert scanner.fields_of(["Ghoul", "AC 6, HD 2+1, Morale 9, THAC0 17"])[0] == "osr"


def test_blocks_end_at_blanks_starts_and_length():
    sized = ["Cave Bear", "Large beast"]
    (a,) = scanner.blocks([*sized, *["x"] * 150])
    assert len(a[2]) == scanner.LONGEST_BLOCK
    (a,) = scanner.blocks([*sized, "", "", "x", "x", "x", "", "", "y"])
    assert a[2][-1] == "x" and len(a[2]) == 7
    assert [n for _, n, _ in scanner.blocks(["Ape Creature 1", *["x"] * 5, "Bee Creature 2", "not a Title 3 Creature 4"])] == ["Ape", "Bee"]
    assert list(scanner.blocks([])) == list(scanner.blocks(["", "lower case creature 3"])) == []


def test_headers_of_tables():
    assert scanner.header("Random Treasure (2d6):") == ("Random Treasure", 12)
    assert scanner.header("roll d20: Wild Magic") == ("Wild Magic", 20) and scanner.header("ROLL d% - Oddities") == ("Oddities", 100)
    assert scanner.header("roll d8") == ("roll d8", 8) and scanner.header("word6") is None and scanner.header("d6") is None


def test_scan_keeps_keys_and_order(spark):
    pages = spark.createDataFrame([(1, 2, "T d4\n1. a\n2. b"), (1, 3, None), (2, 1, "T (d6)\n1-3 a\n4-6 b\nU d6\n1) c\n2) d")], "doc int, page int, text string")
    found = scanner.table_entries(pages, ["doc", "page"]).orderBy("doc", "page", "table_no", "low").collect()
    assert [(r["doc"], r["page"], r["table_no"], r["title"], r["low"], r["high"]) for r in found] == [(1, 2, 1, "T", 1, 1), (1, 2, 1, "T", 2, 2), (2, 1, 1, "T", 1, 3), (2, 1, 1, "T", 4, 6), (2, 1, 2, "U", 1, 1), (2, 1, 2, "U", 2, 2)]


def test_aliases_stand_on_word_bounds(spark):
    names = {"game": {"OSE": ["ose", "Old-School  Essentials"], "D&D": ["d&d 5e"], "none": [""]}, "kind": {"a": ["map", "gm", "fate"], "b": ["rules"]}}
    rows = [(1, "those people"), (2, "an OSE book"), (3, "old-school\nessentials and D&D 5e"), (4, "d&d 5edition maps rules"), (5, None), (6, ""), (7, "map gm fate map rules")]
    hits = dictionary.found(spark.createDataFrame(rows, "id int, text string"), dictionary.dictionary(spark, names))
    assert {r["id"]: r["game"] for r in dictionary.first_names(hits, ["game"]).collect()} == {2: "OSE", 3: "OSE"}
    best = {r["id"]: (r["kind"]["value"], r["kind"]["confidence"]) for r in dictionary.best_names(hits, {"kind": (1, 0.15)}).collect()}
    assert best == {4: ("b", 0.65), 7: ("a", 0.9)}


def test_every_credit_is_tried(spark):
    rows = [("stand by the river\nby Jane Doe",), ("Written by: Ann Lee, Layout by X",), ("Editing by Art Director",), ("by Bo",), ("designers Émile Zola & Max Brod and Jo O'Neil.",), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").select(docs.author_of(F.col("t"))).collect()]
    assert found == ["Jane Doe", "Ann Lee", None, None, "Émile Zola & Max Brod and Jo O'Neil.", None]


def test_containment_equals_nested_loop(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choices("abcé ", k=rng.randint(1, 30))) for _ in range(120)} | {"aaa", "aa", "a" * 40}
    needles = {"".join(rng.choices("abcé ", k=rng.randint(1, 6))) for _ in range(150)} | {"aaaa", "b" * 50, "zzz"}
    found = containment.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((n, t) for n in needles for t in texts if n in t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_overlap_must_leave_room():
    with pytest.raises(ValueError):
        list(extraction.cuts("a" * 2000, 100, 200))
    text = " ".join(f"word{i}" for i in range(300))
    found = list(extraction.cuts(text, 300, 50))
    pieces = [p for _, p in found]
    assert all(text[at : at + len(p)] == p for at, p in found)
    assert all(len(p) <= 300 for p in pieces) and not pieces[-2].endswith(pieces[-1])


def test_strides_by_hand(spark):
    rows = [(1, "ab" * 10), (2, " x "), (3, None), (4, " \n "), (5, "".join(chr(0x1F600 + i) for i in range(23))), (6, "y" * 11), (7, "a" * 8 + " " * 30)]
    found = {(r["id"], r["chunk_index"]): (r["start"], r["chunk"]) for r in extraction.strides(spark.createDataFrame(rows, "id bigint, text string"), 10, 2).collect()}
    assert {k[0] for k in found} == {1, 2, 5, 6, 7} and found[2, 0] == (0, " x ") and found[7, 0] == (0, "a" * 8) and (7, 1) not in found
    for i, text in ((1, rows[0][1]), (5, rows[4][1]), (6, rows[5][1])):
        starts = [a for a in range(0, len(text), 8) if a == 0 or len(text) - a > 2]
        assert [found[i, n] for n in range(len(starts))] == [(a, text[a : a + 10]) for a in starts] and (i, len(starts)) not in found
    with pytest.raises(ValueError):
        extraction.strides(spark.createDataFrame(rows, "id bigint, text string"), 10, 5)


def test_chunks_are_a_lateral_join_and_equal_a_loop(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["word", " ", ". ", "! ", "\n", "\n\n", "é", "? "], k=rng.randint(0, 900))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id bigint, text string")
    out = extraction.chunks(df, 300, 60)
    want = {(i, n): cut for i, t in enumerate(texts) for n, cut in enumerate(extraction.cuts(t, 300, 60))}
    assert {(r["id"], r["chunk_index"]): (r["start"], r["chunk"]) for r in out.collect()} == want and len(want) > 100
    assert "ArrowEvalPythonUDTF" in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        extraction.chunks(df, 300, 200)


def test_pages_of_a_small_file_go_to_all_tasks(spark):
    """One file of many short rows is one split, whose pages one task would scan."""
    pages = spark.range(40).coalesce(1).selectExpr("id", "concat('Finds (d4)\n1. one ', id, '\n2. two') as text")
    found = scanner.table_entries(pages)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["id"], r["low"], r["result"]) for r in found.collect()} == {(i, n, f"one {i}" if n == 1 else "two") for i in range(40) for n in (1, 2)}
