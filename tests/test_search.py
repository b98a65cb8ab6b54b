"""Stored keyword index and trigram bitmaps against scans."""

import random

import pytest

from vellum.operators import keyword_index, search, substrings


def scan(df, fields, query):
    return {r["id"]: round(r["score"], 6) for r in search.bm25(df, fields, query).collect()}


def test_index_equals_scan_on_random_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 8)
    monkeypatch.setattr(keyword_index, "FIRST", 2)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé1", k=rng.choice((1, 2, 3, 4, 6, 20)))) for _ in range(120)] + ["aaaaaaaaaaaaaaaabb", "aaaaaaaaaaaaaaaabc"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 200)))), None if i % 3 else "a Title-" + rng.choice(words)) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, text string, title string").repartition(3)
    keyword_index.write(df, ["title", "text"], f"{tmp_path}/i")
    shown = df.filter("id % 3 <> 1").select("id", "title")
    read = blocks = 0
    for query in [" ".join(rng.choice(words)[: rng.randint(1, 20)] for _ in range(rng.randint(1, 3))) for _ in range(8)] + ["a", "a*b\" c", "zz", "", "aaaaaaaaaaaaaaaab aaaaaaaaaaaaaaaabb"]:
        asked = keyword_index.Search(spark, f"{tmp_path}/i", query)
        wanted = scan(df, ["title", "text"], query)
        assert {r["id"]: round(r["score"], 6) for r in asked.hits().collect()} == wanted
        assert asked.found() == bool(wanted)
        best, counts = asked.top(5, shown)
        assert [(r["id"], r["score"]) for r in best.collect()] == sorted(((i, s) for i, s in wanted.items() if i % 3 != 1), key=lambda x: (-x[1], x[0]))[:5]
        read, blocks = read + counts["read"], blocks + counts["blocks"]
    assert read < blocks


def test_index_takes_changes(spark, tmp_path):
    rows = [(1, "the Cat sat", None), (2, "a cat; a Catalog", "cats"), (3, "", ""), (4, None, "dog"), (5, "dog dog", None)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    keyword_index.write(df, ["a", "b"], f"{tmp_path}/i")
    keyword_index.update(spark, f"{tmp_path}/i", f"{tmp_path}/j", spark.createDataFrame([(1, "dogs", "x"), (9, "a very long new text about a dog and a cat", None)], df.schema), ["a", "b"], spark.createDataFrame([(4,)], "id bigint"))
    later = spark.createDataFrame([(1, "dogs", "x"), rows[1], rows[2], rows[4], (9, "a very long new text about a dog and a cat", None)], df.schema)
    for query in ("dog cat", "x", "a"):
        assert {r["id"]: round(r["score"], 6) for r in keyword_index.Search(spark, f"{tmp_path}/j", query).hits().collect()} == scan(later, ["a", "b"], query)


def test_index_holds_a_word_of_a_document_once(spark, tmp_path):
    """The postings do not grow with the length of the words: prefixes have figures only, and no table of all prefixes is written on the way."""
    words = ["extraordinarily", "extraordinary", "extra", "be", "x" * 40]
    df = spark.createDataFrame([(i, " ".join(words[: i % 6])) for i in range(60)], "id bigint, a string")
    keyword_index.write(df, ["a"], f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i/postings")
    assert stored.selectExpr("sum(size(ids))").first()[0] == sum(i % 6 for i in range(60))
    assert {r["key"] for r in stored.filter("kind = 'prefixes'").collect()} == {w[:i] for w in words for i in range(1, min(len(w), keyword_index.CAP) + 1)}
    assert sorted(f.name for f in tmp_path.joinpath("i").iterdir()) == ["classes", "counts", "postings", "totals"]


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, " ;")], "id bigint, a string")
    keyword_index.write(df, ["a"], f"{tmp_path}/i")
    asked = keyword_index.Search(spark, f"{tmp_path}/i", "word")
    assert asked.hits().count() == 0 and not asked.found() and asked.top(3)[0].count() == 0


def test_search_falls_back_to_substrings(spark, tmp_path):
    df = spark.createDataFrame([(1, "Xylophone", "text", None), (2, "b", "fox yloph", None), (3, "c", None, None)], "id int, title string, text string, publisher string")
    keyword_index.write(df, ["title", "text"], f"{tmp_path}/i")
    substrings.write(df, f"{tmp_path}/t")
    found = lambda q: {r["id"]: r["how"] for r in keyword_index.find(df, keyword_index.Search(spark, f"{tmp_path}/i", q), substrings.holding(spark, f"{tmp_path}/t", q), ["title", "publisher"]).collect()}
    assert found("yloph") == {2: "keyword"} and found("loph") == {1: "metadata", 2: "content"}


@pytest.mark.parametrize("query", ["tion", "é", "ß a", "AB", "x\ny", "日本", "nowhere to be found", ""])
def test_bitmaps_lose_no_text(spark, tmp_path, query):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", "ab", "Aß a", "x\ny é", "日本語", "Nation"])] + [(i, "".join(rng.choices("abtion é\n", k=rng.choice((3, 50, 5000))))) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    substrings.write(df, f"{tmp_path}/t")
    assert {r["id"] for r in substrings.holding(spark, f"{tmp_path}/t", query).collect()} == {i for i, t in rows if t is not None and query.lower() in t.lower()}


def test_bitmaps_are_made_a_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    """A batch is cut to pieces, so a task's Python does not hold bitmaps and copies of all its texts; the last piece may be short."""
    monkeypatch.setattr(substrings, "ROWS", 3)
    texts = {i: "ab" * (i % 5) + f"Word{i}" * (i % 7) for i in range(40)}
    substrings.write(spark.createDataFrame(list(texts.items()), "id int, text string"), f"{tmp_path}/t")
    found = {r["id"]: (r["text"], r["grams"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert found == {i: (t, substrings.bitmap(t.lower().encode()).tolist()) for i, t in texts.items()}
