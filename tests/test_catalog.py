"""Catalog queries against the same queries in SQL, and functions on small rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.functions import numeric, text
from vellum.operators import extraction
from vellum.plans import catalog, changes, documents, entities, ingest, listing, registry, search  # noqa: F401 (register their queries)
from vellum.streaming import jobs

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("None" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = df.select(columns).collect()
    wanted = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert plain(found) == plain(wanted)


def test_text_functions(spark):
    df = spark.createDataFrame([("My-Book_v1 (Print).pdf", '["a", " b "]', "INTRO"), (None, " ", None), (".hidden", "x, ,y", "")], "name string, list string, line string")
    out = df.select(text.stem(F.col("name")), text.parse_list(F.col("list")), text.is_heading(F.col("line"), F.lit(None).cast("string"))).collect()
    assert [tuple(r) for r in out] == [("My-Book_v1 (Print)", ["a", "b"], True), (None, None, False), (".hidden", ["x", "y"], False)]
    assert text.glob_regex("a*[!0-9]?.pdf") == r"(?s)^a.*[^0-9].\.pdf$"


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r[0] for r in df.select(numeric.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(found[0] - 0.5**0.5) < 1e-9 and found[1] is None


def test_chunks_by_hand(spark):
    text_ = "a" * 450 + ". " + "b" * 300
    rows = [(1, text_), (2, " short "), (3, None), (4, ""), (5, "x" * 1200)]
    found = {(r["id"], r["chunk_index"]): r["chunk"] for r in extraction.chunks(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert found[1, 0] == "a" * 450 + "." and found[1, 1] == "a" * 48 + ". " + "b" * 300 and (1, 2) not in found
    assert found[2, 0] == " short " and not any(k[0] in (3, 4) for k in found)
    assert [len(found[5, i]) for i in range(3)] == [500, 500, 300]


@pytest.mark.parametrize("name", ["txt01_chunks", "vec01_embed"])
def test_chunks_cover_every_document(spark, name):
    docs = catalog.QUERIES[name](spark, DATA)
    want = spark.read.parquet(f"{DATA}/documents.parquet").filter("trim(text) <> ''").count()
    assert docs.select("id").distinct().count() == want


def test_admission_against_a_plain_loop(spark):
    rows = changes.src.read(spark, DATA, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) at").orderBy("at", "event_id").collect()
    logs, wanted = {}, {}
    for i, client, at in rows:
        recent = [t for t in logs.get(client, []) if t > at - 86400_000_000]
        wanted[i] = len(recent) < 2
        logs[client] = recent + [at] * wanted[i]
    found = catalog.QUERIES["stm04_admission"](spark, DATA).collect()
    assert {r["id"]: r["admitted"] for r in found} == wanted and not all(wanted.values())
    assert all((r["wait"] > 0) != r["admitted"] for r in found)


def test_streams_of_an_empty_table_give_no_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stm01_changes", "stm03_queue_state", "stm04_admission", "stm06_live_counts"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_state_is_kept_between_batches(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(7, False, i, i), (8, i == 1, i, i)], "item bigint, ok boolean, at bigint, id bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/tries.parquet")
    found = jobs.queue_state(spark, jobs.arriving(spark, str(tmp_path), "tries", 1))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {7: ("failed", 3), 8: ("completed", 2)}


def test_vectors_are_decoded(spark):
    import struct

    df = spark.createDataFrame([(bytearray(struct.pack("<3f", 1.0, -2.0, 0.5)),), (None,)], "b binary")
    assert [r[0] for r in changes.src.decode_vectors(df, "b").select("embedding").collect()] == [[1.0, -2.0, 0.5], None]


def test_searches_answer_every_query(spark, db):
    wanted = {r[0] for r in db.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    found = {n: {r["query_id"] for r in catalog.QUERIES[n](spark, DATA).collect()} for n in ("vec02_search", "vec04_filtered")}
    assert len(wanted) > 1 and found["vec02_search"] == wanted and 1 < len(found["vec04_filtered"])  # hits of some may lie outside the levels
