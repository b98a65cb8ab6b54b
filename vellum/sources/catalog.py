"""Catalog tables over the given tables: a document view, an item view, links, a work queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog rows."""
    d = read(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.col("doc_id") + 1704067200)
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("file_path"),
        F.concat("doc_id", F.lit(".pdf")).alias("file_name"), F.col("n_chars").alias("file_size"), F.sha2("text", 256).alias("file_hash"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("publisher"),
        F.when(F.col("doc_id") % 17 != 0, F.col("lang")).alias("system"), created.alias("created_at"),
        F.when(F.col("doc_id") % 11 != 0, created + F.make_dt_interval((F.col("doc_id") % 5).cast("int"))).alias("modified_at"),
        (F.col("doc_id") % 23 == 0).alias("is_missing"), (F.col("n_chars") >= 100).alias("text_extracted"), "text",
    )


#: The same view for the SQL side.
PRODUCTS_SQL = """products AS (
  SELECT doc_id AS id, '/lib/' || source || '/' || doc_id || '.pdf' AS file_path, doc_id || '.pdf' AS file_name, n_chars AS file_size,
    sha256(text) AS file_hash, split_part(text, chr(10), 1) AS title, source AS publisher, CASE WHEN doc_id % 17 <> 0 THEN lang END AS system,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at,
    CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(doc_id) + to_days(CAST(doc_id % 5 AS INTEGER)) END AS modified_at,
    doc_id % 23 = 0 AS is_missing, n_chars >= 100 AS text_extracted, text FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog rows with level ranges and prices."""
    p = read(spark, sf_dir, "part")
    low = F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 10)
    return p.select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pdf")).alias("file_name"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("product_type"), low.alias("level_min"), (low + F.col("p_size") % 5).alias("level_max"), F.col("p_retailprice").alias("msrp"), F.col("p_size").alias("size"),
    )


ITEMS_SQL = """items AS (
  SELECT p_partkey AS id, p_name || '.pdf' AS file_name, p_name AS title, p_brand AS publisher, p_type AS product_type,
    CASE WHEN p_size % 7 <> 0 THEN p_size % 10 END AS level_min, CASE WHEN p_size % 7 <> 0 THEN p_size % 10 + p_size % 5 END AS level_max,
    p_retailprice AS msrp, p_size AS size FROM part)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a work queue."""
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("product_id"), F.col("event_type").alias("task_type"), (F.floor("value").cast("int") % 10).alias("priority"),
        F.col("ts").cast("timestamp").alias("created_at"), status.alias("status"), (F.col("event_id") % 5).alias("attempts"),
        F.when(status != "pending", F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(1))).alias("started_at"), "props",
    )


QUEUE_SQL = """queue AS (
  SELECT event_id AS id, user_id AS product_id, event_type AS task_type, CAST(floor(value) AS INTEGER) % 10 AS priority, ts AS created_at,
    ['pending', 'processing', 'completed', 'failed'][event_id % 4 + 1] AS status, event_id % 5 AS attempts,
    CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 MINUTE END AS started_at, props FROM events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of items: distinct (item, tag) with the least line number as sort order."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("tag_id")).agg(F.min("l_linenumber").alias("sort_order"))


LINKS_SQL = "links AS (SELECT l_partkey AS product_id, l_suppkey AS tag_id, min(l_linenumber) AS sort_order FROM lineitem GROUP BY ALL)"


def listing(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """Files below ``folder`` with size and time; the content column is not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("file_size"))


def fingerprint(content, length):
    """Fast fingerprint: digest of the size in decimal digits and the first MiB."""
    return F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, 1048576)), 256)


def decode_vectors(df: DataFrame, column: str, out: str = "embedding") -> DataFrame:
    """Little-endian float32 blobs to arrays; null stays null."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return df.withColumn(out, decode(column))


def encode_vectors(df: DataFrame, column: str, out: str = "blob") -> DataFrame:
    """Arrays to little-endian float32 blobs; null stays null, a null component becomes NaN."""
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        import numpy as np

        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(out, encode(column))


EXPORT_SCHEMA = (
    "status string, data array<struct<products_id:string, products_name:string, publishers_name:string, p_id:string, "
    "files:array<struct<filename:string>>, product:struct<title:string, files:array<struct<title:string>>>, publisher:struct<title:string>>>"
)


def marketplace(exports: DataFrame, column: str = "json") -> DataFrame:
    """Entries of marketplace exports in either layout: id, title, publisher, filenames. Only successful exports; entries without id or title go."""
    rows = exports.select(F.from_json(column, EXPORT_SCHEMA).alias("x")).filter(F.col("x.status") == "success").select(F.explode("x.data").alias("e"))
    first = F.col("e.products_id").isNotNull()
    names = F.when(first, F.transform("e.files", lambda f: F.trim(f["filename"]))).otherwise(F.transform("e.product.files", lambda f: F.trim(f["title"])))
    out = rows.select(
        F.when(first, F.col("e.products_id")).otherwise(F.col("e.p_id")).alias("id"), F.trim(F.when(first, F.col("e.products_name")).otherwise(F.col("e.product.title"))).alias("title"),
        F.trim(F.when(first, F.col("e.publishers_name")).otherwise(F.col("e.publisher.title"))).alias("publisher"),
        F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "").alias("filenames"),
    )
    return out.filter((F.col("id") != "") & (F.col("title") != ""))


def write_texts(texts: DataFrame, folder: str, buckets: int = 64) -> None:
    """Store extracted texts (id, value: one JSON document) in folders by bucket of the id, so that a few ids read a few folders."""
    rows = texts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, markdown) of stored texts; an unreadable document has no text."""
    return spark.read.parquet(folder).select("id", F.get_json_object("value", "$.markdown").alias("markdown"))


def with_text(products: DataFrame, texts: DataFrame) -> DataFrame:
    return products.join(texts.select("id", "markdown"), "id", "left")
