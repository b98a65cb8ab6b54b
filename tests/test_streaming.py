"""State that expires, across batches and a restart, and progress by observed metrics."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.streaming import jobs

START = datetime(2024, 1, 1)


def test_fingerprints_are_forgotten(spark, tmp_path):
    schema = "id bigint, fingerprint string, at timestamp"
    batches = [
        [(1, "a", 0), (2, "a", 1), (3, "b", 2), (4, None, 2)],
        [(5, "a", 30), (6, "b", 59), (7, None, 3)],  # copies within the hour
        [(8, "c", 200)],  # moves the watermark on: a and b are forgotten
        [(9, "a", 201), (10, "b", 202), (11, "c", 203), (12, "d", 20)],  # expired, expired, a copy, and one that is too late
        [(13, "a", 204), (14, "e", 205)],
    ]
    at, found = f"{tmp_path}/job", {}
    for n, rows in enumerate(batches):  # each batch is a run of its own, so state comes from the checkpoint
        table = [(i, f, START + timedelta(minutes=m)) for i, f, m in rows]
        spark.createDataFrame(table, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found[n] = {r["id"] for r in jobs.expiring_arrivals(spark, stream, 3600, "5 minutes", at).collect()}
    assert found[0] == {1, 3, 4} and found[1] == {1, 3, 4} and found[2] == {1, 3, 4, 8}
    assert found[3] == {1, 3, 4, 8, 9, 10} and found[4] == {1, 3, 4, 8, 9, 10, 14}


def test_progress_equals_counts(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 = 0 as bad").repartition(4).write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema("id bigint, bad boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    rows, told = jobs.watched(spark, stream, {"seen": F.count(F.lit(1)), "failed": F.count_if("bad")})
    counted = {r["batch"]: (r["seen"], r["failed"]) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("seen"), F.count_if("bad").alias("failed")).collect()}
    assert {r["batch"]: (r["seen"], r["failed"]) for r in told.collect()} == counted and len(counted) == 4


def test_clients_share_a_state(spark):
    """Many clients, null too, meet in few states, and each is admitted by its own times only."""
    rows = [(i, i % 7 or None, 1_000_000 * (i * 37 % 200)) for i in range(200)]
    wanted, logs = {}, {}
    for i, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        log = logs[client] = [t for t in logs.get(client, []) if t > at - 60_000_000]
        wanted[i] = (client, len(log) < 2, 0 if len(log) < 2 else log[0] + 60_000_000 - at)
        if wanted[i][1]:
            log.append(at)
    found = jobs.admit(spark, spark.createDataFrame(rows, "id bigint, client bigint, at bigint"), 2, 60, spans=2, buckets=2).collect()
    assert {r["id"]: (r["client"], r["admitted"], r["wait"]) for r in found} == wanted and len(found) == 200
