"""Structured Streaming jobs over growing tables: change feed, queue state, sliding-window admission, live counts.

Every job writes what a micro-batch changed under a folder of its own per batch, so a batch that is run again replaces its rows. The folders
and the stream's own checkpoint lie in ``spark.checkpoint.dir``. Jobs drain what has arrived and stop; ``drain`` is the only place that says so.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from vellum.sources.shared import new_folder


#: Keys are grouped by hash into so many states, as a call of a Python state function costs as much as many rows.
BUCKETS = 1024


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def arriving(spark: SparkSession, sf_dir: str, name: str, files: int = 8) -> DataFrame:
    """A table as a stream of its files. The pattern matches the name alone; a plain path has to be a folder, and a table may be one file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the batches wrote, with their batch."""
    at = new_folder(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/batch=-1")
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/rows")


def drain_in_order(spark: SparkSession, rows: DataFrame, time_col: str, job: Callable[[DataFrame], DataFrame], spans: int, mode: str = "append") -> DataFrame:
    """What ``job`` (a stream to a stream) gives for a table, fed to it in spans of time, oldest first, so that a batch holds one span and state carries
    over from one to the next. Spans are quantiles of ``time_col``; rows without a time come first. Every span is one run of the same query."""
    at = new_folder(spark, "stream")
    key = F.coalesce(F.col(time_col).cast("double"), F.lit(float("-inf")))
    bounds = rows.agg(F.percentile_approx(key, [k / spans for k in range(1, spans)], 10_000)).first()[0] if spans > 1 else []
    edges = [None, *sorted(set(bounds or [])), None]
    made = job(spark.readStream.schema(rows.schema).parquet(f"{_feed(spark, rows, at)}"))
    spark.createDataFrame([], made.schema).write.parquet(f"{at}/rows/batch=-1")
    write = lambda out, n: out.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
    for low, high in pairwise(edges):
        span = rows if low is None else rows.filter(key > low)
        span = span if high is None else span.filter(key <= high)
        span.write.mode("append").parquet(f"{at}/in")
        made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*made.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/rows")


def _feed(spark: SparkSession, rows: DataFrame, at: str) -> str:
    rows.limit(0).write.parquet(f"{at}/in")
    return f"{at}/in"


def latest_changes(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """(path, kind, id): the last change of each path in a feed of (path, kind, at, id)."""
    seen = drain(spark, changes.groupBy("path").agg(F.max_by(F.struct("at", "id", "kind"), F.struct("at", "id")).alias("last")), "update")
    return seen.groupBy("path").agg(F.max_by("last", F.struct("last.at", "last.id")).alias("last")).select("path", "last.kind", "last.id")


def last_changes(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """The state after a feed: the last change of each path, deleted ones left out."""
    return latest_changes(spark, changes).filter("kind <> 'deleted'")


def queue_state(spark: SparkSession, outcomes: DataFrame, most: int = 3, spans: int = 4) -> DataFrame:
    """(item, status, attempts) after tries (item, ok, at, id): a success completes an item, ``most`` failures fail it; later tries are ignored.
    A table is fed in spans of time; in a stream, tries of an item must not arrive in a batch before older ones."""

    def advance(key, frames, state):
        status, attempts = state.get if state.exists else ("pending", 0)
        for ok in pd.concat(frames).sort_values(["at", "id"])["ok"]:
            if status != "pending":
                break
            attempts += 1
            status = "completed" if ok else "failed" if attempts >= most else "pending"
        state.update((status, attempts))
        yield pd.DataFrame({"item": [key[0]], "status": [status], "attempts": [attempts]})

    def job(stream: DataFrame) -> DataFrame:
        return stream.groupBy("item").applyInPandasWithState(advance, "item bigint, status string, attempts bigint", "status string, attempts bigint", "update", GroupStateTimeout.NoTimeout)

    found = drain(spark, job(outcomes), "update") if outcomes.isStreaming else drain_in_order(spark, outcomes, "at", job, spans, "update")
    return found.groupBy("item").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s")).select("item", "s.status", "s.attempts")


def admit(spark: SparkSession, requests: DataFrame, limit: int, seconds: int, spans: int = 4, buckets: int = BUCKETS) -> DataFrame:
    """(id, client, admitted, wait) of requests (id, client, at in microseconds): admitted while fewer than ``limit`` were admitted in the last
    ``seconds``; ``wait`` is the time until one would be. Clients share the state of a bucket, which holds at most ``limit`` times of each. A table is fed in spans of
    time; in a stream, requests of a client must not arrive in a batch before older ones."""
    window = seconds * 1_000_000

    def check(key, frames, state):
        logs: dict[str | None, list[int]] = {}
        for client, at in zip(*state.get, strict=True) if state.exists else ():
            logs.setdefault(client, []).append(at)
        rows, admitted, wait = pd.concat(frames).sort_values(["at", "id"]), [], []
        for client, at in zip(rows["client"].tolist(), rows["at"].tolist(), strict=True):
            log = [t for t in logs.get(client, ()) if t > at - window]
            admitted.append(len(log) < limit)
            wait.append(0 if admitted[-1] else log[0] + window - at)
            if admitted[-1]:
                log.append(at)
            logs[client] = log
        state.update(([c for c, log in logs.items() for _ in log], [t for log in logs.values() for t in log]))
        yield pd.DataFrame({"id": rows["id"], "client": rows["client"], "admitted": admitted, "wait": wait})

    def job(stream: DataFrame) -> DataFrame:
        given = stream.select("id", F.col("client").cast("string").alias("client"), "at", bucket_of("client", buckets))
        made = given.groupBy("bucket").applyInPandasWithState(check, "id bigint, client string, admitted boolean, wait bigint", "client array<string>, at array<bigint>", "append", GroupStateTimeout.NoTimeout)
        return made.withColumn("client", F.col("client").cast("bigint"))

    return (drain(spark, job(requests)) if requests.isStreaming else drain_in_order(spark, requests, "at", job, spans)).drop("batch")


def live_counts(spark: SparkSession, rows: DataFrame, by: Column | str) -> DataFrame:
    """(value, n) after the last batch of a running count."""
    seen = drain(spark, rows.groupBy(F.col(by).alias("value") if isinstance(by, str) else by.alias("value")).agg(F.count(F.lit(1)).alias("n")), "update")
    return seen.groupBy("value").agg(F.max_by("n", "batch").alias("n"))


def arrivals(spark: SparkSession, rows: DataFrame, key: list[str], time_col: str, delay: str) -> DataFrame:
    """The rows of a stream (with an event time) of which no other of the same key arrived before; copies are known for ``delay``."""
    return drain(spark, rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(key)).drop("batch")


def first_arrivals(spark: SparkSession, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The same for ever: of all rows of a key the one that came first, by batch and ``order``. A batch reports its own first rows; they meet at the end."""
    fields = [c for c in rows.columns if c not in key]
    seen = drain(spark, rows.groupBy(*key).agg(F.min_by(F.struct(*fields), order).alias("r")), "update")
    return seen.groupBy(*key).agg(F.min_by("r", "batch").alias("r")).select(*key, "r.*")


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through and forgets the key ``keep`` seconds of event time after it. Keys share the state of a bucket, a time for each; a timer of the bucket
    drops what has expired."""

    def __init__(self, keep: int):
        self.keep = 1000 * keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "fingerprints array<string>, since array<bigint>")

    def known(self) -> dict[str | None, int]:
        return dict(zip(*self.seen.get(), strict=True)) if self.seen.exists() else {}

    def hold(self, seen: dict[str | None, int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seen:
            self.seen.update((list(seen), list(seen.values())))
            self.handle.registerTimer(min(seen.values()) + self.keep)
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given, seen, out = pd.concat(list(rows)).sort_values(["us", "id"]), self.known(), []
        for id_, fingerprint, us in zip(given["id"].tolist(), given["fingerprint"].tolist(), given["us"].tolist(), strict=True):
            ms, since = us // 1000, seen.get(fingerprint)
            if since is None or ms >= since + self.keep:
                seen[fingerprint] = ms
                out.append((id_, fingerprint))
        if out:
            self.hold(seen)
        yield pd.DataFrame({"id": [i for i, _ in out], "fingerprint": [f for _, f in out]}).astype({"id": "int64", "fingerprint": "object"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.hold({f: since for f, since in self.known().items() if since + self.keep > now})
        yield pd.DataFrame({"id": [], "fingerprint": []}).astype({"id": "int64", "fingerprint": "object"})

    def close(self) -> None:
        pass


#: The state store that keeps timers and typed state.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiring_arrivals(spark: SparkSession, rows: DataFrame, keep: int, delay: str, at: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, fingerprint, batch) of the arrivals (id, fingerprint, at) that are first of their fingerprint, or first since the last one let through is ``keep`` seconds old.

    A row later than ``delay`` behind the newest is let go. State expires by event time, so it holds the fingerprints of ``keep`` seconds and no more. ``at`` names a folder in which
    the stream goes on from its checkpoint, with as many buckets as before; null fingerprints are one.
    """
    at = at or new_folder(spark, "arrivals")
    given = rows.select(F.col("id").cast("bigint").alias("id"), F.col("fingerprint").cast("string").alias("fingerprint"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    given = given.select("*", F.unix_micros("at").alias("us"), bucket_of("fingerprint", buckets))
    made = given.groupBy("bucket").transformWithStateInPandas(FirstSeen(keep), "id bigint, fingerprint string", "Append", "EventTime")
    write = lambda out, n: out.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        query = made.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema("id bigint, fingerprint string, batch int").parquet(f"{at}/rows")


class Progress(StreamingQueryListener):
    """Gathers a row of observed metrics per batch of the queries named ``name``."""

    def __init__(self, name: str):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name == self.name and self.name in progress.observedMetrics:
            self.rows.append((progress.batchId, progress.observedMetrics[self.name].asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watched(spark: SparkSession, stream: DataFrame, metrics: dict[str, Column], patience: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """The rows of a stream as ``drain`` gives them, and (batch, a column per metric): whole numbers that Spark observes while a batch is written, told by a listener."""
    name, at = f"progress-{uuid.uuid4().hex}", new_folder(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/batch=-1")
    listener = Progress(name)
    spark.streams.addListener(listener)
    try:
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")
        seen = stream.observe(name, *(c.cast("bigint").alias(m) for m, c in metrics.items()))
        query = seen.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        # Listeners are told a little later than the query ends.
        wanted, end = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}, time.time() + patience
        while not wanted <= {n for n, _ in listener.rows} and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = {n: row for n, row in listener.rows if n in wanted}
    found = spark.createDataFrame([(n, *(row[m] for m in metrics)) for n, row in sorted(told.items())], ", ".join(["batch int", *(f"{m} bigint" for m in metrics)]))
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{at}/rows"), found


def drain_contributions(spark: SparkSession, queue: DataFrame, send, polls: int, most: int = 50, tries: int = 3) -> DataFrame:
    """The queue (id, status, attempts, created_at) after ``polls`` bounded polls: each sends the oldest ``most`` rows that are pending with tries left.
    ``send`` maps a DataFrame (id) to (id, ok). What was not sent is what it was."""
    now = queue
    for _ in range(polls):
        batch = now.filter((F.col("status") == "pending") & (F.col("attempts") < tries)).orderBy("created_at", "id").limit(most)
        at = new_folder(spark, "poll")
        send(batch.select("id")).write.parquet(at)
        result = spark.read.parquet(at)
        sent = F.col("ok").isNotNull()
        status = F.when(F.col("ok"), "submitted").when(sent, F.when(F.col("attempts") + 1 >= tries, "failed").otherwise("pending")).otherwise(F.col("status"))
        joined = now.join(result, "id", "left")
        now = joined.select("id", status.alias("status"), (F.col("attempts") + sent.cast("int")).alias("attempts"), "created_at")
    return now
