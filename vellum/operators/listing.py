"""Listings: sorted pages with totals, type-ahead, capped samples, product views, summaries, image inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numeric import aspect_ratio, likely_map, percent
from vellum.functions.text import display_title, level_label

SORTABLE = ["title", "created_at", "updated_at", "file_size", "page_count"]


def order_by(column: str | None, descending: bool = False, key: str = "id", among: list[str] = SORTABLE) -> list[Column]:
    """Sort keys: one of the columns ``among``, else the first of them, ties by ``key``; nulls come first ascending and last descending."""
    name = column if column in among else among[0]
    return [F.desc_nulls_last(name) if descending else F.asc_nulls_first(name), F.col(key)]


def page_of(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with ``total`` and ``pages``: at least one page, of 1 to 10 000 rows."""
    size = min(max(size, 1), 10_000)
    counted = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long"))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size).crossJoin(F.broadcast(counted))  # one row


def type_ahead(df: DataFrame, column: str, typed: str, most: int = 10) -> DataFrame:
    """Values of a facet that hold ``typed``, most frequent first."""
    found = df.filter(F.contains(F.lower(column), F.lit(typed.lower()))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "value").limit(most)


def latest(df: DataFrame, time: str, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), key).limit(n)


def placed(df: DataFrame, within: str, *order: str) -> DataFrame:
    """Rows with their place in the sorted list of their group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)).cast("long"))


def sample_of(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first ``n`` rows by id: the capped list of a report."""
    return df.orderBy(key).limit(n)


def missing_ids(requested: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids that do not exist, once each."""
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti").filter(F.col(key).isNotNull())


def outcome_summary(df: DataFrame, outcome: str, states: list[str], detail: Column, key: str = "id", most: int = 20) -> DataFrame:
    """(outcome, n, details): counts for every state and the details of the first rows by id of each."""
    counts = df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    firsts = reduce(DataFrame.unionByName, (df.filter(F.col(outcome) == s).select(outcome, key, detail.alias("d")).orderBy(key).limit(most) for s in states))
    details = firsts.groupBy(outcome).agg(F.array_join(F.array_sort(F.collect_list(F.struct(key, "d")))["d"], ",").alias("details"))
    every = df.sparkSession.createDataFrame([(s,) for s in states], f"{outcome} string")
    return F.broadcast(every).join(counts, outcome, "left").join(details, outcome, "left").select(F.col(outcome).alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("details", F.lit("")).alias("details"))


def export_totals(entries: DataFrame) -> DataFrame:
    """One row about marketplace entries (publisher, filenames): entries, files, publishers that are named."""
    named = F.nullif(F.trim("publisher"), F.lit(""))
    return entries.agg(F.count(F.lit(1)).alias("products"), F.coalesce(F.sum(F.size("filenames")), F.lit(0)).alias("files"), F.countDistinct(named).alias("publishers"))


def product_view(products: DataFrame, tags: DataFrame) -> DataFrame:
    """Products as a client sees them: shown title, level label, a struct of processing states, a run status only if any part of it is set, tags as
    an array, and a cover with a fallback. ``tags`` has (id, tags)."""
    any_run = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in ("run_state", "run_rating", "run_at")))
    states = F.struct(F.col("cover_url").isNotNull().alias("cover"), F.col("text_extracted").alias("text"), F.col("indexed").alias("search"))
    return products.join(tags, "id", "left").select(
        "id", display_title(F.col("title"), F.col("file_name")).alias("title"), level_label(F.col("level_min"), F.col("level_max")).alias("levels"), states.alias("processing_status"),
        F.when(any_run, F.struct(F.col("run_state").alias("state"), F.col("run_rating").alias("rating"), F.col("run_at").alias("at"))).alias("run_status"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("cover_url", F.concat(F.lit("/covers/"), "id", F.lit(".jpg"))).alias("cover"),
    )


def progress(tasks: DataFrame, by: str, done: Column) -> DataFrame:
    """(by, percent) of finished tasks; 0 where there are none."""
    return tasks.groupBy(by).agg(F.count_if(done).alias("d"), F.count(F.lit(1)).alias("n")).select(by, percent(F.col("d"), F.col("n")).alias("percent"))


def image_inventory(images: DataFrame, least: int = 100) -> DataFrame:
    """Images (doc, page, pos, hash, width, height, page_share) of at least ``least`` pixels each way, every hash of a document once, where it
    comes first; with aspect ratio, whether it may be a map and whether it fills its page."""
    large = images.filter((F.col("width") >= least) & (F.col("height") >= least))
    first = large.groupBy("doc", "hash").agg(F.min_by(F.struct("page", "pos", "width", "height", "format", "page_share"), F.struct("page", "pos", "width", "height", "page_share")).alias("i")).select("doc", "hash", "i.*")
    return first.withColumn("aspect", aspect_ratio(F.col("width"), F.col("height"))).withColumn("likely_map", likely_map(F.col("width"), F.col("height"))).withColumn("full_page", F.coalesce(F.col("page_share") >= 0.8, F.lit(False)))


def image_statistics(inventory: DataFrame) -> DataFrame:
    """Per document: images, likely maps, full pages, average size rounded down, and counts of formats."""
    formats = inventory.groupBy("doc", "format").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.array_sort(F.collect_list(F.concat("format", F.lit(":"), "n"))).alias("formats"))
    figures = inventory.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("likely_map").alias("maps"), F.count_if("full_page").alias("full_pages"),
        F.floor(F.avg("width")).alias("width"), F.floor(F.avg("height")).alias("height"),
    )
    return figures.join(formats, "doc")
