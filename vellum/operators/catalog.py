"""Catalog operators: filters, joins, aggregates and windows over DataFrames."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import glob_regex, stem
from vellum.operators.containment import containing

UNKNOWN = "Unknown"


def facet(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; None means no filter, "Unknown" means null."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name).isNull() if value == UNKNOWN else F.col(name) == value)
    return df


def flags(df: DataFrame, **wanted: bool | None) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def in_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range with either end optional; nulls go as soon as an end is given."""
    df = df if low is None else df.filter(F.col(column) >= low)
    return df if high is None else df.filter(F.col(column) <= high)


def overlaps(df: DataFrame, low_col: str, high_col: str, low=None, high=None) -> DataFrame:
    """Intervals that meet [low, high]; a null bound is open."""
    df = df if low is None else df.filter((F.col(high_col) >= low) | F.col(high_col).isNull())
    return df if high is None else df.filter((F.col(low_col) <= high) | F.col(low_col).isNull())


def contains_any(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Substring in any of the columns, without regard to case; ``%`` and ``_`` are wildcards."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{text}%") for c in columns)))


def valid_regex(pattern: str) -> bool:
    """Whether Java takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def rule_table(spark: SparkSession, rules: list[tuple[int, str, str, int]]) -> DataFrame:
    """Rules (id, kind, pattern, priority) as a table with ``regex`` and ``number``, without those that can never match."""
    rows = []
    for rule_id, kind, pattern, priority in rules:
        number = int(pattern) if pattern.strip().isdigit() else None
        regex = glob_regex(pattern) if kind in ("folder_path", "filename") else pattern if kind == "regex" else None
        if (kind not in ("size_min", "size_max") or number is not None) and (kind != "regex" or valid_regex(pattern)):
            rows.append((rule_id, kind, pattern, priority, regex, number))
    return spark.createDataFrame(rows, "rule_id int, kind string, pattern string, priority int, regex string, number bigint")


def rule_predicate(kind: str, pattern: str, path: Column, size: Column) -> Column:
    """Whether an exclusion rule matches a file; rules with invalid numbers or patterns never do."""
    parent = F.regexp_replace(path, r"/?[^/]*$", "")
    number = int(pattern) if pattern.strip().isdigit() else None
    return {
        "folder_path": lambda: parent.rlike(glob_regex(pattern)),
        "folder_name": lambda: F.array_contains(F.split(path, "/"), pattern),
        "filename": lambda: F.element_at(F.split(path, "/"), -1).rlike(glob_regex(pattern)),
        "size_min": lambda: F.lit(False) if number is None else size < number,
        "size_max": lambda: F.lit(False) if number is None else size > number,
        "regex": lambda: path.rlike(pattern) if valid_regex(pattern) else F.lit(False),
    }[kind]()


def first_rule(rules: list[tuple[int, str, str, int]], path: Column, size: Column) -> Column:
    """Id of the first matching rule (id, kind, pattern, priority): highest priority, then lowest id."""
    ordered = sorted(rules, key=lambda r: (-r[3], r[0]))
    return F.coalesce(*(F.when(rule_predicate(kind, pattern, path, size), F.lit(i)) for i, kind, pattern, _ in ordered))


def tags_of(products: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Each product with its tag names as a sorted array, empty where it has none."""
    folded = links.join(tags, "tag_id").groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("tags"))
    return products.join(folded, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def with_any_tag(products: DataFrame, links: DataFrame, tag_ids: list[int]) -> DataFrame:
    return products.join(links.filter(F.col("tag_id").isin(tag_ids)).select(F.col("product_id").alias("id")), "id", "left_semi")


def without_open_task(products: DataFrame, queue: DataFrame, task_type: str) -> DataFrame:
    """Products without a pending or running task of the type."""
    busy = queue.filter(F.col("status").isin("pending", "processing") & (F.col("task_type") == task_type)).select(F.col("product_id").alias("id"))
    return products.join(busy, "id", "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, zero included."""
    return parents.join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def fuzzy_titles(df: DataFrame, title: str, patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """Best of the (pattern, confidence, pattern_id) rows that contain or are contained in a title, whatever the case, for each row of ``df`` that has one.

    Different titles and patterns meet over rare grams in both directions. An empty pattern is in every title, and an empty title in every pattern.
    """
    own = [c for c in df.columns if c not in ("pattern_id", "confidence", "match_kind")]
    best = F.max(F.struct("confidence", (-F.col("pattern_id")).alias("order"), "pattern_id")).alias("b")
    p = patterns.filter(F.col("confidence") > least).groupBy(F.lower("pattern").alias("p")).agg(best).filter("p is not null")
    titles = df.select(F.lower(title).alias("t")).distinct().filter("t <> ''")
    named, known = titles.select(F.col("t").alias("text")), p.filter("p <> ''").select(F.col("p").alias("needle"))
    inside = containing(known, named).select(F.col("text").alias("t"), F.col("needle").alias("p"))
    around = containing(titles.select(F.col("t").alias("needle")), known.select(F.col("needle").alias("text"))).select(F.col("needle").alias("t"), F.col("text").alias("p"))
    found = inside.union(around).join(p, "p").groupBy("t").agg(F.max("b").alias("b"))
    both = p.agg(F.max("b").alias("any"), F.max(F.when(F.col("p") == "", F.col("b"))).alias("empty"))  # one row
    rows = df.withColumn("t", F.lower(title)).filter("t is not null").join(found, "t", "left").crossJoin(F.broadcast(both))
    rows = rows.withColumn("b", F.when(F.col("t") == "", F.col("any")).otherwise(F.greatest("b", "empty"))).filter("b is not null")
    return rows.select(*own, "b.pattern_id", "b.confidence", F.when(F.col("b.confidence") > 0.9, "exact").otherwise("fuzzy").alias("match_kind"))


def facet_counts(df: DataFrame, column: str, keep_null: bool = False, top: int | None = None) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(UNKNOWN)) if keep_null else F.col(column)
    out = df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def facet_table(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of every value of several columns in one pass: (dim, value, n); null and empty count as unknown."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(UNKNOWN)).alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"))


def status_counts(queue: DataFrame, states: list[str]) -> DataFrame:
    return queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in states), F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def canonical(products: DataFrame) -> DataFrame:
    """Marks duplicates by hash: the oldest row present is canonical, ties by id; missing rows are left out."""
    present = products.filter(~F.col("is_missing"))
    keep = present.groupBy("file_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    marked = present.join(keep, "file_hash")
    return marked.withColumn("is_duplicate", F.col("id") != F.col("keep_id")).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("keep_id")))


def duplicate_groups(products: DataFrame) -> DataFrame:
    """Groups of equal hashes with more than one row: canonical id, copies, wasted bytes."""
    grouped = products.filter(~F.col("is_missing")).groupBy("file_hash").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("keep_id"), F.count(F.lit(1)).alias("copies"), F.sum("file_size").alias("bytes"), F.min_by("file_size", F.struct("created_at", "id")).alias("kept_bytes")
    )
    return grouped.filter("copies > 1").select("file_hash", "keep_id", "copies", (F.col("bytes") - F.col("kept_bytes")).alias("wasted"))


def duplicate_members(products: DataFrame) -> DataFrame:
    """(file_hash, keep_id, id) of the other members of each group, one row each, so that no group has to fit a row."""
    return canonical(products).filter("is_duplicate").select("file_hash", "keep_id", "id")


def keep_policy(products: DataFrame, source_of_truth: str) -> DataFrame:
    """Which copy of each duplicated hash stays: the source of truth, else the latest change, else the oldest, with the reason."""
    w = Window.partitionBy("file_hash")
    best = w.orderBy(F.desc("sot"), F.desc_nulls_last("modified_at"), "created_at", "id")
    rows = products.withColumn("sot", F.col("publisher") == source_of_truth).withColumn("copies", F.count(F.lit(1)).over(w)).filter("copies > 1")
    rows = rows.withColumn("rank", F.row_number().over(best))
    reason = F.when(F.col("sot"), "source of truth").when(F.col("modified_at").isNotNull(), "newest").otherwise("oldest")
    return rows.select("id", "file_hash", (F.col("rank") == 1).alias("keep"), F.when(F.col("rank") == 1, reason).alias("reason"), "file_size")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action) between two listings (path, size, hash): new, changed, unchanged, missing. Where both have ``modified_at``, a file that is the same but later is touched;
    where the old one has ``is_missing``, a file that was missing and is the same as before has reappeared."""
    timed, known = "modified_at" in old.columns and "modified_at" in new.columns, "is_missing" in old.columns
    more = {"old": ["modified_at"] * timed + ["is_missing"] * known, "new": ["modified_at"] * timed}
    o, n = (d.select("path", *(F.col(c).alias(f"{x}_{c}") for c in ["size", "hash", *more[x]])) for d, x in ((old, "old"), (new, "new")))
    action = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "missing").when((F.col("old_hash") != F.col("new_hash")) | (F.col("old_size") != F.col("new_size")), "changed")
    if known:
        action = action.when(F.col("old_is_missing"), "reappeared")
    if timed:
        action = action.when(F.col("old_modified_at").isNull() | (F.col("new_modified_at") > F.col("old_modified_at")), "touched")
    return o.join(n, "path", "full_outer").select("path", action.otherwise("unchanged").alias("action"))


def chapter_ends(outline: DataFrame) -> DataFrame:
    """Last page of each entry: one before the next entry that has a page; null for the last."""
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return outline.withColumn("end_page", F.first("page", ignorenulls=True).over(w) - 1)


def outline_parents(outline: DataFrame) -> DataFrame:
    """Parent of each outline entry, the last earlier entry of a smaller level, and ``path``, the titles from the top down to it.

    A fold over the entries of a document in order keeps the open entry of each level, at any depth.
    """
    entry = F.struct("seq", "level", "title")
    docs = outline.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    open_type = "array<struct<seq:bigint,level:int,title:string>>"

    def step(acc: Column, e: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["level"] < e["level"])
        opened = F.concat(above, F.array(F.struct(e["seq"].cast("bigint").alias("seq"), e["level"].cast("int").alias("level"), e["title"].alias("title"))))
        row = F.struct(e["seq"].cast("bigint").alias("seq"), F.try_element_at(above, F.lit(-1))["seq"].alias("parent_seq"), F.array_join(opened["title"], "/").alias("path"))
        return F.struct(opened.alias("open"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.array().cast(open_type).alias("open"), F.array().cast("array<struct<seq:bigint,parent_seq:bigint,path:string>>").alias("rows"))
    found = docs.select("doc", F.inline(F.aggregate("entries", start, step, lambda acc: acc["rows"])))
    return outline.join(found.withColumn("seq", F.col("seq").cast(outline.schema["seq"].dataType)), ["doc", "seq"])


def fill_fields(target: DataFrame, source: DataFrame, key: str, fields: list[str], overwrite: bool = False, named_by: str | None = None) -> DataFrame:
    """Fill empty fields (or overwrite all) from a second table, with the names of fields that changed; null never overwrites. With ``named_by``, a file name, a
    title that is no more than that name without its ending counts as empty."""
    s = source.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    j = target.join(s, key, "left")
    blank = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) == ""
    empty = lambda f: blank(f) | F.coalesce(F.col(f) == stem(F.col(named_by)), F.lit(False)) if named_by and f == "title" else blank(f)
    takes = {f: F.col(f"__{f}").isNotNull() & ((F.lit(overwrite) | empty(f)) & ~F.col(f).eqNullSafe(F.col(f"__{f}"))) for f in fields}
    changed = F.array_compact(F.array(*(F.when(takes[f], F.lit(f)) for f in fields)))
    kept = [F.when(takes[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in target.columns]
    return j.select(*kept, changed.alias("changed"))
