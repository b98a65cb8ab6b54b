"""Taking files into the catalog: what a listing changes, what is left out, and the work that follows.

Paths are unique in a listing and among stored rows. A null size or time counts as unknown, so the file is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.catalog import first_rule, rule_table
from vellum.operators.changes import mark_arrivals
from vellum.sources.catalog import fingerprint


def unchanged(stored_size: Column, size: Column, stored_time: Column, time: Column, force: bool = False) -> Column:
    """Whether a file need not be read again: same size, and the stored time is known and not older."""
    return F.lit(False) if force else F.coalesce((stored_size == size) & (stored_time >= time), F.lit(False))


def without_tombstones(files: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Files whose path was not buried."""
    return files.join(tombstones.select("path"), "path", "left_anti")


def first_rules(files: DataFrame, rules: list[tuple[int, str, str, int]]) -> DataFrame:
    """(path, rule_id) of files (path, size) that a rule excludes, by a theta join with the rules, which their author bounds: of several
    matching rules the one of highest priority, then of lowest id."""
    table = F.broadcast(rule_table(files.sparkSession, rules))
    parent, parts, number = F.regexp_replace("path", r"/?[^/]*$", ""), F.split("path", "/"), F.col("number")
    subject = F.when(F.col("kind") == "folder_path", parent).when(F.col("kind") == "filename", F.element_at(parts, -1)).otherwise(F.col("path"))
    hit = F.when(F.col("kind") == "folder_name", F.array_contains(parts, F.col("pattern"))).when(F.col("kind") == "size_min", F.col("size") < number).when(F.col("kind") == "size_max", F.col("size") > number)
    hit = hit.otherwise(F.regexp_like(subject, F.col("regex")))
    return files.select("path", "size").join(table, hit).groupBy("path").agg(F.min_by("rule_id", F.struct(-F.col("priority"), "rule_id")).alias("rule_id"))


def plan(stored: DataFrame, listed: DataFrame, tombstones: DataFrame, rules: list[tuple[int, str, str, int]], force: bool = False) -> DataFrame:
    """What to do about each path, from stored rows (path, id, size, modified_at, file_hash, is_missing) and a listing (path, size, modified_at).

    ``step`` is excluded, buried, new, unchanged, read (its content has to be compared) or missing.
    """
    old = stored.select("path", "id", F.col("size").alias("old_size"), F.col("modified_at").alias("old_time"), F.col("file_hash").alias("old_hash"), F.col("is_missing").alias("was_missing"))
    dead = tombstones.select("path", F.lit(True).alias("dead")).distinct()
    files = listed.select("path", "size", "modified_at", F.lit(True).alias("there"), first_rule(rules, F.col("path"), F.col("size")).alias("rule_id")).join(dead, "path", "left")
    same = unchanged(F.col("old_size"), F.col("size"), F.col("old_time"), F.col("modified_at"), force) & ~F.coalesce("was_missing", F.lit(False))
    step = F.when(F.col("there").isNull(), "missing").when(F.col("rule_id").isNotNull(), "excluded").when(F.col("dead"), "buried").when(F.col("id").isNull(), "new")
    return files.join(old, "path", "full_outer").select("path", "id", "size", "modified_at", "old_hash", "was_missing", step.when(same, "unchanged").otherwise("read").alias("step"))


def read_changed(planned: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, id, action, file_hash) after the contents (path, content) of new files and of those to compare were read, and no others.

    ``action`` is that of the plan, or updated, touched (the content is the same) or reappeared.
    """
    ask = F.col("step").isin("new", "read")
    seen = planned.filter(ask).join(contents, "path").withColumn("file_hash", fingerprint(F.col("content"), F.col("size")))
    action = F.when(F.col("step") == "new", "new").when(~F.col("old_hash").eqNullSafe(F.col("file_hash")), "updated").when(F.col("was_missing"), "reappeared").otherwise("touched")
    rest = planned.filter(~ask).select("path", "id", F.col("step").alias("action"), F.col("old_hash").alias("file_hash"))
    return seen.select("path", "id", action.alias("action"), "file_hash").unionByName(rest)


def ingest(stored: DataFrame, listed: DataFrame, tombstones: DataFrame, rules: list[tuple[int, str, str, int]], contents: DataFrame, force: bool = False) -> DataFrame:
    """(path, action, file_hash, duplicate_of): the whole way from a listing to marked arrivals; ``duplicate_of`` is a path and set for new files only."""
    done = read_changed(plan(stored, listed, tombstones, rules, force), contents)
    known = stored.filter("not is_missing").select(F.col("path").alias("id"), "file_hash")
    copies = mark_arrivals(known, done.filter("action = 'new'").select(F.col("path").alias("id"), "file_hash"))
    return done.join(copies.filter("duplicate_of is not null").withColumnRenamed("id", "path"), "path", "left").select("path", "action", "file_hash", "duplicate_of")


def counters(ingested: DataFrame) -> DataFrame:
    """(action, n, duplicates) of an ingest."""
    return ingested.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("duplicate_of").alias("duplicates"))


def purge_missing(products: DataFrame, folder: Column) -> DataFrame:
    """Products without the missing ones of a folder."""
    return products.filter(~(folder & F.col("is_missing")))


def backlog(products: DataFrame, queue: DataFrame, needs: dict[str, Column]) -> DataFrame:
    """(product_id, task_type, file_size) of all work that products need and that is not open, largest files first."""
    asked = F.array_compact(F.array(*(F.when(need, F.lit(task)) for task, need in needs.items())))
    tasks = products.select(F.col("id").alias("product_id"), F.explode(asked).alias("task_type"), "file_size")
    open_ = queue.filter(F.col("status").isin("pending", "processing")).select("product_id", "task_type")
    return tasks.join(open_, ["product_id", "task_type"], "left_anti").orderBy(F.desc("file_size"), "product_id", "task_type")


def stuck(queue: DataFrame, cutoff: Column) -> DataFrame:
    """Rows that run since before ``cutoff``, or since no one knows when."""
    return queue.filter((F.col("status") == "processing") & ((F.col("started_at") < cutoff) | F.col("started_at").isNull()))


def retry_eligible(queue: DataFrame, most: int = 3, batch: int = 50) -> DataFrame:
    """The next batch to send: pending rows with tries left, oldest first."""
    return queue.filter((F.col("status") == "pending") & (F.col("attempts") < most)).orderBy("created_at", "id").limit(batch)


def edit_queue(queue: DataFrame, retry: bool = False, reset_stuck: Column | None = None, drop: list[str] | None = None) -> DataFrame:
    """The queue after edits: failed rows go back with no tries (``retry``), rows stuck since before ``reset_stuck`` go back, rows of the states ``drop`` go."""
    again = (F.col("status") == "failed") & F.lit(retry)
    late = F.lit(False) if reset_stuck is None else (F.col("status") == "processing") & ((F.col("started_at") < reset_stuck) | F.col("started_at").isNull())
    kept = queue if not drop else queue.filter(~F.col("status").isin(drop))
    changed = {"status": F.when(again | late, "pending").otherwise(F.col("status")), "attempts": F.when(again, F.lit(0)).otherwise(F.col("attempts")), "started_at": F.when(~(again | late), F.col("started_at"))}
    return kept.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns))


def dismiss_failed(queue: DataFrame, products: DataFrame, task_type: str | None = None, mark_as: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, products) after all failed rows (of a type of task) are dismissed. With ``mark_as``, their products get that type if they have none, and count as extracted, so that
    they are not queued again."""
    gone = (F.col("status") == "failed") & (F.lit(True) if task_type is None else F.col("task_type") == task_type)
    kept = queue.filter(~F.coalesce(gone, F.lit(False)))
    if mark_as is None:
        return kept, products
    hit = queue.filter(gone).select(F.col("product_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    marked = products.join(hit, "id", "left")
    changed = {
        "product_type": F.when(F.col("__hit") & (F.coalesce("product_type", F.lit("")) == ""), mark_as).otherwise(F.col("product_type")),
        "text_extracted": F.coalesce(F.col("__hit"), F.lit(False)) | F.col("text_extracted"),
    }
    return kept, marked.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in products.columns))


def resolve_duplicates(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, totals) of rows with ``keep`` (null: no duplicate): losers go, keepers lose their mark; totals are rows gone and bytes freed."""
    gone = F.coalesce(~F.col("keep"), F.lit(False))
    totals = ranked.agg(F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("file_size"))), F.lit(0)).alias("freed"))
    return ranked.filter(~gone).withColumn("duplicate_of", F.lit(None).cast("bigint")), totals


def only_flag(rows: DataFrame, flag: str, chosen: Column) -> DataFrame:
    """``rows`` with ``flag`` on the chosen one alone."""
    return rows.withColumn(flag, F.coalesce(chosen, F.lit(False)))


def clear_tombstones(tombstones: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Tombstones without those of ``paths``, or none."""
    return tombstones.limit(0) if paths is None else tombstones.join(paths.select("path"), "path", "left_anti")


def rule_statistics(rules: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n, enabled, builtin) of rules (kind, enabled, is_default) for every kind, also for those without a rule, and for ``all``."""
    every = rules.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    figures = [F.count("enabled").alias("n"), F.count_if("enabled").alias("enabled"), F.count_if("is_default").alias("builtin")]
    by_kind = F.broadcast(every).join(rules, "kind", "left").groupBy("kind").agg(*figures)
    return by_kind.unionByName(rules.agg(*figures).select(F.lit("all").alias("kind"), "n", "enabled", "builtin"))


def seed(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """``rules`` with ``defaults``, unless a default rule is there already."""
    there = rules.filter("is_default").limit(1).select(F.lit(True).alias("__there"))
    return rules.unionByName(defaults.join(there, F.col("__there"), "left_anti"))


def owning_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder): the longest of the folders (folder) above each path, by equality on every parent path."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    found = files.select("path", F.explode(parents).alias("folder")).join(folders.select("folder").distinct(), "folder")
    return found.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def routed_changes(last: DataFrame, stored: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, folder, action) of the last change of each path (path, kind, file_hash) against stored rows (path, file_hash): added, modified only where
    the hash differs, deleted only where it was stored. Paths outside all folders are left out."""
    j = last.join(stored.select("path", F.col("file_hash").alias("__old"), F.lit(True).alias("__stored")), "path", "left")
    known, gone = F.coalesce("__stored", F.lit(False)), F.col("kind") == "deleted"
    action = F.when(gone & known, "deleted").when(gone, None).when(~known, "added").when(~F.col("file_hash").eqNullSafe(F.col("__old")), "modified")
    acted = j.select("path", action.alias("action")).filter("action is not null")
    return acted.join(owning_folders(acted, folders), "path").select("path", "folder", "action")


def delete_list(ranked: DataFrame) -> DataFrame:
    """(file_hash, keep_id, id, file_size) of the copies that a resolution would delete, from ``keep_policy``."""
    keepers = ranked.filter("keep").select("file_hash", F.col("id").alias("keep_id"))
    return ranked.filter("not keep").join(keepers, "file_hash").select("file_hash", "keep_id", "id", "file_size")
