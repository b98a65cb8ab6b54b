"""Set-based changes of catalog tables. Each takes a table of requests and returns the next snapshot; a single edit is the case of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as names


def link(links: DataFrame, requested: DataFrame) -> DataFrame:
    """Links with the requested ones added; those that exist stay as they are."""
    keys = requested.columns
    return links.unionByName(requested.distinct().join(links.select(keys), keys, "left_anti"), allowMissingColumns=True)


def unlink(links: DataFrame, requested: DataFrame) -> DataFrame:
    return links.join(requested, requested.columns, "left_anti")


def update_fields(target: DataFrame, requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Requested values replace old ones, null never does; ``affected`` marks rows with a request. One request a key."""
    r = requests.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("affected"))
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns]
    return target.join(r, key, "left").select(*kept, F.coalesce("affected", F.lit(False)).alias("affected"))


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(gone.select(key), key, "left_anti")


def null_out(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children with the key of deleted parents set to null."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    return children.join(g, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def completion_stamp(new_status: Column, stamp: Column, now: Column) -> Column:
    """Kept or set once the status is completed, cleared otherwise."""
    return F.when(new_status == "completed", F.coalesce(stamp, now))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts) of rows to insert under a unique key."""
    taken = existing.select(key).distinct()
    return incoming.join(taken, key, "left_anti").dropDuplicates([key]), incoming.join(taken, key, "left_semi")


def enqueue(products: DataFrame, queue: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(product_id, task_type) of the tasks that the rules ask for and that are not open already."""
    asked = F.array_compact(F.array(*(F.when(rule, F.lit(task)) for task, rule in rules.items())))
    tasks = products.select(F.col("id").alias("product_id"), F.explode(asked).alias("task_type"))
    return tasks.join(queue.filter(F.col("status").isin("pending", "processing")), ["product_id", "task_type"], "left_anti")


def mark_arrivals(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """(id, duplicate_of) of arriving rows: an existing row of the hash comes first, then the smallest id."""
    hashes = existing.join(arriving.select("file_hash"), "file_hash", "left_semi")
    both = hashes.select("file_hash", "id", F.lit(False).alias("new")).unionByName(arriving.select("file_hash", "id", F.lit(True).alias("new")))
    first = both.groupBy("file_hash").agg(F.min_by("id", F.struct("new", "id")).alias("first_id"))
    return arriving.select("id", "file_hash").join(first, "file_hash", "left").select("id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")).alias("duplicate_of"))


def orphans(marked: DataFrame, remaining: DataFrame) -> DataFrame:
    """Duplicates whose canonical row is no longer among ``remaining`` ids."""
    return marked.filter("duplicate_of is not null").join(remaining.select(F.col("id").alias("duplicate_of")), "duplicate_of", "left_anti")


def identify(products: DataFrame, hashes: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, method, confidence, confirm): by hash, else by title from (id, confidence), else by hand."""
    known = hashes.select("file_hash").distinct().withColumn("known", F.lit(True))
    j = products.select("id", "file_hash").join(known, "file_hash", "left").join(titles.select("id", F.col("confidence").alias("fuzzy")), "id", "left")
    method = F.when(F.col("known"), "hash").when(F.col("fuzzy").isNotNull(), "title").otherwise("manual")
    confidence = F.when(F.col("known"), 1.0).otherwise(F.coalesce("fuzzy", F.lit(0.0)))
    return j.select("id", method.alias("method"), confidence.alias("confidence"), (confidence < 0.8).alias("confirm"))


def differences(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, ours, theirs) where both are set and differ."""
    t = theirs.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("ours"), F.col(f"__{f}").cast("string").alias("theirs")) for f in fields))
    return ours.join(t, key).select(key, F.inline(cells)).filter("ours <> theirs")


def contribution_reason(ours: DataFrame, registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, reason): new_product, has_<first field that the registry lacks>, or no_new_data."""
    r = registry.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__in"))
    reasons = [F.when(F.col(f).isNotNull() & F.col(f"__{f}").isNull(), F.lit(f"has_{f}")) for f in fields]
    return ours.join(r, key, "left").select(key, F.when(F.col("__in").isNull(), "new_product").otherwise(F.coalesce(*reasons, F.lit("no_new_data"))).alias("reason"))


def submit(queue: DataFrame, succeeded: Column, most: int = 3) -> DataFrame:
    """The queue after every eligible row was sent once."""
    eligible = (F.col("status") == "pending") & (F.col("attempts") < most)
    return queue.withColumn("new_status", F.when(eligible, F.when(succeeded, "submitted").otherwise("failed")).otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + eligible.cast("int")).drop("status").withColumnRenamed("new_status", "status")


def match_report(ours: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: how many file names of ours have an entry (title, id) of the same normalised name; entries of one name count once."""
    index = entries.select(names.normalize_name(F.col("title")).alias("name"), "id").groupBy("name").agg(F.min("id").alias("entry"))
    j = ours.select(names.normalize_name(F.col("file_name")).alias("name")).join(index, "name", "left")
    total, matched = F.count(F.lit(1)), F.count("entry")
    return j.agg(total.alias("total"), matched.alias("matched"), F.format_string("%.1f%%", F.when(total > 0, 100.0 * matched / total).otherwise(0.0)).alias("rate"))


def sparse_json(*columns: str) -> Column:
    """The columns as a JSON object without nulls."""
    return F.to_json(F.struct(*columns))


def vault(entities: DataFrame, folder: str, name: Column, content: Column, order: str) -> DataFrame:
    """(path, content) of one Markdown file per entity; of equal paths the last in ``order`` wins."""
    path = F.concat(F.lit(f"{folder}/"), names.sanitize(name), F.lit(".md"))
    return entities.select(path.alias("path"), content.alias("content"), order).groupBy("path").agg(F.max_by("content", order).alias("content"))


def promote(marked: DataFrame, chosen: DataFrame) -> DataFrame:
    """``marked`` (id, duplicate_of) after chosen duplicates (id) became canonical: the old canonical row and its other copies point to them.
    Of several chosen copies of one row the smallest id wins; ids that are no duplicates change nothing."""
    swaps = marked.filter("duplicate_of is not null").join(chosen.select("id"), "id", "left_semi").groupBy(F.col("duplicate_of").alias("__old")).agg(F.min("id").alias("__new"))
    j = marked.join(swaps, F.coalesce("duplicate_of", "id") == F.col("__old"), "left")
    target = F.when(F.col("__new").isNull(), F.col("duplicate_of")).when(F.col("id") != F.col("__new"), F.col("__new"))
    return j.select(*(target.alias(c) if c == "duplicate_of" else F.col(c) for c in marked.columns))


def delete_duplicates(marked: DataFrame, requested: DataFrame) -> DataFrame:
    """(id, outcome) of requested ids: deleted, not a duplicate, or not found."""
    found = marked.select("id", "duplicate_of", F.lit(True).alias("found"))
    outcome = F.when(F.col("found").isNull(), "not found").when(F.col("duplicate_of").isNull(), "not a duplicate").otherwise("deleted")
    return requested.select("id").distinct().join(found, "id", "left").select("id", outcome.alias("outcome"))


def bury(tombstones: DataFrame, deleted: DataFrame) -> DataFrame:
    """Tombstones (path, ...) with those of deleted rows; a path has one."""
    return tombstones.unionByName(deleted.join(tombstones.select("path"), "path", "left_anti").dropDuplicates(["path"]), allowMissingColumns=True)


def mark_missing(products: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """Products with ``is_missing`` by whether ``listed`` (path) holds them; ``missing_since`` is kept while missing and cleared on return."""
    there = listed.select(F.col("path").alias("__path")).distinct()
    j = products.join(there, F.col("file_path") == F.col("__path"), "left")
    gone = F.col("__path").isNull()
    since = F.when(gone, F.coalesce("missing_since", now))
    return j.select(*(gone.alias(c) if c == "is_missing" else since.alias(c) if c == "missing_since" else F.col(c) for c in products.columns))


def repair(products: DataFrame, artefacts: DataFrame, flag: str) -> DataFrame:
    """Products whose flag is cleared where no artefact (id) backs it; ``requeue`` marks those."""
    backed = artefacts.select("id", F.lit(True).alias("__backed")).distinct()
    lost = F.col(flag) & F.col("__backed").isNull()
    return products.join(backed, "id", "left").select(*((F.col(flag) & ~lost).alias(c) if c == flag else F.col(c) for c in products.columns), F.coalesce(lost, F.lit(False)).alias("requeue"))
