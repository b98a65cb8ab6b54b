"""Exchange with a registry and model jobs: pulling metadata, contributing, applying identifications and suggested tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import normalize_name, outermost_json, stem
from vellum.operators.catalog import fill_fields, fuzzy_titles

#: Characters of a text that a prompt holds, by kind of job.
PROMPT_CHARS = {"identify": 4000, "suggest_tags": 4000, "structured": 15000}
#: Confidence of the answers of a model by how sure it says it is.
SURE = {"high": 0.9, "medium": 0.7, "low": 0.5}


def entries_by_hash(registry: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file hash of registry entries (id, file_hashes, fields...); of several entries the one of smallest id counts."""
    rows = registry.select(F.explode("file_hashes").alias("file_hash"), "id", *fields)
    return rows.groupBy("file_hash").agg(F.min_by(F.struct("id", *fields), "id").alias("e")).select("file_hash", F.col("e.id").alias("entry_id"), *(F.col(f"e.{f}").alias(f) for f in fields))


def level_range(low: Column, high: Column) -> Column:
    """Struct (min, max); null only where neither says anything (null or 0)."""
    says = lambda c: F.coalesce(c, F.lit(0)) != 0
    return F.when(says(low) | says(high), F.struct(low.alias("min"), high.alias("max")))


def registry_json(products: DataFrame) -> DataFrame:
    """(id, json) of registry entries from products (id, file_hash, title, publisher, level_min, level_max, links map); nulls are left out."""
    entry = F.struct(F.array("file_hash").alias("file_hashes"), "title", "publisher", level_range(F.col("level_min"), F.col("level_max")).alias("level_range"), F.col("links").alias("external_links"))
    return products.select("id", F.to_json(entry).alias("json"))


#: The fields of an entry in a seed document, with their types.
SEED_FIELDS = {
    "file_hashes": "array<string>", "file_size": "bigint", "page_count": "int", "title": "string", "publisher": "string", "publication_year": "int", "game_system": "string", "product_type": "string",
    "level_range": "struct<min:int,max:int>", "description": "string", "external_links": "map<string,string>", "tags": "array<string>", "confidence": "double", "source": "string",
}


def seed_schema() -> str:
    return f"version string, generated_at string, source string, products array<struct<{','.join(f'{f}:{t}' for f, t in SEED_FIELDS.items())}>>"


def seed_documents(products: DataFrame, source: str, at: Column, version: str = "1.0", blocks: int = 64) -> DataFrame:
    """(json) seed documents of products (id, level_min, level_max and fields of ``SEED_FIELDS``) in blocks by id, so that no document has to hold all. Fields that the products lack are null, but
    links and tags are empty, the confidence is 1 and the source of an entry ``manual``; nulls are written."""
    usual = {"external_links": F.create_map().cast("map<string,string>"), "tags": F.array().cast("array<string>"), "confidence": F.lit(1.0), "source": F.lit("manual")}

    def value(f: str) -> Column:
        given = level_range(F.col("level_min"), F.col("level_max")) if f == "level_range" else F.col(f) if f in products.columns else F.lit(None)
        return (F.coalesce(given, usual[f]) if f in usual else given).cast(SEED_FIELDS[f]).alias(f)

    rows = products.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.struct(*map(value, SEED_FIELDS)).alias("entry"))
    parts = rows.groupBy("block").agg(F.collect_list("entry").alias("products"))
    head = [F.lit(version).alias("version"), at.cast("string").alias("generated_at"), F.lit(source).alias("source")]
    return parts.select(F.to_json(F.struct(*head, "products"), {"ignoreNullFields": "false"}).alias("json"))


def read_seed(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Entries of seed documents, one document a line, or with ``pretty`` one document a file over many lines, with ``version``, ``generated_at`` and ``seed_source``. An unreadable document
    gives no entries."""
    docs = spark.read.schema(seed_schema()).option("multiLine", pretty).json(path)
    return docs.select("version", "generated_at", F.col("source").alias("seed_source"), F.inline("products"))


def pull(products: DataFrame, registry: DataFrame, patterns: DataFrame, fields: list[str], everything: bool = False) -> DataFrame:
    """Products (id, file_hash, title, identified, fields...) after a pull: by hash, and what is left by title pattern (pattern, confidence, pattern_id,
    fields...). Empty fields are filled; ``changed`` names them, ``confidence`` is stamped where anything changed. Identified products are
    left alone unless ``everything``."""
    asked = products if everything else products.filter("not coalesce(identified, false)")
    by_hash = asked.select("id", "file_hash").join(entries_by_hash(registry, fields), "file_hash").select("id", *fields, F.lit(1.0).alias("__sure"))
    left = asked.join(by_hash.select("id"), "id", "left_anti").select("id", F.col("title").alias("__title"))
    by_title = fuzzy_titles(left, "__title", patterns).join(patterns.select("pattern_id", *fields), "pattern_id").select("id", *fields, F.col("confidence").alias("__sure"))
    found = by_hash.unionByName(by_title)
    filled = fill_fields(products, found, "id", fields)
    sure = filled.join(found.select("id", "__sure"), "id", "left")
    return sure.withColumn("confidence", F.when(F.size("changed") > 0, F.col("__sure"))).drop("__sure")


def contributions(products: DataFrame, open_: DataFrame, fields: list[str], edits: DataFrame | None = None) -> DataFrame:
    """(id, payload) of products with a title and without an open contribution; null fields are left out of the payload, and the fields of
    ``edits`` (id, edits map) replace a product's own."""
    rows = products.filter(F.coalesce(F.trim("title"), F.lit("")) != "").join(open_.select("id"), "id", "left_anti")
    if edits is not None:
        e = edits.select("id", F.col("edits").alias("__edits"))
        rows = rows.join(e, "id", "left").select("id", *(F.coalesce(F.try_element_at("__edits", F.lit(f)), F.col(f).cast("string")).alias(f) for f in fields))
    return rows.select("id", F.to_json(F.struct(*fields)).alias("payload"))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps; where both have a key, the second one's value counts. Null is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def apply_identification(products: DataFrame, found: DataFrame, fields: list[str], least: float = 0.8) -> DataFrame:
    """Products with the values of identifications (id, confidence, confirmed, fields...) that are sure enough or confirmed; empty values replace nothing."""
    sure = found.filter((F.col("confidence") >= least) | F.coalesce("confirmed", F.lit(False)))
    cleaned = sure.select("id", *(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(f)).alias(f) for f in fields))
    return fill_fields(products, cleaned, "id", fields, overwrite=True)


def run_model(rows: DataFrame, ask: Callable[[list[str]], list[str]], schema: str, prompt: str = "text", job: str = "identify", batch: int = 64) -> DataFrame:
    """``id``, the fields of the JSON that a model answers, and ``error`` for rows without a usable answer.

    ``ask`` maps prompts to answers, ``batch`` at a time; a batch that raises makes errors of its rows, not of the job.
    """
    given = rows.select("id", F.substring(F.coalesce(prompt, F.lit("")), 1, PROMPT_CHARS[job]).alias("prompt"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                try:
                    answers, error = ask(part["prompt"].tolist()), None
                except Exception as e:  # noqa: BLE001 (a model may fail in any way)
                    answers, error = [None] * len(part), str(e)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "answer": answers, "error": error})

    answered = given.mapInPandas(work, f"id {dict(given.dtypes)['id']}, answer string, error string")
    parsed = F.from_json(outermost_json(F.col("answer")), schema)
    return answered.withColumn("r", parsed).select("id", "r.*", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("r").isNull(), "no JSON in the answer").alias("error"))


def run_model_once(rows: DataFrame, ask: Callable[[list[str]], list[str]], schema: str, store: str, model: str, prompt: Column, slices: int = 8, batch: int = 64, tries: int = 2) -> DataFrame:
    """``id``, the fields of the JSON that a model answers, and ``error``, with every different prompt asked once, whatever runs how often.

    Answers lie in ``store`` (key, slice, answer, error, asked), by a digest of model and prompt. Prompts that are not there are asked slice by slice, each one job that adds
    its answers whole or not at all, so that what breaks off loses a slice at most and the next run goes on from there. A batch that raises is asked once more prompt by
    prompt; what fails ``tries`` times is stored as an error.
    """
    spark = rows.sparkSession
    keyed = rows.select("id", prompt.alias("prompt")).withColumn("key", F.sha2(F.concat_ws("\x00", F.lit(model), F.coalesce("prompt", F.lit(""))), 256))
    stored_as = "key string, answer string, error string, asked int, slice int"

    def ask_some(prompts: list[str]) -> list[tuple[str | None, str | None, int]]:
        try:
            return [(a, None, 1) for a in ask(prompts)]
        except Exception as e:  # noqa: BLE001 (a model may fail in any way)
            if len(prompts) > 1:
                return [r for p in prompts for r in ask_some([p])]
            error = str(e)
        for n in range(2, tries + 1):
            try:
                return [(ask(prompts)[0], None, n)]
            except Exception as e:  # noqa: BLE001
                error = str(e)
        return [(None, error, tries)]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                answers = ask_some(part["prompt"].fillna("").tolist())
                yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": [a for a, _, _ in answers], "error": [e for _, e, _ in answers], "asked": [n for _, _, n in answers]})

    spark.createDataFrame([], stored_as).write.mode("append").partitionBy("slice").parquet(store)
    for n in range(slices):
        known = spark.read.schema(stored_as).parquet(store).filter(F.col("slice") == n)
        wanted = keyed.filter(F.pmod(F.crc32("key"), F.lit(slices)) == n).groupBy("key").agg(F.first("prompt").alias("prompt")).join(known, "key", "left_anti")
        found = wanted.mapInPandas(work, "key string, answer string, error string, asked int")
        found.withColumn("slice", F.lit(n)).write.mode("append").partitionBy("slice").parquet(store)
    answers = spark.read.schema(stored_as).parquet(store).groupBy("key").agg(F.first("answer").alias("answer"), F.first("error").alias("failed"))
    answered = keyed.join(answers, "key").withColumn("r", F.from_json(outermost_json(F.col("answer")), schema))
    return answered.select("id", "r.*", F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("r").isNull(), "no JSON in the answer").alias("error"))


#: What the structured extractors ask for: the list in the answer and its fields. Lists of pairs have a name and a text.
_PARTS = "array<struct<name:string, description:string>>"
_SCORES = "struct<strength:int, dexterity:int, constitution:int, intelligence:int, wisdom:int, charisma:int>"
EXTRACTED = {
    "monsters": f"name string, size string, creature_type string, alignment string, armor_class int, armor_type string, hit_points int, hit_dice string, speed map<string,string>, abilities {_SCORES}, saving_throws map<string,int>, skills map<string,int>, damage_vulnerabilities array<string>, "
    f"damage_resistances array<string>, damage_immunities array<string>, condition_immunities array<string>, senses string, languages string, challenge_rating string, experience_points int, traits {_PARTS}, actions {_PARTS}, bonus_actions {_PARTS}, reactions {_PARTS}, legendary_actions {_PARTS}",
    "spells": "name string, level int, school string, ritual boolean, casting_time string, `range` string, duration string, concentration boolean, components struct<verbal:boolean, somatic:boolean, material:boolean, material_description:string, material_cost:string, material_consumed:boolean>, "
    "description string, higher_levels string, classes array<string>, subclasses array<string>, damage struct<dice:string, damage_type:string, average:int>, save string",
    "magic_items": "name string, rarity string, item_type string, requires_attunement boolean, attunement_requirements string, description string, properties array<string>, charges int, recharge string",
    "npcs": "name string, role string, race string, occupation string, location string, description string, personality string, motivation string, secret string",
}


def asks_for(kind: str, text: Column) -> Column:
    """The prompt of a structured extractor: the fields wanted, and the beginning of a text that a model takes."""
    wanted = ", ".join(f.name for f in T.DataType.fromDDL(EXTRACTED[kind]).fields)
    return F.concat(F.lit(f'List all {kind.replace("_", " ")} of this text as JSON {{"{kind}": [...]}}, an empty list if there are none. Fields of each: {wanted}.\n\n'), F.substring(F.coalesce(text, F.lit("")), 1, PROMPT_CHARS["structured"]))


def extracted(rows: DataFrame, ask: Callable[[list[str]], list[str]], store: str, model: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """What a model finds of a kind in texts (id, text): (id, place, the fields of ``EXTRACTED``), and (id, error) of texts without a usable answer. Entries without a name are left out."""
    answers = run_model_once(rows, ask, f"{kind} array<struct<{', '.join(f.simpleString() for f in T.DataType.fromDDL(EXTRACTED[kind]).fields)}>>", store, model, asks_for(kind, F.col("text")))
    found = answers.select("id", F.posexplode(kind).alias("place", "entry")).select("id", "place", "entry.*").filter("name is not null")
    return found, answers.filter("error is not null").select("id", "error")


def suggested(answer: Column, groups: tuple[str, ...] = ("themes", "content_types", "settings", "tone")) -> Column:
    """The tags of all groups of a struct of arrays, in order; null groups are empty."""
    return F.flatten(F.array(*(F.coalesce(answer[g], F.array().cast("array<string>")) for g in groups)))


def apply_tags(tags: DataFrame, links: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tags, new links) from suggestions (product_id, names): tags (tag_id, name) are found by name without regard to case or made, and links
    (product_id, tag_id) added where absent. A new tag's id is a hash of its name, so that no counter has to be shared."""
    wanted = suggestions.select("product_id", F.explode("names").alias("name")).select("product_id", F.trim("name").alias("name")).filter("name <> ''").distinct()
    known = tags.groupBy(F.lower("name").alias("key")).agg(F.min("tag_id").alias("tag_id"))
    j = wanted.withColumn("key", F.lower("name")).join(known, "key", "left").withColumn("made", F.col("tag_id").isNull()).withColumn("tag_id", F.coalesce("tag_id", F.xxhash64("key")))
    new_tags = j.filter("made").groupBy("tag_id").agg(F.min("name").alias("name"))
    return new_tags, j.select("product_id", "tag_id").distinct().join(links.select("product_id", "tag_id"), ["product_id", "tag_id"], "left_anti")


def properties_metadata(title: Column, author: Column, producers: list[Column], created: Column, publishers: dict[str, list[str]]) -> Column:
    """Struct (title, author, publisher, year) of a document's embedded properties: blanks trimmed, empty is null, a publisher by an alias in any
    of ``producers``, the year of ``D:YYYY...`` between 1970 and 2030."""
    text = F.lower(F.concat_ws("\n", *producers))
    publisher = F.coalesce(*(F.when(F.arrays_overlap(F.array(F.lit(True)), F.array(*(F.contains(text, F.lit(a.lower())) for a in aliases))), F.lit(n)) for n, aliases in publishers.items()))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(some(title).alias("title"), some(author).alias("author"), publisher.alias("publisher"), property_year(created).alias("year"))


def property_year(created: Column, low: int = 1970, high: int = 2030) -> Column:
    digits = F.when(created.startswith("D:"), F.try_to_number(F.substring(created, 3, 4), F.lit("9999"))).cast("int")
    return F.when(digits.between(low, high), digits)


def first_of_year(year: Column) -> Column:
    return F.format_string("%04d-01-01", year)


def code_of(value: Column, codes: dict[str, str], default: str) -> Column:
    """The code of a value, without regard to case and blanks around it."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(default))


def code_by_word(value: Column, codes: dict[str, str], default: str) -> Column:
    """The code of the first word, in order, that the value holds."""
    low = F.lower(value)
    return F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(c)) for w, c in codes.items()), F.lit(default))


def cascade(products: DataFrame, hashes: DataFrame, titles: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, method, confidence, confirm): by hash (1.0), else by title (id, confidence; to confirm below 0.8), else by a model's answer (id, sure: high,
    medium, low or other; to confirm below 0.9), else by hand."""
    known = hashes.select("file_hash").distinct().withColumn("known", F.lit(True))
    table = F.create_map(*(F.lit(x) for pair in SURE.items() for x in pair))
    said = answers.select("id", F.coalesce(F.try_element_at(table, F.coalesce("sure", F.lit(""))), F.lit(0.6)).alias("__model"))
    j = products.select("id", "file_hash").join(known, "file_hash", "left").join(titles.select("id", F.col("confidence").alias("__title")), "id", "left").join(said, "id", "left")
    method = F.when(F.col("known"), "hash").when(F.col("__title").isNotNull(), "title").when(F.col("__model").isNotNull(), "model").otherwise("manual")
    confidence = F.when(F.col("known"), 1.0).otherwise(F.coalesce("__title", "__model", F.lit(0.0)))
    return j.select("id", method.alias("method"), confidence.alias("confidence")).withColumn("confirm", F.col("confidence") < F.when(F.col("method") == "model", 0.9).otherwise(0.8))


def import_entries(products: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, title, publisher, changed): products (id, file_name, title, publisher) filled from marketplace entries (id, title, publisher) of the same normalised
    name: an empty publisher, and a title that only repeats the file name. Of several entries of a name the smallest id counts. A dry run is this
    without writing it."""
    index = entries.groupBy(normalize_name(F.col("title")).alias("__name")).agg(F.min_by(F.struct("title", "publisher"), "id").alias("e"))
    j = products.withColumn("__name", normalize_name(F.col("file_name"))).join(index, "__name", "left")
    bare = F.coalesce(F.col("title") == stem(F.col("file_name")), F.lit(True)) | (F.col("title") == "")
    no_publisher = F.coalesce(F.trim("publisher"), F.lit("")) == ""
    takes = {"title": bare & F.col("e.title").isNotNull() & ~F.col("e.title").eqNullSafe(F.col("title")), "publisher": no_publisher & F.col("e.publisher").isNotNull()}
    changed = F.array_compact(F.array(*(F.when(takes[f], F.lit(f)) for f in takes)))
    return j.select("id", *(F.when(takes[f], F.col(f"e.{f}")).otherwise(F.col(f)).alias(f) for f in takes), changed.alias("changed"))


def book_submissions(queue: DataFrame, results: DataFrame, tries: int = 3) -> DataFrame:
    """The queue (id, status, attempts) after results (id, ok, message) of what was sent: tries count up, success is submitted, failure failed with its
    message; rows that were not pending or had no tries left are skipped."""
    j = queue.join(results.select("id", "ok", F.col("message").alias("__said")), "id", "left")
    sent = F.col("ok").isNotNull() & (F.col("status") == "pending") & (F.col("attempts") < tries)
    status = F.when(sent, F.when(F.col("ok"), "submitted").otherwise("failed")).otherwise(F.col("status"))
    return j.select("id", status.alias("status"), (F.col("attempts") + sent.cast("int")).alias("attempts"), F.when(sent & ~F.col("ok"), F.col("__said")).alias("message"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys of ``new`` replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_source(*sources: DataFrame, key: str = "doc") -> DataFrame:
    """Rows of the first table that has any for a key, with ``source``, the table's number: outlines before contents found in text."""
    out = sources[0].withColumn("source", F.lit(1))
    for k, more in enumerate(sources[1:], 2):
        out = out.unionByName(more.join(out.select(key).distinct(), key, "left_anti").withColumn("source", F.lit(k)))
    return out
