"""Structure and metadata from document text: repeated lines, reflow, contents, metadata, exports.

Texts come as (id, text), pages as (doc, page, text). A null text has no lines. Windows run within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as names
from vellum.operators import dictionary
from vellum.operators.catalog import chapter_ends, outline_parents
from vellum.operators.changes import sparse_json

#: Codes of sizes in virtual tabletops.
SIZE_CODES = {"tiny": "tiny", "small": "sm", "medium": "med", "large": "lg", "huge": "huge", "gargantuan": "grg"}

#: Marks between a title and its page number, and words of lines above a table of contents.
LEADERS = ".·…-_"
CONTENTS_WORDS = ["contents", "content", "chapters", "chapter", "index"]

#: Words that credit someone with a text, and beginnings of words of other credits, which end a name.
AUTHOR_WORDS = ["by", "author", "authors", "writer", "writers", "writing", "written", "designer", "designers"]
OTHER_CREDITS = ["layout", "design", "art", "editing"]

#: How sure what a text says is.
SURE = {"system": 0.8, "publisher": 0.8, "author": 0.7, "year": 0.8}

#: Product types under other names, and the types themselves.
TYPE_NAMES = {
    "core rulebook": "core_rules", "setting": "sourcebook", "character options": "supplement", "gm tools": "tools", "map": "other",
    "zine": "magazine", "module": "adventure", "campaign": "adventure", "one-shot": "adventure", "art/maps": "other",
}
TYPES = ["adventure", "sourcebook", "supplement", "bestiary", "tools", "magazine", "core_rules", "screen", "other"]


def repeated_lines(pages: DataFrame, more_than: int = 2, shorter_than: int = 100) -> DataFrame:
    """(doc, line): trimmed lines that end more than two pages of a document, among the last three of each."""
    last = F.slice(F.reverse(F.split("text", "\n")), 1, 3)
    lines = pages.select("doc", F.explode(F.transform(last, lambda x: F.trim(x))).alias("line")).filter((F.col("line") != "") & (F.length("line") < shorter_than))
    return lines.groupBy("doc", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than).select("doc", "line")


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, line) with trimmed lines."""
    return pages.select("doc", "page", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("pos", "line"))


def strip_repeated(pages: DataFrame) -> DataFrame:
    """Page lines without repeated ones and bare page numbers."""
    lines = page_lines(pages).filter(~F.col("line").rlike(r"(?i)^Page\s+\d+\s*$"))
    return lines.join(repeated_lines(pages), ["doc", "line"], "left_anti").select("doc", "page", "pos", "line")


def reflow(docs: DataFrame) -> DataFrame:
    """(id, block, kind, content): headings, list items with their continuation lines, and paragraphs, joined by spaces.
    A blank line ends a block; so does a heading or a list item."""
    w = Window.partitionBy("id").orderBy("pos")
    lines = docs.select("id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("pos", "line"))
    line = F.col("line")
    kind = F.when(line == "", "blank").when(names.is_heading(line, F.col("following")), "heading").when(names.is_list_item(line), "item").otherwise("text")
    rows = lines.withColumn("following", F.lead("line").over(w)).withColumn("kind", kind).withColumn("before", F.coalesce(F.lag("kind").over(w), F.lit("blank")))
    starts = F.col("kind").isin("heading", "item") | ((F.col("kind") == "text") & F.col("before").isin("blank", "heading"))
    rows = rows.withColumn("block", F.count_if(starts).over(w)).filter("kind <> 'blank'")
    shown = names.markdown_line(line, F.col("kind") == "heading").alias("line")
    grouped = rows.select("id", "block", "pos", "kind", shown).groupBy("id", "block").agg(F.min_by("kind", "pos").alias("kind"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    return grouped.select("id", "block", "kind", F.array_join(F.col("parts.line"), " ").alias("content"))


def contents_line(line: Column) -> Column:
    """Struct (title, target) of a contents line: a title, a leader, a page number at the end. A leader is two marks in a row, three blanks, or,
    after a title that begins with a chapter number, any blank. Null if the line is none."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731 (a value that is computed once)

    def told(x: Column) -> Column:
        title, left = x["title"], x["left"]
        gap = F.substr(left, F.length(title) + 1)
        marks = F.translate(gap, LEADERS, "." * len(LEADERS))
        numbered = F.rtrim(F.element_at(F.split(title, " "), 1), F.lit(".)"))
        leads = F.contains(marks, F.lit("..")) | F.contains(gap, F.lit("   ")) | ((gap != "") & F.contains(title, F.lit(" ")) & numbered.rlike("^[0-9]+$"))
        target = F.try_to_number(F.nullif(x["number"], F.lit("")), F.lit("999999999")).cast("int")
        return F.when((title != "") & leads & (target > 0), F.struct(F.trim(title).alias("title"), target.alias("target")))

    left = lambda x: F.substr(line, F.lit(1), F.length(line) - F.length(x))
    split = let(F.regexp_extract(line, r"[0-9]+$", 0), lambda x: F.struct(x.alias("number"), left(x).alias("left"), F.rtrim(left(x), F.lit(f" \t{LEADERS}")).alias("title")))
    return F.when(F.right(line, F.lit(1)).between("0", "9"), let(split, told))


def contents(pages: DataFrame, gap: int = 1) -> DataFrame:
    """(doc, page, pos, title, target) of contents lines: a header, a few words of which one is of ``CONTENTS_WORDS``, with an entry in the next line, opens
    the section, and more than ``gap`` pages in a row without entries end it. Pages without text do not count as such.

    A page stays one row with an array of its entries; what depends on other pages comes from windows over the pages of a document in one order, so they are shuffled and sorted once."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    lines = pages.filter(F.col("text").rlike(r"[^ \n]")).select("doc", "page", F.filter(numbered, lambda x: x["line"] != "").alias("lines"))
    # A line that holds one of the words is rare, and only such a line is cut to words.
    parts = [w for w in CONTENTS_WORDS if not any(x != w and x in w for x in CONTENTS_WORDS)]
    holds = lambda line: reduce(lambda a, b: a | b, (F.contains(F.lower(line), F.lit(w)) for w in parts))
    words = lambda line: F.split(F.lower(line), r"[^\p{L}\p{N}]+")
    named = lambda line: holds(line) & (F.size(words(line)) <= 4) & F.arrays_overlap(words(line), F.array(*map(F.lit, CONTENTS_WORDS)))
    read = F.transform("lines", lambda x: F.struct(x["pos"].alias("pos"), contents_line(x["line"]).alias("found"), named(x["line"]).alias("named")))
    rows = lines.select("doc", "page", read.alias("lines"))
    # Headers whose next line is on the same page, and whether the last line is one if the next page begins with an entry.
    entry = lambda i: F.get(F.col("lines"), i)["found"].isNotNull()
    inner = F.get(F.filter(F.transform("lines", lambda x, i: F.when(x["named"] & x["found"].isNull() & F.coalesce(entry(i + 1), F.lit(False)), x["pos"])), lambda p: p.isNotNull()), F.lit(0))
    last = F.element_at("lines", -1)
    found = F.transform(F.filter("lines", lambda x: x["found"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x["found"]["title"].alias("title"), x["found"]["target"].alias("target")))
    rows = rows.select("doc", "page", inner.alias("inner"), F.when(last["named"] & last["found"].isNull(), last["pos"]).alias("outer"), entry(F.lit(0)).alias("first"), found.alias("found"))
    by_page = Window.partitionBy("doc").orderBy("page")
    header = F.coalesce("inner", F.when(F.lead("first").over(by_page), F.col("outer")))
    rows = rows.withColumn("header", header)
    before = F.coalesce(F.max(F.col("header").isNotNull()).over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("entries", F.when(before, F.col("found")).when(F.col("header").isNotNull(), F.filter("found", lambda x: x["pos"] > F.col("header"))).otherwise(F.slice("found", 1, 0)))
    # The first page of a section has its header, so pages are counted from the last one with an entry.
    rows = rows.withColumn("place", F.dense_rank().over(by_page)).withColumn("hit", F.max(F.when(F.col("header").isNotNull() | (F.size("entries") > 0), F.col("place"))).over(by_page))
    inside = rows.withColumn("worst", F.max(F.col("place") - F.col("hit")).over(by_page)).filter(F.col("worst") <= gap)
    return inside.select("doc", "page", F.inline("entries")).select("doc", "page", "pos", "title", "target")


def whole_outlines(documents: DataFrame, outlines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, source, seq, level, title, page, end_page, parent_seq) of documents (doc): the entries of a document's outline (doc, seq, level, title, page), else the contents lines of its pages (doc, page,
    text), all of level 1, else one row of source ``none``. A page that is not positive is unknown; a null or blank page text holds no entries."""
    marks = outlines.select("doc", F.lit("outline").alias("source"), F.col("seq").cast("bigint").alias("seq"), F.col("level").cast("int").alias("level"), F.trim("title").alias("title"), F.when(F.col("page") > 0, F.col("page").cast("int")).alias("page"))
    found = contents(pages.join(marks.select("doc").distinct(), "doc", "left_anti"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "pos")).cast("bigint")
    told = found.select("doc", F.lit("text").alias("source"), place.alias("seq"), F.lit(1).alias("level"), "title", F.col("target").alias("page"))
    rows = marks.unionByName(told)
    parents = outline_parents(marks).select("doc", "seq", "parent_seq")  # lines of one level have none
    out = documents.select("doc").distinct().join(chapter_ends(rows).join(parents, ["doc", "seq"], "left"), "doc", "left")
    return out.select("doc", F.coalesce("source", F.lit("none")).alias("source"), "seq", "level", "title", "page", "end_page", "parent_seq")


def first_entry(text: Column, dictionary: dict[str, list[str]]) -> Column:
    """First name, in order, of which an alias occurs anywhere in the text, inside words too."""
    low = F.lower(text)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(a.lower())) for a in aliases)), F.lit(name)) for name, aliases in dictionary.items()))


def best_by_words(text: Column, dictionary: dict[str, list[str]], least: int, step: float) -> Column:
    """Struct (value, confidence) of the name with most of its words anywhere in the text, the first of equals; null below ``least`` words."""
    low = F.lower(text)
    scores = [(n, reduce(lambda a, b: a + b, (F.contains(low, F.lit(w.lower())).cast("int") for w in words))) for n, words in dictionary.items()]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("value")) for i, (n, s) in enumerate(scores))))
    return F.when(best["score"] >= least, F.struct(best["value"].alias("value"), F.round(F.least(F.lit(0.9), 0.5 + best["score"] * step), 2).alias("confidence")))


def author_of(text: Column) -> Column:
    """The first name in a text that a word of ``AUTHOR_WORDS`` credits: two capitalised words or more, joined by blanks, commas, ``&`` or "and", of
    4 to 199 characters together. Every place of every such word is tried; words of other credits end a name."""
    word = rf"(?!(?i:{'|'.join(OTHER_CREDITS)}))\p{{Lu}}[\p{{L}}.'’-]*"
    name = rf"{word}(?:(?:[ \t]*(?:,|&|\band\b)[ \t]*|[ \t]+){word})+"
    found = F.regexp_extract_all(text, F.lit(rf"(?i:\b(?:{'|'.join(AUTHOR_WORDS)})\b)[ \t:–-]*({name})"), F.lit(1))
    return F.get(F.filter(found, lambda x: F.length(x).between(4, 199)), F.lit(0))


def text_metadata(docs: DataFrame, systems: dict, publishers: dict, genres: dict, types: dict, inside: bool = False) -> DataFrame:
    """(id, system, publisher, genre, type, author, year, confidence, sources) of what texts (id, text) tell about their documents; fields that a text does not tell are
    null and not in the maps. Names stand on word bounds, found in one pass over all texts; with ``inside`` they may stand within words too."""
    rules = {"genre": (2, 0.1), "type": (1, 0.15)}
    if inside:
        t = F.col("text")
        named = docs.select("id", first_entry(t, systems).alias("system"), first_entry(t, publishers).alias("publisher"), *(best_by_words(t, d, *rules[n]).alias(n) for n, d in (("genre", genres), ("type", types))))
    else:
        hits = dictionary.found(docs, dictionary.dictionary(docs.sparkSession, {"system": systems, "publisher": publishers, "genre": genres, "type": types}))
        named = dictionary.first_names(hits, ["system", "publisher"]).join(dictionary.best_names(hits, rules), "id", "full_outer")
    rows = docs.select("id", author_of(F.col("text")).alias("author"), names.year_of_text(F.col("text")).alias("year")).join(named, "id", "left")
    fields = ["system", "publisher", "genre", "type", "author", "year"]
    sure = {f: F.col(f)["confidence"] if f in rules else F.lit(SURE[f]) for f in fields}
    told = lambda value: F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("k"), value(f).alias("v"))) for f in fields))))
    values = [F.col(f)["value"].alias(f) if f in rules else F.col(f) for f in fields]
    return rows.select("id", *values, told(lambda f: sure[f]).alias("confidence"), told(lambda f: F.lit("text")).alias("sources"))


def name_metadata(file_name: Column, systems: dict, publishers: dict) -> Column:
    """Struct (title, publisher, system) of ``Publisher - Title``, ``System - Title`` or ``Title (Publisher)``, else the cleaned name as title."""
    stem = names.stem(file_name)

    def known(value: Column, dictionary: dict) -> Column:
        return F.coalesce(*(F.when(F.lower(value).isin([x.lower() for x in {n, *aliases}]), F.lit(n)) for n, aliases in dictionary.items()))

    head, rest = F.trim(F.regexp_extract(stem, r"^(.*?) - (.*)$", 1)), F.trim(F.regexp_extract(stem, r"^(.*?) - (.*)$", 2))
    front, tail = F.trim(F.regexp_extract(stem, r"^(.+?)\s*\(([^)]+)\)\s*$", 1)), F.trim(F.regexp_extract(stem, r"^(.+?)\s*\(([^)]+)\)\s*$", 2))
    by_head, system = known(head, publishers), known(head, systems)
    by_tail = F.when(by_head.isNull(), known(tail, publishers))
    cleaned = F.trim(F.regexp_replace(F.replace(stem, F.lit("_"), F.lit(" ")), r"\s+", " "))
    title = F.when(by_tail.isNotNull(), front).when(by_head.isNotNull() | system.isNotNull(), F.nullif(rest, F.lit("")))
    return F.struct(F.coalesce(title, cleaned).alias("title"), F.coalesce(by_head, by_tail).alias("publisher"), F.when(by_head.isNull(), system).alias("system"))


def merged(*sources: Column) -> Column:
    """The last source that says something: later sources win, empty counts as silence."""
    return F.coalesce(*(F.nullif(s, F.lit("")) for s in reversed(sources)))


def product_type(value: Column) -> Column:
    """Registry name of a product type; unknown ones are ``other``, null stays null."""
    low = F.lower(F.trim(value))
    table = F.create_map(*(F.lit(x) for pair in ({t: t for t in TYPES} | TYPE_NAMES).items() for x in pair))
    return F.when(value.isNotNull(), F.coalesce(F.element_at(table, low), F.lit("other")))


def needs_ocr(pages: DataFrame, sample: int = 3, least: int = 100) -> DataFrame:
    """(doc, needs_ocr) of pages (doc, page, text, image_count): images on the first pages and little text besides addresses and transaction lines."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\S+@\S+", ""), r"(?i)transaction:\s*\d+", ""), r"\s+", "")
    first = pages.filter(F.col("page") <= sample).groupBy("doc").agg(F.avg(F.length(bare)).alias("mean"), F.sum("image_count").alias("images"))
    return first.select("doc", ((F.col("mean") < least) & (F.col("images") > 0)).alias("needs_ocr"))


def roll_tables(entries: DataFrame) -> DataFrame:
    """(id, json) of one roll table per id from rows (id, name, die, low, high, result)."""
    result = F.struct(F.lit(0).alias("type"), F.col("result").alias("text"), F.lit(1).alias("weight"), F.array("low", "high").alias("range"), F.lit(False).alias("drawn"))
    rows = entries.groupBy("id").agg(F.min("name").alias("name"), F.min("die").alias("die"), F.array_sort(F.collect_list(F.struct("low", "high", result.alias("r"))))["r"].alias("results"))
    formula = F.concat(F.lit("1d"), "die").alias("formula")
    return rows.select("id", sparse_json(F.col("name"), F.col("results"), formula, F.lit(True).alias("replacement"), F.lit(True).alias("displayRoll")).alias("json"))


def compendium(entities: DataFrame) -> DataFrame:
    """(source, json) from rows (source, kind, name, id): one document per source with an array of names per kind, ordered by id."""
    kinds = ("actors", "spells", "items", "tables")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("id", "name")))).alias(k) for k in kinds]
    return entities.groupBy("source").agg(*lists).select("source", F.to_json(F.struct(*(F.col(k)["name"].alias(k) for k in kinds), F.col("source").alias("source_product"))).alias("json"))


def note(title: Column, front: dict[str, Column], sections: dict[str, Column]) -> Column:
    """Markdown with front matter; keys and sections without a value are left out."""
    head = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in front.items()), F.lit("---"))
    return F.concat_ws("\n\n", head, F.concat(F.lit("# "), title), *(F.concat(F.lit(f"## {k}\n"), v.cast("string")) for k, v in sections.items()))


def session_prep(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """(campaign, number, overview, products) of the next session from sessions (campaign, number, title) and products (campaign, id, title)."""
    last = sessions.groupBy("campaign").agg(F.max_by("title", "number").alias("title"), F.max("number").alias("number"))
    used = products.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("products"))
    overview = F.concat(F.lit("Session "), "number", F.lit(": "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    return last.join(used, "campaign", "left").select("campaign", "number", overview.alias("overview"), F.coalesce(F.col("products")["title"], F.array().cast("array<string>")).alias("products"))
