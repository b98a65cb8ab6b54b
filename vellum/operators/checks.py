"""Row checks and smaller views: ordinal thresholds, length gates, value ranges, campaigns, session numbers, extractor cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What fields of notes and products may hold.
ALLOWED = {
    "note_type": ["prep_tip", "modification", "warning", "review"],
    "spoiler_level": ["none", "minor", "major", "endgame"],
    "visibility": ["private", "anonymous", "public"],
    "run_status": ["want_to_run", "running", "completed"],
    "difficulty": ["easier", "as_written", "harder"],
}
#: Ranges of numbers.
RANGES = {"rating": (1, 5), "ability": (1, 30), "spell_level": (0, 9)}
COLOUR = "^#[0-9a-fA-F]{6}$"
#: What to do before a session.
CHECKLIST = [
    "Review session notes", "Prepare NPC voices and motivations", "Have monster stat blocks ready", "Prepare maps if needed",
    "Review relevant rules", "Prepare music/ambiance", "Have random encounter tables ready",
]


def at_most(df: DataFrame, column: str, level: str, order: list[str] = ALLOWED["spoiler_level"]) -> DataFrame:
    """Rows whose level is not above ``level`` in an ordered list; an unknown ``level`` allows all."""
    allowed = order[: order.index(level) + 1] if level in order else order
    return df.filter(F.col(column).isin(allowed))


def long_enough(text: Column, least: int) -> Column:
    return F.coalesce(F.length(text) >= least, F.lit(False))


def violations(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, violations): the names of fields with a value out of ``ALLOWED``, ``RANGES`` or not a colour, of rows that have any; null is no value."""
    bad = [F.when(~F.col(f).isin(v), F.lit(f)) for f, v in ALLOWED.items() if f in df.columns]
    bad += [F.when(~F.col(f).between(*v), F.lit(f)) for f, v in RANGES.items() if f in df.columns]
    bad += [F.when(~F.col("colour").rlike(COLOUR), F.lit("colour"))] if "colour" in df.columns else []
    return df.select(key, F.array_compact(F.array(*bad)).alias("violations")).filter("size(violations) > 0")


def campaigns(parents: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """Campaigns (id) with ``products`` (array of titles by id) and ``sessions`` (array of titles by number), each folded by itself and empty where there are none."""
    none = F.array().cast("array<string>")
    p = products.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("product_id", "title")))["title"].alias("products"))
    s = sessions.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("number", "title")))["title"].alias("sessions"))
    j = parents.join(p.withColumnRenamed("campaign", "id"), "id", "left").join(s.withColumnRenamed("campaign", "id"), "id", "left")
    return j.withColumns({"products": F.coalesce("products", none), "sessions": F.coalesce("sessions", none)})


def numbered(new: DataFrame, existing: DataFrame, by: str, *order: str) -> DataFrame:
    """New rows numbered on from the largest number that their group has."""
    last = existing.groupBy(by).agg(F.max("number").alias("__last"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return new.join(last, by, "left").withColumn("number", (F.coalesce("__last", F.lit(0)) + place).cast("long")).drop("__last")


def cascade(methods: dict[str, Column]) -> Column:
    """Struct (method, text) of the first method that gives a text; the method is ``none`` where none does."""
    tries = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(F.lit(n).alias("method"), c.alias("text"))) for n, c in methods.items()]
    return F.coalesce(*tries, F.struct(F.lit("none").alias("method"), F.lit(None).cast("string").alias("text")))


def low_text(chars: Column, pages: Column) -> Column:
    """Whether a text is short: under 100 characters a page and 500 in all."""
    return (chars / F.greatest(pages, F.lit(1)) < 100) & (chars < 500)


def low_text_type(chars: Column, pages: Column, product_type: Column) -> Column:
    """The type, or ``Art/Maps`` where it is unset and the text is short."""
    return F.coalesce(F.nullif(product_type, F.lit("")), F.when(low_text(chars, pages), "Art/Maps"))


def share_notes(notes: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared, rejected) of requested notes (id): private ones and those shared already are rejected, with the reason."""
    j = notes.join(requested.select("id").distinct(), "id", "left_semi")
    reason = F.when(F.col("visibility") == "private", "private").when(F.col("shared_id").isNotNull(), "already shared")
    marked = j.withColumn("reason", reason)
    shared = marked.filter("reason is null").withColumn("shared_id", F.concat(F.lit("note-"), "id")).drop("reason")
    return shared, marked.filter("reason is not null").select("id", "reason")


def session_bundle(campaigns_: DataFrame) -> DataFrame:
    """(id, overview, products, checklist) for the next session of each campaign (id, title, products, sessions)."""
    number = F.size("sessions") + 1
    overview = F.concat(F.lit("Session "), number, F.lit(" of "), "title")
    return campaigns_.select("id", overview.alias("overview"), "products", F.array(*map(F.lit, CHECKLIST)).alias("checklist"))
