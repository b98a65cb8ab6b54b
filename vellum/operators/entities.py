"""Game entities (creatures, spells, items, places, people) as tabletop documents and as Markdown notes, by tables of what goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import first_integer
from vellum.operators.documents import SIZE_CODES, note
from vellum.operators.scanner import ABILITIES
from vellum.operators.registry import code_by_word, code_of

#: Codes of schools of magic, of activations and of units of time in virtual tabletops.
SCHOOL_CODES = {
    "abjuration": "abj", "conjuration": "con", "divination": "div", "enchantment": "enc",
    "evocation": "evo", "illusion": "ill", "necromancy": "nec", "transmutation": "trs",
}
ACTIVATION_CODES = {"bonus": "bonus", "reaction": "reaction", "minute": "minute", "hour": "hour"}
DURATION_CODES = {"instant": "inst", "round": "round", "minute": "minute", "hour": "hour", "day": "day"}

#: Where a creature's fields go in a tabletop's actor.
ACTOR = {
    "name": "name", "system.attributes.ac.flat": "armor_class", "system.attributes.hp.value": "hit_points", "system.attributes.hp.max": "hit_points",
    "system.attributes.hp.formula": "hit_dice", "system.details.alignment": "alignment", "system.details.cr": "challenge_rating",
    "system.details.xp.value": "experience_points", "system.details.type.value": "creature_type", "system.details.type.subtype": "subtype",
    "system.traits.di.value": "damage_immunities", "system.traits.dr.value": "damage_resistances", "system.traits.dv.value": "damage_vulnerabilities", "system.traits.ci.value": "condition_immunities",
    "system.traits.languages.value": "languages",
}
#: Ways to move, senses, and the lists of a creature's parts, each with how it is activated in a tabletop.
MOVES, SENSES = ["walk", "fly", "swim", "climb", "burrow"], ["darkvision", "blindsight", "tremorsense", "truesight"]
PARTS = {"traits": None, "actions": "action", "bonus_actions": "bonus", "reactions": "reaction", "legendary_actions": "legendary"}
#: Where a spell's fields go.
SPELL = {"name": "name", "system.description.value": "description", "system.level": "level", "system.duration.concentration": "concentration"}
#: Where an item's fields go.
ITEM = {"name": "name", "system.description.value": "description", "system.rarity": "rarity", "system.attunement": "requires_attunement", "system.uses.max": "charges"}

#: Front matter and sections of the notes, by kind: (key in the note, field).
NOTES = {
    "monster": ([("size", "size"), ("creature_type", "creature_type"), ("alignment", "alignment"), ("cr", "challenge_rating"), ("ac", "armor_class"), ("hp", "hit_points")], [
        ("Description", "description"), ("Abilities", "abilities"), ("Speed", "speed"), ("Saving throws", "saving_throws"), ("Skills", "skills"), ("Senses", "senses"), ("Languages", "languages"),
        ("Traits", "traits"), ("Actions", "actions"), ("Bonus actions", "bonus_actions"), ("Reactions", "reactions"), ("Legendary actions", "legendary_actions"),
    ]),
    "spell": ([("level", "level"), ("school", "school")], [("Casting time", "casting_time"), ("Range", "range"), ("Duration", "duration"), ("Description", "description"), ("At higher levels", "higher_levels")]),
    "item": ([("rarity", "rarity"), ("item_type", "item_type")], [("Attunement", "attunement_requirements"), ("Description", "description")]),
    "npc": ([("role", "role"), ("race", "race"), ("location", "location")], [("Description", "description"), ("Personality", "personality"), ("Motivation", "motivation"), ("Secret", "secret")]),
    "location": ([("number", "number")], [("Read aloud", "read_aloud"), ("Description", "description"), ("Features", "features"), ("Treasure", "treasure"), ("Connections", "connections")]),
    "table": ([("die", "die")], [("Description", "description"), ("Entries", "entries")]),
}


def nested(paths: dict[str, Column]) -> Column:
    """A struct of structs from columns by dotted path."""
    tree: dict = {}
    for path, column in paths.items():
        *above, name = path.split(".")
        at = tree
        for step in above:
            at = at.setdefault(step, {})
        at[name] = column
    build = lambda t: F.struct(*((build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()))
    return build(tree)


def placed_fields(df: DataFrame, table: dict[str, str]) -> dict[str, Column]:
    """The columns that ``df`` has of a table of paths."""
    return {path: F.col(f) for path, f in table.items() if f in df.columns}


def actors(creatures: DataFrame) -> DataFrame:
    """(id, json): creatures (id, name, size and fields of ``ACTOR``, abilities as an array of six scores, speed and senses as maps, and arrays of parts, each with name and description) as
    actors; nulls are left out. Parts become the actor's items, in the order of ``PARTS``."""
    has = set(creatures.columns)
    fixed = {"type": F.lit("npc"), "system.traits.size": code_of(F.coalesce("size", F.lit("")), SIZE_CODES, "med")}
    scores = {f"system.abilities.{a}.value": F.get("abilities", F.lit(k)) for k, a in enumerate(ABILITIES)} if "abilities" in has else {}
    moves = {f"system.attributes.movement.{m}": F.try_element_at("speed", F.lit(m)) for m in MOVES} | {"system.attributes.movement.units": F.lit("ft")} if "speed" in has else {}
    senses = {f"system.attributes.senses.{n}": first_integer(F.try_element_at("senses", F.lit(n))) for n in SENSES} | {"system.attributes.senses.units": F.lit("ft")} if "senses" in has else {}
    lists = [F.coalesce(F.transform(name, part_item(activation)), F.lit([]).cast(PART)) for name, activation in PARTS.items() if name in has]
    parts = {"items": F.concat(*lists)} if lists else {}
    return creatures.select("id", F.to_json(nested(placed_fields(creatures, ACTOR) | fixed | scores | moves | senses | parts)).alias("json"))


PART = "array<struct<name:string, type:string, system:struct<description:struct<value:string>, activation:struct<type:string, cost:int>>>>"


def part_item(activation: str | None):
    """A part of a creature as an item: a feat with its description and, but for traits, how it is activated."""

    def made(part: Column) -> Column:
        how = F.lit(None).cast("struct<type:string, cost:int>") if activation is None else F.struct(F.lit(activation).alias("type"), F.lit(1).alias("cost"))
        return F.struct(
            F.coalesce(part["name"], F.lit("Unnamed")).alias("name"), F.lit("feat").alias("type"),
            F.struct(F.struct(F.coalesce(part["description"], F.lit("")).alias("value")).alias("description"), how.alias("activation")).alias("system"),
        )

    return made


def part_lines(parts: Column) -> Column:
    """An array of parts as Markdown paragraphs, each with its name in front; null where there is none."""
    line = lambda p: F.concat(F.lit("***"), F.coalesce(p["name"], F.lit("Unnamed")), F.lit(".*** "), F.coalesce(p["description"], F.lit("")))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, line), "\n\n"))


def pair_lines(pairs: Column) -> Column:
    """A map as ``name value`` by name, between commas; null where there is none."""
    entries = F.array_sort(F.map_entries(F.map_filter(pairs, lambda _, v: v.isNotNull())))
    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", "))


def score_table(scores: Column) -> Column:
    """Six scores as a Markdown table, each with its modifier."""
    modifier = lambda x: F.floor((x - 10) / 2)
    cell = lambda x: F.coalesce(F.concat(x.cast("string"), F.lit(" ("), F.when(x >= 10, "+").otherwise(""), modifier(x).cast("string"), F.lit(")")), F.lit("-"))
    head = f"| {' | '.join(a.upper() for a in ABILITIES)} |\n|{' --- |' * len(ABILITIES)}\n| "
    return F.when(F.size(scores) > 0, F.concat(F.lit(head), F.array_join(F.transform(scores, cell), " | "), F.lit(" |")))


def known(rows: DataFrame, field: str) -> Column:
    """A field as text; null where the rows lack it or it is empty."""
    return F.nullif(F.col(field).cast("string"), F.lit("")) if field in rows.columns else F.lit(None).cast("string")


def encounter_cards(creatures: DataFrame, actions: int = 3, chars: int = 100) -> DataFrame:
    """(id, card): a creature (id, name and what there is of armor_class, hit_points, challenge_rating, abilities: six scores, actions: array of name and description) in
    short for play. Unknown figures are question marks, unknown or zero scores dashes; of the first ``actions`` the first ``chars`` characters are shown."""
    score = lambda x: F.when(F.coalesce(x, F.lit(0)) == 0, "—").otherwise(F.concat(x.cast("string"), F.lit(" ("), F.format_string("%+d", F.floor((x - 10) / 2).cast("bigint")), F.lit(")")))
    cells = [score(F.get("abilities", F.lit(i))) if "abilities" in creatures.columns else F.lit("—") for i in range(len(ABILITIES))]
    figures = F.concat_ws(" | ", *(F.concat(F.lit(f"**{label}** "), F.coalesce(known(creatures, f), F.lit("?"))) for label, f in (("AC", "armor_class"), ("HP", "hit_points"), ("CR", "challenge_rating"))))
    head = f"\n\n| {' | '.join(a.upper() for a in ABILITIES)} |\n|{':---:|' * len(ABILITIES)}\n| "
    card = F.concat(F.lit("\n## "), F.coalesce(known(creatures, "name"), F.lit("Unknown")), F.lit("\n"), figures, F.lit(head), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    if "actions" in creatures.columns:
        line = lambda a: F.concat(F.lit("- **"), F.coalesce(a["name"], F.lit("Action")), F.lit("**: "), F.substring(F.coalesce(a["description"], F.lit("")), 1, chars), F.lit("...\n"))
        shown = F.array_join(F.transform(F.slice("actions", 1, actions), line), "")
        card = F.concat(card, F.when(F.size("actions") > 0, F.concat(F.lit("\n### Actions\n"), shown)).otherwise(""))
    return creatures.select("id", card.alias("card"))


def npc_cards(npcs: DataFrame) -> DataFrame:
    """(id, card): a person (id, name and what there is of race, occupation, role, description, personality, motivation, secret) in short for play; what is unknown is left out."""
    some = lambda f: F.coalesce(known(npcs, f), F.lit(""))
    about = F.concat(F.lit("*"), some("race"), F.lit(" "), some("occupation"), F.lit("* "), F.coalesce(F.concat(F.lit("("), known(npcs, "role"), F.lit(")")), F.lit("")), F.lit("\n\n"))
    parts = [("**Appearance**: ", "description", "\n\n"), ("**Personality**: ", "personality", "\n\n"), ("**Wants**: ", "motivation", "\n\n"), ("> **Secret**: ", "secret", "\n")]
    told = [F.coalesce(F.concat(F.lit(label), known(npcs, f), F.lit(end)), F.lit("")) for label, f, end in parts]
    return npcs.select("id", F.concat(F.lit("\n## "), F.coalesce(known(npcs, "name"), F.lit("Unknown")), F.lit("\n"), about, *told).alias("card"))


def spells(rows: DataFrame) -> DataFrame:
    """(id, json): spells (id, name, school, casting_time, duration, range and fields of ``SPELL``) as items of a tabletop."""
    some = lambda c: F.coalesce(c, F.lit(""))
    fixed = {
        "type": F.lit("spell"), "system.school": code_of(some("school"), SCHOOL_CODES, "evo"), "system.activation.type": code_by_word(some("casting_time"), ACTIVATION_CODES, "action"),
        "system.duration.value": first_integer(F.col("duration")), "system.duration.units": code_by_word(some("duration"), DURATION_CODES, "inst"),
        "system.range.value": first_integer(F.col("range")), "system.range.units": F.when(some("range") == "", "self").otherwise("ft"),
    }
    return rows.select("id", F.to_json(nested(placed_fields(rows, SPELL) | fixed)).alias("json"))


def items(rows: DataFrame) -> DataFrame:
    """(id, json): magic items (id, name, item_type and fields of ``ITEM``) as items of a tabletop."""
    kind = code_by_word(F.coalesce("item_type", F.lit("")), {"weapon": "weapon", "armor": "equipment", "shield": "equipment", "potion": "consumable", "scroll": "consumable"}, "loot")
    return rows.select("id", F.to_json(nested(placed_fields(rows, ITEM) | {"type": kind})).alias("json"))


def table_lines(entries: Column) -> Column:
    """An array of (low, high, result) as rows of a Markdown table; pipes in results are escaped."""
    rolls = lambda e: F.when(e["low"] == e["high"], e["low"].cast("string")).otherwise(F.concat(e["low"], F.lit("-"), e["high"]))
    lines = F.transform(entries, lambda e: F.concat(F.lit("| "), rolls(e), F.lit(" | "), F.replace(e["result"], F.lit("|"), F.lit("\\|")), F.lit(" |")))
    return F.concat(F.lit("| Roll | Result |\n| --- | --- |\n"), F.array_join(lines, "\n"))


def bullets(values: Column) -> Column:
    """An array as a Markdown list; null where there is nothing to list."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n"))


def notes(rows: DataFrame, kind: str) -> DataFrame:
    """(id, name, content): a Markdown note per entity, with what its kind's table names and the rows have; arrays become lists, maps pairs,
    a creature's parts paragraphs and its scores a table."""
    front, sections = NOTES[kind]
    kinds = dict(rows.dtypes)

    def shown(f: str) -> Column:
        special = {"entries": table_lines, "abilities": score_table} | dict.fromkeys(PARTS, part_lines)
        if f in special:
            return special[f](F.col(f))
        return pair_lines(F.col(f)) if kinds[f].startswith("map") else bullets(F.col(f)) if kinds[f].startswith("array") else F.nullif(F.col(f).cast("string"), F.lit(""))

    head = {"type": F.lit(kind)} | {k: shown(f) for k, f in front if f in kinds}
    return rows.select("id", "name", note(F.col("name"), head, {k: shown(f) for k, f in sections if f in kinds}).alias("content"))


def write_vault(files: DataFrame, folder: str) -> None:
    """Store notes (kind, path, content) by kind; ``path`` names the file within the vault."""
    files.write.partitionBy("kind").parquet(folder)


def compendium_rows(entities: DataFrame, blocks: int = 64) -> DataFrame:
    """(source, kind, block, json) of entities (source, kind, id, json): the documents of a source and kind in blocks by id, each one JSON array, so
    that no source has to fit a row."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = entities.groupBy("source", "kind", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "json")))["json"].alias("parts"))
    return parts.select("source", "kind", "block", F.concat(F.lit("["), F.array_join("parts", ","), F.lit("]")).alias("json"))
