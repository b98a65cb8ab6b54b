"""Scanners that go through the lines of a page once and carry state: stat blocks of creatures and rollable tables.

A page is one row, so pages are scanned where they lie, and only those of a small file are dealt to all tasks first; tasks take them in Arrow batches. The scanners are small generators over the lines of one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.sources.shared import spread

#: Creature sizes and kinds that a stat block names after its title.
SIZES = ["Tiny", "Small", "Medium", "Large", "Huge", "Gargantuan"]
KINDS = ["aberration", "beast", "celestial", "construct", "dragon", "elemental", "fey", "fiend", "giant", "humanoid", "monstrosity", "ooze", "plant", "undead"]
ABILITIES = ["str", "dex", "con", "int", "wis", "cha"]

NUMBER, DICE, REST = r"\+?(\d+)", r"(\d+(?:d\d+)?(?:[+-]\d+)?)", r"([^,;\n]+)"
#: Labels of the fields of a stat block, and what follows them.
LABELS = {
    "Armor Class": ("ac", NUMBER), "AC": ("ac", NUMBER), "Hit Points": ("hp", NUMBER), "HP": ("hp", NUMBER), "Speed": ("speed", REST), "Challenge": ("cr", r"(\d+(?:/\d+)?)"),
    "Perception": ("perception", NUMBER), "HD": ("hd", DICE), "THAC0": ("thac0", NUMBER), "Morale": ("morale", NUMBER), "ML": ("morale", NUMBER),
}
#: Labels that only blocks of one family carry; a block belongs to the family of which it has most, two at least.
SIGNS = {"5e": ["Armor Class", "Hit Points", "Challenge"], "pf2e": ["Creature", "Perception"], "osr": ["HD", "THAC0", "Morale", "ML"]}
TEXTS, NUMBERS = ["size", "kind", "hit_dice", "speed", "cr", "xp", "hd"], ["ac", "hp", "level", "perception", "thac0", "morale"]

#: Lines of a block or table at most; a block's first lines, in which nothing ends it; lines after a title in which its size may stand.
LONGEST_BLOCK, FIRST_LINES, LOOK_AHEAD = 100, 6, 3
LONGEST_TABLE = 50

_label = {name: re.compile(rf"(?<!\w){name}(?!\w)[ \t:]*{value}", re.I) for name, (_, value) in LABELS.items()}
_in_brackets = re.compile(r"[^\n(]*\(([^)\n]*)\)")
_sized = re.compile(rf"\s*({'|'.join(SIZES)})\s+({'|'.join(KINDS)})(?!\w)", re.I)
_title = re.compile(r"[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|[ '-])*")
_leveled = re.compile(r"(.+?)\s+creature\s+(\d+)", re.I)
_ability_names, _ability_scores = re.compile(r"\W*" + r"\W+".join(ABILITIES) + r"\W*", re.I), re.compile(r"\d+")
_die = r"([1-9]?)d(4|6|8|10|12|20|100|%)"
_die_first, _title_first = re.compile(rf"roll\s+{_die}\s*[:-]?\s*(.*)", re.I), re.compile(rf"(.*?)\s*\(?(?<!\w){_die}\)?[\s:]*", re.I)
_entry = re.compile(r"(\d+)(?:(?:\s*[-–]\s*(\d+))?[.:)]\s+|\s*[-–]\s*(\d+)\s+|\s{2,})(\S.*)")


def name_at(lines: list[str], i: int) -> str | None:
    """The creature whose block may begin with a line: a title with a size and kind in one of the next lines, or with a level."""
    if m := _leveled.fullmatch(lines[i]):
        return m[1] if _title.fullmatch(m[1]) else None
    if _title.fullmatch(lines[i]) and any(_sized.match(x) for x in lines[i + 1 : i + 1 + LOOK_AHEAD]):
        return lines[i]
    return None


def blocks(lines: list[str]) -> Iterator[tuple[int, str, list[str]]]:
    """Place, name and lines of the stat blocks of a page. After its first lines a block ends at the next start or two blank lines."""
    names, i = [name_at(lines, i) for i in range(len(lines))], 0
    while i < len(lines):
        if names[i] is None:
            i += 1
            continue
        end = i + 1
        while end < min(len(lines), i + LONGEST_BLOCK):
            if end - i >= FIRST_LINES and (names[end] or lines[end : end + 2] == ["", ""]):
                break
            end += 1
        yield i, names[i], lines[i:end]
        i = end


def fields_of(lines: list[str]) -> tuple[str, dict[str, object]]:
    """Family and fields of a stat block. A label counts where it stands as words of their own with a value of its kind behind it."""
    body, found, seen = "\n".join(lines), {}, set()
    for label, (name, _) in LABELS.items():
        if m := _label[label].search(body):
            seen.add(label)
            if name not in found:
                found[name] = int(m[1]) if name in NUMBERS else m[1].strip()
                beside = _in_brackets.match(body, m.end(1))
                if beside and name == "hp":
                    found["hit_dice"] = beside[1]
                if beside and name == "cr" and "XP" in beside[1]:
                    found["xp"] = beside[1].partition("XP")[0].strip()
    if m := _leveled.fullmatch(lines[0]):
        seen.add("Creature")
        found["level"] = int(m[2])
    if sized := next((m for m in map(_sized.match, lines) if m), None):
        found["size"], found["kind"] = sized[1], sized[2]
    for names, scores in zip(lines, lines[1:], strict=False):
        if _ability_names.fullmatch(names):
            values = _ability_scores.findall(re.sub(r"\([^)]*\)", " ", scores))
            if len(values) == len(ABILITIES):
                found["abilities"] = [int(v) for v in values]
    signs = {family: len(seen.intersection(labels)) for family, labels in SIGNS.items()}
    best = max(signs, key=signs.get)
    return best if signs[best] >= 2 else "unknown", found


def header(line: str) -> tuple[str, int] | None:
    """Title and highest roll of a line that opens a table: ``roll d20: Title`` or a title with its die behind it."""
    if m := _die_first.fullmatch(line):
        title, count, sides = m[3] or line, m[1], m[2]
    elif (m := _title_first.fullmatch(line)) and m[1]:
        title, count, sides = m[1], m[2], m[3]
    else:
        return None
    return title, int(count or 1) * (100 if sides == "%" else int(sides))


def roll_tables(lines: list[str]) -> Iterator[tuple[str, int, list[list]]]:
    """Title, highest roll and entries [low, high, result] of the tables of a page.

    A range on the die opens an entry; lines that begin with another number are left out; other lines go on with the last entry. Two blank lines, the next header or
    ``LONGEST_TABLE`` lines end a table. Tables have two entries or more, up to twice the highest roll.
    """
    i = 0
    while i < len(lines):
        opened, i = header(lines[i]), i + 1
        if not opened:
            continue
        entries, end = [], i
        while end < min(len(lines), i + LONGEST_TABLE) and lines[end : end + 2] != ["", ""] and not header(lines[end]):
            line, end = lines[end], end + 1
            m = _entry.fullmatch(line)
            low = int(m[1]) if m else 0
            high = int(m[2] or m[3] or m[1]) if m else 0
            if m and 1 <= low <= high <= opened[1]:
                entries.append([low, high, m[4].strip()])
            elif line and entries and not line[0].isdigit():
                entries[-1][2] += f" {line}"
        if 2 <= len(entries) <= 2 * opened[1]:
            yield *opened, entries
            i = end


def scan(pages: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``keys`` and the rows that ``work`` yields for the trimmed lines of each ``text``; a null text has no lines."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    given = pages.select(*keys, "text")
    wanted = T.StructType([*given.schema.fields[:-1], *T.DataType.fromDDL(schema).fields])
    arrow = to_arrow_schema(wanted)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # a few pages at a time, as what is found may be as long as they are
                part = batch.slice(k, 256)
                of, rows = [], []
                for n, text in enumerate(part.column("text").to_pylist()):
                    for row in work([x.strip() for x in (text or "").split("\n")]):
                        of.append(n)
                        rows.append(row)
                columns = list(zip(*rows, strict=True)) or [[]] * (len(arrow) - len(keys))
                at = pa.array(of, pa.int32())
                made = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keys), *made], schema=arrow)

    return spread(given).mapInArrow(run, wanted)


FIELDS = f"struct<{', '.join([*(f'{n}:string' for n in TEXTS), *(f'{n}:int' for n in NUMBERS)])}, abilities:array<int>>"


def stat_blocks(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (of a page), start, name, system, fields: a struct; what is not found is null."""

    def work(lines):
        for start, name, body in blocks(lines):
            system, found = fields_of(body)
            yield start, name, system, {n: found.get(n) for n in [*TEXTS, *NUMBERS, "abilities"]}

    return scan(pages, keys or ["id"], work, f"start int, name string, system string, fields {FIELDS}")


def table_entries(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (of a page), table_no, title, die (the highest roll), low, high, result: a row per entry of a rollable table."""

    def work(lines):
        for n, (title, die, entries) in enumerate(roll_tables(lines), 1):
            for low, high, result in entries:
                yield n, title, die, low, high, result

    return scan(pages, keys or ["id"], work, "table_no int, title string, die int, low int, high int, result string")
