"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a variant of a file, dropped from the end of its name.
VARIANTS = ["print", "screen", "printer", "web", "lite", "free", "preview", "sample"]


def stem(name: Column) -> Column:
    """File name without its extension; names that begin with a dot keep it."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_part(path: Column, part: str) -> Column:
    """Whether a folder of the path, or its file name, is exactly ``part``."""
    return F.array_contains(F.split(path, "/"), part)


def normalize_name(name: Column) -> Column:
    """Lower case, separators to spaces, one variant word taken from the end."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(stem(name)), r"[-_.]", " "), r" +", " "))
    return F.trim(F.regexp_replace(plain, f" ({'|'.join(VARIANTS)})$", ""))


def glob_regex(pattern: str) -> str:
    """An anchored Java regex for a shell glob: ``*`` crosses ``/``, ``[!x]`` excludes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end
        elif c in "*?":
            out.append({"*": ".*", "?": "."}[c])
        else:
            out.append(c if c.isalnum() or c in "_/ " else f"\\{c}")
        i += 1
    return f"(?s)^{''.join(out)}$"


def clean_text(text: Column) -> Column:
    """Tags to nothing, blanks squeezed, words joined over hyphenated line ends, single line ends within sentences to spaces."""
    for pattern, new in ((r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""), (r"[ \t]+", " "), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"([a-z,;])\n([a-z])", "$1 $2"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def sanitize(name: Column) -> Column:
    return F.substring(F.replace(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), F.lit(" "), F.lit("_")), 1, 100)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def display_title(title: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), file_name)


def level_label(low: Column, high: Column) -> Column:
    some = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.when(low.isNotNull() | high.isNotNull(), F.concat(some(low), F.lit("-"), some(high)))


def first_integer(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def is_heading(line: Column, following: Column) -> Column:
    """All capitals without a final full stop, or a short line before a blank one that begins with a capital and ends no clause."""
    capitals = (F.length(line) >= 3) & (line == F.upper(line)) & line.rlike(r"\p{Lu}") & ~line.endswith(".")
    short = (F.length(line) >= 3) & (F.length(line) < 60) & (F.coalesce(F.trim(following), F.lit("")) == "") & line.rlike(r"^\p{Lu}") & ~line.rlike(r"[,;:]$")
    return F.coalesce(capitals | short, F.lit(False))


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([•●\-*]|\d+[.)])\s+")


def markdown_line(line: Column, heading: Column) -> Column:
    return F.when(heading, F.concat(F.lit("### "), F.trim(line))).when(line.rlike(r"^\s*[•●\-*]\s+"), F.regexp_replace(line, r"^\s*[•●\-*]\s+", "- ")).otherwise(line)


def year_of_text(text: Column, low: int = 1970, high: int = 2030) -> Column:
    """The first pattern that gives a year in range: after a copyright sign or word, after "published", before or after "edition"."""
    guarded = []
    for pattern in (r"(?i)(?:©|copyright)\s*(?:©\s*)?(\d{4})", r"(?i)published[^\d]{0,20}(\d{4})", r"(?i)(\d{4})\s+edition"):
        year = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
        guarded.append(F.when(year.between(low, high), year))
    return F.coalesce(*guarded)


def parse_list(value: Column) -> Column:
    """A JSON array or a comma list as an array of trimmed, non-empty strings; blank and null give null."""
    text = F.trim(value)
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.when(F.coalesce(text, F.lit("")) != "", F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def outermost_json(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
