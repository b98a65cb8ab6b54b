"""Removal of lines that spread over many sites.

Per hash of a line, HyperLogLog sketches of the sites merge by aggregation. Lines whose estimate is clearly at or above the
threshold are boilerplate; those within the sketch's error of it get an exact count of distinct sites. A boilerplate line
stays in the document with the smallest id that has it and goes from all others.

Lines are compared after trimming blanks; lines of under ``LEAST_CHARS`` characters always stay. Null text stays null and has no lines; rows without
a site add to no count; a null id never keeps a line. Documents stay, even if no line is left. Repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import free_names, materialize, without

SITES = 10
LEAST_CHARS = 16
SKETCH_BITS = 12
#: Five standard errors of a sketch.
BAND = 5 * 1.04 / 2 ** (SKETCH_BITS / 2)


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row per line long enough: hashes of the line, site, document, place."""
    row = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text"))
    lines = row.select("doc_id", "site", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    trimmed = lines.withColumn("line", F.trim("line")).filter(F.length("line") >= LEAST_CHARS)
    return trimmed.select("doc_id", "site", "text_hash", "place", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes of the lines on at least ``sites`` sites, with the smallest id that has each."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min("doc_id").alias("first_id"))
    likely = materialize(sketched.select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("about")).filter(F.col("about") >= sites * (1 - BAND) - 1))
    near = F.col("about") <= sites * (1 + BAND) + 1
    counted = lines.select("h1", "h2", "site").join(likely.filter(near).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"))
    exact = likely.join(counted.filter(F.col("n") >= sites).select("h1", "h2"), ["h1", "h2"], "left_semi")
    return likely.filter(~near).unionByName(exact).select("h1", "h2", "first_id")


def remove(docs: DataFrame, sites: int = SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and the number of lines gone; a column of that name is replaced."""
    lines = line_rows(docs, doc_id, text, site)
    gone = lines.drop("site").join(boilerplate(lines, sites), ["h1", "h2"]).filter(F.col("doc_id").isNull() | F.col("first_id").isNull() | (F.col("doc_id") != F.col("first_id")))
    given = without(docs, [removed_col])
    of, hashed, cut = free_names(docs, "__id", "__hash", "__gone")
    places = gone.groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed)).agg(F.collect_set("place").alias(cut))
    joined = given.join(places, (F.col(f"`{doc_id}`").eqNullSafe(F.col(of))) & (F.xxhash64(F.col(f"`{text}`")) == F.col(hashed)), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line, i: ~F.array_contains(cut, i)), "\n")
    changed = {text: F.when(F.col(cut).isNull(), F.col(f"`{text}`")).otherwise(kept)}
    return joined.select([changed[c].alias(c) if c == text else F.col(f"`{c}`") for c in given.columns] + [F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(removed_col)])


def lines_of(docs: DataFrame) -> DataFrame:
    """Query: per document the lines removed, and digest and length of what is left."""
    left = F.coalesce("text", F.lit(""))
    return remove(docs.select("doc_id", "text", "source")).select("doc_id", "n_removed", F.length(left).cast("long").alias("left_chars"), F.sha2(left, 256).alias("left_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), long AS (SELECT *, trim(raw, ' ') AS line FROM lines),
spread AS (SELECT line, min(doc_id) AS first_id FROM long WHERE length(line) >= {LEAST_CHARS} GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
marked AS (SELECT doc_id, place, raw, spread.first_id IS NOT NULL AND doc_id <> spread.first_id AS gone FROM long LEFT JOIN spread USING (line)),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '') AS rest
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_removed, CAST(length(rest) AS BIGINT) AS left_chars, sha256(rest) AS left_sha256 FROM kept
"""
