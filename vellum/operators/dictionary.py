"""Names from texts by a dictionary of aliases, all in one pass.

Texts and aliases are cut into the same tokens: runs of letters, digits and underscores, and other characters one by one. A run of tokens of a text that equals an alias is
a hit, so aliases stand on word bounds, whatever the case and the white space between. Hits come from an equijoin of the texts' runs, as long as the aliases are, with the aliases;
ten thousand aliases cost about what ten do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Names = dict[str, list[str]]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def dictionary(spark: SparkSession, fields: dict[str, Names]) -> DataFrame:
    """(field, place, name, alias) of names in their order; the dictionary's author bounds it."""
    rows = [(field, i, name, alias) for field, names in fields.items() for i, (name, aliases) in enumerate(names.items()) for alias in aliases]
    return spark.createDataFrame(rows, "field string, place int, name string, alias string")


def found(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, field, place, name, n): how many different aliases of a name a text (id, text) has."""
    known = names.withColumn("words", tokens(F.col("alias"))).filter("size(words) > 0")
    sizes = sorted(r[0] for r in known.select(F.size("words")).distinct().collect())  # lengths of aliases in words: a few
    runs = lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*map(runs, sizes))) if sizes else F.array().cast("array<string>")
    rows = docs.select("id", tokens(F.col("text")).alias("t")).select("id", F.explode(every).alias("run"))
    hits = rows.join(known.select("field", "place", "name", F.array_join("words", " ").alias("run")).distinct(), "run")
    return hits.groupBy("id", "field", "place", "name").agg(F.count(F.lit(1)).alias("n"))


def first_names(hits: DataFrame, fields: list[str]) -> DataFrame:
    """(id, a column per field): the first name, in the dictionary's order, that a text has."""
    return hits.filter(F.col("field").isin(fields)).groupBy("id").agg(*(F.min(F.when(F.col("field") == f, F.struct("place", "name")))["name"].alias(f) for f in fields))


def best_names(hits: DataFrame, rules: dict[str, tuple[int, float]]) -> DataFrame:
    """(id, a struct (value, confidence) per field): the name with most of its words in the text, the first of equals. ``rules`` has the least number of
    words of each field and what each word adds to the confidence."""
    top = lambda f: F.max(F.when(F.col("field") == f, F.struct("n", (-F.col("place")).alias("order"), "name")))
    rows = hits.filter(F.col("field").isin(list(rules))).groupBy("id").agg(*(top(f).alias(f) for f in rules))
    made = lambda f, least, step: F.when(F.col(f)["n"] >= least, F.struct(F.col(f)["name"].alias("value"), F.round(F.least(F.lit(0.9), 0.5 + F.col(f)["n"] * step), 2).alias("confidence")))
    return rows.select("id", *(made(f, *rule).alias(f) for f, rule in rules.items()))
