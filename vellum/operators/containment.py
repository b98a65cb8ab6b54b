"""Joins on containment of one string in another, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The different runs of ``n`` characters."""
    chars = F.split(text, "")
    runs = chars
    for k in range(2, n + 1):  # lists of unequal length are filled with nulls, and what is joined with null is null
        runs = F.zip_with(runs, F.slice(chars, k, F.greatest(F.length(text), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull() & (F.length(x) == n)))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of all needles (needle) that texts (text) hold; both distinct, without nulls and empty needles.
    Needles longer than every text are left out first.

    A needle stands under the rarest of its trigrams, by how many texts have it, or, if shorter, as it is. It meets the texts that have this gram,
    and is looked for there. A needle with a gram that no text has meets none.
    """
    longest = F.broadcast(texts.agg(F.max(F.length("text")).alias("__longest")))  # one row
    needles = needles.crossJoin(longest).filter(F.length("needle") <= F.col("__longest"))
    held = F.concat(*(grams(F.col("text"), n) for n in range(1, GRAM + 1)))
    own = needles.select("needle", F.explode(F.when(F.length("needle") > GRAM, grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))).alias("gram"))
    stands = texts.select("text", F.explode(held).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    often = stands.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    return rarest.select("needle", F.col("r.gram").alias("gram")).join(stands, "gram").filter(F.contains("text", "needle")).select("needle", "text")
