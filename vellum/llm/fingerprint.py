"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Words of a text make five-word shingles (fewer words make one). Each shingle is hashed once; ``BITS_BINS`` bits of the hash
choose its bin and each bin keeps its smallest hash. Empty bins take the hash of a full bin that a fixed sequence of probes,
drawn for the empty bin alone, meets first (optimal densification). The fingerprint is the low ``BITS`` bits of every bin in
hex. Equal low bits by chance are taken out of the likeness: ``(equal share - c) / (1 - c)`` with ``c = 2 ** -BITS``, at least 0.

The next document by ascending id is found within ranges of ids, whose bounds are quantiles and whose number follows the bytes of all
texts; the first document of a range also comes last in the range before. An id that would fill several ranges is dealt to them by hash. Null text is empty. Texts without words have the fingerprint of all zeros, like only each
other. Rows with equal ids follow each other by a hash of the text. Rows without an id come first. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BITS_BINS, BITS, WORDS = 8, 4, 5
BINS = 1 << BITS_BINS
#: A bin's hash has so many bits; the full range marks an empty bin.
HASH_BITS = 48
EMPTY = (1 << HASH_BITS) - 1
#: Probes of an empty bin until bins are simply tried in order.
PROBES = 24
#: Bytes of text of a range of ids; a small table has ranges of at least ``LEAST_BYTES``, up to eight for each of the session's shuffle partitions.
#: A partition holds several ranges, so that their hashes spread them evenly.
RANGE_BYTES, LEAST_BYTES = 32 << 20, 1 << 20


def probe(j: int, k: int) -> int:
    """The k-th bin that empty bin j tries: a fixed pseudo-random sequence, and in the end every bin."""
    x = (j * 0x9E3779B1 + (k + 1) * 0x85EBCA77) & 0xFFFFFFFF
    x = ((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    return (x ^ x >> 12) % BINS if k < PROBES else (j + k) % BINS


def shingle_hashes(words: Column) -> Column:
    """One long per shingle: the bin above, the hash below."""
    n = F.size(words)
    whole = lambda w: F.shiftrightunsigned(w, 64 - HASH_BITS - BITS_BINS)
    several = F.transform(F.slice(words, 1, F.greatest(n - WORDS + 1, F.lit(0))), lambda w, i: whole(F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WORDS)))))
    return F.when(n >= WORDS, several).when(n > 0, F.array(whole(F.xxhash64(words)))).otherwise(F.array().cast("array<bigint>"))


def constants(values: list[int], kind: str) -> Column:
    """A literal array; one string is quicker to plan than thousands of literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the fingerprint and the number of words, as columns ``name`` and ``name_words``."""
    w, h, s, b = (f"__{name}_{x}" for x in "whsb")
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    df = df.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(h, shingle_hashes(F.col(w)))
    marks = constants([(j << HASH_BITS) + EMPTY for j in range(BINS)], "bigint")
    # Sorting brings each bin's smallest hash first; a mark in every bin stands in where there is none.
    df = df.withColumn(s, F.sort_array(F.concat(F.col(h), marks)))
    first = F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, HASH_BITS) != F.shiftright(F.get(F.col(s), i - 1), HASH_BITS)))
    df = df.withColumn(b, F.transform(first, lambda x: x.bitwiseAND(F.lit(EMPTY))))
    table = constants([probe(j, k) for j in range(BINS) for k in range(PROBES)], "int")
    full = lambda x: x != EMPTY

    def filled(x: Column, j: Column) -> Column:
        tries = F.transform(F.slice(table, j * PROBES + 1, F.lit(PROBES)), lambda k: F.get(F.col(b), k))
        hit = F.get(F.filter(tries, full), F.lit(0))
        in_order = F.get(F.filter(F.concat(F.slice(F.col(b), j + 1, BINS), F.col(b)), full), F.lit(0))
        return F.when(full(x), x).otherwise(F.coalesce(hit, in_order))


    def digit(x: Column, j: Column) -> Column:
        # Bins take their bits at different places, so that bins filled from one hash do not agree by chance all at once.
        low = F.call_function("shiftright", x, (j % 10 * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))
        return F.substr(F.lit("0123456789abcdef"), (low + 1).cast("int"), F.lit(1))

    packed = F.array_join(F.transform(F.transform(F.col(b), filled), digit), "")
    return df.withColumn(name, F.when(F.size(w) == 0, F.lit("0" * BINS)).otherwise(packed)).withColumn(f"{name}_words", F.size(w)).drop(w, h, s, b)


def likeness(a: str, b: str) -> Column:
    """Bias-corrected share of equal bins; texts without words are like each other only."""
    def digits(c: str, i: Column) -> Column:
        return F.conv(F.substr(F.col(c), i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    def add(total: Column, i: Column) -> Column:
        d = digits(a, i).bitwiseXOR(digits(b, i))
        d = d.bitwiseOR(F.shiftright(d, 1))
        return total + F.bit_count(d.bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(0x11111111)))

    different = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), add)
    chance = 2.0**-BITS
    both = (F.col(f"{a}_words") > 0) & (F.col(f"{b}_words") > 0)
    none = (F.col(f"{a}_words") == 0) & (F.col(f"{b}_words") == 0)
    return F.when(none, 1.0).when(~both, 0.0).otherwise(F.greatest(F.lit(0.0), ((1 - different / BINS) - chance) / (1 - chance)))


def below(limits: list[int], value: Column, equal: bool) -> Column:
    """How many of the ascending ``limits`` lie below a value (or are equal): a search among every n-th, then among the n after it."""
    n = max(1, math.isqrt(len(limits)))
    before = (lambda x: x <= value) if equal else (lambda x: x < value)
    coarse = F.size(F.filter(constants(limits[n - 1 :: n], "bigint"), before)) if limits else F.lit(0)
    return coarse * n + (F.size(F.filter(F.slice(constants(limits, "bigint"), coarse * n + 1, F.lit(n)), before)) if limits else F.lit(0))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, and bucket and place, such that the next row of a bucket is the next document; ``extra`` rows only serve their forerunner."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    of = F.coalesce("doc_id", F.lit(-(1 << 63)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, -(-size // RANGE_BYTES), min(8 * usual, -(-size // LEAST_BYTES)))
    bounds = rows.select(of.alias("i")).agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], max(10_000, 4 * parts)).alias("b")).first()["b"] or []
    # An id with several bounds has more rows than a range should: they are dealt by hash of the text, which is their order.
    low, spread = below(bounds, F.col("i"), False), below(bounds, F.col("i"), True) - below(bounds, F.col("i"), False)
    part = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * (spread + 1)).cast("int")
    bucket = low + F.least(part, spread)
    # The first row of each bucket, by id and text hash: at most one per bucket, found in one aggregation.
    key = F.struct(of.alias("i"), F.xxhash64("text").alias("h"))
    placed = rows.withColumn("i", of).withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket)
    heads = placed.groupBy("bucket").agg(F.min(key).alias("k")).select("bucket", "k.i", "k.h").toArrow()  # a row per range
    order = sorted(zip(*(heads.column(c).to_pylist() for c in ("bucket", "i", "h")), strict=True))
    if not order:
        return placed.withColumn("extra", F.lit(False))
    before = {b: order[n - 1][0] for n, (b, _, _) in enumerate(order)}
    wanted = docs.sparkSession.createDataFrame([(i, h, before[b], b == order[0][0]) for b, i, h in order], "i bigint, h bigint, to bigint, wraps boolean")
    extra = placed.join(F.broadcast(wanted), ["i", "h"]).dropDuplicates(["i", "h"])
    extra = extra.select("doc_id", "text", "i", F.col("to").cast("int").alias("bucket"), "h", F.lit(True).alias("extra"))
    return placed.withColumn("extra", F.lit(False)).unionByName(extra).repartition(max(min(parts, usual), -(-size // (2 * RANGE_BYTES))), "bucket")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    follow = Window.partitionBy("bucket").orderBy("extra", "i", "h")
    rows = with_next(docs, doc_id, text).withColumn("n", F.length("text")).withColumn("m", F.floor(F.col("n") / 4).cast("int"))
    rows = rows.withColumn("next_text", F.lead("text").over(follow))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n") - F.col("m")), F.substr("next_text", F.lit(1), F.col("m")))).drop("next_text")
    rows = with_fingerprint(rows, F.col("text"), "fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "m")
    rows = with_fingerprint(rows, F.col("edited"), "edited_fingerprint").drop("edited")
    rows = rows.withColumn("next_fp", F.lead("fingerprint").over(follow)).withColumn("next_fp_words", F.lead("fingerprint_words").over(follow))
    return rows.filter(~F.col("extra")).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fp").alias("near_next"),
    )
