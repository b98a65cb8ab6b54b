"""Substring search over stored texts with a bitmap of trigrams beside each.

``write`` stores (id, text, grams): a bit for every three bytes in a row of the lower-cased text, by hash, in about eight bits for each different one. A substring
of three bytes or more can only be in texts that have the bits of all its trigrams, so others are dropped before they are lower-cased or split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.shared import spread

#: Bits for each different trigram, before rounding up to a power of two, and longs of the largest bitmap.
BITS, MOST = 8, 1 << 15
#: Texts of a piece of a batch.
ROWS = 128
#: Changes with the table's columns.
LAYOUT = 1


def trigrams(text: np.ndarray) -> np.ndarray:
    """Hashes of the trigrams of UTF-8 bytes (31 bits each)."""
    b = text.astype(np.uint64)
    code = b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def bitmap(text: pa.Buffer | bytes) -> np.ndarray:
    """Longs with a bit per different trigram; a text without any has one empty long."""
    grams = np.unique(trigrams(np.frombuffer(text, np.uint8))) if len(text) > 2 else np.zeros(0, np.int64)
    width = min(MOST, max(1, 1 << (len(grams) * BITS // 64).bit_length()))
    bits = np.zeros(width * 64, bool)
    bits[grams % (width * 64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def write(docs: DataFrame, root: str) -> None:
    """Store texts (id, text) with their bitmaps; null texts hold nothing and are left out."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # a few texts at a time, as copies of theirs and their bitmaps are as long as they are
                part = batch.slice(k, ROWS)
                maps = [bitmap(t.as_buffer()) for t in part.column("low").cast(pa.binary())]
                at = np.cumsum([0, *map(len, maps)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(maps)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), lists], names=["id", "text", "grams"])

    given = spread(docs.select("id", "text")).filter("text is not null").select(F.col("id").cast("bigint").alias("id"), "text", F.lower("text").alias("low"))
    given.mapInArrow(run, "id bigint, text string, grams array<bigint>").write.parquet(root)


def may_contain(query: str) -> Column:
    """Whether the bitmap has all trigrams of a lower-case query."""
    raw = np.frombuffer(query.encode(), np.uint8)
    test = F.lit(True)
    for h in sorted(set(trigrams(raw).tolist())) if len(raw) > 2 else []:
        bit = F.lit(h) % (F.size("grams") * 64)
        word = F.get(F.col("grams"), F.floor(bit / 64).cast("int"))
        test &= F.call_function("shiftrightunsigned", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return test


def holding(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(id, text) of the stored texts that hold the query, whatever the case."""
    low = query.lower()
    rows = spark.read.schema("id bigint, text string, grams array<bigint>").parquet(root).filter(may_contain(low))
    return rows.filter(F.contains(F.lower("text"), F.lit(low))).select("id", "text")
