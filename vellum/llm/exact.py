"""Exact deduplication by a tree-merge of sorted digest runs; DataFrame functions only.

Input partitions are dealt to ``RUNS`` runs. A run holds its distinct (digest, length, second hash), each with the smallest
identifier and the number of rows, sorted, and is spread over tasks by key, so that it grows with the cluster and not with a task.
Runs meet in binomial rounds: in round k, run i takes in run i + 2^k, for every i that has its lower k + 1 bits clear. A meeting is one
pass through two sorted inputs that keeps the smaller identifier and adds the counts: a sort-merge full outer join, in which a task
walks the same keys of all pairs of the round together. After log2(RUNS) rounds run 0 holds everything. A text copied any number of
times has at most one row per run, so no key is hot in a round. Rows meet only where digest, length and second hash all agree,
which verifies the digest at every level. Each round is written to the shared folder.

A null text equals the empty text. Repeated rows count as copies; where several rows carry the smallest id, all of them are kept.
Rows without an id never give ``keep_id`` while others do; if none has one, ``keep_id`` is null and no row is kept. An empty table gives no rows.
The last join brings the result back to all rows of a text; a text that holds many of them is a skewed key there, which adaptive
execution splits, as the other side has one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import discard, materialize

RUNS = 8
KEY = ["text_sha256", "n_chars", "check"]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS) -> DataFrame:
    """Id, digest of the text with white space squeezed, its length and a second hash, and the run a row belongs to."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), plain.alias("plain")).select(
        "doc_id", F.sha2("plain", 256).alias("text_sha256"), F.length("plain").alias("n_chars"), F.xxhash64("plain").alias("check"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run")
    )


def meet(runs: DataFrame, step: int) -> DataFrame:
    """One round: each run with ``step`` in its number goes into the run without it."""
    odd = F.col("run").bitwiseAND(F.lit(step)) != 0
    there = runs.filter(odd).select((F.col("run") - step).alias("run"), *KEY, F.col("keep_id").alias("keep_there"), F.col("group_size").alias("size_there"))
    here = runs.filter(~odd).hint("merge")
    both = here.join(there, ["run", *KEY], "full_outer")
    size = F.coalesce("group_size", F.lit(0)) + F.coalesce("size_there", F.lit(0))
    return both.select("run", *KEY, F.least("keep_id", "keep_there").alias("keep_id"), size.alias("group_size"))


def tree_merge(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """KEY with keep_id and group_size, from rows of KEY, doc_id and run (0 <= run < runs)."""
    merged = rows.groupBy("run", *KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = materialize(merged.sortWithinPartitions("run", *KEY))
    step = 1
    while step < runs:
        before, merged = merged, materialize(meet(merged, step))
        discard(before)
        step *= 2
    return merged.drop("run")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digests(docs, doc_id, text))
    return rows.join(tree_merge(rows), KEY).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
