"""A stored keyword index: blocks of postings with their greatest weights, and ranked search that leaves out blocks which cannot enter.

Every word of a query is a prefix and words are alternatives. Documents are dealt to blocks, some ``BLOCK`` documents of about equal length each. For every block the
index has the postings (id, length, count) of each whole word, and for each prefix of up to ``CAP`` characters only the number of documents, the highest count and the
smallest length, from which the greatest BM25 weight follows for any average length: the index needs no rewrite when the average moves. As
documents of one block have like lengths, weights differ between blocks, and ranked search reads few of them. The same of a query's longer words, which begin few words, is added up from these
words' postings.

Texts are counted once, documents go to the tasks of their blocks, and a block is inverted there; postings are never rows of a shuffle.

Tables under ``root``: ``postings`` (kind, shard, key, block and, for a prefix, n, max_tf, min_len, for a word ids, lens, tfs) sorted by key, ``counts`` (id, len, words, tfs), ``classes``
(the number of blocks of each class of lengths) and ``totals`` (one row). Documents without words are not in the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.operators import search
from vellum.sources.shared import spread

#: Documents of a block, and words of a block whose documents are long; blocks inverted by one task.
CAP, BLOCK, WORDS, TASK, SHARDS = 4, 1024, 1 << 20, 32, 16
#: Changes with the tables' columns, so that stored ones of another layout are not taken for these.
LAYOUT = 2
#: Blocks scored first, to know what a hit has to beat, and so many at most are named in the scan's filter.
FIRST, NAMED = 16, 1000
BLOCKS = "kind string, key string, block bigint, n bigint, max_tf bigint, min_len int, ids array<bigint>, lens array<int>, tfs array<int>"
STORED = f"{BLOCKS}, shard int"


def shard_of(key: Column) -> Column:
    """Keys that begin with the same character share a shard."""
    return (F.crc32(F.substring(key, 1, 1)) % SHARDS).cast("int")


def counted(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, len, words, tfs) of whole texts: the number of words, the different words and how often each stands there. Texts without words are left out."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    words = docs.select(F.col("id").cast("bigint").alias("id"), tokens(text).alias("t")).filter("size(t) > 0")

    def count(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lists = part.column("t")
                length = np.diff(lists.offsets.to_numpy())
                coded = lists.flatten().dictionary_encode()
                word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(np.repeat(np.arange(part.num_rows), length) * len(coded.dictionary) + word, return_counts=True)
                row, word = np.divmod(pair, len(coded.dictionary))
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                own, often = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(length.astype(np.int32)), own, often], names=["id", "len", "words", "tfs"])

    return words.mapInArrow(count, "id bigint, len int, words array<string>, tfs array<int>")


def class_of(length: Column) -> Column:
    """Lengths within a fifth of each other share a class; there are at most 125 classes."""
    return F.floor(F.log2(length) * 4).cast("int")


def in_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``block``: the class of the length, and a share of it by hash of the id."""
    share = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1)))
    return rows.withColumn("class", class_of(F.col("len"))).join(F.broadcast(classes), "class", "left").withColumn("block", F.col("class") * (1 << 40) + share).drop("class", "shares")


def inverted(block: int, docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """The stored rows of one block of documents (id, len, words, tfs): its words, then its prefixes."""
    lists, often = docs.column("words").combine_chunks(), docs.column("tfs").combine_chunks()
    ids, length = docs.column("id").to_numpy(), docs.column("len").to_numpy()
    row = np.repeat(np.arange(docs.num_rows), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    word, tf = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), often.flatten().to_numpy()
    order = np.argsort(word, kind="stable")
    row, word, tf = row[order], word[order], tf[order]
    at = pa.array(np.searchsorted(word, np.arange(len(coded.dictionary) + 1)).astype(np.int32))
    yield stored("words", coded.dictionary, block, postings=[pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids[row], length[row], tf)])
    # All prefixes of the different words, and which words have which.
    keys, begins = {}, []
    for w in coded.dictionary.to_pylist():
        begins.append([keys.setdefault(w[:i], len(keys)) for i in range(1, min(len(w), CAP) + 1)])
    size = np.fromiter(map(len, begins), np.int64, len(begins))
    flat = np.fromiter((p for b in begins for p in b), np.int64, int(size.sum()))
    n = size[word]
    at = np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pair = flat[at] * docs.num_rows + np.repeat(row, n)
    order = np.argsort(pair)
    pair = pair[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    total = np.add.reduceat(np.repeat(tf, n)[order].astype(np.int64), new)
    key, row = np.divmod(pair[new], docs.num_rows)
    at = np.searchsorted(key, np.arange(len(keys) + 1))
    bounds = [pa.array(np.diff(at)), pa.array(np.maximum.reduceat(total, at[:-1])), pa.array(np.minimum.reduceat(length[row], at[:-1]))]
    yield stored("prefixes", pa.array(list(keys), pa.string()), block, bounds=bounds)


def stored(kind: str, keys: pa.Array, block: int, bounds: list | None = None, postings: list | None = None) -> pa.RecordBatch:
    none = lambda *types: [pa.nulls(len(keys), t) for t in types]
    columns = [pa.repeat(pa.scalar(kind), len(keys)), keys, pa.repeat(pa.scalar(block, pa.int64()), len(keys))]
    columns += (bounds or none(pa.int64(), pa.int64(), pa.int32())) + (postings or none(pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "block", "n", "max_tf", "min_len", "ids", "lens", "tfs"])


def blocks_of(documents: DataFrame, n_blocks: int) -> DataFrame:
    """The stored rows of documents (id, len, words, tfs, block). Whole blocks meet in a task, some ``TASK`` of them."""

    def fold(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            block = t.column("block").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()]
            for low, high in pairwise(at):
                yield from inverted(int(block[low]), t.slice(low, high - low))
            held = t.slice(at[-1])  # the last block may go on in the next batch
        if held is not None and held.num_rows:
            yield from inverted(held.column("block")[0].as_py(), held)

    cores = documents.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n_blocks // TASK), min(n_blocks, cores), 1)
    return documents.select("block", "id", "len", "words", "tfs").repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(fold, BLOCKS).withColumn("shard", shard_of(F.col("key")))


def store(blocks: DataFrame, root: str) -> None:
    """Write the blocks and the totals of the counts that lie there."""
    blocks.sortWithinPartitions("kind", "shard", "key", "block").write.partitionBy("kind", "shard").parquet(f"{root}/postings")
    counts = blocks.sparkSession.read.parquet(f"{root}/counts")
    counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len")).write.parquet(f"{root}/totals")


def write(docs: DataFrame, fields: list[str], root: str) -> None:
    """Index documents (id and text fields; ids are distinct)."""
    spark = docs.sparkSession
    counted(spread(docs.select("id", *fields)), fields).write.parquet(f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    shares = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("len") / WORDS))
    counts.groupBy(class_of(F.col("len")).alias("class")).agg(shares.alias("shares")).write.parquet(f"{root}/classes")
    classes = spark.read.parquet(f"{root}/classes")
    store(blocks_of(in_blocks(counts, classes), classes.agg(F.sum("shares")).first()[0] or 0), root)


def update(spark: SparkSession, old: str, new: str, docs: DataFrame, fields: list[str], gone: DataFrame) -> None:
    """A new version of an index: ``docs`` replace the documents of their ids, and ``gone`` (id) are taken out. Only texts of ``docs`` are counted and only blocks of documents that change made anew."""
    classes, before, postings = (spark.read.parquet(f"{old}/{t}") for t in ("classes", "counts", "postings"))
    classes.write.parquet(f"{new}/classes")
    added = counted(spread(docs.select("id", *fields)), fields)
    out = gone.select("id").unionByName(docs.select("id")).distinct()
    before.join(out, "id", "left_anti").unionByName(added).write.parquet(f"{new}/counts")
    after = in_blocks(spark.read.parquet(f"{new}/counts"), classes)
    touched = in_blocks(before.select("id", "len"), classes).join(out, "id", "left_semi").select("block")
    more = after.select("id", "block").join(docs.select("id"), "id", "left_semi").select("block")
    changed = F.broadcast(touched.unionByName(more).distinct())  # a row for some BLOCK documents
    kept = postings.join(changed, "block", "left_anti").select(*spark.read.schema(STORED).parquet(f"{old}/postings").columns)
    made = blocks_of(after.join(changed, "block", "left_semi"), after.select("block").distinct().count())
    store(kept.unionByName(made), new)


@dataclass
class Search:
    """A query against a stored index."""

    spark: SparkSession
    root: str
    query: str

    def __post_init__(self):
        words = search.query_words(self.query)
        short, long = [w for w in words if len(w) <= CAP], [w for w in words if len(w) > CAP]
        rows = self.spark.read.schema(STORED).parquet(f"{self.root}/postings").filter(F.col("shard").isin(sorted({zlib.crc32(w[:1].encode()) % SHARDS for w in words})))
        any_word = reduce(lambda a, b: a | b, (F.startswith("key", F.lit(w)) for w in words), F.lit(False))
        self.rows = rows.filter((F.col("kind") == "words") & any_word).select("key", "block", "ids", "lens", "tfs")
        self.blocks = rows.filter((F.col("kind") == "prefixes") & F.col("key").isin(short)).select(F.col("key").alias("word"), "block", "n", "max_tf", "min_len")
        for w in long:  # a longer word stands for all whole words that it begins, whose postings are added up
            each = self.postings(self.rows.filter(F.startswith("key", F.lit(w)))).groupBy("block", "id").agg(F.sum("tf").alias("tf"), F.min("len").alias("len"))
            self.blocks = self.blocks.unionByName(each.groupBy(F.lit(w).alias("word"), "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")))
        totals = self.spark.read.schema("n_docs bigint, avg_len double").parquet(f"{self.root}/totals").first()
        counts = {r["word"]: r["n"] for r in self.blocks.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word of the query
        self.n_docs, self.average = totals["n_docs"], totals["avg_len"] or 1.0
        self.words = [w for w in words if w in counts]
        self.counts = counts

    def postings(self, rows: DataFrame) -> DataFrame:
        """(key, block, id, len, tf)"""
        return rows.select("key", "block", F.inline(F.arrays_zip("ids", "lens", "tfs"))).toDF("key", "block", "id", "len", "tf")

    def idf(self, word: str) -> Column:
        return search.idf(F.lit(self.n_docs), F.lit(self.counts[word]))

    def found(self) -> bool:
        """Whether any document has a word of the query; known from the blocks' counts."""
        return bool(self.words)

    def score(self, rows: DataFrame) -> DataFrame:
        """(id, score): the counts of the words that a word of the query begins are added up before they are weighed."""
        tfs = [F.sum(F.when(F.startswith("key", F.lit(w)), F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(self.words)]
        each = self.postings(rows).groupBy("id").agg(F.min("len").alias("len"), *tfs)
        parts = [F.coalesce(self.idf(w) * search.weight(F.col(f"tf{i}"), F.col("len"), F.lit(self.average)), F.lit(0.0)) for i, w in enumerate(self.words)]
        return each.select("id", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"))

    def hits(self) -> DataFrame:
        """(id, score) of all documents with a word of the query."""
        return self.score(self.rows)

    def bounds(self) -> DataFrame:
        """(block, bound): no document of a block scores higher."""
        part = F.coalesce(*(F.when(F.col("word") == w, self.idf(w)) for w in self.words), F.lit(0.0)) * search.weight(F.col("max_tf"), F.col("min_len"), F.lit(self.average))
        return self.blocks.withColumn("part", part).groupBy("block").agg(F.sum("part").alias("bound"))

    def top(self, k: int, shown: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """The best ``k`` (id, score, columns of ``shown``) among ``shown`` by score to six decimals, then id; and how many blocks there are and were read.

        The blocks with the highest bounds are scored first. Others are only read if their bound reaches the k-th score.
        """
        kept = (lambda hits: hits.join(shown, "id")) if shown is not None else (lambda hits: hits)
        bounds = self.bounds()
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        best = search.best_hits(kept(self.score(self.rows.filter(F.col("block").isin(first)))), k).select("score").collect()
        least = best[-1]["score"] if len(best) == k else 0.0
        rest = bounds.filter(~F.col("block").isin(first) & (F.col("bound") >= least - 1e-6)).select("block")
        named = [r["block"] for r in rest.limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            rows, read = self.rows.filter(F.col("block").isin(first + named)), len(first) + len(named)
        else:
            rows, read = self.rows.join(rest.unionByName(bounds.filter(F.col("block").isin(first)).select("block")), "block", "left_semi"), len(first) + rest.count()
        return search.best_hits(kept(self.score(rows)), k), {"blocks": bounds.count(), "read": read}


def find(products: DataFrame, index: Search, holding: DataFrame, metadata: list[str]) -> DataFrame:
    """(id, how): keyword hits, or where no keyword hits at all, substring hits in metadata and among ``holding`` (id: texts that hold the query)."""
    if index.found():
        return index.hits().select("id", F.lit("keyword").alias("how"))
    inside = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(index.query.lower())), F.lit(False))
    by_metadata = reduce(lambda a, b: a | b, map(inside, metadata))
    marked = products.select("id", by_metadata.alias("m")).join(holding.select("id", F.lit(True).alias("b")), "id", "left")
    return marked.select("id", F.when(F.col("m"), "metadata").when(F.col("b"), "content").alias("how")).filter("how is not null")
