"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. A document's set holds its distinct five-word shingles (A-Z lower-cased). Documents with the same set form one class, represented by
   its smallest id; only representatives go on.
2. The forest is several sorted orders of the signatures: each tree puts the components in a sequence of its own, and sorts representatives by it. Those that share
   a prefix of ``BASE`` components are a region; the longer the common prefix, the closer two stand in it. The depth is adapted to each region:
   a. up to ``DENSE`` members have each other as candidates;
   b. in a larger one, candidates are the neighbours of longest common prefix: blocks of about ``DENSE`` in sorted order, which share a few leaders. If all but one in eight then hang
      together, the region is a family, and the rest meets all its blocks;
   c. otherwise it holds many unlike texts with a piece in common, and its members go on to prefixes of ``DEEP`` components, in ``DEEP_TREES`` orders to make up
      for what longer prefixes miss. Regions that are large even there are handled as in b.
   Candidates agree in enough components. A task reports only which rows hang together, so a large group gives one row per member and tree, not pairs.
3. Clusters too large for a task are split first, as documents that share a template are alike without being linked. With
   shingles ordered by how often they occur, rarest first, a linked pair shares one of the first n - ceil(6/7 n) + 1 of its smaller
   document and of the first n - ceil(3/4 n) + 1 of its larger one. Documents that share none part, so a shingle of the template
   brings nobody together.
4. Within a cluster, links are confirmed on the full sets: a search from document to document over an inverted index
   of their shingles, so every link between members counts. Clusters that are still large are dealt out in chunks that share
   a few members; then the members outside the cluster's largest component are compared, in blocks, with all its chunks.

At similarity 0.75 a tree misses a pair with probability 1 - 0.75 ** 3, all 24 with 2e-6; the 64 deep ones together with less than 1e-5.

Documents without words (null or empty text) have no set and link with nothing. Rows of one id are one document. Rows
without an id are their own, with a null component_id, and kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.regions import components, groups, region_links, settle, starts_of
from vellum.llm.shared import add_columns, free_names, materialize, mix, ragged, split_words, strings_of, word_hashes

WORDS = 5
PERCENT = 75
COMPONENTS, TREES, BASE = 128, 24, 3
#: Members of a region that are compared whole, and the prefix and number of trees of what is in larger regions of unlike texts.
DENSE = 512
DEEP, DEEP_TREES = 5, 64
#: Candidates agree in so many of the components: at similarity 0.75 five standard deviations below the mean.
AGREE = 71
#: Documents and shingles of a cluster that one task confirms together.
CHUNK_DOCS, CHUNK_SHINGLES = 256, 2_000_000
#: Members that all chunks of a large cluster share.
SHARED = 6
#: Cells of the counts that order shingles from rare to frequent; any order gives right links, a good one small groups.
CELL_BITS = 18

_rng = np.random.default_rng(20240607)
WORD_KEYS = _rng.integers(0, 1 << 63, 2 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = _rng.integers(0, 1 << 31, COMPONENTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    codes, vocab, at = split_words(texts)
    words, n = word_hashes(pc.ascii_lower(vocab))[codes], np.diff(at)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k : len(words) - WORDS + 1 + k] * WORD_KEYS[k]
    rolled = mix(rolled)
    sets = []
    for a, m in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if m >= WORDS:
            sets.append(np.unique(rolled[a : a + m - WORDS + 1]))
        elif m:
            sets.append(mix(np.array([(words[a : a + m] * WORD_KEYS[WORDS : WORDS + m]).sum() + np.uint64(m)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signature(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash components of each set; all must be non-empty."""
    x, starts = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[:-1]
    out = np.empty((len(starts), COMPONENTS), np.uint32)
    for c in range(COMPONENTS):
        out[:, c] = np.minimum.reduceat(x * MULTIPLY[c] + ADD[c], starts)
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size and two hashes of the set, a key per tree, and the low bytes of the components."""
    new = T.StructType(
        [T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    )

    def make():
        def work(texts: pa.Array) -> dict[str, object]:
            flat, at = shingle_sets(texts)
            n = np.diff(at)
            full = np.flatnonzero(n)
            s = [np.zeros(len(n), np.int64) for _ in range(2)]
            keys, low = np.zeros((len(n), TREES), np.int64), np.zeros((len(n), COMPONENTS), np.uint8)
            if len(full):
                starts = at[:-1][full]
                for i, salt in enumerate((0x51ED270B, 0x2545F491)):
                    s[i][full] = np.add.reduceat(mix(flat + np.uint64(salt)), starts).view(np.int64)
                sig = signature(flat, np.append(starts, at[-1]))
                low[full] = (sig ^ sig >> np.uint32(16)).astype(np.uint8)
                wide = sig.astype(np.uint64)
                for t in range(TREES):
                    key = np.full(len(full), t + 1, np.uint64)
                    for k in range(BASE):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, (BASE * t + k) % COMPONENTS])
                    keys[full, t] = key.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), pa.array(keys.ravel()))
            return {"n": n, "s1": s[0], "s2": s[1], "keys": lists, "sig": pa.array([r.tobytes() for r in low], pa.binary())}

        return work

    return add_columns(docs.withColumnRenamed(doc_id, "doc_id"), text, ["doc_id"], new, make)


def agreeing(sig: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which rows (signatures, sizes) are candidates with which others."""
    same = np.zeros((len(sig), len(other)), np.uint8)
    for c in range(COMPONENTS):
        same += sig[:, c, None] == other[None, :, c]
    return (same >= AGREE) & (100 * np.minimum(n[:, None], m[None]) >= PERCENT * np.maximum(n[:, None], m[None]))


def bytes_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(strings_of(t.column("sig").combine_chunks())), np.uint8).reshape(-1, COMPONENTS)


def within(t: pa.Table, at: np.ndarray) -> np.ndarray:
    """For each row the first row of its group that it hangs together with by candidates."""
    n, sig, size = t.column("n").to_numpy(), bytes_of(t), np.diff(at)
    label = np.arange(t.num_rows)
    two = at[:-1][size == 2]
    ok = ((sig[two] == sig[two + 1]).sum(axis=1) >= AGREE) & (100 * np.minimum(n[two], n[two + 1]) >= PERCENT * np.maximum(n[two], n[two + 1]))
    label[two[ok] + 1] = two[ok]
    for i in np.flatnonzero(size > 2).tolist():
        x, y = at[i], at[i + 1]
        label[x:y] = x + settle(y - x, *np.nonzero(np.triu(agreeing(sig[x:y], n[x:y], sig[x:y], n[x:y]), 1)))
    return label


def cross(own: pa.Table, there: pa.Table) -> np.ndarray:
    return agreeing(bytes_of(own), own.column("n").to_numpy(), bytes_of(there), there.column("n").to_numpy())


def order_of(sig: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """The place of signatures in a tree's sorted order, by the low bytes of up to six components of its sequence."""
    o = np.zeros(len(sig), np.int64)
    for c in sequence[:6].tolist():
        o = o << 8 | sig[:, c]
    return o


#: Sequences of components of the deep trees; the others take ``BASE`` components each, one after the other, and then go on.
SEQUENCES = np.array([_rng.permutation(COMPONENTS) for _ in range(DEEP_TREES)])


def forest(reps: DataFrame) -> DataFrame:
    """(v, label) of the representatives in candidate clusters: connected components of the candidates of all trees."""
    attach = lambda rows: rows.join(reps.select(F.col("rep").alias("v"), "n", "sig"), "v")
    tree_row = "key bigint, v bigint, o bigint"

    def rows_of(v: pa.Array, keys: list[np.ndarray], orders: list[np.ndarray]) -> pa.RecordBatch:
        # Rows at one place are told apart by bits of their hash, so that many of them can be cut into blocks.
        apart = (mix(v.to_numpy().view(np.uint64)) & np.uint64(0x7FFF)).view(np.int64)
        order = np.concatenate(orders) << 15 | np.tile(apart, len(orders))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(v.to_numpy(), len(keys))), pa.array(order)], names=["key", "v", "o"])

    def base(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(strings_of(b.column("sig"))), np.uint8).reshape(-1, COMPONENTS)
                keys = b.column("keys").flatten().to_numpy().reshape(-1, TREES)
                yield rows_of(b.column("rep"), [keys[:, t] for t in range(TREES)], [order_of(sig, (np.arange(BASE, BASE + 6) + BASE * t) % COMPONENTS) for t in range(TREES)])

    def deep(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(strings_of(b.column("sig"))), np.uint8).reshape(-1, COMPONENTS)
                keys = [mix(order_of(sig, s[:DEEP]).view(np.uint64) * np.uint64(DEEP_TREES) + np.uint64(t)).view(np.int64) for t, s in enumerate(SEQUENCES)]
                yield rows_of(b.column("v"), keys, [order_of(sig, s[DEEP:]) for s in SEQUENCES])

    def deeper(open_: DataFrame) -> DataFrame:
        rows = attach(open_).select("v", "sig").mapInArrow(deep, tree_row)
        return region_links(rows, DENSE, within, cross, attach)

    rows = reps.select("rep", "keys", "sig").mapInArrow(base, tree_row)
    return components(region_links(rows, DENSE, within, cross, attach, deeper))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that it is connected with by links."""
    g, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * both >= PERCENT * (size.sum() - both) else 1])
    flat = np.concatenate(sets)
    _, item = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(g), size)
    by_item = owner[np.argsort(item, kind="stable")]
    count = np.bincount(item)
    first = np.cumsum(count) - count
    ends = np.cumsum(size)
    root, open_ = np.full(g, -1), np.ones(g, bool)
    for seed in range(g):
        if not open_[seed]:
            continue
        root[seed], open_[seed], queue = seed, False, [seed]
        while queue and open_.any():
            d = queue.pop()
            own = item[ends[d] - size[d] : ends[d]]
            both = np.bincount(ragged(by_item, first[own], count[own]), minlength=g)
            new = np.flatnonzero(open_ & (100 * both >= PERCENT * (size[d] + size - both)))
            root[new], open_[new] = seed, False
            queue += new.tolist()
    return root


def with_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (rep, ...) with the sorted shingle hashes of each rep's text, as bytes in ``set``."""

    def make():
        def work(texts: pa.Array) -> dict[str, object]:
            flat, at = shingle_sets(texts)
            return {"set": pa.array([flat[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())}

        return work

    wanted = docs.join(rows.select("rep").distinct(), docs["doc_id"] == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    return add_columns(wanted, "text", ["rep"], T.StructType([T.StructField("set", T.BinaryType())]), make).join(rows, "rep")


def split_large(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """``clusters`` (rep, n, cluster), the large ones split where rare shingles are not shared."""
    sizes = clusters.groupBy("cluster").agg(((F.count(F.lit(1)) > CHUNK_DOCS) | (F.sum("n") > CHUNK_SHINGLES)).alias("large"))
    marked = materialize(clusters.join(sizes, "cluster"))
    if marked.filter("large").isEmpty():
        return clusters
    sets = materialize(with_sets(docs, marked.filter("large").select("rep", "cluster")).select("cluster", "rep", "set"))

    def count(batches):
        for b in batches:
            total = np.bincount(cell(np.frombuffer(b"".join(strings_of(b.column("set"))), np.uint64)), minlength=1 << CELL_BITS)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    counted = sets.select("set").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** CELL_BITS rows
    often = np.zeros(1 << CELL_BITS, np.int64)
    often[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def rarest(batches):
        often = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            out, early, of = [], [], []
            for i, raw in enumerate(strings_of(b.column("set"))):
                own = np.frombuffer(raw, np.uint64)
                n = len(own)
                order = np.lexsort((own, often[cell(own)]))[: n - -(-PERCENT * n // 100) + 1]
                out.append(own[order].view(np.int64))
                early.append(np.arange(len(order)) < n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1)
                of.append(np.full(len(order), i))
            of = np.concatenate(of)
            n = pc.divide(pc.binary_length(b.column("set")), 8).cast(pa.int64())
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("cluster").take(take), b.column("rep").take(take), n.take(take), pa.array(np.concatenate(out)), pa.array(np.concatenate(early))], names=["cluster", "rep", "n", "shingle", "early"])

    rows = materialize(sets.mapInArrow(rarest, "cluster bigint, rep bigint, n bigint, shingle bigint, early boolean"))
    first = lambda f, c: f(F.when(F.col("early"), F.col(c)))
    meets = rows.groupBy("cluster", "shingle").agg(first(F.min, "rep").alias("center"), first(F.min, "n").alias("least"), first(F.max, "n").alias("most"), F.count(F.lit(1)).alias("k"))
    meets = meets.filter("k > 1 and center is not null").drop("k")
    near = rows.join(meets, ["cluster", "shingle"]).filter((F.col("n") >= F.col("least")) & (PERCENT * F.col("n") <= 100 * F.col("most")) & (F.col("rep") != F.col("center")))
    found = components(near.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct())
    parts = marked.join(found, F.col("rep") == F.col("v")).filter("large").select("rep", "n", F.col("label").alias("cluster"))
    return marked.filter("not large").select("rep", "n", "cluster").unionByName(parts)


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def confirm(dealt: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, root) by confirmed links within each (cluster, chunk) of ``dealt`` (rep, cluster, chunk)."""
    sets = with_sets(docs, dealt)

    def search(batches):
        for t in groups(batches, ["cluster", "chunk"]):
            at = starts_of(t, ["cluster", "chunk"])
            rep, sets = t.column("rep").to_numpy(), [np.frombuffer(x, np.uint64) for x in strings_of(t.column("set").combine_chunks())]
            root = np.empty(len(rep), np.int64)
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                root[x:y] = rep[x + linked(sets[x:y])]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(root)], names=["rep", "root"])

    rows = sets.select("cluster", "chunk", "rep", "set").repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "rep")
    return rows.mapInArrow(search, "rep bigint, root bigint")


def confirmed_components(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, label) by confirmed links, from clusters (rep, n, cluster)."""
    clusters = split_large(clusters, docs)
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("chunks", F.ceil(F.greatest(F.col("docs") / CHUNK_DOCS, F.col("shingles") / CHUNK_SHINGLES)).cast("int"))
    placed = materialize(clusters.join(sizes, "cluster").select("cluster", "rep", "docs", "chunks", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("home")))
    everywhere = (F.col("rep") == F.col("cluster")) | (F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("docs")) < SHARED)
    to = F.when((F.col("chunks") > 1) & everywhere, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("home"))
    links = materialize(confirm(placed.select("rep", "cluster", F.explode(to).alias("chunk")).withColumn("chunk", F.col("chunk").cast("bigint")), docs))
    large = placed.filter("chunks > 1")
    if large.isEmpty():
        return links.select(F.col("rep").alias("v"), F.col("root").alias("label"))
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # Links that chunks have kept apart: whoever is not in its cluster's largest component, against every chunk.
    inside = materialize(large.join(labels, F.col("rep") == F.col("v")).select("cluster", "rep", "home", "chunks", "label"))
    main = inside.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    apart = materialize(inside.join(main, "cluster").filter("label <> main"))
    if apart.isEmpty():
        return labels
    blocks = apart.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")).cast("int")
    base = inside.join(blocks, "cluster").select("rep", "cluster", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = apart.join(blocks, "cluster").select("rep", "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("home"), block.alias("block"))
    dealt = base.unionByName(asked).distinct().select("rep", "cluster", (F.col("home") * (1 << 31) + F.col("block")).cast("bigint").alias("chunk"))
    more = confirm(dealt, docs)
    return components(links.unionByName(more).select(F.col("rep").alias("a"), F.col("root").alias("b")))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = materialize(signatures(docs))
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    reps = materialize(classes)
    labels = forest(reps)
    clusters = labels.join(reps.select("rep", "n"), F.col("v") == F.col("rep")).select("rep", "n", F.col("label").alias("cluster"))
    found = confirmed_components(clusters, docs).groupBy("v").agg(F.min("label").alias("label"))
    named = reps.select("s1", "s2", "n", "rep").join(found, F.col("rep") == F.col("v"), "left").select("s1", "s2", "n", F.coalesce("label", "rep").alias("component"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that have a near duplicate with a smaller id; rows without an id stay."""
    (name,) = free_names(docs, "__gone")
    gone = find(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
