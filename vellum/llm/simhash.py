"""Near duplicates by SimHash with keys from a Golay code.

1. A text's words (A-Z lower-cased) make four-word shingles, repeats included; a bit of the 64-bit fingerprint is set if it is set in over half of their hashes.
   Documents with one fingerprint form a class; only distinct fingerprints go on.
2. A fingerprint is cut into three segments of 22, 21 and 21 bits. The binary Golay code of length 23 is perfect: a segment (padded with zeros) has one codeword
   within distance 3, and those within distance 4 number one or six. Two segments at distance 2 or less have a point between them, whose codeword is
   within 4 of both: they share a codeword index.
3. Fingerprints that differ in 4 bits or fewer spread these over the segments, so the two segments with the fewest have at most 2 together: one is equal and
   another within 2, or both differ in 1 and the third in at most 2. Keys are therefore an equal segment with a codeword index of another one (all six ways) and
   indices of the first two segments together: about 60 keys, of 24 to 34 bits, and no pair is missed.
4. Fingerprints that share a key meet and are verified by counting differing bits; a task reports only who hangs together. A key with more than ``DENSE`` fingerprints is
   cut further, by which of five pieces of the fingerprint are equal (four differing bits leave one of five untouched); what is still large is
   sorted and compared in blocks of neighbours that share leaders.
5. Connected components over all links name each document's class.

Documents without words (null or empty text) have the fingerprint zero and link like any other. A text of fewer than four words is one shingle. Repeated rows are copies. Rows without
an id link too but name nothing: their ``component_id`` is the smallest id they reach, null if there is none. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.regions import LINK, components, groups, linked_batch, region_links, settle, starts_of
from vellum.llm.shared import add_columns, materialize, strings_of

WORDS, SEED = 4, 42
BITS, DISTANCE = 64, 4
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23, by its bits.
GENERATOR = 0b110001110101
LENGTH, CHECKS, RADIUS = 23, 11, 4
#: Fingerprints of a key that a task compares whole, and the size up to which groups are compared side by side.
DENSE, SMALL = 8192, 48
#: First bit and width of the pieces of which ``DISTANCE`` differing bits leave one equal.
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of which a task makes keys.
EACH = 1 << 16
#: Shingles hashed at once.
STEP = 1 << 20

_bit_of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.append(0, ends[:-1] + 1)[:n].tolist()
    last = ends[min(WORDS, len(words)) - 1 :].tolist()
    counts = np.zeros((8, 256), np.int64)
    for k in range(0, n, STEP):
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(first[k : k + STEP], last[k : k + STEP], strict=True)), np.uint64, min(STEP, n - k))
        lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _bit_of_byte) > n).astype(np.uint8).ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the fingerprint as a long."""

    def make():
        def work(texts: pa.Array) -> dict[str, object]:
            return {"v": np.array([fingerprint(t) for t in strings_of(texts.cast(pa.binary()))], np.uint64).view(np.int64)}

        return work

    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return add_columns(given, "text", ["doc_id"], T.StructType([T.StructField("v", T.LongType())]), make)


def remainder(x: np.ndarray) -> np.ndarray:
    """Words of ``LENGTH`` bits modulo the generator: their syndromes."""
    x = x.copy()
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        x ^= np.where(x >> k & 1, GENERATOR << (k - CHECKS), 0)
    return x


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the patterns of up to ``RADIUS`` errors that explain it (padded by the first), and how many."""
    bits = 1 << np.arange(LENGTH)
    words, last = [np.zeros(1, np.int64)], [np.full(1, -1)]
    for _ in range(RADIUS):
        i, j = np.nonzero(last[-1][:, None] < np.arange(LENGTH)[None])
        words.append(words[-1][i] | bits[j])
        last.append(j)
    words = np.concatenate(words)
    of = remainder(words)
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=1 << CHECKS)
    first = np.cumsum(count) - count
    slot = np.minimum(np.arange(count.max())[None], count[:, None] - 1)
    return words[order][first[:, None] + slot], count


class Keys:
    """Keys of fingerprints, such that two within ``DISTANCE`` share one."""

    def __init__(self):
        self.patterns, self.count = error_patterns()

    def indices(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords within ``RADIUS`` of each word, and which of the columns count."""
        s = remainder(x)
        return (x[:, None] ^ self.patterns[s]) >> CHECKS, np.arange(self.patterns.shape[1])[None] < self.count[s][:, None]

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the row each belongs to."""
        x = v.view(np.uint64)
        parts = [(x >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        near = [self.indices(p) for p in parts]
        info = LENGTH - CHECKS
        keys, rows = [], []
        kind = 0
        for i in range(3):
            for j in range(3):
                if i != j:
                    code, good = near[j]
                    r, c = np.nonzero(good)
                    keys.append(kind << 48 | parts[i][r] << info | code[r, c])
                    rows.append(r)
                    kind += 1
        (code, good), (other, fine) = near[:2]
        both = good[:, :, None] & fine[:, None, :]
        r, c, d = np.nonzero(both)
        keys.append(kind << 48 | code[r, c] << info | other[r, d])
        rows.append(r)
        return np.concatenate(keys), np.concatenate(rows)


def within(t: pa.Table, at: np.ndarray) -> np.ndarray:
    """For each row the first row of its group that it is connected with."""
    v = t.column("v").to_numpy().view(np.uint64)
    size = np.diff(at)
    ends = np.repeat(at[1:], size)
    small = np.repeat(size <= SMALL, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.flatnonzero(small)
    for d in range(1, SMALL):
        rows = rows[rows + d < ends[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(v[rows] ^ v[rows + d]) <= DISTANCE]
        a.append(near)
        b.append(near + d)
    label = settle(len(v), np.concatenate(a), np.concatenate(b))
    for x, y in ((at[i], at[i + 1]) for i in np.flatnonzero(size > SMALL).tolist()):
        rest = np.arange(x, y)
        while len(rest):
            seed, queue, rest = rest[0], [rest[0]], rest[1:]
            while queue and len(rest):
                near = np.bitwise_count(v[rest] ^ v[queue.pop()]) <= DISTANCE
                label[rest[near]] = seed
                queue += rest[near].tolist()
                rest = rest[~near]
    return label


def cross(own: pa.Table, there: pa.Table) -> np.ndarray:
    x, y = (t.column("v").to_numpy().view(np.uint64) for t in (own, there))
    return np.bitwise_count(x[:, None] ^ y[None]) <= DISTANCE


def links_of(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``v`` within ``DISTANCE`` of each other."""

    def keyed(batches):
        keys = Keys()
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                v = batch.column("v").slice(k, 4096).to_numpy()
                key, row = keys.of(v)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(v[row])], names=["key", "v"])

    def link(batches):
        for t in groups(batches, ["key"]):
            yield linked_batch(t.column("v").to_numpy(), within(t, starts_of(t, ["key"])))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(link, LINK)

    def large(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > dense).select("key"))

    # A fingerprint gives some 60 keys, so a task gets few of them.
    parts = max(1, -(-distinct.count() // EACH))
    rows = distinct.select("v").repartition(parts).mapInArrow(keyed, "key bigint, v bigint")
    hot = large(rows)
    if hot.isEmpty():
        return materialize(met(rows).distinct())
    piece = lambda a, n: F.shiftrightunsigned("v", a).bitwiseAND(F.lit((1 << n) - 1))
    pieces = F.array(*(F.xxhash64("key", F.lit(k), piece(a, n)) for k, (a, n) in enumerate(PIECES)))
    cut = materialize(rows.join(hot, "key").select(F.explode(pieces).alias("key"), "v"))
    still = large(cut)
    links = met(rows.join(hot, "key", "left_anti")).union(met(cut.join(still, "key", "left_anti")))
    if not still.isEmpty():
        links = links.union(region_links(cut.join(still, "key").withColumn("o", F.col("v")), dense, within, cross))
    return materialize(links.distinct())


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = materialize(fingerprints(docs, doc_id, text))
    classes = materialize(rows.groupBy("v").agg(F.min("doc_id").alias("rep")))
    found = components(links_of(classes, dense))
    labelled = classes.join(found, "v", "left").select("v", "rep", F.coalesce("label", "v").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "label").select("v", "component_id")
    return rows.join(named, "v").select("doc_id", F.lpad(F.lower(F.hex("v")), 16, "0").alias("fingerprint"), "component_id")
