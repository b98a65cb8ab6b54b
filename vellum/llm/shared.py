"""Helpers shared by the corpus operators: intermediate tables, Arrow batches, word dictionaries.

The array helpers run inside Spark tasks on one bounded slice of a partition at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a task handles at once; a single longer text is handled alone.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/vellum-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage, column pruning, survives lost executors.

    The folder stays until ``discard`` or whoever owns ``spark.checkpoint.dir`` clears it, as results are computed from it later.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def held_out(doc_id: str, modulus: int, remainder: int):
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare case-insensitively, as Spark's do)."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores added where ``df`` has one already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def add_columns(
    df: DataFrame, text: str, keep: list[str], new: T.StructType, make: Callable[[], Callable[[pa.Array], dict[str, object]]]
) -> DataFrame:
    """``df[keep]`` plus columns that ``make()(texts)`` computes from slices of ``text`` (nulls arrive as empty strings).

    ``make`` runs once per task, so that models and caches are built there.
    """
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in new}]
    given = df.select([F.col(f"`{c}`") for c in keep] + [F.col(f"`{text}`").cast("string").alias("__text")])
    names = [f.name for f in new]

    def run(batches):
        work = make()
        for b in slices(batches, "__text"):
            out = work(pc.fill_null(b.column("__text"), ""))
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names)], names=[*keep, *names])

    schema = T.StructType([*given.schema.fields[:-1], *new.fields])
    return given.mapInArrow(run, schema)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, their vocabulary, and where each text's codes begin."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes, at = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        full = codes != empty
        at = np.concatenate([[0], np.cumsum(full)])[at]
        codes = codes[full]
    return codes, coded.dictionary, at


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, 0 of the empty one."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in strings_of(words)), np.uint64, len(words))


def strings_of(values: pa.Array) -> list:
    """``values.to_pylist()`` of strings or binaries, in a tenth of the time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s:s+n]`` for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty spans give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros((len(values) + 1, *values.shape[1:]), kind)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


_kept: dict[tuple, object] = {}


def kept_by_worker(key: tuple, build: Callable[[], object]) -> object:
    """``build()``, kept for later tasks of the same Python worker, until an operator with another ``key[0]`` keeps something."""
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = build()
    return _kept[key]


class CodeTable:
    """Id sequences of strings, encoded once and then looked up. ``encode`` gives the ids of all strings and how many each has.

    When it would hold more than ``limit`` strings, only those of the present lookup stay, to bound memory. At most ``step``
    strings are encoded at a time, as an encoder may need much room for each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 250_000, step: int = 65536):
        self.encode, self.limit, self.step = encode, limit, step
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lookup(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in ``self.ids``, valid until the next lookup."""
        index = self.index
        at = np.fromiter(map(index.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(at < 0)
        if len(new):
            if index and len(index) + len(new) > self.limit:
                stay, first, place = np.unique(at[at >= 0], return_index=True, return_inverse=True)
                known = np.flatnonzero(at >= 0)
                self.ids, self.lengths = ragged(self.ids, self.starts[stay], self.lengths[stay]), self.lengths[stay]
                self.index = index = {strings[i]: k for k, i in enumerate(known[first].tolist())}
                at[known] = place
            wanted = [strings[i] for i in new.tolist()]
            missing = list(dict.fromkeys(wanted))
            flats, sizes = [self.ids], [self.lengths]
            for i in range(0, len(missing), self.step):
                ids, n = self.encode(missing[i : i + self.step])
                sizes.append(n.astype(np.int32))
                flats.append(ids.astype(np.uint32))
            self.ids, self.lengths = np.concatenate(flats), np.concatenate(sizes)
            self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
            index.update(zip(missing, range(len(index), len(index) + len(missing)), strict=True))
            at[new] = np.fromiter(map(index.__getitem__, wanted), np.int64, len(wanted))
        return self.starts[at], self.lengths[at].astype(np.int64)


def bounded_sample(df: DataFrame, key: str, per_group: int, group: str | None = None, buckets: int = 4096) -> DataFrame:
    """``per_group`` values of ``key`` (per value of ``group``), spread by hash; all of them where there are no more. Keys must be distinct.

    Whole hash buckets up to the bound, and of the bucket that crosses it as many as still fit.
    """
    by = ["__bucket", *([group] if group else [])]
    rows = df.select(key, *([group] if group else []), F.pmod(F.xxhash64(F.lit(12), F.col(key)), F.lit(buckets)).alias("__bucket"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*([group] if group else [])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = sizes.select(*by, (F.lit(per_group) - (F.sum("__n").over(order) - F.col("__n"))).alias("__room")).filter("__room > 0")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(11), F.col(key)), key))
    taken = rows.join(F.broadcast(room), by).withColumn("__place", place).filter("__place <= __room")
    return taken.select(key, *([group] if group else []))
