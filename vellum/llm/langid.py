"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts up to ``ORDER`` bytes long counts which byte followed. The code length of a byte is that of
the longest context seen in training; where a context never saw the byte, its escape is paid and the next shorter context
is tried, down to a uniform code (method C: the escape counts as often as the context has distinct bytes). Contexts run through
the whole UTF-8 text as it is, over words, lines and marks, and begin anew with each text. A byte's code length
depends on it and the ``ORDER`` bytes before it only, so it is computed once per different window of bytes. Statistics are
frozen after training; the language with the shortest code wins.

Trained on at most ``PER_LANGUAGE`` whole documents a language; tasks count the windows. Null texts and texts without a letter give
``und`` and score 0, as does a model without training rows; ties go to the language first in order. Repeated rows are scored one by
one. A text of any length is scored in blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.shared import add_columns, bounded_sample, held_out, slices

PER_LANGUAGE = 400
ORDER = 5
BLOCK = 1 << 20
UNKNOWN = "und"
LENGTH_BITS = 8 * (ORDER + 1)


@dataclass
class Tree:
    """Contexts of one language: byte strings as sorted keys (length in the high bits, then the bytes)."""

    nodes: np.ndarray
    code: np.ndarray  # bits of a string's last byte after its others
    escape: np.ndarray  # bits of an escape from a string as context; 0 where it never was one
    unseen: float  # bits of a byte that no context saw: the escape from the empty one, and the uniform code


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts, and where each text's begin."""
    wide = texts.cast(pa.large_string())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def windows(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of bytes its start, and per byte the key of the window that ends with it: up to ``ORDER`` bytes before it, and itself."""
    for a in range(0, len(flat), BLOCK):
        b = min(a + BLOCK, len(flat))
        near = np.zeros(b - a + ORDER, np.int64)
        near[max(0, ORDER - a) :] = flat[max(0, a - ORDER) : b]
        value = near[ORDER:].copy()
        for k in range(1, ORDER + 1):
            value |= near[ORDER - k : len(near) - k] << 8 * k
        keys = value | (ORDER + 1) << LENGTH_BITS
        for k in range(1, ORDER + 1):  # the k-th byte of a text has k bytes to its window
            place = at[:-1] + k - 1
            place = place[(place < at[1:]) & (place >= a) & (place < b)] - a
            keys[place] = suffix(value[place] | k << LENGTH_BITS, k)
        yield a, keys


def suffix(keys: np.ndarray, k: int) -> np.ndarray:
    """Key of the last k bytes of each string; 0 where it is shorter."""
    return np.where(keys >> LENGTH_BITS >= k, keys & ((1 << 8 * k) - 1) | k << LENGTH_BITS, 0)


def parent(keys: np.ndarray) -> np.ndarray:
    """Key of each string without its last byte; 0 for single bytes."""
    n = keys >> LENGTH_BITS
    return np.where(n > 1, (keys & ((1 << LENGTH_BITS) - 1)) >> 8 | (n - 1) << LENGTH_BITS, 0)


def grow(keys: np.ndarray, counts: np.ndarray) -> Tree:
    """The tree of one language from its windows and how often each was seen."""
    nodes, total = [], []
    for k in range(1, ORDER + 2):
        own, place = np.unique(suffix(keys, k), return_inverse=True)
        n = np.bincount(place, counts, len(own))
        nodes.append(own[own > 0])
        total.append(n[own > 0])
    nodes, total = np.concatenate(nodes), np.concatenate(total)
    place = np.searchsorted(nodes, parent(nodes))
    place[parent(nodes) == 0] = len(nodes)  # the empty context
    seen, kinds = np.bincount(place, total, len(nodes) + 1), np.bincount(place, minlength=len(nodes) + 1)
    code = -np.log2(total / (seen + kinds)[place])
    escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(1, seen + kinds)), 0)
    return Tree(nodes, code.astype(np.float32), escape[:-1].astype(np.float32), 8 + float(escape[-1]))


def lookup(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the tree, -1 where they are not."""
    place = np.minimum(np.searchsorted(tree.nodes, keys), len(tree.nodes) - 1)
    return np.where(tree.nodes[place] == keys, place, -1)


def code_lengths(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each window."""
    bits, left = np.zeros(len(keys), np.float32), np.arange(len(keys))
    for k in range(ORDER + 1, 0, -1):
        long = np.flatnonzero(keys[left] >> LENGTH_BITS >= k)
        own = suffix(keys[left[long]], k)
        place = lookup(tree, own)
        hit = place >= 0
        bits[left[long[hit]]] += tree.code[place[hit]]
        if k > 1:
            context = lookup(tree, parent(own[~hit]))
            bits[left[long[~hit]]] += np.where(context >= 0, tree.escape[context], 0)
        left = np.delete(left, long[hit])
    bits[left] += tree.unseen
    return bits


class Lengths:
    """Code lengths of windows in every language; each window's are kept at a place that its hash names, until another takes it over."""

    CACHE_BITS = 18

    def __init__(self, model: Model):
        self.trees = model.trees
        self.keys = np.full(1 << self.CACHE_BITS, -1, np.int64)
        self.bits = np.zeros((1 << self.CACHE_BITS, len(model.trees)), np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.CACHE_BITS)).view(np.int64)
        new = np.flatnonzero(self.keys[place] != keys)
        out = self.bits[place]
        if len(new):
            out[new] = np.stack([code_lengths(t, keys[new]) for t in self.trees], axis=1)
            self.bits[place[new]], self.keys[place[new]] = out[new], keys[new]
            # Of several new windows with one place, the bits of the last one stay, as its key does.
        return out

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text in each language."""
        flat, at = text_bytes(texts)
        total = np.zeros((len(texts), len(self.trees)))
        for a, keys in windows(flat, at):
            coded = pa.array(keys).dictionary_encode()
            bits, which = self.of(coded.dictionary.to_numpy()), coded.indices.to_numpy()
            first, last = np.searchsorted(at[1:], a, side="right"), np.searchsorted(at[:-1], a + len(keys), side="left")
            begin = np.maximum(at[first:last] - a, 0)
            full = np.flatnonzero(at[first + 1 : last + 1] - a > begin)
            for c in range(len(self.trees)):
                total[first + full, c] += np.add.reduceat(bits[:, c].astype(np.float64)[which], begin[full])
        return total


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` with a language: at most ``per_language`` documents of each, chosen by hash of the id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    chosen = bounded_sample(rows.select("id", "lang"), "id", per_language, "lang")
    sample = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        for b in slices(batches, "text"):
            for lang in pc.unique(b.column("lang")):
                for _, keys in windows(*text_bytes(b.column("text").filter(pc.equal(b.column("lang"), lang)))):
                    found = pa.array(keys).value_counts()
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), found.field("values"), found.field("counts")], names=["lang", "window", "n"])

    counted = sample.mapInArrow(count, "lang string, window bigint, n bigint").groupBy("lang", "window").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(pc.unique(counted.column("lang")).to_pylist())
    trees = []
    for language in languages:
        own = counted.filter(pc.equal(counted.column("lang"), language))
        trees.append(grow(own.column("window").to_numpy(), own.column("n").to_numpy()))
    return Model(languages, trees)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` with lang_pred and score: the winner's share of probability under the code lengths."""
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        lengths = Lengths(model)

        def work(texts: pa.Array) -> dict[str, object]:
            if not model.languages:
                return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": np.zeros(len(texts))}
            bits = lengths.sums(texts)
            best = bits.argmin(axis=1)
            gap = np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            return {"lang_pred": pa.array(np.where(letters, np.array(model.languages, object)[best], UNKNOWN), pa.string()), "score": np.where(letters, 1 / np.exp2(-gap).sum(axis=1), 0.0)}

        return work

    return add_columns(docs, text, [doc_id], new, make)


def languages_of(docs: DataFrame) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 5 is not 0, predict everywhere."""
    model = train(docs.filter(~held_out("doc_id", 5, 0)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
