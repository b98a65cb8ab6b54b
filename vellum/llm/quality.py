"""Quality score by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by its words and pairs of neighbouring words, hashed
into ``BUCKETS`` signed sums, and by means of word figures (shares of letters, digits, symbols, capitals, sentence ends, repeated
words), and encoded by a tanh layer. Gated attention weighs the encoded passages, and a logistic unit scores the weighted mean. All
weights are learned from document labels alone.

Trained on all passages of at most ``TRAIN_DOCS`` labelled documents, which are gathered as vectors. Every text is scored whole: null and empty texts are one passage
without words. Without training labels the score is 0.5. Several labels of one document count as their largest; null labels are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.shared import add_columns, bounded_sample, held_out, mix, split_words, sums, without, word_hashes

TRAIN_DOCS = 6000
PASSAGE = 64
HIDDEN, GATE = 24, 16
THRESHOLD = 0.7
WORD_FIGURES = 15
BUCKET_BITS = 6
BUCKETS = 1 << BUCKET_BITS
#: What a passage is described by: figures of its words, its size, whether it is empty, and hashed words and pairs.
FEATURES = WORD_FIGURES + 2 + BUCKETS


def word_figures(vocab: pa.Array) -> np.ndarray:
    """Figures of each distinct word."""
    n = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.float32)
    left = lambda pattern: pc.utf8_length(pc.replace_substring_regex(vocab, pattern, "")).to_numpy(zero_copy_only=False).astype(np.float32)
    letters, digits, capitals, plain = left(r"\P{L}+"), left(r"\D+"), left(r"\P{Lu}+"), left(r"[\p{L}\p{N}.,;:!?'\"()-]+")
    marks = n - letters - digits
    has = lambda pattern: pc.match_substring_regex(vocab, pattern).to_numpy(zero_copy_only=False).astype(np.float32)
    size = np.maximum(n, 1)
    return np.stack(
        [np.log1p(n), letters / size, digits / size, marks / size, capitals / size, plain / size, letters == 0, n > 12, n == 1, has(r"^\p{Lu}"), has(r"[.!?]$"), has(r"[,;:]$"), marks >= 2],
        axis=1,
    ).astype(np.float32)


def hashed(words: np.ndarray, same_text: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
    """Signed sums of hashed words and of pairs with the word before (``same_text``: it is of the same text), per passage."""
    pairs = mix(words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1])[same_text[1:]]
    keys, of = np.concatenate([words, pairs]), np.concatenate([passage, passage[1:][same_text[1:]]])
    bucket = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    sign = 1.0 - 2.0 * (keys & np.uint64(1)).astype(np.float64)
    return np.bincount(of * BUCKETS + bucket, sign, count * BUCKETS).reshape(count, BUCKETS)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and where each text's begin; a text without words has one of zeros."""
    codes, vocab, at = split_words(texts)
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    of_doc = np.repeat(np.arange(len(count)), count)
    begins = at[of_doc] + (np.arange(first[-1]) - first[of_doc]) * PASSAGE
    edges = np.append(begins, at[-1])
    words = np.diff(edges)[:, None]
    figures = word_figures(vocab)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    again, same, inner = np.ones(len(codes), bool), np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    again[np.unique(doc * max(1, len(vocab)) + codes, return_index=True)[1]] = False
    inner[1:] = doc[1:] == doc[:-1]
    same[1:] = (codes[1:] == codes[:-1]) & inner[1:]
    rows = np.concatenate([figures[codes], again[:, None], same[:, None]], axis=1).astype(np.float32)
    mean = sums(rows, edges) / np.maximum(1, words)
    lexical = hashed(word_hashes(pc.utf8_lower(vocab))[codes], inner, np.repeat(np.arange(len(begins)), words[:, 0]), len(begins))
    return np.concatenate([mean, np.minimum(1, words / PASSAGE), words == 0, lexical / np.sqrt(np.maximum(1, words))], axis=1).astype(np.float32), first


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    raw = np.clip((v * u) @ w["a"], -30, 30)
    e = np.exp(raw)
    a = e / np.repeat(sums(e, at), np.diff(at))
    bag = sums(a[:, None] * h, at)
    return 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out_b"][0], -30, 30))), (h, v, u, a, bag)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of whole bags."""
    p, (h, v, u, a, bag) = forward(w, x, at)
    of = np.repeat(np.arange(len(y)), np.diff(at))
    d = (p - y) / len(y)
    g = {"out": bag.T @ d, "out_b": np.array([d.sum()])}
    d_bag = d[:, None] * w["out"]
    d_a = (d_bag[of] * h).sum(axis=1)
    d_raw = a * (d_a - sums(a * d_a, at)[of])
    d_vu = d_raw[:, None] * w["a"]
    g["a"] = (v * u).T @ d_raw
    d_v, d_u = d_vu * u * (1 - v * v), d_vu * v * u * (1 - u)
    g["v"], g["u"] = h.T @ d_v, h.T @ d_u
    d_h = (a[:, None] * d_bag[of] + d_v @ w["v"].T + d_u @ w["u"].T) * (1 - h * h)
    g["enc"], g["enc_b"] = x.T @ d_h, d_h.sum(axis=0)
    return g


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam on the logistic loss of whole bags."""
    center, scale = x.mean(axis=0, dtype=np.float64).astype(np.float32), x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
    x = np.clip((x - center) / scale, -8, 8)
    rng = np.random.default_rng(7)
    shape = {"enc": (x.shape[1], HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    w |= {"enc_b": np.zeros(HIDDEN), "a": rng.normal(0, 0.1, GATE), "out": rng.normal(0, 0.1, HIDDEN), "out_b": np.zeros(1)}
    w = {k: p.astype(np.float32) for k, p in w.items()}
    m, s = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, steps + 1):
        g = gradients(w, x, at, y)
        for k in w:
            grad = g[k] + decay * w[k]
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * s[k] + 0.001 * grad * grad
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(center, scale, w)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out quarter, chosen by hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)).groupBy("doc_id").agg(F.max(label).cast("double").alias("__label"))
    chosen = bounded_sample(known, "doc_id", most).join(known, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> Model | None:
    new = T.StructType([T.StructField("x", T.BinaryType())])

    def make():
        def work(texts: pa.Array) -> dict[str, object]:
            x, at = passages(texts)
            return {"x": pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())}

        return work

    found = add_columns(labelled(docs, labels, label, most), "text", ["__label"], new, make).toArrow()
    if not found.num_rows:
        return None
    rows = sorted(zip(found.column("x").to_pylist(), found.column("__label").to_pylist(), strict=True))  # the same model however the rows arrive
    del found
    at = np.concatenate([[0], np.cumsum([len(x) // (4 * FEATURES) for x, _ in rows])])
    y = np.array([label for _, label in rows])
    x = np.frombuffer(b"".join([x for x, _ in rows]), "<f4").reshape(-1, FEATURES)
    del rows
    return fit(x, at, y)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score_col``; a column of that name is replaced."""
    keep = docs.columns if keep is None else keep
    if model is None:
        return without(docs.select(*keep), [score_col]).withColumn(score_col, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array) -> dict[str, object]:
            x, at = passages(texts)
            return {score_col: forward(model.weights, np.clip((x - model.center) / model.scale, -8, 8), at)[0]}

        return work

    return add_columns(docs, text, keep, T.StructType([T.StructField(score_col, T.DoubleType())]), make)


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract query."""
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    names = docs.columns
    scored = score(docs, train(training, labels), score_col="__quality")
    return scored.filter(F.col("__quality") >= threshold).select(*names)
