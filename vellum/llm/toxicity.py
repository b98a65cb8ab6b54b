"""Toxic spans by a linear-chain conditional random field.

Words are tagged clean or toxic. Features of a token are its word (lower case, without marks at its ends), the beginnings of the
word of ``BEGINNINGS`` characters, written with a star, and a bias; neighbouring tags interact by transition weights. Training tokens
are labelled from document labels: in toxic documents, words with a feature that toxic documents use far more often than others
are toxic; every other token is clean. Forward-backward gives each token's marginal; a document's score is a logistic function
of the expected number of toxic tokens and its length, and its spans are runs of tokens that are toxic more likely than not.

Trained on at most ``TRAIN_DOCS`` labelled documents, as hashes of their words, which tasks compute, and a list of the different words.
Every text is scored whole; null and empty texts have no tokens.
Without training labels every token is clean and the score 0. Several labels of one document count as their largest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.quality import labelled
from vellum.llm.shared import add_columns, held_out, materialize, slices, split_words, sums, without, word_hashes

TRAIN_DOCS = 8000
#: Words with a feature of their own have been in so many training documents at least; toxic ones have this log odds ratio.
LEAST_DOCS, LEAST_ODDS = 3, 2.5
#: Lengths of the beginnings of words that are features; a word has those that are shorter than it is.
BEGINNINGS = (5, 6, 7)
BLOCK = 64
#: Tokens whose marginals training computes at once; a longer document is handled alone.
SLICE_TOKENS = 400_000
THRESHOLD = 0.3
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def bare(vocab: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


@dataclass
class Model:
    weights: dict[str, float]  # of known words and beginnings; what they add to the toxic tag's score
    bias: float
    transitions: np.ndarray  # by tag before and tag
    document: np.ndarray  # weights of what ``describe`` says about a document


def features_of(words: pa.Array) -> list[pa.Array]:
    """The features of each word, null where it has none: itself, and its beginnings."""
    size = pc.utf8_length(words)
    cut = lambda n: pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", "")
    return [pc.if_else(pc.greater(size, 0), words, None), *(pc.if_else(pc.greater(size, n), cut(n), None) for n in BEGINNINGS)]


def marginals(scores: np.ndarray, at: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token and the expected transitions, by tag before and tag.

    ``scores`` favour the toxic tag. Sequences are cut into blocks; products of the 2 x 2 step matrices within blocks run over
    all blocks at once, and only the blocks' products are chained, so the result is exact for any length.
    """
    n = np.diff(at)
    blocks = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total, grid = int(first[-1]), np.exp(transitions)
    pairs = np.zeros((2, 2))
    if not total:
        return np.zeros(0), pairs
    of = np.repeat(np.arange(len(n)), blocks)
    begin = at[of] + (np.arange(total) - first[of]) * BLOCK
    size = np.minimum(BLOCK, at[of + 1] - begin)
    e = np.ones((BLOCK, total))
    place = np.arange(BLOCK)[:, None]
    here = place < size
    e[here] = np.exp(np.clip(scores, -30, 30))[(begin + place)[here]]

    def step(row, emission):  # row vectors times the transition, then the emission
        out = np.stack([row[0] * grid[0, 0] + row[1] * grid[1, 0], (row[0] * grid[0, 1] + row[1] * grid[1, 1]) * emission])
        return out / out.sum(axis=0)

    # Product of each block's steps, row by row; rows are scaled apart, with their scales kept.
    rows, scale = [np.stack([np.ones(total), np.zeros(total)]), np.stack([np.zeros(total), np.ones(total)])], np.zeros((2, total))
    for t in range(BLOCK):
        for r in range(2):
            x, y = rows[r]
            new = np.stack([x * grid[0, 0] + y * grid[1, 0], (x * grid[0, 1] + y * grid[1, 1]) * e[t]])
            norm = new.sum(axis=0)
            rows[r] = np.where(here[t], new / norm, rows[r])
            scale[r] += np.where(here[t], np.log(norm), 0)
    weight = np.exp(scale - scale.max(axis=0))
    product = np.stack([rows[0] * weight[0], rows[1] * weight[1]])  # tag before the block, tag at its end, block
    enter, leave = np.full((2, total), 0.5), np.full((2, total), 0.5)
    # Chain the blocks: all sequences step together, the k-th step over those that have k blocks.
    longest = int(blocks.max())
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, longest):
        now = first[order[: np.searchsorted(-blocks[order], -k, side="left")]] + k
        v = np.einsum("ib,ijb->jb", enter[:, now - 1], product[:, :, now - 1])
        enter[:, now] = v / v.sum(axis=0)
        now = first[order[: np.searchsorted(-blocks[order], -k, side="left")] + 1] - 1 - k
        v = np.einsum("ijb,jb->ib", product[:, :, now + 1], leave[:, now + 1])
        leave[:, now] = v / v.sum(axis=0)
    forward = np.empty((BLOCK, 2, total))
    state = enter
    for t in range(BLOCK):
        state = np.where(here[t], step(state, e[t]), state)
        forward[t] = state
    p = np.empty((BLOCK, total))
    back = leave
    for t in range(BLOCK - 1, -1, -1):
        joint = forward[t] * back
        p[t] = joint[1] / joint.sum(axis=0)
        before = forward[t - 1] if t else enter
        ahead = np.stack([back[0], back[1] * e[t]])
        both = before[:, None] * grid[:, :, None] * ahead[None]
        pairs += (both / both.sum(axis=(0, 1)) * here[t]).sum(axis=2)
        new = np.stack([grid[0, 0] * ahead[0] + grid[0, 1] * ahead[1], grid[1, 0] * ahead[0] + grid[1, 1] * ahead[1]])
        back = np.where(here[t], new / new.sum(axis=0), back)
    out = np.empty(int(at[-1]))
    out[(begin + place)[here]] = p[here]
    return out, pairs


def marginals_in_slices(scores: np.ndarray, at: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` of a slice of the sequences at a time, to bound memory."""
    p, pairs, i = np.empty(int(at[-1])), np.zeros((2, 2)), 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_TOKENS, side="right")) - 1)
        p[at[i] : at[j]], some = marginals(scores[at[i] : at[j]], at[i : j + 1] - at[i], transitions)
        pairs += some
        i = j
    return p, pairs


def describe(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per document, from its tokens' marginals: the expected number of toxic tokens and the number of tokens, both as logarithms, and 1."""
    return np.stack([np.log1p(20 * sums(p, at)), np.log1p(np.diff(at)), np.ones(len(at) - 1)], axis=1)


def fit(codes: np.ndarray, at: np.ndarray, words: pa.Array, toxic: np.ndarray, steps: int = 60) -> Model | None:
    """From word codes of documents, the words and the documents' labels."""
    if not len(toxic):
        return None
    found = pa.chunked_array(features_of(words)).combine_chunks().dictionary_encode()
    names, none = found.dictionary, len(found.dictionary)
    has = pc.fill_null(found.indices, none).to_numpy(zero_copy_only=False).reshape(-1, len(words))  # features of each word
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(at))
    pair = np.unique(doc * np.int64(max(1, len(words))) + codes)
    word, owner = pair % max(1, len(words)), pair // max(1, len(words))
    del pair
    bad, good = np.zeros(none + 1), np.zeros(none + 1)
    for k, own in enumerate(has):  # documents that have each feature
        both = np.unique(owner * np.int64(none + 1) + own[word]) if k else owner * np.int64(none + 1) + own[word]
        feature, doc_of = both % (none + 1), both // (none + 1)
        bad += np.bincount(feature, toxic[doc_of], none + 1)
        good += np.bincount(feature, 1 - toxic[doc_of], none + 1)
    del word, owner, both, feature, doc_of
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    own = bad + good >= LEAST_DOCS
    own[none] = False
    lexicon = own & (bad >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (bad * bad >= bad + 4 * good * bad)
    # Features that few toxic documents have can reach the odds by chance: ask for more than chance gives among so many.
    lexicon &= bad * np.log1p((1 - toxic).sum() / max(1.0, toxic.sum())) > np.log(max(2, own.sum())) + 3 + good
    tag = lexicon[has].any(axis=0)[codes] & (toxic[doc] > 0)
    del doc
    has = np.where(own[has], has, none)
    weights, bias, transitions = np.zeros(none + 1), -3.0, np.zeros((2, 2))
    tags = tag.astype(np.int8)
    inner = np.ones(len(codes), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    seen_pairs = np.bincount((2 * tags[:-1] + tags[1:])[inner[1:]], minlength=4).reshape(2, 2).astype(float)

    def by_feature(values: np.ndarray | None) -> np.ndarray:
        per_word = np.bincount(codes, values, len(words))
        return sum(np.bincount(f, per_word, none + 1) for f in has)

    seen, uses = by_feature(tag), by_feature(None)
    for _ in range(steps):
        p, pairs = marginals_in_slices((weights[has].sum(axis=0) + bias)[codes], at, transitions)
        # Quasi-Newton: each weight moves by its gradient over its own curvature, with a Gaussian prior; the features of a word share the way.
        slack = by_feature(p * (1 - p))
        weights += np.clip((seen - by_feature(p) - 0.02 * weights) / (slack + 0.02 + 1e-3 * uses), -1, 1) / len(has)
        weights[-1] = 0
        bias += float(np.clip((tag.sum() - p.sum()) / ((p * (1 - p)).sum() + 1), -0.5, 0.5))
        transitions += np.clip((seen_pairs - pairs - transitions) / (np.minimum(seen_pairs, pairs) + 50), -0.2, 0.2)
    p, _ = marginals_in_slices((weights[has].sum(axis=0) + bias)[codes], at, transitions)
    x, w = describe(p, at), np.array([1.0, 0.0, -1.0])
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(curve, x.T @ (toxic - q)), -1, 1)
    kept = np.flatnonzero(own[:-1] & (np.abs(weights[:-1]) > 1e-3))
    return Model(dict(zip(names.take(pa.array(kept)).to_pylist(), weights[kept].tolist(), strict=True)), bias, transitions, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_DOCS) -> Model | None:
    texts = materialize(labelled(docs, labels, label, most))  # bounded by ``most`` documents

    def make():
        def work(texts: pa.Array) -> dict[str, object]:
            codes, vocab, at = split_words(texts)
            hashes = word_hashes(bare(vocab)).view(np.int64)[codes]
            return {"words": pa.array([hashes[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())}

        return work

    found = add_columns(texts, "text", ["__label"], T.StructType([T.StructField("words", T.BinaryType())]), make).toArrow()
    if not found.num_rows:
        return None
    # The same model however the rows arrive; long texts share slices.
    rows = sorted(zip(found.column("words").to_pylist(), found.column("__label").to_pylist(), strict=True), key=lambda r: (len(r[0]), *r))
    del found
    at, toxic = np.concatenate([[0], np.cumsum([len(w) // 8 for w, _ in rows])]), np.array([y for _, y in rows], float)
    hashes = np.frombuffer(b"".join([w for w, _ in rows]), np.int64)
    del rows

    def name(batches):
        for b in slices(batches, "text"):
            words = pc.unique(bare(split_words(b.column("text"))[1]))
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), words], names=["hash", "word"])

    named = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(name, "hash bigint, word string").distinct().toArrow().combine_chunks()
    named = named.take(pc.sort_indices(named, sort_keys=[("hash", "ascending"), ("word", "ascending")]))
    vocab, codes = np.unique(hashes, return_inverse=True)
    del hashes
    words = named.column("word").combine_chunks().take(pa.array(np.searchsorted(named.column("hash").to_numpy(), vocab)))
    return fit(codes.astype(np.int32), at, words, toxic)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text", score_col: str = "score", spans_col: str | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score and, if named, the offending spans in code points."""
    keep = docs.columns if keep is None else keep
    new = T.StructType([T.StructField(score_col, T.DoubleType()), *([T.StructField(spans_col, SPANS)] if spans_col else [])])
    if model is None:
        bare_docs = without(docs.select(*keep), [f.name for f in new])
        return bare_docs.select("*", F.lit(0.0).alias(score_col), *([F.array().cast(SPANS).alias(spans_col)] if spans_col else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        known, weights = pa.array(list(model.weights), pa.string()), np.append(np.fromiter(model.weights.values(), float), 0.0)

        def work(texts: pa.Array) -> dict[str, object]:
            codes, vocab, at = split_words(texts)
            total = sum(weights[pc.fill_null(pc.index_in(f, known), len(known)).to_numpy(zero_copy_only=False)] for f in features_of(bare(vocab)))
            p, _ = marginals(total[codes] + model.bias, at, model.transitions) if len(codes) else (np.zeros(0), None)
            out = {score_col: 1 / (1 + np.exp(-np.clip(describe(p, at) @ model.document, -30, 30)))}
            if spans_col:
                spans: list[list[dict]] = [[] for _ in range(len(texts))]
                for i in np.unique(np.searchsorted(at[1:], np.flatnonzero(p > 0.5), side="right")).tolist():
                    found, last = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i].as_py())], -2
                    for k in np.flatnonzero(p[at[i] : at[i + 1]] > 0.5).tolist():
                        if k == last + 1:
                            spans[i][-1] |= {"end": found[k][1], "score": max(spans[i][-1]["score"], float(p[at[i] + k]))}
                        else:
                            spans[i].append({"start": found[k][0], "end": found[k][1], "score": float(p[at[i] + k])})
                        last = k
                out[spans_col] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            return out

        return work

    return add_columns(docs, text, keep, new, make)


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract query."""
    scored = score(docs, train(docs, labels), ["doc_id"], spans_col="spans")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with their columns."""
    names = docs.columns
    scored = score(docs, train(training, labels), score_col="__toxic")
    return scored.filter(F.col("__toxic") < threshold).select(*names)
