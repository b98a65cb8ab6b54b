"""Packing: cut the token stream of each partition into windows at document or sentence ends.

Order-preserving dynamic programming: over the possible cuts ``c`` in stream order,
``cost(c) = min over b in [c - size, c) of cost(b) + padding(size - (c - b)) + penalty(c)``, where ends of documents cost
nothing, ends of sentences a little and other places more. The minimum slides with ``c``, so a monotone queue gives each
transition in constant time. Documents stay in the order in which the table stores them; no shuffle is needed.

Null text is an empty document: its stream is the end id alone. Repeated ids are packed row by row. Very long documents are
cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import CodeTable, kept_by_worker, ragged, slices, split_words, strings_of

SIZE = 4096
END_ID = 2
SENTENCE_COST, INNER_COST = 4.0, 12.0
#: Within a sentence a cut is possible every so many tokens.
INNER_STEP = 32
#: Marks at the end of a word that are encoded by themselves; a word with more is encoded whole.
MARKS = 8
#: Tokens that a task gathers before it solves and writes them; the last window is carried on.
BUFFER = 1_500_000
#: How the files split texts into words that encode alone. Fixed values.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def plan_cuts(cuts: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Cheapest ends of windows: ``cuts`` are ascending stream positions after 0, the last is the end of the stream.

    Neighbouring cuts must lie at most ``size`` apart.
    """
    place = [0, *cuts.tolist()]
    # With key(c) = cost(c) + c, a window from b to c adds size + penalty(c) to key(b), so the least key in reach is wanted.
    added, key, source = (size + costs).tolist(), [0.0] * len(place), [0] * len(place)
    queue, head = [0], 0  # places of ascending keys; those before ``head`` are out of reach
    for j, (at, more) in enumerate(zip(place[1:], added, strict=True), 1):
        while place[queue[head]] < at - size:
            head += 1
        source[j] = i = queue[head]
        key[j] = own = key[i] + more
        while key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    ends, j = [], len(place) - 1
    while j:
        ends.append(place[j])
        j = source[j]
    return ends[::-1]


def halves(length: int) -> list[int]:
    """Lengths that are powers of two and need no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def fill_gaps(cuts: np.ndarray, costs: np.ndarray, step: int = INNER_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Add cuts inside long sentences."""
    gaps = np.diff(cuts, prepend=0)
    extra = np.maximum(0, (gaps - 1) // step)
    if not extra.any():
        return cuts, costs
    inner = np.repeat(cuts - gaps, extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    place = np.concatenate([cuts, inner])
    order = np.argsort(place, kind="stable")
    return place[order], np.concatenate([costs, np.full(len(inner), INNER_COST)])[order]


class Stream:
    """Tokens of consecutive documents that are not written yet."""

    def __init__(self, first_sequence: int, size: int = SIZE):
        self.size, self.sequence = size, first_sequence
        self.tokens = np.zeros(0, np.uint32)
        self.cuts, self.costs = np.zeros(0, np.int64), np.zeros(0)
        self.doc_ids, self.doc_starts, self.doc_lengths = [np.zeros(0, np.int64) for _ in range(3)]
        self.doc_nulls = np.zeros(0, bool)

    def add(self, tokens, doc_ids, nulls, doc_lengths, cuts, costs) -> None:
        base = len(self.tokens)
        self.doc_starts = np.concatenate([self.doc_starts, base + np.cumsum(doc_lengths) - doc_lengths])
        self.doc_ids, self.doc_lengths = np.concatenate([self.doc_ids, doc_ids]), np.concatenate([self.doc_lengths, doc_lengths])
        self.doc_nulls = np.concatenate([self.doc_nulls, nulls])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.cuts, self.costs = np.concatenate([self.cuts, base + cuts]), np.concatenate([self.costs, costs])

    def write(self, last: bool) -> pa.RecordBatch | None:
        if not len(self.tokens):
            return None
        ends = plan_cuts(*fill_gaps(self.cuts, self.costs), self.size)
        if not last:
            ends = ends[:-1]
            if not ends:
                return None
        else:
            rest = ends[-1] - (ends[-2] if len(ends) > 1 else 0)
            pieces = halves(rest)
            if (len(pieces) - 1) * INNER_COST < self.size - rest:
                ends[-1:] = (ends[-1] - rest + np.cumsum(pieces)).tolist()
        done = ends[-1]
        ends = np.array(ends, np.int64)
        docs_to = self.doc_starts + self.doc_lengths
        bounds = np.union1d(np.union1d(ends, docs_to[docs_to <= done]), [0])
        a, b = bounds[:-1], bounds[1:]
        doc, window = np.searchsorted(docs_to, a, side="right"), np.searchsorted(ends, a, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        raw = self.tokens.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [pa.array(self.doc_ids[doc], mask=self.doc_nulls[doc]), pa.array(a - self.doc_starts[doc]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(self.doc_lengths[doc]), pa.array(self.sequence + window), pa.array(a - begins[window])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(ends)
        open_docs = docs_to > done
        self.doc_ids, self.doc_starts, self.doc_lengths, self.doc_nulls = self.doc_ids[open_docs], self.doc_starts[open_docs] - done, self.doc_lengths[open_docs], self.doc_nulls[open_docs]
        self.tokens = self.tokens[done:]
        later = self.cuts > done
        self.cuts, self.costs = self.cuts[later] - done, self.costs[later]
        return out


class ChunkEncoder:
    """Ids of whitespace-separated chunks by the vocabulary file.

    If the file normalises and splits by ``BY_WORDS``, white space is dropped and its pieces never join a letter or digit with
    a mark, so chunks encode alone, and so do the marks at their ends. Plain words are encoded many at a time and told apart
    by their last tokens; lower-case Latin words are their own normal form. For other files ``by_words`` is false and only
    ``whole`` may be used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.latin = Tokenizer.from_file(path), Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = {k: steps[k] for k in BY_WORDS} == BY_WORDS and steps["model"].get("end_of_word_suffix") == "</w>"
        self.latin.normalizer = None
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.table = CodeTable(self.encode)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, flats, order, left = np.zeros(len(chunks), np.int64), [], [], []
        given = pa.array(chunks, pa.string())
        latin = pc.match_substring_regex(given, r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$").to_numpy(zero_copy_only=False)
        plain = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        left += np.flatnonzero(~plain).tolist()
        for tokenizer, words in ((self.latin, np.flatnonzero(latin)), (self.tokenizer, np.flatnonzero(plain & ~latin))):
            for k in range(0, len(words), 512):
                part = words[k : k + 512]
                ids = np.array(tokenizer.encode_batch_fast([" ".join([chunks[i] for i in part.tolist()])], add_special_tokens=False)[0].ids, np.int64)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part) and (not len(cuts) or cuts[-1] == len(ids)):
                    lengths[part] = np.diff(cuts, prepend=0)
                    flats.append(ids)
                    order.append(part)
                else:
                    left += part.tolist()
        for k in range(0, len(left), 4096):
            part = left[k : k + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)]
            lengths[part] = [len(x) for x in found]
            flats.append(np.array([i for x in found for i in x], np.int64))
            order.append(np.array(part))
        if not flats:
            return np.zeros(0, np.int64), lengths
        order = np.concatenate(order)
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return ragged(np.concatenate(flats), starts, lengths), lengths

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole texts, how many each has, and whether a sentence ends at each id, for files that do not go by words."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ends = [b > a and t[b - 1] in ".!?" for t, e in zip(texts, found, strict=True) for a, b in e.offsets]
        return np.array([i for e in found for i in e.ids], np.uint32), np.array([len(e.ids) for e in found], np.int64), np.array(ends, bool)

    def of(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks of ``vocab``, one after the other, with starts and lengths."""
        low = pc.if_else(pc.match_substring(vocab, "<|"), vocab, pc.ascii_lower(vocab))
        low = pc.if_else(pc.match_substring_regex(low, r"^[a-z.,;:!?\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"), pc.utf8_lower(low), low)
        core = pc.ascii_rtrim(low, ".,;:!?")
        core = pc.if_else(pc.less_equal(pc.subtract(pc.binary_length(low), pc.binary_length(core)), MARKS), core, low)
        cut = pc.match_substring_regex(core, r"[\p{L}\p{N}]$")
        core = pc.if_else(cut, core, low)
        cores = core.dictionary_encode()
        marks, mark = self.tails(low, core)
        starts, lengths = self.table.lookup(strings_of(cores.dictionary) + marks)
        at = np.stack([cores.indices.to_numpy(), len(cores.dictionary) + mark], axis=1).ravel()
        n = lengths[at].reshape(-1, 2).sum(axis=1)
        return ragged(self.table.ids, starts[at], lengths[at]), np.cumsum(n) - n, n

    @staticmethod
    def tails(low: pa.Array, core: pa.Array) -> tuple[list[str], np.ndarray]:
        """What ``core`` leaves of ``low``, at most ``MARKS`` ASCII marks: the different ones, and which each has."""
        size = pc.subtract(pc.binary_length(low), pc.binary_length(core)).to_numpy().astype(np.int64)
        ends = np.cumsum(pc.binary_length(low).to_numpy(), dtype=np.int64)
        raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low), "")[0].as_buffer(), np.uint8)
        code = np.zeros(len(low), np.uint64)
        for k in range(MARKS):
            has = np.flatnonzero(size > k)
            code[has] |= raw[ends[has] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        found, which = np.unique(code, return_inverse=True)
        return [int(c).to_bytes(MARKS, "big").lstrip(b"\0").decode() for c in found], which


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: its place in its sequence of at most ``size`` tokens."""
    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        encoder = kept_by_worker(("packing", vocabulary), lambda: ChunkEncoder(vocabulary))
        stream = Stream(TaskContext.get().partitionId() << 33, size)
        for b in slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            if encoder.by_words:
                codes, vocab, at = split_words(texts)
                flat, starts, lengths = encoder.of(vocab)
                ends_sentence = (pc.match_substring_regex(vocab, r"[.!?]$").to_numpy(zero_copy_only=False) & (lengths > 0))[codes]
                n = lengths[codes]
                flat = ragged(flat, starts[codes], n)
            else:
                flat, lengths, ends_sentence = encoder.whole(strings_of(texts))
                n, at = np.ones(len(flat), np.int64), np.concatenate([[0], np.cumsum(lengths)])
            after = np.concatenate([[0], np.cumsum(n)])
            doc_lengths = after[at[1:]] - after[at[:-1]] + 1
            doc_ends = np.cumsum(doc_lengths)
            tokens = np.full(int(doc_ends[-1]), end_id, np.uint32)
            inner = np.ones(len(tokens), bool)
            inner[doc_ends - 1] = False
            tokens[inner] = flat
            sentence = np.flatnonzero(ends_sentence)
            of = np.searchsorted(at[1:], sentence, side="right")
            place = after[sentence + 1] + of
            place = place[place < doc_ends[of] - 1]
            cuts = np.concatenate([place, doc_ends])
            costs = np.concatenate([np.full(len(place), SENTENCE_COST), np.zeros(len(doc_ends))])
            order = np.argsort(cuts, kind="stable")
            ids = b.column("doc_id")
            stream.add(tokens, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False), doc_lengths, cuts[order], costs[order])
            if len(stream.tokens) >= BUFFER and (out := stream.write(False)):
                yield out
        if out := stream.write(True):
            yield out

    return given.mapInArrow(run, SCHEMA)
