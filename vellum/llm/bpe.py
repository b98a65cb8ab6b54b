"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid encoding, so it has exactly one valid last token. ``last[e]`` is the one
token ``b[s:e]`` that may follow ``last[s]``, where two tokens may stand together if merging their joined bytes gives them
back. Reading ``last`` from the end gives the encoding; appending bytes only adds entries, and an edit changes entries only
until the old ones are met again.

A null text is empty: no tokens, digest of no bytes. Repeated rows, ties and other columns do not matter: rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellum.llm.shared import CodeTable, add_columns, kept_by_worker, ragged, strings_of, sums

#: Patterns of which no match crosses the place before a space, unless the space follows other white space. Fixed values:
#: contractions, words, numbers and marks with one space before them at most, and runs of white space.
CUT_BEFORE_SPACES = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
}
#: White space by Unicode; after it no cut is made.
SPACE = r"[\x09-\x0D\x1c-\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Longer pieces are encoded one at a time.
TOGETHER_BYTES = 256
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """Whether two tokens may stand together, for arrays of pairs.

    Seen from the place where two tokens meet, merging builds each side up from its last or first byte: the tokens that touch
    the place are the right ends of ever larger parts of the one, and the left ends of the other. Going back through both in
    order of their ranks visits all neighbours that ever touched; the tokens may stand together if no such neighbours had a
    rank below that at which either of them was merged into its own side.
    """

    CACHE_BITS = 20

    def __init__(self, ranks: dict[bytes, int], left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        joined = [(a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        joined.sort()
        self.keys, self.merged = (np.array(x, np.int64) for x in (zip(*joined, strict=True) if joined else ([NEVER], [NEVER])))
        #: A pair and its answer in one number, at a place that the pair's hash names; a later pair takes the place over.
        self.known = np.full(1 << self.CACHE_BITS, -1, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        of, until_a, until_b = np.arange(len(a)), np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(of):
            r = self.rank(a, b)
            crossed = (r < until_a) & (r <= until_b)
            ok[of[crossed]] = False
            first = a > b  # the later of the two is taken apart
            whole = np.where(first, self.left[a], self.left[b]) < 0
            go = ~crossed & ~whole
            of, a, b, until_a, until_b, first = of[go], a[go], b[go], until_a[go], until_b[go], first[go]
            until_a, until_b = np.where(first, a, until_a), np.where(first, until_b, b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 21 | b) << 1
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.CACHE_BITS)).view(np.int64)
        seen = self.known[place]
        ok = (seen & 1).astype(bool)
        new = np.flatnonzero(seen & ~1 != key)
        if len(new):
            ok[new] = self.walk(a[new], b[new])
            self.known[place[new]] = key[new] | ok[new]
        return ok


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.length = np.array([len(b) for b in self.bytes_of])
        #: The two tokens that a token was merged from last; -1 for one byte, -2 for tokens that merging never makes.
        self.left, self.right = np.full(size, -2, np.int64), np.full(size, -2, np.int64)
        for b, r in ranks.items():
            parts = self.merge(b, 2) if len(b) > 1 else [-1, -1]
            if len(parts) == 2 and max(parts) < r:
                self.left[r], self.right[r] = parts
        singles = [r for b, r in ranks.items() if len(b) == 1]
        multiple = [r for b, r in ranks.items() if len(b) > 1]
        if len(singles) < 256 or (multiple and max(singles) > min(multiple)):
            raise ValueError("ranks must begin with the 256 bytes")
        self.pairs = Pairs(ranks, self.left, self.right)
        self.build_endings()

    def build_endings(self) -> None:
        """A tree over the reversed bytes of tokens: sorted keys (node, byte) and what they lead to, and the token at each node."""
        usable = [r for r in range(len(self.bytes_of)) if self.bytes_of[r] and self.left[r] != -2]
        flat, n = np.frombuffer(b"".join(self.bytes_of[r][::-1] for r in usable), np.uint8), self.length[usable]
        starts, usable = np.cumsum(n) - n, np.array(usable)
        node, keys, token = np.zeros(len(usable), np.int64), [], [np.array([-1])]
        for k in range(self.longest):
            has = np.flatnonzero(n > k)
            step, place = np.unique(node[has] << 8 | flat[starts[has] + k], return_inverse=True)
            before = sum(map(len, token))
            node[has] = before + place
            keys.append(step)
            token.append(np.full(len(step), -1))
            ends = has[n[has] == k + 1]
            token[-1][node[ends] - before] = usable[ends]
        #: Nodes are numbered level by level, and within a level by key; as parents are numbered before children, keys ascend.
        self.edges, self.token_at = np.concatenate(keys), np.concatenate(token)
        self.near = np.full(1 << 16, -1, np.int32)  # by the last two bytes, read backwards
        two = np.flatnonzero((self.edges >= 1 << 8) & (self.edges < 257 << 8))
        self.near[self.edges[two] - (1 << 8)] = two + 1

    def merge(self, piece: bytes, down_to: int = 1) -> list[int]:
        """Plain merging, until so many tokens are left."""
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        found = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while len(parts) > down_to and (rank := min(found)) != none:
            i = found.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], none)
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def candidates(self, flat: np.ndarray, start: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end right after each of ``positions`` of ``flat``, shortest first, and where each position's begin.

        ``start`` is where the piece of each position begins.
        """
        of, token = [np.arange(len(positions))], [self.token_at[1 + flat[positions].astype(np.int64)]]
        live = np.flatnonzero(positions > start)
        node = self.near[flat[positions[live]].astype(np.int32) << 8 | flat[positions[live] - 1]]
        k = 2
        while len(live):
            go = node >= 0
            live, node = live[go], node[go].astype(np.int64)
            found = self.token_at[node]
            real = found >= 0
            of.append(live[real])
            token.append(found[real])
            go = positions[live] - k >= start[live]
            live, node = live[go], node[go]
            key = node << 8 | flat[positions[live] - k]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            node = np.where(self.edges[place] == key, place + 1, -1)
            k += 1
        count = sum(np.bincount(x, minlength=len(positions)) for x in of)
        first = np.cumsum(count) - count
        out, filled = np.empty(int(count.sum()), np.int64), first.copy()
        for x, t in zip(of, token, strict=True):
            out[filled[x]] = t
            filled[x] += 1
        return out, first, count

    def last_tokens_of(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last token of every byte prefix of every piece ``flat[at[i]:at[i + 1]]``, all pieces a byte at a time."""
        n = np.diff(at)
        token, first, count = self.candidates(flat, np.repeat(at[:-1], n), np.arange(len(flat)))
        last = np.full(len(flat), -1, np.int64)
        order = np.argsort(-n, kind="stable")
        begin, sizes = at[:-1][order], -n[order]
        for e in range(int(n.max(initial=0))):
            base = begin[: np.searchsorted(sizes, -e, side="left")]
            place = base + e
            choice, lowest = first[place] + count[place] - 1, first[place]
            while len(place):
                t = token[choice]
                before = place - self.length[t]
                inner = before >= base
                ok = np.ones(len(place), bool)
                ok[inner] = self.pairs.fit(last[before[inner]], t[inner])
                last[place[ok]] = t[ok]
                more = ~ok & (choice > lowest)
                place, base, choice, lowest = place[more], base[more], choice[more] - 1, lowest[more]
        return last

    def last_tokens(self, piece: bytes) -> list[int]:
        return self.append(b"", [-1], piece)[1]

    def fill(self, piece: bytes, last: list[int], e: int) -> None:
        """Set ``last[e]``, given all entries before it. ``last[0]`` is -1."""
        window = np.frombuffer(piece[max(0, e - self.longest) : e], np.uint8)
        tokens = self.candidates(window, np.zeros(1, np.int64), np.array([len(window) - 1]))[0]
        before = np.array([last[e - n] for n in self.length[tokens].tolist()])
        ok = before < 0
        ok[~ok] = self.pairs.fit(before[~ok], tokens[~ok])
        last[e] = int(tokens[ok][-1])

    def read(self, last: list[int]) -> list[int]:
        ids, e = [], len(last) - 1
        while e:
            ids.append(last[e])
            e -= len(self.bytes_of[last[e]])
        return ids[::-1]

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The entries of ``piece + more``; those of ``piece`` stay as they are."""
        whole, last = piece + more, [*last, *[-1] * len(more)]
        flat, at = np.frombuffer(whole, np.uint8), np.arange(len(piece), len(whole))
        tokens, first, count = self.candidates(flat, np.zeros(len(at), np.int64), at)
        lengths = self.length[tokens].tolist()
        tokens, known, fit = tokens.tolist(), {}, self.pairs.fit
        for e, a, k in zip((at + 1).tolist(), first.tolist(), count.tolist(), strict=True):
            for c in range(a + k - 1, a - 1, -1):
                pair = (last[e - lengths[c]], tokens[c])
                if pair[0] >= 0 and pair not in known:
                    known[pair] = bool(fit(np.array(pair[:1]), np.array(pair[1:]))[0])
                if pair[0] < 0 or known[pair]:
                    last[e] = tokens[c]
                    break
        return whole, last

    def edit(self, piece: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int]]:
        """The entries after an edit: recomputed from it on until, for a longest token's length, they are the old ones again."""
        whole = piece[:at] + inserted + piece[at + removed :]
        shift, fresh, same = len(inserted) - removed, at + len(inserted), 0
        new = [*last[: at + 1], *[-1] * (len(whole) - at)]
        for e in range(at + 1, len(new)):
            self.fill(whole, new, e)
            same = same + 1 if e > fresh and new[e] == last[e - shift] else 0
            if same >= self.longest:
                new[e + 1 :] = last[e + 1 - shift :]
                break
        return whole, new

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        get = self.ranks.get
        whole = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = (whole >= 0).astype(np.int64)
        some = np.flatnonzero((whole < 0) & (size <= TOGETHER_BYTES))
        flat = np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)
        at = np.concatenate([[0], np.cumsum(size[some])])
        last = self.last_tokens_of(flat, at)
        # Read all pieces from their ends; ``depth`` tells a token's place from the end.
        place, of, found = at[1:][size[some] > 0] - 1, some[size[some] > 0], []
        begin = at[:-1][size[some] > 0]
        while len(place):
            t = last[place]
            found.append((of, t))
            place = place - self.length[t]
            go = place >= begin
            place, of, begin = place[go], of[go], begin[go]
        for i, _ in found:
            counts[i] += 1
        long = {i: self.read(self.last_tokens(pieces[i])) for i in np.flatnonzero((whole < 0) & (size > TOGETHER_BYTES)).tolist()}
        for i, ids in long.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[ends[whole >= 0] - 1] = whole[whole >= 0]
        for depth, (i, t) in enumerate(found):
            out[ends[i] - 1 - depth] = t
        for i, ids in long.items():
            out[ends[i] - len(ids) : ends[i]] = ids
        return out, counts


class Encoder:
    """Ids of text chunks: the pattern's matches, each encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe, self.find = PrefixBpe(ranks), regex.compile(pattern).findall

    def chunks(self, strings: list[str], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings and how many each has. ``joined``: each begins with its only space and may be matched beside others."""
        index: dict[str, int] = {}
        number = lambda found: [index.setdefault(p, len(index)) for p in found]
        if joined:
            found = self.find("".join(strings))
            codes, heads = number(found), np.fromiter((p[0] == " " for p in found), bool, len(found))
            pieces = np.diff(np.append(np.flatnonzero(heads), len(found)))
        else:
            lists = list(map(self.find, strings))
            codes, pieces = number([p for found in lists for p in found]), np.fromiter(map(len, lists), np.int64, len(lists))
        ids, n = self.bpe.encode([p.encode() for p in index])
        codes = np.array(codes, np.int64)
        own = n[codes]
        return ragged(ids, (np.cumsum(n) - n)[codes], own), sums(own, np.concatenate([[0], np.cumsum(pieces)]))

    def mixed(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any strings; those that may be matched beside others are."""
        easy = np.fromiter((s[0] == " " and len(s) > 1 and not s[-1].isspace() for s in strings), bool, len(strings))
        together, alone = self.chunks([strings[i] for i in np.flatnonzero(easy)], True), self.chunks([strings[i] for i in np.flatnonzero(~easy)])
        lengths = np.empty(len(strings), np.int64)
        lengths[easy], lengths[~easy] = together[1], alone[1]
        starts = np.empty(len(strings), np.int64)
        starts[easy], starts[~easy] = np.cumsum(together[1]) - together[1], len(together[0]) + np.cumsum(alone[1]) - alone[1]
        return ragged(np.concatenate([together[0], alone[0]]), starts, lengths), lengths


NEW = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of what they decode to, and on request the ids.

    For the patterns of ``CUT_BEFORE_SPACES``, chunks are cut before each space; no match crosses such a cut, unless the space
    follows other white space. Texts that have this, and all texts for other patterns, are matched as a whole.
    """

    def make():
        encoder = kept_by_worker(("bpe", ranks_path, pattern), lambda: Encoder(read_ranks(ranks_path), pattern))
        table = kept_by_worker(("bpe", ranks_path, pattern, "ids"), lambda: CodeTable(encoder.mixed))
        bytes_of = pa.array(encoder.bpe.bytes_of, pa.binary())

        def digests(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            raw, at = memoryview(values).cast("B"), [0, *(ends * values.itemsize).tolist()]
            return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())

        def work(texts: pa.Array) -> dict[str, object]:
            whole = pc.match_substring_regex(texts, SPACE + " ") if pattern in CUT_BEFORE_SPACES else pa.repeat(True, len(texts))
            lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
            coded, at = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
            first = at[:-1]
            heads = lists.flatten().take(pa.array(first)).dictionary_encode()
            vocab = [f" {w}" for w in strings_of(coded.dictionary)]
            head_words = strings_of(heads.dictionary)
            starts, lengths = table.lookup([*vocab, *(w or "\0" for w in head_words)])
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes[first] = len(vocab) + heads.indices.to_numpy(zero_copy_only=False)
            if "" in head_words:  # a text that is empty or begins with a space
                lengths[len(vocab) + head_words.index("")] = 0
            n = lengths[codes]
            ids, counts = ragged(table.ids, starts[codes], n), sums(n, at)
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            if len(rows):
                extra, extra_n = encoder.chunks([t or "" for t in texts.take(pa.array(rows)).to_pylist()])
                begins = np.cumsum(counts) - counts
                begins[rows], counts[rows] = len(ids) + np.cumsum(extra_n) - extra_n, extra_n
                ids = ragged(np.concatenate([ids, extra]), begins, counts)
            ends, ids = np.cumsum(counts), np.ascontiguousarray(ids, "<u4")
            decoded = bytes_of.take(pa.array(ids))
            bounds = decoded.offsets.to_numpy() if hasattr(decoded, "offsets") else np.frombuffer(decoded.buffers()[1], np.int32)[: len(ids) + 1]
            data = decoded.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None and len(ids) else np.zeros(0, np.uint8)
            result = {"n_tokens": counts, "ids_sha256": digests(ids, ends), "decoded_sha256": digests(raw, bounds[ends].astype(np.int64))}
            if with_ids:
                result["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            return result

        return work

    return add_columns(docs, text, [doc_id], T.StructType([*NEW.fields, *[IDS] * with_ids]), make)
