"""Corpus operators against plain versions, on small tables with nulls, empty texts, ties and clashing names."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import bpe, chat, exact, fingerprint, langid, lines, neardup, packing, quality, regions, toxicity
from vellum.llm.shared import bounded_sample, held_out, split_words

SCHEMA = "doc_id bigint, text string, lang string, source string, score string"
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "one two", "One  two", "a\n b", "a \nb  c", "x" * 3000, "don't STOP, now.%%% <|endoftext|> é́ 　z", "日本語 text\x1c\x85 end ", "a b c d e f g h", "A b c d e f g h"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(len(ODD), 160):
        body = rng.choices(words, k=rng.randint(5, 120))
        if i % 4 == 0:
            body = (rows[-1][1] or "").split(" ") or body
            for _ in range(rng.randint(0, 3)):
                body[rng.randrange(len(body))] = rng.choice(words)
        rows.append((i, " ".join(body)))
    rows += [(None, "no id here at all you see"), (5, "One  two"), (20, rows[20][1])]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 3}", "mine") for i, t in rows], SCHEMA)


def known(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_bpe_equals_tiktoken(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t in known(docs):
        ids = own.encode_ordinary(t)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    found = [tuple(r) for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_bpe_appends_and_edits():
    b, rng = bpe.PrefixBpe(bpe.read_ranks(RANKS)), random.Random(5)
    for _ in range(60):
        piece = "".join(rng.choices("abethinor ", k=rng.randint(1, 300))).encode()
        last = b.last_tokens(piece)
        assert b.append(piece, last, b"tion")[1] == b.last_tokens(piece + b"tion")
        at = rng.randrange(len(piece))
        gone = rng.randint(0, min(4, len(piece) - at))
        whole, new = b.edit(piece, last, at, gone, b"en")
        assert new == b.last_tokens(whole)


def test_packing_covers_every_token(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORDS, size=64).toPandas()
    texts = dict(known(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    for i, p in pieces.groupby("doc_id"):
        ids, at = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in p.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(pieces.doc_id) == set(texts)
    for _, p in pieces.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert (p.offset == p.length.cumsum() - p.length).all() and p.length.sum() <= 64


def test_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(50):
        cuts = np.cumsum([rng.randint(1, 6) for _ in range(9)])
        costs = np.array([float(rng.randint(0, 5)) for _ in cuts])
        price = dict(zip(cuts.tolist(), costs.tolist(), strict=True))

        def total(ends):
            return sum(10 - (b - a) + price[b] for a, b in itertools.pairwise([0, *ends]))

        options = [[*c, int(cuts[-1])] for k in range(9) for c in itertools.combinations(cuts[:-1].tolist(), k)]
        options = [o for o in options if all(b - a <= 10 for a, b in itertools.pairwise([0, *o]))]
        assert total(packing.plan_cuts(cuts, costs, 10)) == min(map(total, options))


def test_exact(docs):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in known(docs)]
    for r in exact.deduplicate(docs).collect():
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        ids = [i for i in same if i is not None]
        assert r["group_size"] == len(same) and r["keep_id"] == (min(ids) if ids else None) and r["kept"] == (bool(ids) and r["doc_id"] == min(ids))


def test_near_duplicates(docs):
    rows = [(i, t) for i, t in known(docs) if i is not None]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in range(12):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    found = neardup.find(docs).collect()
    assert len(found) == len(known(docs))
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]])


def test_chunked_clusters_keep_every_link(spark, monkeypatch, docs):
    whole = {(r["doc_id"], r["component_id"]) for r in neardup.find(docs).collect()}
    monkeypatch.setattr(neardup, "CHUNK_DOCS", 2)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.find(docs).collect()} == whole


@pytest.mark.parametrize("dense", [None, 16])
def test_large_regions_lose_no_candidate(spark, monkeypatch, dense):
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 256, (700, neardup.COMPONENTS), dtype=np.uint8)
    for i in range(350):  # a pair far apart in most orders: 80 components, anywhere
        same = rng.permutation(neardup.COMPONENTS)[:80]
        sig[350 + i, same] = sig[i, same]
    sig[600:] = sig[0]  # and a group that the region's largest component comes from
    rows = [(i, 100, bytes(r)) for i, r in enumerate(sig)]
    label = np.arange(700)
    same = np.array([(sig == r).sum(axis=1) >= neardup.AGREE for r in sig])
    for _ in range(5):
        label = np.array([label[s].min() for s in same])
    wanted = {i: label[i] for i in range(700) if same[i].sum() > 1}
    if dense:
        monkeypatch.setattr(regions, "ASKED", 3 * dense)
    reps = spark.createDataFrame(rows, "v bigint, n bigint, sig binary")
    region = reps.select(F.lit(7).cast("bigint").alias("key"), "v", F.xxhash64("sig").alias("o"))
    found = regions.components(regions.region_links(region, dense or neardup.DENSE, neardup.within, neardup.cross, lambda df: df.join(reps, "v")))
    assert {r["v"]: r["label"] for r in found.collect()} == wanted


def test_regions_of_unlike_texts_are_cut_deeper(spark, monkeypatch):
    """All signatures share the first components of every tree's region, so depth must tell them apart; pairs agree in 100 of 128 components."""
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 256, (900, neardup.COMPONENTS), dtype=np.uint8)
    for i in range(300):
        same = rng.permutation(neardup.COMPONENTS)[:100]
        sig[600 + i, same] = sig[i, same]
    monkeypatch.setattr(neardup, "DENSE", 64)
    met = []
    links = regions.region_links
    monkeypatch.setattr(neardup, "region_links", lambda rows, *a, **k: met.append(rows) or links(rows, *a, **k))
    rows = [(i, 100, list(range(neardup.TREES)), bytes(r)) for i, r in enumerate(sig)]
    found = neardup.forest(spark.createDataFrame(rows, "rep bigint, n bigint, keys array<bigint>, sig binary"))
    assert {r["v"]: r["label"] for r in found.collect()} == {k: i for i in range(300) for k in (i, 600 + i)}
    assert len(met) == 2


def test_chat(spark):
    turns = [(1, 0, "user", "hi <|im_end|>\n<\\|x"), (1, 1, "user", None), (1, 2, "assistant", "<|im_turn|> \\ <"), (2, 0, None, ""), (None, 0, "a\nb", "x"), (1, 3, "assistant", "|end")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_conversations(df)
    found = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for c in (1, 2, None):
        wanted = [(r or "", t or "") for i, _, r, t in sorted((x for x in turns if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in found[c]["turns"]] == wanted
        text, at, masked = found[c]["formatted"], 0, ""
        for loss, n in found[c]["loss_runs"]:
            masked += text[at : at + n] if loss else ""
            at += n
        assert at == len(text) and re.sub(r"<\\(\\*)\|", r"<\1|", masked) == "".join(t for r, t in wanted if r == "assistant")
    assert "<|im_turn|>" in found[1]["formatted"]


def test_lines(spark):
    common = "this line is everywhere, really"
    rows = [(i, f"own line number {i} of the lot\n{common}\nshort", f"s{i % 12}") for i in range(24)] + [(99, None, "s1"), (98, "", None), (97, common, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, n_removed string")
    found = {r["doc_id"]: r for r in lines.remove(df).collect()}
    assert len(found) == len(rows) and found[0]["text"] == rows[0][1] and found[97]["text"] == "" and found[99]["text"] is None
    assert all(found[i]["text"] == f"own line number {i} of the lot\nshort" and found[i]["n_removed"] == 1 for i in range(1, 24))
    assert {r["n_removed"] for r in lines.remove(df, sites=13).collect()} == {0}


def test_fingerprints(docs):
    rows = sorted(known(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()

    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(t)
        a, b = shingles(t), shingles(edited)
        assert abs(found[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.3


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 5, 10):
        s, t = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {}
        for tags in itertools.product((0, 1), repeat=n):
            weight[tags] = np.exp(sum(s[k] * y for k, y in enumerate(tags)) + sum(t[a, b] for a, b in itertools.pairwise(tags)))
        total = sum(weight.values())
        wanted = [sum(w for y, w in weight.items() if y[k]) / total for k in range(n)]
        old, toxicity.BLOCK = toxicity.BLOCK, 3
        # The first token's step leaves an even start; its transition weights are taken out by comparing with that start.
        p, _ = toxicity.marginals(s, np.array([0, n]), t)
        toxicity.BLOCK = old
        q, _ = toxicity.marginals(s, np.array([0, n]), t)
        assert np.allclose(p, q)
        if n > 1 or np.allclose(t[:, 0], t[:, 1]):
            start = {y: w * (np.exp(t[0, y[0]]) + np.exp(t[1, y[0]])) for y, w in weight.items()}
            wanted = [sum(w for y, w in start.items() if y[k]) / sum(start.values()) for k in range(n)]
            assert np.allclose(p, wanted)


def test_classifiers_take_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)] + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for found in (quality.quality_of(docs, labels), toxicity.toxicity_of(docs, labels)):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(docs, quality.train(docs, labels)).columns == ["doc_id", "text", "lang", "source", "score"]
    assert quality.quality_of(docs.limit(0), labels).count() == 0 and toxicity.toxicity_of(docs, labels.limit(0)).count() == docs.count()
    assert neardup.find(docs.limit(0)).count() == 0 and exact.deduplicate(docs.limit(0)).count() == 0 and fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_samples_fill_their_bound(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    count = lambda *a: [r["doc_id"] for r in bounded_sample(df, "doc_id", *a).select("doc_id").collect()]
    for rows, size in ((count(3000), 3000), (count(5000), 3000), (count(1234), 1234), (count(400, "g"), 1200), (count(2000, "g"), 3000)):
        assert len(rows) == len(set(rows)) == size
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    texts = df.select("doc_id", F.lit("x").alias("text"))
    assert quality.labelled(texts, labels, "quality", quality.TRAIN_DOCS).count() == labels.filter(~held_out("doc_id", 4, 2)).count()


def test_toxicity_learns_in_slices_as_whole(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90)) + ["Vile!"] * (i % 5 == 0))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    whole = toxicity.train(docs, labels)
    assert whole.weights["vile"] > 1 and set(whole.weights) <= {*words, "vile"}
    monkeypatch.setattr(toxicity, "SLICE_TOKENS", 64)
    parts = toxicity.train(docs, labels)
    assert set(parts.weights) == set(whole.weights) and all(abs(parts.weights[w] - v) < 1e-6 for w, v in whole.weights.items())


def test_language(spark):
    rows = [(i, "the cat and the other thing with them", "en") if i % 2 else (i, "der hund und die katze nicht mit ihnen", "de") for i in range(60)] + [(200, None, "en"), (201, "12 34 !!", "de"), (202, "", None)]
    found = {r["doc_id"]: r for r in langid.languages_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60)) and all(found[i]["lang_pred"] == "und" for i in (200, 201, 202))


def test_split_words():
    texts = ["a  b\n", "", " 　x ", "\x0b\x1ca"]
    codes, vocab, at = split_words(pa.array(texts))
    words = [vocab[int(c)].as_py() for c in codes]
    assert [words[a:b] for a, b in itertools.pairwise(at.tolist())] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert F.lit(1) is not None
