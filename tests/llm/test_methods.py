"""The dealt methods against plain versions: merging rounds, byte contexts, gradients, densification, templates, stages."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import bpe, chat, exact, fingerprint, langid, lines, neardup, packing, quality, toxicity

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, low=False):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t) if low and t else t)
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(sets):
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


# Exact


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_binomial_rounds_merge_all_runs(spark, parts):
    rows = [(i if i % 13 else None, f"t{i % 7} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    want = defaultdict(list)
    for i, t in rows:
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    found = exact.deduplicate(df).collect()
    assert len(found) == 300
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in found:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(i for i in ids if i is not None)


def test_a_round_takes_partners_only(spark):
    rows = [(run, "k", 1, 1, 100 - run, 2) for run in range(8)]
    df = spark.createDataFrame(rows, "run int, text_sha256 string, n_chars int, check bigint, keep_id bigint, group_size bigint")
    once = {r["run"]: (r["keep_id"], r["group_size"]) for r in exact.meet(df, 1).collect()}
    assert once == {0: (99, 4), 2: (97, 4), 4: (95, 4), 6: (93, 4)}
    last = exact.meet(exact.meet(exact.meet(df, 1), 2), 4).collect()
    assert [(r["run"], r["keep_id"], r["group_size"]) for r in last] == [(0, 93, 16)]


# Language


def plain_bits(texts, text, order=langid.ORDER):
    """Method C by dictionaries, byte after byte."""
    after = defaultdict(lambda: defaultdict(int))
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(i, order) + 1):
                after[b[i - k : i]][b[i]] += 1
    total, b = 0.0, text.encode()
    for i in range(len(b)):
        for k in range(min(i, order), -1, -1):
            seen = after.get(b[i - k : i])
            if seen is None:
                continue
            n = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / n)
                break
            total -= math.log2(len(seen) / n)
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_plain_partial_matching(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choices("abc dé\n", k=rng.randint(0, 60))), "xy"[i % 2]) for i in range(40)]
    model = langid.train(spark.createDataFrame(texts, "doc_id bigint, text string, lang string"))
    asked = ["", "abc", "zzz q", "a b c d é\n" * 9, "日本語", *[t for _, t, _ in texts[:5]]]
    monkeypatch.setattr(langid, "BLOCK", 7)
    bits = langid.Lengths(model).sums(pa.array(asked))
    for i, t in enumerate(asked):
        for c, language in enumerate(model.languages):
            assert bits[i, c] == pytest.approx(plain_bits([x for _, x, g in texts if g == language], t), abs=1e-3)


def test_training_reads_texts_without_blanks_whole(spark):
    rows = [(1, "x" * 500 + "qqqqqq", "a"), (2, "y" * 500, "b")]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    bits = langid.Lengths(model).sums(pa.array(["qqqqqq"]))[0]
    assert bits[0] < bits[1]


# Quality


def test_quality_gradients_and_forward():
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    w = {"enc": rng.normal(size=(5, 4)), "enc_b": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "out": rng.normal(size=4), "out_b": rng.normal(size=1)}

    def plain(w):
        out = []
        for a, b in itertools.pairwise(at):
            h = np.tanh(x[a:b] @ w["enc"] + w["enc_b"])
            e = np.exp((np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-h @ w["u"])))) @ w["a"])
            out.append(1 / (1 + np.exp(-((e / e.sum()) @ h @ w["out"] + w["out_b"][0]))))
        return np.array(out)

    assert np.allclose(quality.forward(w, x, at)[0], plain(w))
    loss = lambda w: -(y * np.log(plain(w)) + (1 - y) * np.log(1 - plain(w))).mean()
    for k, g in quality.gradients(w, x, at, y).items():
        for place in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            assert g[place] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_every_passage_is_encoded():
    texts = ["a b c d " * 400, "", "One two"]
    x, at = quality.passages(pa.array(texts))
    assert at.tolist() == [0, 25, 26, 27] and x.shape == (27, quality.FEATURES)
    got, words = x[26, -quality.BUCKETS :], ["one", "two"]
    want = np.zeros(quality.BUCKETS)
    h = [xxhash.xxh64_intdigest(w) for w in words]
    pair = int(quality.mix(np.array([(h[1] * 0x9E3779B97F4A7C15 + h[0]) % 2**64], np.uint64))[0])
    for key in [*h, pair]:
        want[key >> (64 - quality.BUCKET_BITS)] += 1 - 2 * (key & 1)
    assert np.allclose(got, want / np.sqrt(2))


# Near duplicates


def test_templates_do_not_bring_documents_together(spark, monkeypatch):
    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    template, rows = fresh(80), []
    for i in range(60):
        own = fresh(22)
        rows.append((2 * i, " ".join(template + own)))
        rows.append((2 * i + 1, " ".join(template + own[:18] + fresh(4)) if i % 3 else " ".join(template + fresh(20))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components({i: shingles(t, True) for i, t in rows})
    assert len(set(want.values())) < 120
    monkeypatch.setattr(neardup, "CHUNK_DOCS", 16)
    clusters = spark.createDataFrame([(i, len(shingles(t)), 0) for i, t in rows], "rep bigint, n bigint, cluster bigint")
    sizes = [r["count"] for r in neardup.split_large(clusters, df).groupBy("cluster").count().collect()]
    assert sizes and max(sizes) <= 3
    assert {r["doc_id"]: r["component_id"] for r in neardup.find(df).collect()} == want


def test_links_survive_the_split(spark, monkeypatch):
    rng, rows = random.Random(9), []
    base = [str(rng.random()) for _ in range(60)]
    for i in range(70):  # sizes and overlaps around the threshold
        body = base[: rng.randint(40, 60)]
        for _ in range(rng.randint(0, 2)):
            body[rng.randrange(len(body))] = str(rng.random())
        rows.append((i, " ".join(body)))
    monkeypatch.setattr(neardup, "CHUNK_DOCS", 8)
    found = {r["doc_id"]: r["component_id"] for r in neardup.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == brute_components({i: shingles(t, True) for i, t in rows})


# Fingerprints


def plain_fingerprint(text):
    w = words_of(text)
    if not w:
        return "0" * fingerprint.BINS
    grams = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else None
    least = {}

    def add(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        j, x = h >> 56, h >> 8 & fingerprint.EMPTY
        least[j] = min(least.get(j, x), x)

    for g in grams if grams is not None else [w]:
        add(g if grams is not None else [f"{w[0]}"] if len(w) == 1 else w)
    out = []
    for j in range(fingerprint.BINS):
        if j in least:
            x = least[j]
        else:
            x = next(least[p] for k in range(10_000) if (p := fingerprint.probe(j, k)) in least) if any(fingerprint.probe(j, k) in least for k in range(fingerprint.PROBES)) else next(least[(j + k) % fingerprint.BINS] for k in range(fingerprint.BINS) if (j + k) % fingerprint.BINS in least)
        out.append("0123456789abcdef"[x >> j % 10 * fingerprint.BITS & 15])
    return "".join(out)


def test_fingerprint_bits(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "cd", "é", "x1", "yy", "zz"], k=n)) for n in (5, 6, 30, 300, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fingerprint.with_fingerprint(df, F.col("text"), "fp").collect():
        assert r["fp"] == plain_fingerprint(r["text"])


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "q r s t u v"), (1, "q r s t u v"), (1, None), (2, "")]
    found = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in found)


# Odd rows


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert lines.remove(docs).count() == 0 and packing.pack(docs, WORDS).count() == 0
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN).count() == 0 and langid.languages_of(docs).count() == 0


def test_a_text_of_a_megabyte(spark):
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghijklmnoé", k=rng.randint(1, 9))) for _ in range(170_000)) + "\n"
    df = spark.createDataFrame([(1, text, "en", "s"), (2, text + "x", "en", "t"), (3, "short", "de", "t")], "doc_id bigint, text string, lang string, source string")
    ids = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert sum(r["length"] for r in packing.pack(df.filter("doc_id = 1"), WORDS).collect()) == len(ids) + 1
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    first = bpe.encode(df.filter("doc_id = 1"), RANKS, public_tokenizers.PATTERN).first()
    assert first["n_tokens"] == len(own.encode_ordinary(text)) and first["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["doc_id"]: r["component_id"] for r in neardup.find(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["group_size"] for r in exact.deduplicate(df).collect()} == {1: 1, 2: 1, 3: 1}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_of(df, labels).count() == toxicity.toxicity_of(df, labels).count() == 3
    assert langid.languages_of(df).count() == fingerprint.fingerprints(df).count() == lines.remove(df).count() == 3


def test_other_patterns_are_matched_whole(spark):
    import tiktoken

    pattern, text = r"[a-z ]{3}|.|\n", "ab cd ef  g\nh"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), RANKS, pattern, with_ids=True).first()
    assert row["ids"] == own.encode_ordinary(text)


def test_packing_takes_other_vocabularies_and_odd_ids(spark):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "One two. Three?"), (1, "a b"), (1, "a b"), (2, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), other).collect()
    t = Tokenizer.from_file(other)
    assert sorted(r["doc_tokens"] for r in found if r["start"] == 0) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)


def test_pairs_agree_with_merging():
    b, rng = bpe.PrefixBpe(bpe.read_ranks(RANKS)), random.Random(3)
    a, c = (np.array(rng.choices(range(len(b.bytes_of)), k=4000)) for _ in range(2))
    want = [b.merge(b.bytes_of[x] + b.bytes_of[y]) == [x, y] for x, y in zip(a.tolist(), c.tolist(), strict=True)]
    assert b.pairs.fit(a, c).tolist() == want == b.pairs.fit(a, c).tolist()


# The pipeline


def test_pipeline_stage_by_stage(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs, labels = read("documents"), read("labels")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality.quality_of(docs, labels).filter("predicted = 1"))
    clean = stages["toxicity"](spark, good, SF).cache()
    assert clean.columns == docs.columns and ids(clean) == ids(toxicity.toxicity_of(docs, labels).filter("predicted = 0").join(good, "doc_id", "left_semi"))
    thin = stages["lines"](spark, clean, SF).cache()
    own, spread, first = clean.collect(), defaultdict(set), {}
    for r in own:
        for x in (r["text"] or "").split("\n"):
            if len(x.strip(" ")) >= lines.LEAST_CHARS:
                spread[x.strip(" ")].add(r["source"])
                first[x.strip(" ")] = min(first.get(x.strip(" "), r["doc_id"]), r["doc_id"])
    want = {}
    for r in own:
        gone = lambda x: len(spread[x.strip(" ")] - {None}) >= lines.SITES and first[x.strip(" ")] != r["doc_id"]  # noqa: B023, E731
        want[r["doc_id"]] = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not gone(x))
    assert {r["doc_id"]: r["text"] for r in thin.collect()} == want
    kept = stages["near"](spark, thin, SF).cache()
    label = brute_components({i: shingles(t, True) for i, t in want.items()})
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i in label if label[i] == i)
    packed = stages["packing"](spark, kept, SF).toPandas()
    assert set(packed.doc_id) == set(ids(kept)) and packed.groupby("sequence_id").length.sum().max() <= packing.SIZE
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    ran = corpus_pipeline.run(spark, SF).toPandas()
    assert set(ran.doc_id) == set(packed.doc_id) and ran.length.sum() == packed.length.sum()
