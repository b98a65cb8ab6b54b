"""SimHash, hard negatives and the Merkle manifest against plain versions, on small tables with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import merkle, negatives, regions, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, v string, idx string, tree string, n string, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine", "mine", "mine", "mine") for r in rows], DOCS).repartition(3)


def sample(n=220, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    odd = [None, "", " \n", "one", "one two three", "ONE  two\tthree", "a b c d", "A b C d", "é́ 　z  x\x1cy", "x y " * 4000]
    rows = [(i, t, None if i % 3 == 0 else "en", f"s{i}", None if i % 4 == 0 else i) for i, t in enumerate(odd)]
    while len(rows) < n:
        i = len(rows)
        body = rng.choices(words, k=rng.randint(3, 150))
        if i % 3 == 0 and len(rows) > 20:
            body = (rows[-1][1] or "a").split()
            for _ in range(rng.randint(0, 2)):
                body[rng.randrange(len(body))] = rng.choice(words)
        rows.append((i, " ".join(body), rng.choice(["en", "de", "", "ü", "fr"]) if i != 57 else "alone", None if i % 9 == 0 else "s", i * 7))
    return rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values, ids):
    """The smallest id that each place reaches by links of at most 4 bits."""
    seen, out = {}, [None] * len(values)
    for start in range(len(values)):
        if start in seen:
            continue
        group, queue = [start], [start]
        seen[start] = True
        while queue:
            x = queue.pop()
            for y in range(len(values)):
                if y not in seen and (values[x] ^ values[y]).bit_count() <= 4:
                    seen[y] = True
                    group.append(y)
                    queue.append(y)
        known = [ids[i] for i in group if ids[i] is not None]
        for i in group:
            out[i] = min(known, default=None)
    return out


def test_golay_keys_meet_within_four_bits():
    keys, rng = simhash.Keys(), random.Random(1)
    assert sorted(set(keys.count.tolist())) == [1, 6]
    values = [rng.getrandbits(64) for _ in range(600)]
    others = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for v in values]
    sets = []
    for side in (values, others):
        found = defaultdict(set)
        for k, r in zip(*(x.tolist() for x in keys.of(np.array(side, np.uint64).view(np.int64))), strict=True):
            found[r].add(k)
        sets.append(found)
    assert all(sets[0][i] & sets[1][i] for i in range(len(values)))


@pytest.mark.parametrize("dense", [3, simhash.DENSE])
def test_simhash_equals_brute_force(spark, dense):
    rows = sample()
    rows += [(None, rows[30][1], "en", "s", 1), (None, "nobody knows this text at all", "en", "s", 1), rows[40], rows[40], (7, "different under a known id", "en", "s", 1)]
    values = [plain_fingerprint(r[1]) for r in rows]
    wanted = [(r[0], f"{v:016x}", c) for r, v, c in zip(rows, values, plain_classes(values, [r[0] for r in rows]), strict=True)]
    found = [tuple(r) for r in simhash.find(documents(spark, rows), dense=dense).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_simhash_dense_families_keep_every_link(spark):
    """A large region of close fingerprints and chains that only one block sees."""
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)}
    chain = center
    for _ in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        values.add(chain)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.links_of(spark.createDataFrame([(v,) for v in signed], "v bigint"), dense=32)
    label = {r["v"]: r["label"] for r in simhash.components(links).collect()}
    wanted = plain_classes(values, list(range(len(values))))
    own = [label.get(v, v) for v in signed]
    assert len(set(zip(own, wanted, strict=True))) == len(set(own)) == len(set(wanted))


@pytest.mark.parametrize("held", [40, 1 << 20])
def test_components_in_parts(spark, monkeypatch, held):
    monkeypatch.setattr(regions, "LINKS", held)
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(250)] + [(7, 7), (2, 1), (2, 1)]
    label = {v: v for link in links for v in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = regions.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4)).collect()
    assert {r["v"]: r["label"] for r in found} == label and len(found) == len(label)


def test_empty_tables(spark):
    empty = documents(spark, []).filter("doc_id > 0")
    assert simhash.find(empty).count() == 0 and merkle.manifest(empty).count() == 0
    assert negatives.mine(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows, fanout):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    leaf = lambda r: H("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.COLUMNS))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def siblings(tree, i):
        out = []
        for level in tree[:-1]:
            s = i // fanout * fanout
            out.append(("".join(level[s:i]), "".join(level[i + 1 : s + fanout])))
            i //= fanout
        return out

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(dict(zip(names, r, strict=True)))
    order = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        by_lang[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in by_lang[g]]) for g in order}
    top, out = levels([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(by_lang[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            x = leaf(changed)
            for a, b in path:
                x = H(a + x + b)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return out


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_plain_trees(spark, fanout):
    rows = sample(70)
    rows += [rows[20], rows[20], (None, "no id", "en", "s", 3), (None, None, None, None, None), (21, "same id", rows[21][2], "s", 2)]
    found = [tuple(r) for r in merkle.manifest(documents(spark, rows), fanout=fanout).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows, fanout), key=str)
    assert {False, True} == {r[-1] for r in found}


def test_one_row_is_its_own_root(spark):
    (r,) = merkle.manifest(documents(spark, [(7, "text", None, None, None)])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H("") and r["verified"]


def test_residues_give_exact_products():
    rng = np.random.default_rng(3)
    for width, top in ((5, 3), (64, 140), (2500, 100_000), (8, 1_000_000_000), (3, 0)):
        a, b = (rng.integers(-top, top + 1, (7, width)) for _ in range(2))
        a[0] = top
        b[0] = -top
        primes = negatives.primes_for(width * top**2)
        found = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes)
        assert (found.astype(object) == a.astype(object) @ b.astype(object).T).all()
    with pytest.raises(ValueError):
        negatives.primes_for(1 << 63)


def plain_negatives(rows):
    taken = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            c = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
            taken[i, (label + 1) % 10 if i % 7 == 0 else label, c] = None
    taken, out = sorted(taken), set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in taken:
        if a[0] % 100 == 0:
            others = sorted(((-dot(a[2], r[2]), r) for r in taken if r != a))
            for s, p in [x for x in others if x[1][1] == a[1]][:5]:
                near = [x for x in others if x[1][1] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
                out.update((a[0], p[0], k, n[0], -s, -t) for k, (t, n) in enumerate(near[:5], 1))
    return sorted(out)


@pytest.mark.parametrize("block", [7, negatives.ROWS])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0.4, 0.5, 6), 1).astype(np.float32)], int(rng.integers(0, 4))) for i in range(0, 1000, 5)]
    rows += [(i, rows[3][1], rows[3][2] + 1) for i in range(2000, 2040)]  # ties
    rows += [rows[20], rows[20], (100, rows[7][1], 2), (None, rows[7][1], 2), (7, None, 1), (14, [1.0, None] * 3, 1), (21, [float("nan")] * 6, 1), (28, [float("inf")] * 6, 1), (300, [0.5, 1.5], 1), (400, [], 0), (35, rows[4][1], None)]
    monkeypatch.setattr(negatives, "ROWS", block)
    monkeypatch.setattr(negatives, "ANCHORS", block)
    table = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "vec_id bigint, embedding array<float>, label int, a string, anchor_id string")
    found = [tuple(r) for r in negatives.mine(table).collect()]
    by_ids = lambda rs: sorted({(r[0], r[1], r[3], r[4], r[5]) for r in rs})
    wanted = plain_negatives(rows)
    assert [r for r in sorted(found) if r[0] != 100] == [r for r in wanted if r[0] != 100]
    assert {r[:2] for r in by_ids(found)} == {r[:2] for r in by_ids(wanted)}


def test_crc_column_is_unsigned(spark):
    rows = spark.range(50).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in rows)
