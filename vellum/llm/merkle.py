"""Merkle manifest of a dataset: a tree per group (language), their roots joined into one, a proof for every row.

1. A row's leaf is the digest of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. H is lowercase
   hex sha256; inner digests go into H as hex text.
2. Leaves get their place in their group: rows are sorted by range, counted by sorted partition and group, and numbered within those,
   so that a group of any size is spread over tasks.
3. Sibling-shift self-joins: at every level each node looks for the nodes of its run, whose indices are computed from its own (XOR with 1
   for two children, the slots of the run otherwise), by an equijoin. Rows of slot zero then emit the parent: H of the run left to right.
   A last run with fewer nodes, even one, becomes their H. A group with one node left is done; a lone leaf is its own root.
4. The groups' roots, ordered by group, are the leaves of a last tree.
5. Proofs go down the same levels: a node's siblings followed by those of its parent, so that each level is shipped once.

Every level is a table in the shared folder. Rows that tie on the id are ordered by their leaves, so repeated rows have neighbouring equal leaves;
rows without an id come first. The null group comes first, then groups bytewise. An empty table gives no rows. A null text is ``-``, an empty one ``0:``.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import discard, materialize

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 2
#: Rows of which ``tampered`` changes ``n_chars``: those whose id's crc32 this divides.
TAMPERED = 7


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the place from 0 within ``group`` by ``order``, and ``n``, the size of the group."""
    ranged = materialize(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    # A row per sorted partition and group in it: as many as there are tasks and groups, not rows.
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__here"))
    whole = Window.partitionBy(group)
    before = F.sum("__here").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__here").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    placed = ranged.withColumn("__place", place).join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return placed.withColumn("idx", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before", "__group", "__of")


def runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (tree, idx, n, digest) with the digests of their run's other slots: ``s0`` .. (null where there is none), by self-joins on computed indices."""
    out = nodes
    for shift in range(1, fanout):
        there = nodes.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("digest").alias(f"s{shift}"))
        slot = F.pmod("idx", F.lit(fanout))
        wanted = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + F.pmod(slot + shift, F.lit(fanout))
        out = out.withColumn("__wanted", wanted).join(there, (F.col("tree") == F.col("__tree")) & (F.col("__wanted") == F.col("__idx")), "left").drop("__tree", "__idx", "__wanted")
    return out


def hashed(parts: list[Column]) -> Column:
    """H of digests (32 bytes each, null where a slot is empty), left to right."""
    return F.unhex(F.sha2(F.concat(*(F.lower(F.coalesce(F.hex(p), F.lit(""))) for p in parts)), 256))


def in_order(slot: Column, fanout: int) -> Column:
    """The run's other digests by slot: a node in slot s meets slot (s + k) mod fanout at shift k."""
    each = F.array(*(F.struct(F.pmod(slot + k, F.lit(fanout)).alias("at"), F.col(f"s{k}").alias("digest")) for k in range(1, fanout)))
    return F.array_sort(F.filter(each, lambda x: x["digest"].isNotNull()))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels of (tree, idx, n, digest, others) from (tree, idx, n, digest), the leaves first, and (tree, digest) of the roots.

    ``others`` holds slot and digest of the rest of a node's run.
    """
    levels, roots, nodes = [], [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most:
        slot = F.pmod("idx", F.lit(fanout)).cast("int")
        level = materialize(runs(nodes, fanout).select("tree", "idx", "n", "digest", in_order(slot, fanout).alias("others")))
        levels.append(level)
        roots.append(level.filter("n = 1").select("tree", "digest"))
        most = -(-most // fanout) if most > 1 else 0
        first = level.filter(f"n > 1 and idx % {fanout} = 0")
        run = [F.col("digest"), *(F.get(F.col("others"), F.lit(k))["digest"] for k in range(fanout - 1))]
        nodes = first.select("tree", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), hashed(run).alias("digest"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def paths(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(tree, idx, path) of the leaves: for each level up to the root the slot and the run's other digests."""
    above = None
    for level in reversed(levels):
        own = F.array(F.struct(F.pmod("idx", F.lit(fanout)).cast("int").alias("slot"), F.col("others")))
        root = level.filter("n = 1").select("tree", "idx", F.filter(own, lambda x: F.lit(False)).alias("path"))
        if above is None:
            below = root
        else:
            up = above.select(F.col("tree").alias("__tree"), F.col("idx").alias("__up"), F.col("path").alias("__path"))
            inner = level.filter("n > 1").withColumn("__at", F.floor(F.col("idx") / fanout))
            inner = inner.join(up, (F.col("tree") == F.col("__tree")) & (F.col("__at") == F.col("__up")))
            below = root.unionByName(inner.select("tree", "idx", F.concat(own, "__path").alias("path")))
        before, above = above, materialize(below)
        if before is not None:
            discard(before)
    return above


def proof_of(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.array_join(F.transform(x["others"], lambda o: F.lower(F.hex(o["digest"]))), "")), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path lead to."""

    def up(digest: Column, x: Column) -> Column:
        hexes = lambda f: F.array_join(F.transform(F.filter(x["others"], f), lambda o: F.lower(F.hex(o["digest"]))), "")
        return F.sha2(F.concat(hexes(lambda o: o["at"] < x["slot"]), digest, hexes(lambda o: o["at"] > x["slot"])), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, doc_id: str = "doc_id", group: str = "lang", changed: str = "n_chars", fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: per row, the proof checked against the row with ``changed`` tampered where ``TAMPERED`` says."""
    value = lambda c: F.col(f"`{c}`")
    tampers = F.coalesce(F.crc32(value(doc_id).cast("string")) % TAMPERED == 0, F.lit(False))
    other = F.when(tampers, leaf_of([value(c) + 1 if c == changed else value(c) for c in columns]))
    # The tree's name holds whether the group is null, so that joins need no null-safe keys and order is by bytes, null first.
    tree = F.coalesce(F.concat(F.lit("="), value(group).cast("string")), F.lit(""))
    rows = docs.select(value(doc_id).alias("doc_id"), tree.alias("tree"), leaf_of([value(c) for c in columns]).alias("leaf"), other.alias("other"))
    leaves = materialize(numbered(rows, "tree", ["doc_id", "leaf"]).select("doc_id", "tree", "idx", "n", "leaf", "other"))
    levels, subroots = grow(leaves.select("tree", "idx", "n", F.unhex("leaf").alias("digest")), fanout)
    below = paths(levels, fanout)
    tops = materialize(numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("of"), "digest"), "all", ["of"]))
    upper, roots = grow(tops.select(F.col("all").alias("tree"), "idx", "n", "digest"), fanout)
    ends = paths(upper, fanout).select("idx", F.col("path").alias("top"))
    named = tops.join(ends, "idx").crossJoin(roots.select(F.col("digest").alias("root"))).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "top")
    named = materialize(named)
    found = leaves.join(below, ["tree", "idx"]).join(named, "tree").withColumn("path", F.concat("path", "top"))
    low = lambda c: F.lower(F.hex(c))
    found = found.select("doc_id", "leaf", low("subroot").alias("subroot"), low("root").alias("root"), proof_of(F.col("path")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The contract's query for DuckDB; the first part computes crc32, which DuckDB lacks.
SQL = """
WITH RECURSIVE bits AS (SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT doc_id, lang, unnest([0, 1]) AS added, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(CAST(n_chars + added AS VARCHAR)) || ':' || (n_chars + added), '-'), coalesce(strlen(text) || ':' || text, '-')) AS fields FROM documents),
leaves AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, sha256(min(fields) FILTER (added = 0)) AS leaf, sha256(min(fields) FILTER (added = 1)) AS other,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM texts GROUP BY doc_id, lang),
nodes AS (SELECT 0 AS level, tree, idx, n, leaf AS h FROM leaves
  UNION ALL SELECT level + 1, tree, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 2),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2),
steps AS (
  SELECT l.doc_id, s.level, (l.idx >> s.level) % 2 = 1 AS is_right, coalesce(b.h, '') AS h
    FROM leaves l JOIN (SELECT DISTINCT level, tree FROM nodes WHERE n > 1) s USING (tree)
    LEFT JOIN nodes b ON b.tree = l.tree AND b.level = s.level AND b.idx = xor(l.idx >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + s.level, (r.idx >> s.level) % 2 = 1, coalesce(b.h, '')
    FROM leaves l JOIN subroots r USING (tree) CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s
    LEFT JOIN tops b ON b.level = s.level AND b.idx = xor(r.idx >> s.level, 1)),
proofs AS (SELECT doc_id, list(struct_pack(h := h, r := is_right) ORDER BY level) AS proof FROM steps GROUP BY doc_id),
started AS (SELECT l.*, coalesce(proof, []) AS proof, CASE WHEN xor(list_reduce([4294967295] || list_transform(range(1, strlen(CAST(l.doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(l.doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda a, x: xor(t[xor(a & 255, x) + 1], a >> 8)), 4294967295) % 7 = 0 THEN other ELSE leaf END AS given
  FROM leaves l LEFT JOIN proofs USING (doc_id) CROSS JOIN crc),
climb AS (SELECT doc_id, 0 AS k, proof, given AS h FROM started
  UNION ALL SELECT doc_id, k + 1, proof, CASE WHEN proof[k + 1].r THEN sha256(proof[k + 1].h || h) ELSE sha256(h || proof[k + 1].h) END FROM climb WHERE k < len(proof))
SELECT s.doc_id, s.leaf, r.subroot, t.h AS root, sha256(coalesce(array_to_string(list_transform(s.proof, lambda x: x.h), ''), '')) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM started s JOIN subroots r USING (tree) JOIN (SELECT h FROM tops WHERE n = 1) t ON true JOIN climb c ON c.doc_id = s.doc_id AND c.k = len(c.proof)
"""
