"""Merkle manifest of a dataset: a tree per language over its rows, a tree over the languages' subroots, and a proof for every row.

Levels are built one DataFrame at a time. Leaves are numbered within their tree: a range exchange puts them in order, ``row_number``
counts inside each stretch of a partition, and the rows of earlier stretches are added. A parent's number is its child's, divided by the
fanout; children meet in groups of at most ``fanout`` and are hashed in order. Every level is written before the next one is built.

Proofs come down again, level by level: a run of siblings joins its parent's path once, and each of its children puts its own siblings in
front. A level has a ``fanout``-th of the rows of the level below, so all joins together move about as many rows as the last one.

Hash: lowercase hex SHA-256. A leaf hashes its fields joined without a separator, each as ``-`` if null, else its length in UTF-8 bytes, ``:``
and its value. A parent hashes its children's hex digests, joined. A node that is alone on its level is the root of its tree.

Defined cases: rows without a language have a tree of their own, before all others; rows of one language go by id (null ids first), then by
leaf; equal rows are leaves each; a single row has an empty proof if its language is the only one; an empty table has no rows and no
root; columns besides the five are neither hashed nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_hash(fields: list[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``tree``, not null) with idx, their place in ``order`` within the tree from 0, and n, the tree's rows."""
    keys = ["tree", *order, "__tie"]  # a range holds no more than its share even of rows that are equal
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys)
    ranged = materialise(ranged.withColumn("__part", F.spark_partition_id()), "merkle-order")
    stretches = ranged.groupBy("tree", "__part").agg(F.count("*").alias("__rows"))
    whole = W.partitionBy("tree")  # a row for each partition at most
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("tree", "__part", before.alias("__before"), F.sum("__rows").over(whole).alias("n"))
    place = F.row_number().over(W.partitionBy("tree", "__part").orderBy(*keys[1:]))
    return ranged.join(stretches, ["tree", "__part"]).withColumn("idx", place - 1 + F.col("__before")).drop("__part", "__before", "__tie")


def climb(leaves: DataFrame, payload: list[str], fanout: int, tag: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of all trees from ``leaves`` (tree, idx, n, hash and ``payload``) up.

    First the runs of every level: tree, idx (the parent's), n (the nodes of the runs' level), kids (their idx and hash, on the lowest level
    the payload too). Second the single nodes of every level: tree, hash, which are the trees' roots.
    """
    nodes = materialise(leaves.select("tree", "idx", "n", "hash", *payload), f"{tag}-leaves")
    runs, roots = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1"))
        if most <= 1:
            return runs, roots
        kid = F.struct("idx", "hash", *payload)
        grouped = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        runs.append(materialise(grouped.withColumnRenamed("parent", "idx"), f"{tag}-level"))
        joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        nodes = runs[-1].select("tree", "idx", F.ceil(F.col("n") / fanout).alias("n"), digest(joined).alias("hash"))
        most, payload = -(-most // fanout), []


def descend(runs: list[DataFrame], roots: list[DataFrame], top: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, idx, hash, path, subroot and ``payload``) of every leaf; ``top`` has path and subroot by tree.

    A path is an array of (left, right), the joined digests of the siblings on either side, from the leaf's level up.
    """
    above = None
    for level in range(len(runs), -1, -1):
        own = payload if level == 0 else []
        found = [roots[level].join(top, "tree").select("tree", "idx", "hash", "path", "subroot", *own)]
        if above is not None:
            kids = runs[level].select("tree", "idx", "kids").join(above.select("tree", "idx", "path", "subroot"), ["tree", "idx"])
            each = kids.select("tree", "path", "subroot", "kids", F.posexplode("kids").alias("at", "kid"))
            side = lambda start, length: F.array_join(F.transform(F.slice("kids", start, length), lambda k: k["hash"]), "")
            step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.size("kids")).alias("right"))
            found.append(each.select("tree", "kid.idx", "kid.hash", F.concat(F.array(step), "path").alias("path"), "subroot", *[f"kid.{c}" for c in own]))
        above = reduce(DataFrame.unionByName, found)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda got, p: digest(F.concat(p["left"], got, p["right"])))


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", text: str = "text", fields: tuple[str, ...] = FIELDS, fanout: int = 8, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path, altered (the leaf to verify with).

    ``altered`` is the leaf of the row after its text lost its capitals where ``tampered`` holds, else the leaf itself.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_hash(list(cols.values()))
    other = leaf_hash([F.translate(c, UPPER, LOWER) if name == text else c for name, c in cols.items()])
    altered = F.lit(None).cast("string") if tampered is None else F.when(tampered, other)
    tree = F.coalesce(F.concat(F.lit("="), cols[group].cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = materialise(docs.select(tree.alias("tree"), cols[id_col].alias("id"), leaf.alias("hash"), altered.alias("altered")), "merkle-rows")

    runs, roots = climb(numbered(leaves, ["id", "hash"]), ["id", "altered"], fanout, "merkle")
    subroots = reduce(DataFrame.unionByName, [r.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash") for r in roots])
    top_runs, top_roots = climb(numbered(subroots, ["of"]), ["of"], fanout, "merkle-top")
    root = next((r["hash"] for t in top_roots for r in t.select("hash").collect()), None)  # one row at most

    nothing = F.array().cast("array<struct<left: string, right: string>>")
    start = docs.sparkSession.createDataFrame([("",)], "tree string").select("tree", nothing.alias("path"), F.lit("").alias("subroot"))
    top = descend(top_runs, top_roots, start, ["of"]).select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"))
    found = descend(runs, roots, top, ["id", "altered"])
    return found.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", F.coalesce("altered", "hash").alias("altered"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(documents(spark, sf_dir), tampered=tampered)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), fold(F.col("altered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
d AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1])), 4294967295::BIGINT) % 3 = 0 AS hit
    FROM documents, crc)),
nodes AS (SELECT 0 AS lvl, lang, idx, n, leaf AS h FROM d
    UNION ALL SELECT lvl + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, lang, idx // 8, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, idx, n, h FROM subroots UNION ALL SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 8, n),
root AS (SELECT h AS root FROM tops WHERE n = 1),
steps AS (SELECT d.r, s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < d.idx // (8 ** s.lvl)::BIGINT), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > d.idx // (8 ** s.lvl)::BIGINT), '') AS g
    FROM d JOIN nodes s ON s.lang IS NOT DISTINCT FROM d.lang AND s.n > 1 AND s.idx // 8 = d.idx // (8 ** (s.lvl + 1))::BIGINT GROUP BY d.r, s.lvl
    UNION ALL SELECT d.r, 1000 + s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < b.idx // (8 ** s.lvl)::BIGINT), ''), coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > b.idx // (8 ** s.lvl)::BIGINT), '')
    FROM d JOIN subroots b ON b.lang IS NOT DISTINCT FROM d.lang JOIN tops s ON s.n > 1 AND s.idx // 8 = b.idx // (8 ** (s.lvl + 1))::BIGINT GROUP BY d.r, s.lvl),
paths AS (SELECT r, list({'l': l, 'g': g} ORDER BY lvl) AS p, string_agg(l || g, '' ORDER BY lvl) AS s FROM steps GROUP BY r),
folded AS (SELECT r, 0 AS k, CASE WHEN hit AND low IS NOT NULL THEN sha256(head || strlen(low) || ':' || low) ELSE leaf END AS h FROM d
    UNION ALL SELECT f.r, f.k + 1, sha256(p[f.k + 1].l || f.h || p[f.k + 1].g) FROM folded f JOIN paths USING (r) WHERE f.k < len(p))
SELECT d.doc_id, d.leaf, b.h AS subroot, root, sha256(coalesce(paths.s, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM d JOIN subroots b ON b.lang IS NOT DISTINCT FROM d.lang CROSS JOIN root LEFT JOIN paths USING (r) JOIN folded f ON f.r = d.r AND f.k = coalesce(len(paths.p), 0)
"""
