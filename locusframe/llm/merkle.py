"""Merkle manifest of a dataset: per language a tree over its documents, and a tree over the trees.

A level is a table of nodes (tree, place). A node's siblings stand at computed places - its place XOR 1 in binary trees,
slot offsets within the run otherwise - so each level is an equijoin of its nodes with themselves on (tree, place), and
the rows of slot zero, which hold their whole run then, emit the parents. Proofs come back down the same levels: a node's
proof is its siblings and its parent's proof. Every join is on (tree, place), where a place has one node and a parent at
most ``arity`` children, so no language, however large, is a hot key. Leaves are numbered by range slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import CRC_TABLE_SQL, crc_sql, table, written
from locusframe.operators.scan import running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ("tree", "at", "n", "digest")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def digest_of(*parts: Column) -> Column:
    """SHA-256 of texts one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def field(c: Column) -> Column:
    """A value as a leaf takes it: ``-`` for null, else UTF-8 byte count, colon, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, tampered): a row per document. ``tampered`` is the leaf with ``n_chars`` one higher where 7
    divides the checksum of the id and ``n_chars`` is not null, else null."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = lambda n: digest_of(*[field(n if c == "n_chars" else F.col(c)) for c in FIELDS])
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    # A tree's name keeps the order of languages: null first, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(F.col("n_chars")).alias("digest"), F.when(touched, leaf(more)).alias("tampered"))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``others``: the digests of the other nodes of the run, by slot."""
    slot = F.col("at") % arity
    out = nodes
    for k in range(1, arity):
        other = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + (slot + k) % arity
        right = nodes.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), F.struct(F.col("at").alias("at"), F.col("digest").alias("digest")).alias(f"__s{k}"))
        out = out.join(right, (F.col("tree") == F.col("__tree")) & (other == F.col("__at")), "left").drop("__tree", "__at")
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"__s{k}") for k in range(1, arity)])))
    return out.withColumn("others", F.transform(found, lambda s: s["digest"])).drop(*[f"__s{k}" for k in range(1, arity)])


def climb(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of every tree, each node with its siblings, and the tops: (tree, level, digest).

    ``nodes``: tree, place, number of nodes in the tree, digest, and columns that only the lowest level keeps. A level is
    written before the next one is made, so a plan never holds more than one.
    """
    tops = [nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")]
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(_siblings(nodes.where("n > 1"), arity), f"{name}-{len(levels)}"))
        parent = digest_of(_hex(F.col("digest")), F.concat_ws("", F.transform("others", _hex)))
        up = F.expr(f"(n + {arity - 1}) div {arity}")
        nodes = levels[-1].where(F.col("at") % arity == 0).select("tree", F.expr(f"at div {arity}").alias("at"), up.alias("n"), parent.alias("digest"))
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        most = -(-most // arity)
    return levels, written(reduce(DataFrame.unionByName, tops), f"{name}-tops")


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> list[DataFrame]:
    """Per level its nodes with ``subroot`` and ``path``: (slot, other digests) of each level from there on.

    ``tops``: (tree, level, subroot, path) of each tree's top. The list begins with trees of one node; that of the lowest
    level follows. No row is made for trees that end lower.
    """
    step = F.array(F.struct((F.col("at") % arity).cast("int").alias("slot"), F.col("others")))
    at_top = lambda k: tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("__up"), "subroot", "path")
    above = at_top(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        if k < len(levels) - 1:
            above = above.select("tree", F.col("at").alias("__up"), "subroot", "path").unionByName(at_top(k + 1))
        above = above.withColumnRenamed("tree", "__tree").withColumnRenamed("path", "__path")
        here = levels[k].join(above, (F.col("tree") == F.col("__tree")) & (F.expr(f"at div {arity}") == F.col("__up")))
        above = here.withColumn("path", F.concat(step, "__path")).drop("__tree", "__up", "__path", "others")
        if k and k % 6 == 0:
            above = written(above.select("tree", "at", "subroot", "path"), "proofs")
    return [at_top(0), above]


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give: at each level the run's digests with this one in its slot."""
    join = lambda xs: F.concat_ws("", F.transform(xs, _hex))
    one = lambda at, s: digest_of(join(F.slice(s["others"], F.lit(1), s["slot"])), _hex(at), join(F.slice(s["others"], s["slot"] + 1, F.size(s["others"]))))
    return F.aggregate(path, start, one)


EMPTY_PATH = "array<struct<slot:int,others:array<binary>>>"


def manifest(docs: DataFrame, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    Rows with equal ids are ordered by their leaf, so rows equal in all five columns are interchangeable; a null id comes
    first, and null languages are a tree of their own, the first. Null and empty values differ. One language: its subroot
    is the root. One document: its leaf is both, its proof is that of no siblings. An empty table gives no rows. Other
    columns than the five are not read. ``arity`` is the length of a run, 2 or more.
    """
    leaves = written(leaves_of(docs), "leaves")
    placed = running(leaves, ["tree"], ["doc_id", "digest"], {"__place": F.lit(1).cast("long")})
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    placed = placed.join(sizes, "tree").select("tree", (F.col("__place") - 1).alias("at"), "n", "digest", "doc_id", "tampered")
    levels, tops = climb(written(placed, "placed"), arity, "level")
    trees = running(tops, [], ["tree"], {"__place": F.lit(1).cast("long")})
    upper = written(trees.select(F.lit("").alias("tree"), (F.col("__place") - 1).alias("at"), F.lit(tops.count()).alias("n"), "digest", F.col("tree").alias("name"), "level"), "subroots")
    upper_levels, upper_tops = climb(upper, arity, "upper")
    found = upper_tops.first()
    if found is None:
        return docs.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified")).limit(0)
    root = F.lit(found["digest"].hex())
    nil = F.array().cast(EMPTY_PATH)
    if upper_levels:
        ends = descend(upper_levels, upper_tops.select("tree", "level", F.col("digest").alias("subroot"), nil.alias("path")), arity)[1]
        ends = ends.select(F.col("name").alias("tree"), "level", F.col("digest").alias("subroot"), "path")
    else:
        ends = upper.select(F.col("name").alias("tree"), "level", F.col("digest").alias("subroot"), nil.alias("path"))
    ends = written(ends, "subroot-proofs")
    alone, rest = descend(levels, ends, arity)
    alone = placed.where("n = 1").select("tree", "doc_id", "digest", "tampered").join(alone, "tree")
    columns = ["doc_id", "digest", "tampered", "subroot", "path"]
    proofs = alone.select(columns) if not levels else alone.select(columns).unionByName(rest.select(columns))
    siblings = F.concat_ws("", F.transform(F.flatten(F.transform("path", lambda s: s["others"])), _hex))
    folded = _hex(fold(F.coalesce("tampered", "digest"), F.col("path")))
    out = proofs.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*FIELDS))


def _leaf_sql(chars: str) -> str:
    value = lambda c: f"CAST({chars if c == 'n_chars' else c} AS VARCHAR)"
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({value(c)})) || ':' || {value(c)}, '-')" for c in FIELDS) + ")"


#: Levels by a recursive query; a leaf's proof lists its siblings, and its fold walks them.
SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE_SQL}
), leaves AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n, *
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, lang, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS start
    FROM documents, crc_table)
), low AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, level, place // 2
), tops AS (
  SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 2
), root AS (
  SELECT digest AS root, level AS height FROM high WHERE n = 1
), steps AS (
  SELECT tree, place, level, NULL::BIGINT AS top, digest FROM low WHERE n > 1
  UNION ALL
  SELECT t.tree, h.place, t.height + h.level, t.place, h.digest FROM tops t JOIN high h ON h.n > 1
), siblings AS (
  SELECT l.tree, l.place, s.level, s.digest, ((l.place >> s.level) & 1) = 1 AS on_left FROM leaves l JOIN steps s ON s.tree = l.tree AND s.top IS NULL AND s.place = xor(l.place >> s.level, 1)
  UNION ALL
  SELECT l.tree, l.place, s.level, s.digest, ((s.top >> (s.level - t.height)) & 1) = 1
  FROM leaves l JOIN tops t USING (tree) JOIN steps s ON s.tree = l.tree AND s.top IS NOT NULL AND s.place = xor(s.top >> (s.level - t.height), 1)
), walk AS (
  SELECT l.tree, l.place, 0 AS level, t.height + (SELECT height FROM root) AS height, start AS digest FROM leaves l JOIN tops t USING (tree)
  UNION ALL
  SELECT w.tree, w.place, w.level + 1, w.height, CASE WHEN s.digest IS NULL THEN sha256(w.digest) WHEN on_left THEN sha256(s.digest || w.digest) ELSE sha256(w.digest || s.digest) END
  FROM walk w LEFT JOIN siblings s ON s.tree = w.tree AND s.place = w.place AND s.level = w.level WHERE w.level < w.height
), proofs AS (
  SELECT tree, place, string_agg(digest, '' ORDER BY level) AS proof FROM siblings GROUP BY tree, place
)
SELECT l.doc_id, l.leaf, t.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, w.digest AS folded_root, w.digest = root.root AS verified
FROM leaves l JOIN tops t USING (tree) JOIN walk w ON w.tree = l.tree AND w.place = l.place AND w.level = w.height LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.place, root
"""
