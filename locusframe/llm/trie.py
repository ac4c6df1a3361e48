"""Prefix trie of conversations by truncation peeling.

A turn list is named by sums over its turns of hashes of (place, role, text), so stripping the last turn subtracts its
share, and running sums name all prefixes of all conversations without gathering one. From the greatest depth up to the
root, the conversations that end at a depth join the nodes that survive from below, all stripped to that depth, and are
grouped by prefix: one aggregation finds the depth's nodes and their counts. A depth at which nothing ends and no two
nodes meet only passes its nodes on; such stretches are skipped and filled in afterwards by one join, so the number of
rounds follows the depths at which something happens, not the longest conversation.

A node's survivor is its smallest member; it finds its shorter prefixes by an equijoin on the conversation, which has one
row a depth. No group is collected: the ids that end at a node are numbered by range slices, joined in chunks, and hashed
chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import CRC_TABLE_SQL, crc_sql, table, written
from locusframe.operators.scan import running

#: The given rule of who begins with whose turns: conversation c takes the first crc32(c) % HEADS turns of c - c % GROUP.
GROUP, HEADS = 5, 9
#: Ids a chunk of an ends list.
CHUNK = 256
PREFIX = ("depth", "a", "b")


def _share(half: int) -> Column:
    """60 bits of a turn's hash at its place, as a decimal: sums of these over a conversation never overflow."""
    whole = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    return F.conv(F.substring(whole, 1 + 15 * half, 15), 16, 10).cast("decimal(38,0)")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, bytes): turns in order, roles and texts as one digest. Rows that share a turn number
    are ordered by digest."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return running(written(rows, "turns"), ["conv_id"], ["turn", "digest"], {"place": F.lit(1).cast("long")}).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, length), and their turns (conv_id, depth, digest, bytes)."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    held = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    first = turns.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "taken").join(first, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "length"), lent.unionByName(own)


def prefixes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one too: (conv_id, depth, a, b, up_a, up_b, bytes, total, length).

    (a, b) names the prefix and (up_a, up_b) the one without its last turn; ``bytes`` are those of the last text and
    ``total`` those of all.
    """
    shares = turns.select("conv_id", "depth", _share(0).alias("x"), _share(1).alias("y"), "bytes")
    nil, none = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)")
    shares = written(shares.unionByName(convs.select("conv_id", nil.alias("depth"), none.alias("x"), none.alias("y"), nil.alias("bytes"))), "shares")
    sums = running(shares, ["conv_id"], ["depth"], {"a": F.col("x"), "b": F.col("y"), "total": F.col("bytes")})
    sums = sums.join(convs, "conv_id").select(
        "conv_id", "depth", "a", "b", (F.col("a") - F.col("x")).cast("decimal(38,0)").alias("up_a"), (F.col("b") - F.col("y")).cast("decimal(38,0)").alias("up_b"), "bytes", "total", "length")
    return written(sums.sortWithinPartitions("depth"), "prefixes")  # by depth, so that a round's filter skips what it can


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to a hash a node; a node's state is one SHA-256, however many its chunks."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.decimal128(38, 0)), pa.array([key[2]], pa.decimal128(38, 0)), pa.array([state.hexdigest()])], ["depth", "a", "b", "ends_sha256"])

    for batch in batches:
        for depth, a, b, ids in zip(*(batch[c].to_pylist() for c in (*PREFIX, "ids"))):
            if (depth, a, b) != key:
                if key is not None:
                    yield row()
                key, state = (depth, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield row()


def ends_of(ended: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of prefixes at which conversations end: the hash of their ids, ascending, by commas."""
    placed = running(ended.select(*PREFIX, "conv_id"), list(PREFIX), ["conv_id"], {"place": F.lit(1).cast("long")})
    chunks = placed.groupBy(*PREFIX, F.expr(f"(place - 1) div {CHUNK}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    chunks = written(chunks, "ends")
    single = chunks.groupBy(*PREFIX).agg(F.count("*").alias("n"), F.min(F.when(F.col("chunk") == 0, F.col("ids"))).alias("ids"))
    few = single.where("n = 1").select(*PREFIX, F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.join(single.where("n > 1").select(*PREFIX), list(PREFIX), "left_semi").repartition(*PREFIX).sortWithinPartitions(*PREFIX, "chunk")
    return few.unionByName(many.mapInArrow(_ends_hash, "depth long, a decimal(38,0), b decimal(38,0), ends_sha256 string"))


def _events(prefixes: DataFrame) -> list[int]:
    """The depths, greatest first, at which a conversation ends or two nodes meet; the root always. One number a round."""
    nodes = prefixes.groupBy(*PREFIX).agg(F.max((F.col("depth") == F.col("length")).cast("int")).alias("end")).groupBy("depth").agg(F.count("*").alias("n"), F.max("end").alias("end"))
    below = nodes.select((F.col("depth") - 1).alias("depth"), F.col("n").alias("under"))
    met = nodes.join(below, "depth", "left").where("end = 1 or n != under or depth = 0")
    return sorted((r["depth"] for r in met.select("depth").collect()), reverse=True)


def peel(prefixes: DataFrame) -> DataFrame:
    """Nodes by depth: (conv_id, depth, a, b, up_a, up_b, bytes, n_convs, n_children, n_leaves, saved_tokens)."""
    events = _events(prefixes)
    survivors, found = None, []
    rest = ("n_convs", "n_leaves", "saved", "from", "child")
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    for k, depth in enumerate(events):
        here = prefixes.where(F.col("depth") == depth).drop("length")
        items = prefixes.where((F.col("depth") == depth) & (F.col("length") == depth)).drop("length").withColumns({"n_convs": one, "n_leaves": nil, "saved": nil, "from": F.col("total"), "child": nil})
        if survivors is not None:
            items = items.unionByName(here.join(survivors, "conv_id"))
        # What survives has skipped the depths between: its node there saves as much again for each text.
        saved = F.col("saved") + (F.col("n_convs") - 1) * (F.col("from") - F.col("total"))
        nodes = items.groupBy(*PREFIX).agg(
            F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("up_a", "up_b", "bytes", "total")], F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum(saved).alias("saved"))
        nodes = nodes.withColumns({"n_leaves": F.greatest("n_leaves", one), "saved_tokens": F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")}).drop("saved")
        found.append(written(nodes, f"nodes-{depth}"))
        survivors = found[-1].select("conv_id", "n_convs", "n_leaves", F.col("saved_tokens").alias("saved"), (F.col("total") - F.col("bytes")).alias("from"), one.alias("child"))
    if not found:
        return prefixes.limit(0).select("conv_id", *PREFIX, "up_a", "up_b", "bytes", *[nil.alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    nodes = reduce(DataFrame.unionByName, found)
    columns = ("conv_id", *PREFIX, "up_a", "up_b", "bytes", "n_convs", "n_children", "n_leaves", "saved_tokens")
    gaps = [(low, high) for high, low in zip(events, events[1:]) if high - low > 1]
    if not gaps:
        return nodes.select(*columns)
    spark = prefixes.sparkSession
    skipped = spark.createDataFrame(gaps, "low long, __event long").select("__event", F.explode(F.expr("sequence(low + 1, __event - 1)")).alias("depth"))
    ends = nodes.select("conv_id", F.col("depth").alias("__event"), "n_convs", "n_leaves", F.col("saved_tokens").alias("__saved"), (F.col("total") - F.col("bytes")).alias("__from"))
    between = prefixes.drop("length").join(skipped, "depth").join(ends, ["conv_id", "__event"])
    more = (F.col("n_convs") - 1) * (F.col("__from") - F.col("total") + F.col("bytes"))
    between = between.select("conv_id", *PREFIX, "up_a", "up_b", "bytes", "n_convs", one.alias("n_children"), "n_leaves", (F.col("__saved") + more).alias("saved_tokens"))
    return nodes.select(*columns).unionByName(between)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Rows with a null conversation are passed over; turns are ordered by number, null first, and rows that share one by a
    hash of role and text, so equal rows each count as a turn. Null roles and texts are empty; other columns are not read.
    An empty table has no conversation and so no node.
    """
    convs, turns = rebuilt(written(turns_of(conversations), "numbered"))
    prefixes = prefixes_of(convs, turns)
    nodes = written(peel(prefixes), "nodes")
    ends = ends_of(prefixes.where("depth = length"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(ends, list(PREFIX), "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: A prefix is the text of its turns, each with the lengths of its role and text.
SQL = f"""
WITH crc_table AS ({CRC_TABLE_SQL}
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(r)) AS place, r, bytes
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS r, octet_length(encode(coalesce(text, ''))) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), joined AS (
  SELECT c.conv_id, t.place, t.r, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, t.place + {HEADS}, t.r, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, r, bytes FROM joined
), prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(sha256(r), ',') OVER w) AS p, coalesce(sha256(string_agg(sha256(r), ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up, bytes
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0 FROM convs
), ends AS (
  SELECT conv_id, arg_max(p, depth) AS p FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT p, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saves FROM prefixes GROUP BY p
), children AS (
  SELECT up AS p, count(*) AS n_children FROM nodes GROUP BY up
), under AS (
  SELECT a.p, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum(n.saves)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (p) JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.p
), ended AS (
  SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM ends GROUP BY p
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.p = n.up LEFT JOIN children c ON c.p = n.p JOIN under u ON u.p = n.p LEFT JOIN ended e ON e.p = n.p
"""
