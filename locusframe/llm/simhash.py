"""Near-dedup by SimHash fingerprints, searched in BK-trees.

Fingerprints grow with the corpus, so neither they nor their trees are broadcast: a tree belongs to a key, and only
fingerprints with that key can be within the radius in that tree. A fingerprint is cut into ``radius + 2`` blocks; two
that differ in ``radius`` bits or fewer agree on at least two whole blocks, so one tree per pair of blocks and value of
those blocks (the shard key) finds every link. Equal fingerprints are one node, so a group of copies costs one row.
Large shards are cut into blocks of bounded size, and every pair of blocks is a tree and its queries.

``keep_one_near_copy`` links whole texts by the Jaccard similarity of their five-word shingles instead. Two fingerprints
at a similarity of 0.8 differ in ten bits or so, too many for blocks of bits, so there a shard is a key of smallest
shingle hashes, the radius is wide, and what the trees propose is verified on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import component_minimum, connected_components, table, union_all, written
from locusframe.llm.decontamination import shards_of
from locusframe.llm.substring_dedup import rolling, word_hashes

#: Fixed values of the contract.
SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Queries that go down the trees together, and pairs of query and node that they may meet, so memory is bounded.
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 4096, 1_000_000
#: Fingerprints in one tree; larger shards are cut into blocks of about so many.
TREE = 20_000
TEXT_BYTES = 4 << 20
#: Entries of shards in one step of a task.
ENTRIES = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles: a bit is set if more than half the shingle hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shards_of(batch, "text", TEXT_BYTES):
            found = np.array([fingerprint(x) for x in part["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found)], ["doc_id", "fp"])


class BKForest:
    """BK-trees of many groups, built and searched on arrays. A node's children are keyed by Hamming distance to it."""

    def __init__(self, values: np.ndarray, group: np.ndarray, inside: np.ndarray | None = None):
        """values: uint64; group: rising group numbers. The first value of each group is the root of its tree; values that
        are not ``inside`` (by default all are) only ask."""
        self.values, n = values, len(values)
        first = np.r_[True, group[1:] != group[:-1]][:n]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        grows = ~first if inside is None else ~first & inside
        waiting, at, edges, children = np.flatnonzero(grows), self.root[grows], [], []
        while len(waiting):  # one level: the first to come to a free edge becomes the child, the others go on below it
            edge = at * (BITS + 1) + np.bitwise_count(values[waiting] ^ values[at])
            found, who, back = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(found)
            children.append(waiting[who])
            stays = np.ones(len(waiting), bool)
            stays[who] = False
            waiting, at = waiting[stays], waiting[who][back][stays]
        order = np.argsort(np.concatenate([*edges, np.empty(0, np.int64)]), kind="stable")
        self.edges = np.concatenate([*edges, np.empty(0, np.int64)])[order].astype(np.int64)
        self.children = np.concatenate([*children, np.empty(0, np.int64)])[order].astype(np.int64)

    def queries_at_once(self) -> int:
        largest = int(np.bincount(self.root).max()) if len(self.root) else 1
        return max(1, min(QUERIES_AT_ONCE, PAIRS_AT_ONCE // largest))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node index) at most ``radius`` apart, following only edges within the radius."""
        query, node = queries, self.root[queries]
        while len(query):
            apart = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = apart <= radius
            yield query[near], node[near]
            next_query, next_node = [], []
            for step in range(-radius, radius + 1):
                wanted = node * (BITS + 1) + apart + step
                ok = (apart + step >= 0) & (apart + step <= BITS)
                place = np.minimum(np.searchsorted(self.edges, wanted), max(0, len(self.edges) - 1))
                ok &= (self.edges[place] == wanted) if len(self.edges) else False
                next_query.append(query[ok])
                next_node.append(self.children[place[ok]] if len(self.edges) else query[ok])
            query, node = np.concatenate(next_query), np.concatenate(next_node)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; ``parent`` stays flat and points to the smallest index of each set."""
    while True:
        differ = parent[a] != parent[b]
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b]))
        while (above := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = above


def _forest(batch: pa.RecordBatch) -> tuple[BKForest, np.ndarray, pa.StructArray]:
    """The trees of a batch of shard blocks, who asks in them, and all entries."""
    lists = batch["entries"]
    entries = lists.flatten()
    asks = entries.field("asks").to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return BKForest(entries.field("fp").to_numpy().view(np.uint64), group, ~asks), asks, entries


def _askers(asks: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """In a tree with its own queries those ask; in a tree without any its nodes ask each other."""
    visited = np.zeros(len(asks), bool)
    visited[group_of[asks]] = True
    return np.flatnonzero(asks | ~visited[group_of])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch until they hold ENTRIES, so memory does not follow the number of rows in a batch."""
    for batch in batches:
        held = np.cumsum(np.diff(batch["entries"].offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + ENTRIES, side="right")))
            # A slice of a list array keeps its parent's offsets, so it is copied.
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch["entries"].slice(start, stop - start)])], ["entries"])
            start = stop


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        forest, asks, entries = _forest(batch)
        parent, ask = np.arange(len(forest.values)), _askers(asks, forest.root)
        few = forest.queries_at_once()
        for k in range(0, len(ask), few):
            for a, b in forest.within(ask[k : k + few], RADIUS):
                unite(parent, a, b)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        values = forest.values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values[child]), pa.array(values[parent[child]])], ["src", "dst"])


def _shards(keyed: DataFrame, keys: list[str], payload: list[str], tree: int, weight: Column | None = None) -> DataFrame:
    """(entries): a row per block of a shard and pair of its blocks; ``asks`` marks the queries of a pair of blocks.

    A shard of up to ``tree`` rows (or that sum of ``weight``) is one block and its nodes ask each other. Shards of one row
    are left out.
    """
    sizes = keyed.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("__size"))
    large = sizes.where(F.col("__size") > tree).select(*keys, F.ceil(F.col("__size") / tree).cast("int").alias("__blocks"))  # few: rows / tree at most
    rows = keyed.join(large, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    rows = rows.withColumn("__mine", F.pmod(F.xxhash64(*payload[:2]), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.select(*keys, F.least("__mine", "__other").alias("__low"), F.greatest("__mine", "__other").alias("__high"),
                       F.struct(*payload, (F.col("__mine") > F.col("__other")).alias("asks")).alias("entry"))
    groups = rows.groupBy(*keys, "__low", "__high").agg(F.sort_array(F.collect_list(F.struct(F.col("entry.asks").alias("o"), "entry"))).alias("e"))
    return groups.where(F.size("e") > 1).select(F.transform("e", lambda x: x["entry"]).alias("entries"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tree: int | None = None) -> DataFrame:
    """(src, dst): links that join exactly the distinct fingerprints ``fp`` connected at ``radius`` bits, at most one a row and tree."""
    blocks = radius + 2
    width = BITS // blocks
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned("fp", k * width).bitwiseAND(mask if k < blocks - 1 else (1 << (BITS - k * width)) - 1) for k in range(blocks)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("tree"), block[a].alias("x"), block[b].alias("y")) for n, (a, b) in enumerate(combinations(range(blocks), 2))])).alias("k"))
    return _shards(keyed.select("fp", "k.tree", "k.x", "k.y"), ["tree", "x", "y"], ["fp"], tree or TREE).mapInArrow(_links, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: fingerprint and the smallest id that links reach, itself included.

    Null or empty text has fingerprint zero and links like any other. Rows may repeat; a null id is passed over when
    the smallest is taken (null if a component has no other). An empty table gives no rows; other columns are ignored.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = connected_components(fingerprint_links(fps.select("fp")))
    found = component_minimum(fps.withColumnRenamed("fp", "node"), reached, "first").select(F.col("node").alias("fp"), F.col("first").alias("component_id"))
    found = written(found, "fingerprint-components")  # so that the join below has exchanges of its own, which a hot fingerprint can split
    return rows.join(found, "fp", "left").select("doc_id", "fp", "component_id")


#: Of keep_one_near_copy: shard keys a document and smallest hashes in each; a pair at 0.8 shares a key but for one in 600.
KEYS, HASHES, WIDE = 9, 3, 18
SIMILARITY = 0.8
#: Texts of different groups in a shard up to which trees propose its pairs at once.
FEW = 64
#: Texts that lead a larger shard in the first round, and the share of near pairs among those led by that ends the rounds.
LEAD, YIELD = 4, 0.1
_FACTORS = np.random.default_rng(6).integers(1, 1 << 63, KEYS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, lower-cased A-Z; fewer words than ``size`` are one shingle."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(rolling(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _signature(shingles: np.ndarray) -> tuple[int, list[int]]:
    """SimHash of distinct shingles, and the shard keys."""
    if not len(shingles):
        return 0, []
    ones, low = np.zeros(BITS, np.int64), np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1 << 14):
        part = shingles[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        low = np.minimum(low, (part[None, :] * _FACTORS[:, None]).min(axis=1))
    bands = low.reshape(KEYS, HASHES)
    mixed = np.arange(1, KEYS + 1, dtype=np.uint64) * _FACTORS[:KEYS]
    for j in range(HASHES):
        mixed = (mixed ^ bands[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0]), mixed.view(np.int64).tolist()


def _signer(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "text", TEXT_BYTES):
                classes, fps, keys = [], [], []
                for text in part["text"].to_pylist():
                    classes.append(hashlib.md5(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())).digest())
                    fp, mine = _signature(shingles_of(text, shingle))
                    fps.append(fp)
                    keys.append(mine)
                nodes = np.frombuffer(b"".join(classes), "<i8")[::2]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["row"], pa.array(classes, pa.binary()), pa.array(nodes), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "row", "class", "node", "fp", "keys"])

    return sign


def _shingler(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "text", TEXT_BYTES):
                found = [shingles_of(x, shingle).view(np.int64) for x in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return sets


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs of nodes whose shingles have the similarity. Only texts of nodes in a pair are read and moved."""
    pairs = written(pairs, "pairs")
    sets = _texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), classes, docs, shingle)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    alike = both >= similarity * (F.size("a_set") + F.size("b_set") - both)
    return written(pairs.join(side("b"), "b").join(side("a"), "a").where(alike).select("a", "b"), "verified")


BROADCAST_NODES = 200_000


def _texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the texts of ``nodes``, written; other texts are not moved."""
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "first.doc_id", "first.row").dropDuplicates(["node"]), "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, ["doc_id", "row"]).select("node", "text")
    return written(texts.mapInArrow(_shingler(shingle), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")


def _wide_links(similarity: float):
    """Links between groups, of what the trees propose within WIDE bits: each is verified on the shingles in the task, and
    groups that a link joins are one from there on, so a task returns at most a link a group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            forest, asks, entries = _forest(batch)
            node, part = entries.field("node").to_numpy(), np.unique(entries.field("part").to_numpy(), return_inverse=True)[1]
            lists = entries.field("shingles")
            flat, begin = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            size = np.diff(begin)
            group = np.arange(int(part.max()) + 1) if len(part) else np.zeros(0, np.int64)
            ask, few, found = _askers(asks, forest.root), forest.queries_at_once(), []
            for k in range(0, len(ask), few):
                for a, b in forest.within(ask[k : k + few], WIDE):
                    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                    open_ = (group[part[a]] != group[part[b]]) & (low >= similarity * high)
                    for x, y in zip(a[open_].tolist(), b[open_].tolist()):
                        if group[part[x]] != group[part[y]]:
                            both = len(np.intersect1d(flat[begin[x] : begin[x + 1]], flat[begin[y] : begin[y + 1]], assume_unique=True))
                            if both >= similarity * (size[x] + size[y] - both):
                                unite(group, np.array([part[x]]), np.array([part[y]]))
                                found.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["src", "dst"])

    return link


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= WIDE


def _told_apart(classes: DataFrame) -> DataFrame:
    """``classes`` with one 64-bit ``node`` each: of classes that share one all but the first get another by their 128 bits."""
    for salt in range(64):
        shared = written(classes.groupBy("node").agg(F.min("class").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"), "shared-nodes")
        if shared.isEmpty():
            return classes
        other = F.when(F.col("class") > F.col("__first"), F.xxhash64(F.lit(salt), "class")).otherwise(F.col("node"))
        classes = written(classes.join(shared, "node", "left").withColumn("node", F.when(F.col("__first").isNotNull(), other).otherwise(F.col("node"))).drop("__first"), "copy-classes")
    raise RuntimeError("nodes still shared")


def _open_keys(left: DataFrame) -> DataFrame:
    """(key, n) of shards with texts of several groups that have not led yet, and how many."""
    waiting = left.where("not led").groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
    return written(waiting.where("lo <> hi").select("key", "n"), "open-shards")


def _with_turns(left: DataFrame, few: int) -> DataFrame:
    """``left`` with the ``turn`` in which a text leads its shard, where that is open and large: texts closest to the
    majority of the shard's fingerprints first, as the text that others were made from is; by hash among equals."""
    large = _open_keys(left).where(F.col("n") > few).select("key")
    if large.isEmpty():
        return left
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(1)
    sums = left.join(large, "key", "left_semi").groupBy("key").agg(F.count("*").alias("__n"), *[F.sum(bit(k)).alias(f"__b{k}") for k in range(BITS)])
    most = lambda k: F.shiftleft(F.when(2 * F.col(f"__b{k}") > F.col("__n"), F.lit(1)).otherwise(F.lit(0)).cast("long"), k)
    middle = sums.select("key", reduce(lambda x, y: x.bitwiseOR(y), [most(k) for k in range(BITS)]).alias("__middle"))
    order = F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.col("__middle"))).cast("long"), 40).bitwiseOR(F.pmod(F.xxhash64("node"), F.lit(1 << 40)))
    return written(left.drop("turn").join(middle, "key", "left").select("key", "node", "fp", "part", order.alias("turn"), "led"), "shard-turns")


def _merged(left: DataFrame, links: DataFrame) -> DataFrame:
    """(part, component) of groups that links between their texts join; the other groups are not in it."""
    part = left.select("node", "part").distinct()
    both = links.join(part.select(F.col("node").alias("src"), F.col("part").alias("x")), "src").join(part.select(F.col("node").alias("dst"), F.col("part").alias("y")), "dst")
    return connected_components(both.select(F.col("x").alias("src"), F.col("y").alias("dst"))).withColumnRenamed("node", "part")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs in either order, as (a, b) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_near_copy(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", tree: int | None = None, few: int | None = None) -> DataFrame:
    """``docs`` less every row but one of each group of near copies; of a group the row with the smallest id stays.

    Groups are connected by equal words (A-Z lower-cased, any blanks) and by a Jaccard similarity of ``similarity`` or
    more of the distinct shingles. First every text is verified against the smallest of each of its shards. While a shard
    holds more than FEW texts of different groups, texts of it take turns to lead, those closest to the shard's middle
    first: each is verified against all that wait in other groups, four times as many lead each round, and what links joins
    groups, so the near copies of a large family are soon one group. Rounds end where few of the pairs led by are near.
    Trees then propose the pairs of what is left; a task verifies them on the shingles of its texts and returns links
    between groups only. Every link is verified on whole texts; a pair at the similarity is proposed but for about one in
    500.
    Texts without words are one group; rows without an id all stay; of rows equal in id and text one stays; an empty
    table gives no rows; other columns pass through.
    """
    named = docs.withColumn("__row", F.xxhash64(text_col))
    rows = named.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    signed = rows.mapInArrow(_signer(shingle), "doc_id long, row long, class binary, node long, fp long, keys array<long>")
    classes = written(signed.groupBy("class").agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.first("node").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copy-classes")
    classes = _told_apart(classes)
    keyed = classes.select("node", "fp", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("node").alias("a"), F.min_by("fp", "node").alias("a_fp"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = keyed.join(leaders, "key").where((F.col("node") != F.col("a")) & _near("fp", "a_fp")).select("a", F.col("node").alias("b")).distinct()
    ends = lambda links: links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = [ends(_verified(first, classes, rows, shingle, similarity))]
    few = few or FEW
    parts = connected_components(links[0])
    left = keyed.join(parts, "node", "left").select("key", "node", "fp", F.coalesce("component", "node").alias("part"))
    left = written(left.select("*", F.lit(None).cast("long").alias("turn"), F.lit(False).alias("led")), "shard-parts")
    left, lead = _with_turns(left, few), LEAD
    while not (large := _open_keys(left).where(F.col("n") > few)).isEmpty():
        waiting = left.where("not led").join(large.select("key"), "key", "left_semi")
        leaders = waiting.withColumn("__i", F.row_number().over(Window.partitionBy("key").orderBy("turn"))).where(F.col("__i") <= lead).drop("__i")
        leaders = written(leaders.select("key", F.col("node").alias("l"), F.col("fp").alias("l_fp"), F.col("part").alias("l_part"), "turn"), "leaders")
        met = waiting.drop("turn").join(leaders.drop("turn"), "key").where((F.col("part") != F.col("l_part")) & _near("fp", "l_fp"))
        pairs = _ordered(met.select(F.col("node").alias("a"), F.col("l").alias("b"))).distinct().join(_ordered(first), ["a", "b"], "left_anti")
        pairs = written(pairs, "led-pairs")
        links.append(ends(_verified(pairs, classes, rows, shingle, similarity)))
        joined = _merged(left, links[-1])
        last = leaders.groupBy("key").agg(F.max("turn").alias("__last"))
        left = left.join(joined, "part", "left").join(last, "key", "left")
        left = written(left.select("key", "node", "fp", F.coalesce("component", "part").alias("part"), "turn", (F.col("led") | F.coalesce(F.col("turn") <= F.col("__last"), F.lit(False))).alias("led")), "shard-parts")
        lead *= 4
        if links[-1].count() < YIELD * pairs.count():
            break
    open_rows = written(left.where("not led").join(_open_keys(left).select("key"), "key", "left_semi").select("key", "fp", "node", "part"), "open-rows")
    open_rows = open_rows.join(_texts_of(open_rows.select("node").distinct(), classes, rows, shingle), "node")
    shards = _shards(open_rows, ["key"], ["fp", "node", "part", "shingles"], tree or TREE, F.lit(1) + F.size("shingles") / 100)
    links = union_all([*links, written(shards.mapInArrow(_wide_links(similarity), "src long, dst long"), "tree-links")])
    groups = component_minimum(classes.select("node", "first"), connected_components(links), "first")
    kept = groups.select(F.col("first.doc_id").alias("__kept"), F.col("first.row").alias("__row")).distinct()
    same = (F.col(id_col).cast("long") == F.col("__kept")) & (named["__row"] == kept["__row"])
    one = named.join(kept, same, "left_semi").dropDuplicates([id_col, "__row"])
    return one.unionByName(named.where(F.col(id_col).isNull())).select(*docs.columns)
