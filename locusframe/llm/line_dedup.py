"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State is three tables. ``postings`` has a row per (line key, document). ``counts`` is the exact table: for each key the
number of documents that hold it and the smallest of them. ``filters`` has a row per shard: a cuckoo filter over the
shard's repeated keys (two documents or more). Marking routes the keys of documents to their shard, asks the filter,
and takes only what passes to the exact table. Insertions and deletions of documents change the counts and put keys
into the filters or take them out again, so dedup can be undone document by document.

A key is the 128-bit digest of a normalised line. Keys with over 1/2000 of all postings (at most 2000 of them, by
arithmetic) are decided by a broadcast of that bounded list. A shard whose other keys have more postings than one task
should hold is salted: its postings are dealt to several tasks, each with a copy of the shard's filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written
from locusframe.llm.decontamination import shards_of

#: Fixed values of the contract: what is stripped, what is lower-cased, the shortest key in code points.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
HOT_KEYS = 2000
POSTINGS_PER_SHARD = 200_000
MIN_SHARDS = 64
TEXT_BYTES = 8 << 20


class CuckooFilter:
    """Buckets of four 16-bit marks; a key has two buckets, each reached from the other by its mark. All steps on arrays."""

    SLOTS = 4

    def __init__(self, marks: np.ndarray):
        self.marks = marks  # (buckets, SLOTS), 0 is free

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct (n, 2) uint64 keys, at most three quarters full; doubled in the rare case that it jams."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (0.75 * cls.SLOTS)))))
        while True:
            made = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = (keys[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return (keys[:, 0] & np.uint64(len(self.marks) - 1)).astype(np.int64), marks

    def _other(self, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return at ^ ((marks.astype(np.int64) * 0x5BD1E995) & (len(self.marks) - 1))

    def insert(self, keys: np.ndarray, rounds: int = 400) -> bool:
        """Add keys that are not in it. False if some could not be placed (the filter must then be rebuilt larger)."""
        at, marks = self._places(keys)
        rng = np.random.default_rng(0)
        for turn in range(rounds):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, marks = at[order], marks[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            free = np.argsort(self.marks[at] != 0, axis=1, kind="stable")  # free slots first
            fits = rank < (self.marks[at] == 0).sum(axis=1)
            self.marks[at[fits], free[fits, rank[fits]]] = marks[fits]
            at, marks, first = at[~fits], marks[~fits], (rank == 0)[~fits]
            if turn >= 2 and len(at):  # full: the first of each bucket takes the place of a mark, which moves on
                slot = rng.integers(0, self.SLOTS, first.sum())
                where = at[first]
                out = self.marks[where, slot].copy()
                self.marks[where, slot] = marks[first]
                marks[first] = out
            at = self._other(at, marks)
        return not len(at)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, marks = self._places(keys)
        return ((self.marks[at] == marks[:, None]) | (self.marks[self._other(at, marks)] == marks[:, None])).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in it."""
        for at, mark in zip(*self._places(keys)):
            for place in (at, int(self._other(np.array([at]), np.array([mark]))[0])):
                slots = np.flatnonzero(self.marks[place] == mark)
                if len(slots):
                    self.marks[place, slots[0]] = 0
                    break


@dataclass
class LineState:
    postings: DataFrame  # digest, doc_id: written tables, less the deleted documents
    counts: DataFrame  # digest, n_docs, first_doc
    filters: DataFrame  # shard, marks
    shards: int


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _digests(text: Column, min_chars: int) -> Column:
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))
    return F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), lambda k: F.unhex(F.md5(k)))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(digest, doc_id), once per document row and key. Rows without an id have none."""
    return docs.where(F.col(id_col).isNotNull()).select(
        F.explode(F.array_distinct(_digests(F.col(text_col), min_chars))).alias("digest"), F.col(id_col).cast("long").alias("doc_id"),
    )


def reference_counts(rows: DataFrame) -> DataFrame:
    """The exact table. Rows of one document that repeat a key count by document: repeated means two different ids."""
    return rows.groupBy("digest").agg(
        F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
    ).select("digest", F.when(F.col("first_doc") == F.col("last_doc"), 1).otherwise(F.col("n_rows")).alias("n_docs"), "first_doc")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _build(rows: pa.Table) -> pa.Table:
    made = CuckooFilter.of(_keys(rows["digest"]))
    return pa.table({"shard": rows["shard"][:1], "marks": pa.array([made.marks.tobytes()], pa.binary())})


def build_state(docs: DataFrame, **columns: str) -> LineState:
    """Count every line key of ``docs`` and build the filters of repeated keys."""
    rows = written(postings(docs, **columns), "line-postings")
    counts = written(reference_counts(rows), "line-counts")
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    shards = max(MIN_SHARDS, -(-total // POSTINGS_PER_SHARD))
    repeated = counts.where("n_docs > 1").select(_shard(shards), "digest")
    filters = written(repeated.groupBy("shard").applyInArrow(_build, "shard int, marks binary"), "line-filters")
    return LineState(rows, counts, filters, shards)


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    if not rows.num_rows or not filters.num_rows:
        return rows.select(["doc_id", "digest"]).slice(0, 0)
    marks = np.frombuffer(filters["marks"][0].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS)
    hits = CuckooFilter(marks).contains(_keys(rows["digest"]))
    return rows.select(["doc_id", "digest"]).filter(pa.array(hits))


def repeated_lines(rows: DataFrame, state: LineState) -> DataFrame:
    """(doc_id, digest) of ``rows`` whose key an earlier document holds: filter first, then the exact table."""
    total = state.counts.agg(F.sum("n_docs")).first()[0] or 0
    exact = state.counts.where("n_docs > 1").select("digest", "first_doc", "n_docs")
    hot = F.broadcast(exact.where(F.col("n_docs") > total / HOT_KEYS).select("digest", F.col("first_doc").alias("hot_first")))
    routed = rows.join(hot, "digest", "left")
    by_hot = routed.where("doc_id > hot_first").select("doc_id", "digest")
    # Shards that hold more than two tasks' worth: at most one for every so many postings.
    loads = state.counts.where(F.col("n_docs") <= total / HOT_KEYS).groupBy(_shard(state.shards)).agg(F.sum("n_docs").alias("load"))
    salted = loads.where(F.col("load") > 2 * POSTINGS_PER_SHARD).select("shard", F.ceil(F.col("load") / POSTINGS_PER_SHARD).cast("int").alias("salts"))
    cold = routed.where("hot_first is null").select(_shard(state.shards), "doc_id", "digest").join(salted, "shard", "left")
    cold = cold.select("shard", F.pmod(F.xxhash64("doc_id", "digest"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "doc_id", "digest")
    filters = state.filters.join(salted, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), "marks")
    passed = cold.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(_probe, "doc_id long, digest binary")
    return passed.join(exact, "digest").where("doc_id > first_doc").select("doc_id", "digest").unionByName(by_hot)


def _line_key(line: str) -> bytes | None:
    key = line.strip(BLANKS).translate(_LOWERED)
    return hashlib.md5(key.encode()).digest() if len(key) >= MIN_CHARS else None


_LOWERED = str.maketrans(UPPER, LOWER)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shards_of(batch, "__text", TEXT_BYTES):
            texts, n_lines, n_dropped = [], [], []
            for doc_id, text, drop in zip(*(part[c].to_pylist() for c in ("__id", "__text", "__drop"))):
                lines = (text or "").split("\n")
                gone = set(drop or ()) if doc_id is not None else ()
                kept = [x for x in lines if _line_key(x) not in gone] if gone else lines
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            out = part.drop_columns(["__id", "__text", "__drop"])
            for name, values, kind in (("__kept", texts, pa.string()), ("__lines", n_lines, pa.int64()), ("__dropped", n_dropped, pa.int64())):
                out = out.append_column(name, pa.array(values, kind))
            yield out


def dedup_lines(docs: DataFrame, state: LineState | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, plus ``__lines`` and ``__dropped``.

    A line goes if its key has at least ten code points and a document with a smaller id holds it too. Null or empty
    text is one empty line and stays; rows without an id keep all lines; rows that share an id are one document; rows
    may repeat; an empty table gives no rows; all other columns pass through.
    """
    rows = postings(docs, id_col, text_col) if state else None
    state = state or build_state(docs, id_col=id_col, text_col=text_col)
    drops = repeated_lines(state.postings if rows is None else rows, state).groupBy(F.col("doc_id").alias("__key")).agg(F.collect_set("digest").alias("__drop"))
    others = [c for c in docs.columns if c != text_col]
    # Rows without an id are dealt by their text; should that meet an id, what it finds is passed over.
    keyed = docs.select(*others, F.col(text_col).alias("__text"), F.col(id_col).cast("long").alias("__id")).withColumn("__key", F.coalesce("__id", F.xxhash64("__text")))
    joined = keyed.join(drops, "__key", "left").drop("__key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    cut = joined.mapInArrow(_cut, f"{schema}, __kept string, __lines long, __dropped long")
    return cut.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in docs.columns], "__lines", "__dropped")


def insert_documents(state: LineState, docs: DataFrame) -> LineState:
    """The state with ``docs`` (ids not in it yet) added. Only keys whose count crosses two enter the filters."""
    new = written(postings(docs), "line-postings")
    merged = state.counts.select("digest", "n_docs", "first_doc", F.lit(0).alias("new")).unionByName(
        reference_counts(new).select("digest", "n_docs", "first_doc", F.lit(1).alias("new")))
    counts = written(merged.groupBy("digest").agg(
        F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.sum(F.when(F.col("new") == 0, F.col("n_docs")).otherwise(0)).alias("was")), "line-counts")
    changed = counts.where("n_docs > 1 and was < 2").select(_shard(state.shards), "digest", F.lit(True).alias("enters"))
    return _next_state(state, state.postings.unionByName(new), counts.drop("was"), changed)


def delete_documents(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents in ``doc_ids`` (doc_id). Keys that fall below two leave the filters.

    Only the keys of these documents are counted anew, over the written postings of the others.
    """
    gone = written(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "line-deleted")
    touched = written(state.postings.join(gone, "doc_id", "left_semi").select("digest").distinct(), "line-touched")
    left = state.postings.join(gone, "doc_id", "left_anti").select("digest", "doc_id")
    again = reference_counts(left.join(touched, "digest", "left_semi"))
    counts = written(state.counts.join(touched, "digest", "left_anti").select(*again.columns).unionByName(again), "line-counts")
    before = state.counts.where("n_docs > 1").join(touched, "digest", "left_semi")
    now = counts.where("n_docs > 1").select("digest")
    changed = before.join(now, "digest", "left_anti").select(_shard(state.shards), "digest", F.lit(False).alias("enters"))
    return _next_state(state, left, counts, changed)


def _change(filters: pa.Table, changes: pa.Table) -> pa.Table:
    if not changes.num_rows:
        return filters
    keys, enters = _keys(changes["digest"]), np.array(changes["enters"].to_pylist(), bool)
    if not filters.num_rows:
        made = CuckooFilter.of(keys[enters])
    else:
        made = CuckooFilter(np.frombuffer(filters["marks"][0].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())
        made.delete(keys[~enters])
        if not made.insert(keys[enters]):
            return pa.table({"shard": changes["shard"][:1], "marks": pa.array([b""], pa.binary())})  # jammed: rebuilt below
    return pa.table({"shard": changes["shard"][:1], "marks": pa.array([made.marks.tobytes()], pa.binary())})


def _next_state(state: LineState, rows: DataFrame, counts: DataFrame, changed: DataFrame) -> LineState:
    filters = written(state.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(_change, "shard int, marks binary"), "line-filters")
    jammed = filters.where(F.length("marks") == 0).select("shard")
    again = counts.where("n_docs > 1").select(_shard(state.shards), "digest").join(jammed, "shard", "left_semi").groupBy("shard").applyInArrow(_build, "shard int, marks binary")
    return LineState(rows, counts, written(filters.where(F.length("marks") > 0).unionByName(again), "line-filters"), state.shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (k.doc_id > p.first_doc) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (p.first_doc IS NULL OR k.doc_id IS NULL OR k.doc_id = p.first_doc), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated p USING (key) GROUP BY k.r, k.doc_id
"""
