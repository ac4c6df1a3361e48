"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words holds, wherever it starts, one whole block of ``window / 2`` words at a multiple of that
length in the other document. So each document's non-overlapping blocks are the index, and every rolling window of a
block's length is a probe. Index and probes meet by hash: a probe that also is a block carries that in its position, so
one packed exchange serves both. Hits are anchors. Around each anchor (on both sides) the windows that contain it are
the only ones that can repeat; a second packed exchange of these finds, for each, the smallest document that has it. A
window of a later document is removed, so a run of removed windows is the anchor extended to its maximal repeat.

Neither exchange makes pairs. What a slice of documents can decide by itself is decided there and only marked, so a
passage of all documents costs a few entries a slice. Entries travel as packed arrays (hash bytes, position steps), a
row per slice and bucket. A word hash is 64 bits over the word's bytes; a window's removal rests on 96 bits over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written
from locusframe.llm.decontamination import shards_of

WINDOW = 50
SLICE_BYTES, PIECE_BYTES = 6 << 20, 1 << 18
MIN_BUCKETS, BUCKET_BYTES, MAX_FAN = 64, 12 << 20, 8192
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    if len(_powers.get(base, ())) <= n:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, PIECE_BYTES), base, np.uint64)])
    return _powers[base][: n + 1]


_Q, _R = 0x5851F42D4C957F2D, 0x27D4EB2F165667C5
_BACK = {base: pow(base, -1, 1 << 64) for base in (_Q, _R)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum(values * _power(base, len(values))[:-1])]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word (``[^\\x20\\x09-\\x0D]+``) in order; long texts go piece by piece, cut at blanks."""
    out, at = [], 0
    while at < len(text):
        stop = at + PIECE_BYTES
        while stop < len(text) and not (text[stop] == 32 or 9 <= text[stop] <= 13):
            stop += 1
        b = np.frombuffer(text, np.uint8, min(stop, len(text)) - at, at)
        word = np.r_[False, ~((b == 32) | ((b >= 9) & (b <= 13))), False]
        edge = np.flatnonzero(word[1:] != word[:-1])
        begin, end = edge[::2], edge[1::2]
        total = _sums(_BYTE[b], _R)
        out.append(_mix((total[end] - total[begin]) * _power(_BACK[_R], len(b))[begin] + (end - begin).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolling(hashes: np.ndarray, n: int, base: int = _Q) -> np.ndarray:
    """The hash of every n consecutive words; another ``base`` gives further bits."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = []
    for k in range(0, len(hashes) - n + 1, PIECE_BYTES):
        part = hashes[k : k + PIECE_BYTES + n - 1]
        total = _sums(part, base)
        out.append(_mix((total[n:] - total[:-n]) * _power(_BACK[base], len(part))[: len(part) - n + 1]))
    return np.concatenate(out)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the zeros of small numbers lie together, so that the shuffle's compression takes them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


@dataclass
class Entries:
    """Windows of some documents: two hashes, document id, text hash and place of each, by document and place."""

    hashes: np.ndarray  # uint64; the bucket is taken from the high bits
    more: np.ndarray  # uint32: further bits of the window, or zeros
    ids: np.ndarray
    texts: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, docs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> Entries:
        """From (doc_id, text hash, hashes, further bits, places) of each document."""
        sizes = [len(d[4]) for d in docs]
        return cls(*(np.concatenate([d[k] for d in docs]) for k in (2, 3)),
                   *(np.repeat(np.array([d[k] for d in docs], np.int64), sizes) for k in (0, 1)), np.concatenate([d[4] for d in docs]))

    def take(self, which: np.ndarray) -> Entries:
        return Entries(self.hashes[which], self.more[which], self.ids[which], self.texts[which], self.places[which])

    def ordered(self) -> Entries:
        return self.take(np.lexsort((self.places, self.texts, self.ids)))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order that brings equal windows together, where each group begins in it, and each group's size."""
        order = np.argsort(self.hashes, kind="stable")
        h, m = self.hashes[order], self.more[order]
        if ((h[1:] == h[:-1]) & (m[1:] != m[:-1])).any():
            order = np.lexsort((self.more, self.hashes))
            h, m = self.hashes[order], self.more[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
        return order, first, np.diff(np.r_[first, len(order)])


PACKED = "bucket int, known boolean, n int, hashes binary, more binary, steps binary, ids binary, texts binary, sizes binary"
_NAMES = ["bucket", "known", "n", "hashes", "more", "steps", "ids", "texts", "sizes"]


def pack(found: Entries, bucket: np.ndarray, known: Entries, other: int, width: int) -> pa.RecordBatch:
    """Rows of ``PACKED``: a row per bucket with the entries ``found`` in it, and one with those whose fate is ``known``,
    in the bucket ``other``.

    A row names only the documents that have an entry in it, so an entry costs the same however many buckets there are.
    Of a hash its low ``width`` bytes travel; of known entries none.
    """
    rows: dict[str, list] = {k: [] for k in _NAMES}

    def add(bucket: int, e: Entries, of: slice, is_known: bool) -> None:
        ids, texts, places = e.ids[of], e.texts[of], e.places[of]
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])])
        steps = np.diff(np.r_[0, places])
        steps[first] = places[first]
        rows["bucket"].append(bucket)
        rows["known"].append(is_known)
        rows["n"].append(len(ids))
        rows["hashes"].append(b"" if is_known else np.ascontiguousarray(e.hashes[of].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())
        rows["more"].append(e.more[of].tobytes() if width == 8 and not is_known else b"")
        rows["steps"].append(_planes(steps.astype(np.uint32)))
        rows["ids"].append(_planes(np.diff(np.r_[0, ids[first]])))
        rows["texts"].append(texts[first].tobytes() if texts.any() else b"")
        rows["sizes"].append(_planes(np.diff(np.r_[first, len(ids)]).astype(np.uint32)))

    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    found, bucket = found.take(order), bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        add(int(bucket[a]), found, slice(a, b), False)
    if len(known.ids):
        add(other, known, slice(None), True)
    kinds = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in zip(_NAMES, kinds)], _NAMES)


def _unpack(rows: list[dict], width: int) -> Entries:
    parts = []
    for r in rows:
        n = r["n"]
        hashes = np.zeros((n, 8), np.uint8)
        if not r["known"]:
            hashes[:, :width] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, width)
        sizes = _unplaned(r["sizes"], np.uint32).astype(np.int64)
        ids = np.cumsum(_unplaned(r["ids"], np.int64))
        texts = np.frombuffer(r["texts"], np.int64) if r["texts"] else np.zeros(len(ids), np.int64)
        steps = _unplaned(r["steps"], np.uint32).astype(np.int64)
        total, first = np.cumsum(steps), np.cumsum(sizes) - sizes
        parts.append((hashes.view(np.uint64).reshape(-1), np.frombuffer(r["more"], np.uint32) if r["more"] else np.zeros(n, np.uint32),
                      np.repeat(ids, sizes), np.repeat(texts, sizes), total - np.repeat(total[first] - steps[first], sizes)))
    if not parts:
        return _NONE
    return Entries(*(np.concatenate(x) for x in zip(*parts)))


_NONE = Entries(np.zeros(0, np.uint64), np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 3)


def _shared(e: Entries, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(known, sent): windows of a block's length that several of these documents have, and those that others must see.

    A window that several documents of one slice have is a hit whoever else has it. Of those the entries of the smallest
    and the largest id and one at a block go on, so a passage of every document costs three entries a slice.
    """
    order, first, sizes = e.groups()
    ids = e.ids[order]
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    several = np.repeat(low != high, sizes)
    at_block = e.places[order] % block == 0
    group = np.repeat(np.arange(len(first)), sizes)
    sent = ~several
    for mine in (ids == low[group], ids == high[group], at_block):
        which = np.flatnonzero(several & mine)
        sent[which[np.unique(group[which], return_index=True)[1]]] = True
    return order[several], order[sent]


def _later_here(e: Entries) -> tuple[np.ndarray, np.ndarray]:
    """(known, sent): windows that a document of these with a smaller id has, and the others."""
    order, first, sizes = e.groups()
    ids = e.ids[order]
    gone = ids > np.repeat(np.minimum.reduceat(ids, first), sizes)
    return order[gone], order[~gone]


def _packed(e: Entries, split, buckets: int, width: int, inside: int | None = None) -> pa.RecordBatch:
    """The rows of a slice. The bucket is taken from a hash's high bits; one ``inside`` a coarse bucket from its low bits."""
    known, sent = split(e)
    found, known = e.take(np.sort(sent)), e.take(np.sort(known))
    bits = found.hashes >> np.uint64(32) if inside is None else found.hashes & np.uint64(0xFFFFFFFF)
    bucket, first = (bits * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (inside or 0) * buckets
    return pack(found, bucket + first, known, first + int(e.places[-1] + e.ids[-1]) % buckets, width)


def _by_document(e: Entries) -> pa.Table:
    e = e.ordered()
    first = np.flatnonzero(np.r_[True, (e.ids[1:] != e.ids[:-1]) | (e.texts[1:] != e.texts[:-1])]) if len(e.ids) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(e.ids)], pa.int32()), pa.array(e.places.astype(np.int32)))
    return pa.table({"doc_id": e.ids[first], "row": e.texts[first], "places": lists})


def _both(rows: pa.Table, width: int) -> tuple[Entries, Entries]:
    listed = rows.to_pylist()
    return _unpack([r for r in listed if not r["known"]], width), _unpack([r for r in listed if r["known"]], width)


def _joined(a: Entries, b: Entries) -> Entries:
    return Entries(*(np.concatenate([getattr(a, f), getattr(b, f)]) for f in ("hashes", "more", "ids", "texts", "places")))


def _anchors(block: int):
    def find(rows: pa.Table) -> pa.Table:
        e, known = _both(rows, 5)
        if len(e.ids):
            order, first, sizes = e.groups()
            indexed = np.add.reduceat((e.places[order] % block == 0).astype(np.int64), first) > 0
            several = np.minimum.reduceat(e.ids[order], first) != np.maximum.reduceat(e.ids[order], first)
            e = e.take(order[np.repeat(indexed & several, sizes)])
        return _by_document(_joined(e, known))

    return find


def _later(rows: pa.Table) -> pa.Table:
    e, known = _both(rows, 8)
    if len(e.ids):
        e = e.take(_later_here(e)[0])
    return _by_document(_joined(e, known))


FOUND = "doc_id long, row long, places array<int>"


def _probes(window: int, buckets: int):
    block = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "text", SLICE_BYTES):
                docs = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    words = word_hashes(text.encode("utf-8", "surrogatepass"))
                    if len(words) >= window:
                        found = rolling(words, block)
                        docs.append((doc_id, 0, found, np.zeros(len(found), np.uint32), np.arange(len(found))))
                if docs:
                    yield _packed(Entries.of(docs), lambda e: _shared(e, block), buckets, 5)

    return probe


def _candidates(window: int, buckets: int):
    block = window // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "__text", SLICE_BYTES):
                docs = []
                for doc_id, row, text, anchors in zip(*(part[c].to_pylist() for c in ("__id", "__row", "__text", "__anchors"))):
                    if doc_id is None or not anchors:
                        continue
                    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
                    found = rolling(words, window)
                    edge = np.zeros(len(found) + window + block + 1, np.int64)  # windows that contain an anchor
                    at = np.array(anchors, np.int64)
                    at = at[at < len(found) + block]
                    np.add.at(edge, np.maximum(at - (window - block), 0), 1)
                    np.add.at(edge, at + 1, -1)
                    places = np.flatnonzero(np.cumsum(edge)[: len(found)] > 0)
                    if len(places):
                        more = (rolling(words, window, _R)[places] >> np.uint64(32)).astype(np.uint32)
                        docs.append((doc_id, row, found[places], more, places))
                if docs:
                    yield _packed(Entries.of(docs).ordered(), _later_here, buckets, 8)

    return windows


def _finer(width: int, buckets: int, split):
    """Packs the rows of each coarse bucket again, by the ``buckets`` fine ones in it."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"] != held[0]["bucket"] or sum(r["n"] for r in held) + row["n"] > SLICE_BYTES // 4):
                    yield _packed(_unpack(held, width).ordered(), split, buckets, width, held[0]["bucket"])
                    held = []
                if row["known"]:
                    yield pa.RecordBatch.from_pylist([row | {"bucket": row["bucket"] * buckets}], batch.schema)
                else:
                    held.append(row)
        if held:
            yield _packed(_unpack(held, width).ordered(), split, buckets, width, held[0]["bucket"])

    return again


def _exchanged(packed, window: int, buckets: int, width: int, split) -> DataFrame:
    """Packed rows ready to be grouped by bucket. Beyond MAX_FAN buckets they go by coarse buckets first, so a row never
    holds less than a fair number of entries: one more exchange, but the volume stays in proportion to the input."""
    if buckets <= MAX_FAN:
        return packed(window, buckets)
    coarse = -(-buckets // MAX_FAN)
    rows = packed(window, coarse).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return rows.mapInArrow(_finer(width, MAX_FAN, split), PACKED)


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "__text", SLICE_BYTES):
                texts, counts, gone = [], [], []
                for doc_id, text, row, found in zip(*(part[c].to_pylist() for c in ("__id", "__text", "__row", "__removed"))):
                    removed = [k for f in found or () if doc_id is not None and f["row"] == row for k in f["places"]]
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    if removed:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, np.array(removed), 1)
                        np.add.at(edge, np.array(removed) + window, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    gone.append(counts[-1] - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                out = part.drop_columns(["__id", "__text", "__row", "__removed"])
                for name, values, kind in (("__kept", texts, pa.string()), ("__n", counts, pa.int64()), ("__gone", gone, pa.int64())):
                    out = out.append_column(name, pa.array(values, kind))
                yield out

    return cut


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space, plus ``__words`` and ``__removed``.

    A word goes if a window of ``window`` words (an even number) that covers it also starts in a document with a
    smaller id. Null or empty text has no words; rows without an id keep all words and remove none elsewhere; rows that
    share an id do not remove each other; rows may repeat; an empty table gives no rows; other columns pass through.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    block = window // 2
    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    probes = _exchanged(lambda w, n: named.mapInArrow(_probes(w, n), PACKED), window, buckets, 5, lambda e: _shared(e, block))
    hits = written(probes.groupBy("bucket").applyInArrow(_anchors(block), FOUND), "anchors")
    anchors = hits.groupBy(F.col("doc_id").alias("__aid")).agg(F.flatten(F.collect_list("places")).alias("__anchors"))
    # Both joins below are left joins on the same columns of the same exchange, so texts are shuffled once. Rows without
    # an id are dealt by their text; should that meet an id, what it finds is passed over.
    keyed = docs.select(*[c for c in docs.columns if c != text_col], F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__row"))
    keyed = keyed.withColumn("__key", F.coalesce("__id", "__row")).repartition("__key")
    near = keyed.join(anchors.hint("shuffle_hash"), F.col("__key") == F.col("__aid"), "left")
    later = _exchanged(lambda w, n: near.mapInArrow(_candidates(w, n), PACKED), window, buckets, 8, _later_here)
    later = later.groupBy("bucket").applyInArrow(_later, FOUND)
    removed = later.groupBy(F.col("doc_id").alias("__rid")).agg(F.collect_list(F.struct("row", "places")).alias("__removed"))
    joined = keyed.join(removed.hint("shuffle_hash"), F.col("__key") == F.col("__rid"), "left").drop("__key", "__rid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("__id", "__text", "__row", "__removed").schema)
    cut = joined.mapInArrow(_cutter(window), f"{schema}, __kept string, __n long, __gone long")
    return cut.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in docs.columns], F.col("__n").alias("__words"), F.col("__gone").alias("__removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + {WINDOW} - 1], ' ')) AS phrase
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW} + 1)) AS i FROM docs WHERE doc_id IS NOT NULL)
), later AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS first_doc FROM places) WHERE doc_id > first_doc
), gone AS (
  SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(generate_series(i, i + {WINDOW} - 1)) AS k FROM later) GROUP BY r
), words AS (
  SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM docs
), kept AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY k) AS text
  FROM words LEFT JOIN (SELECT r, unnest(ks) AS k, true AS g FROM gone) d USING (r, k) WHERE g IS NULL GROUP BY words.r
)
SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
