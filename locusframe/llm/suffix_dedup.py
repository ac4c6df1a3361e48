"""Suffix-array dedup of bytes: maximal repeats of ``window`` bytes or more, by the common-prefix interval tree.

A corpus has no one suffix array. Its suffixes are sharded by content: every string of ``window`` bytes holds an anchor,
the position of its smallest hash among its strings of GRAM bytes, and equal strings hold equal anchors. An anchor's
context is all strings of the window's length that can hold it. Contexts with one anchor meet in one shard, so a shard
sees every occurrence of every string that it is in charge of.

Contexts meet as hashes first (bytes do not travel): of equal contexts all but those of the smallest document are marked
as removed there and then, and an anchor whose contexts are all equal needs nothing more. Where an anchor has several
contexts, one of each goes on as bytes. A shard sorts their suffixes, takes common-prefix lengths, and scans them with a
stack: each interval of the tree whose suffixes are preceded by different bytes is a maximal repeat with all its
occurrences. Occurrences in later documents than the first are removed.

Equal contexts of one slice of documents are merged before any exchange, so a passage of all documents costs one entry a
slice. Equality of contexts rests on 96 bits and more (64 of the context, 32 and the shard's bits of its anchor).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written
from locusframe.llm.decontamination import shards_of
from locusframe.llm.substring_dedup import _BACK, _BYTE, _R, PACKED, Entries, _both, _joined, _later_here, _mix, _power, _sums, _unpack, pack

WINDOW, GRAM = 50, 24
SLICE_BYTES, PIECE_BYTES = 2 << 20, 1 << 18
MIN_BUCKETS, BUCKET_BYTES, MAX_FAN = 64, 4 << 20, 8192


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    out = np.empty(max(len(text) - 7, 0), np.uint64)
    for s in range(min(8, len(out))):
        out[s::8] = np.frombuffer(text, "<u8", len(out[s::8]), s)
    return out


def gram_hashes(text: bytes, n: int, words: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """A hash of every ``n`` consecutive bytes (8 or more), over all of them."""
    words = _words(text) if words is None else words
    count = max(len(text) - n + 1, 0)
    h = np.full(count, _mix(np.array([seed + n], np.uint64))[0])
    for at in [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]:
        h = _mix(h ^ words[at : at + count])
    return h


def _sliding(h: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    out, k = h, 1
    while 2 * k <= n:
        out, k = pick(out[:-k], out[k:]), 2 * k
    return pick(out[: len(out) - (n - k)], out[n - k :]) if k < n else out


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) of texts of ``window`` bytes or more, long ones cut with overlap, in lists of about PIECE_BYTES."""
    held, size, rim = [], 0, 2 * window
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), PIECE_BYTES):
            begin, end = max(at - rim, 0), min(at + PIECE_BYTES + rim, len(text))
            held.append((k, begin, end))
            size += end - begin
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _context_hashes(data: bytes, begin: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[begin:end], its length and the place in it, from running sums."""
    total = _sums(_BYTE[np.frombuffer(data, np.uint8)], _R)
    own = (total[end] - total[begin]) * _power(_BACK[_R], len(data))[begin]
    return _mix(own + _mix(((places - begin) * 4096 + (end - begin)).astype(np.uint64)))


def anchors_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor hash, context hash): of every ``window`` bytes of each text an anchor, chosen by these bytes
    alone up to equal hashes, and its context: all strings of the window's length that can hold it.

    Texts go through together, long ones piece by piece. Where equal hashes crowd, as in a run of one byte, the first and
    last of every half reach are enough for each window to hold one.
    """
    reach, left = window - gram + 1, window - gram
    found = []
    for pieces in _pieces(texts, window):
        data = b"".join(texts[k][a:b] for k, a, b in pieces)
        text, first, size = (np.array(x, np.int64) for x in zip(*((k, a, b - a) for k, a, b in pieces)))
        stop = np.cumsum(size)
        start, whole = stop - size, np.array([len(texts[k]) for k in text.tolist()])
        h = gram_hashes(data, gram)
        low = _sliding(h, reach)
        for e in stop[:-1].tolist():  # windows that cross from one text to the next
            low[e - window + 1 : e] = 0
        rim = np.zeros(reach - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.r_[rim, low, rim], reach, np.maximum) == h)
        of = np.searchsorted(stop, at, side="right")
        begin, end = np.maximum(at - left, start[of]), np.minimum(at + window, stop[of])
        sure = (at + gram <= stop[of]) & ((at - left >= start[of]) | (first[of] == 0)) & ((at + window <= stop[of]) | (first[of] + size[of] == whole[of]))
        at, of, begin, end = at[sure], of[sure], begin[sure], end[sure]
        found.append((text[of], at - start[of] + first[of], h[at], _context_hashes(data, begin, end, at)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text, place, h, context = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, text))
    text, place, h, context = text[order], place[order], h[order], context[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])]  # pieces overlap
    text, place, h, context = text[new], place[new], h[new], context[new]
    fresh = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (np.diff(place) >= reach)]
    run = np.cumsum(fresh)
    cell = (place - place[fresh][run - 1]) // (reach // 2)
    new = np.r_[True, (run[1:] != run[:-1]) | (cell[1:] != cell[:-1])]
    keep = new | np.r_[new[1:], True]
    return text[keep], place[keep], h[keep], context[keep]


def _probes(window: int, gram: int, buckets: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "text", SLICE_BYTES):
                text, place, h, context = anchors_of([t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()], window, gram)
                if len(text):
                    ids, rows = (np.array(part[c].to_pylist(), np.int64)[text] for c in ("doc_id", "row"))
                    yield _split(Entries(context, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids, rows, place), h >> np.uint64(32), buckets)

    return probe


def _split(e: Entries, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A slice's rows: what a smaller document of the slice settles is only marked."""
    order = np.lexsort((e.places, e.texts, e.ids))
    e, key = e.take(order), key[order]
    known, sent = _later_here(e)
    sent, known = np.sort(sent), e.take(np.sort(known))
    bucket = (key[sent] * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return pack(e.take(sent), bucket, known, int(e.places[-1] + e.ids[-1]) % buckets, 8)


def _finer(fan: int):
    """Packs the rows of each coarse bucket again by the ``fan`` fine ones in it; what a smaller document among some hundred
    thousand entries settles is only marked, so a hot context of very many slices is a few entries then."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def packed() -> pa.RecordBatch:
            e = _unpack(held, 8).ordered()
            known, sent = _later_here(e)
            sent, known, first = np.sort(sent), e.take(np.sort(known)), held[0]["bucket"] * fan
            fine = (e.more[sent].astype(np.uint64) * np.uint64(fan) >> np.uint64(32)).astype(np.int64)
            return pack(e.take(sent), first + fine, known, first + int(e.places[-1] + e.ids[-1]) % fan, 8)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"] != held[0]["bucket"] or sum(r["n"] for r in held) + row["n"] > SLICE_BYTES // 4):
                    yield packed()
                    held = []
                if row["known"]:
                    yield pa.RecordBatch.from_pylist([row | {"bucket": row["bucket"] * fan}], batch.schema)
                else:
                    held.append(row)
        if held:
            yield packed()

    return again


def _exchanged(named: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Packed rows ready to be grouped by bucket. Beyond MAX_FAN buckets they go by coarse buckets first, so a row never
    holds less than a fair number of entries: one more exchange, but the volume stays in proportion to the input."""
    if buckets <= MAX_FAN:
        return named.mapInArrow(_probes(window, gram, buckets), PACKED)
    coarse = named.mapInArrow(_probes(window, gram, -(-buckets // MAX_FAN)), PACKED)
    return coarse.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_finer(MAX_FAN), PACKED)


def _lists(e: Entries, wanted: np.ndarray) -> pa.Table:
    """(doc_id, row, known, wanted): places by document, those whose context goes and those whose bytes are needed."""
    order = np.lexsort((e.places, wanted, e.texts, e.ids))
    e, wanted = e.take(order), wanted[order]
    first = np.flatnonzero(np.r_[True, (e.ids[1:] != e.ids[:-1]) | (e.texts[1:] != e.texts[:-1])]) if len(e.ids) else np.zeros(0, np.int64)
    ends = np.r_[first, len(e.ids)]
    places = e.places.astype(np.int32)
    asked = np.r_[0, np.cumsum(wanted)]
    known = pa.ListArray.from_arrays(pa.array((ends - asked[ends]).astype(np.int32)), pa.array(places[~wanted]))
    want = pa.ListArray.from_arrays(pa.array(asked[ends].astype(np.int32)), pa.array(places[wanted]))
    return pa.table({"doc_id": e.ids[first], "row": e.texts[first], "known": known, "wanted": want})


HITS = "doc_id long, row long, known array<int>, wanted array<int>"


def _settle(rows: pa.Table) -> pa.Table:
    """Contexts of a shard by their hashes: later copies go; one of each is wanted where an anchor has several contexts and
    these lie in several documents."""
    e, known = _both(rows, 8)
    wanted = np.zeros(0, bool)
    if len(e.ids):
        gone, rest = _later_here(e)
        left, gone = e.take(rest), e.take(gone)
        order = np.argsort(left.more, kind="stable")
        m, ids = left.more[order], left.ids[order]
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        left = left.take(order[np.repeat(several, np.diff(np.r_[first, len(m)]))])
        known = _joined(known, gone)
        wanted = np.ones(len(left.ids), bool)
        e = left
    return _lists(_joined(e, known), np.r_[wanted, np.zeros(len(known.ids), bool)])


CONTEXTS = "bucket int, ids binary, rows binary, begins binary, anchors binary, sizes binary, bytes binary"
_PARTS = ["ids", "rows", "begins", "anchors", "sizes"]


def _cut_out(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings data[begin : begin + size], each in a row of ``width`` bytes, and which of these are theirs."""
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(width, np.uint8)], width)[begin]
    return rows, np.arange(width) < size[:, None]


def _contexts(window: int, gram: int, buckets: int):
    left, width = window - gram, 2 * window - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "__text", SLICE_BYTES // 2):
                texts, ids, rows, places = [], [], [], []
                for doc_id, row, text, hits in zip(*(part[c].to_pylist() for c in ("__id", "__row", "__text", "__hits"))):
                    asked = [p for h in hits or () if doc_id is not None and h["row"] == row for p in h["wanted"]]
                    if asked:
                        texts.append((text or "").encode("utf-8", "surrogatepass"))
                        ids.append(doc_id)
                        rows.append(row)
                        places.append(np.array(asked, np.int64))
                if not texts:
                    continue
                data = np.frombuffer(b"".join(texts), np.uint8)
                of = np.repeat(np.arange(len(texts)), [len(p) for p in places])
                length = np.array([len(t) for t in texts])
                start = np.cumsum(length) - length
                place = np.concatenate(places)
                begin, end = np.maximum(place - left, 0), np.minimum(place + window, length[of])
                h = gram_hashes_of(_cut_out(data, start[of] + place, end - place, gram)[0])
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((h, bucket))
                of, place, begin, end, bucket = of[order], place[order], begin[order], end[order], bucket[order]
                cut, own = _cut_out(data, start[of] + begin, end - begin, width)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                parts = [np.array(ids, np.int64)[of], np.array(rows, np.int64)[of], begin, place - begin, end - begin]
                columns = [bucket[edge[:-1]].tolist(), *([x[a:b].tobytes() for a, b in zip(edge, edge[1:])] for x in parts), [cut[a:b][own[a:b]].tobytes() for a, b in zip(edge, edge[1:])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 6])], ["bucket", *_PARTS, "bytes"])

    return cut


def gram_hashes_of(rows: np.ndarray) -> np.ndarray:
    """The hash of each row of bytes, the same as in a text."""
    n = rows.shape[1]
    h = np.full(len(rows), _mix(np.array([n], np.uint64))[0])
    for at in [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]:
        h = _mix(h ^ np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").reshape(-1))
    return h


def suffix_array(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common): suffixes of ``window`` bytes or more of the strings in ``data``, in order, and the length
    that each shares with the one before (0 for the first)."""
    count = np.maximum(sizes - window + 1, 0)
    string = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    if not len(string):
        return string, offset, offset
    rest = sizes[string] - offset
    width = -(-int(rest.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(width, np.uint8)], width)[begins[string] + offset]
    rows[np.arange(width) >= rest[:, None]] = 0
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((rest, *keys.T[::-1]))
    rows, rest = rows[order], rest[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return string[order], offset[order], np.r_[0, np.minimum(common, np.minimum(rest[1:], rest[:-1]))]


def repeat_intervals(common: np.ndarray, before: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of each maximal repeat: the intervals of the common-prefix tree, found by one scan with a
    stack, whose suffixes are preceded by different bytes. ``before`` is that byte, negative where a string begins."""
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, first suffix, byte before all of them or -1
    runs = np.flatnonzero(common >= window)
    if not len(runs):
        return found
    values, previous = common.tolist(), before.tolist()

    def close(last: int, down_to: int) -> None:
        """Closes intervals longer than ``down_to``; what they are preceded by goes to the one around them."""
        while stack and stack[-1][0] > down_to:
            length, first, byte = stack.pop()
            if byte < 0:
                found.append((length, first, last))
            if stack and stack[-1][0] >= down_to:
                if stack[-1][2] != byte:
                    stack[-1][2] = -1
            elif down_to >= window:
                stack.append([down_to, first, byte])

    at = -2
    for k in runs.tolist():
        if k != at + 1:
            close(at, 0)
            stack.append([values[k], k - 1, previous[k - 1]])
        elif values[k] > stack[-1][0]:
            stack.append([values[k], k - 1, previous[k - 1]])
        else:
            close(k - 1, values[k])
        for top in (stack[-1],):
            if top[2] != previous[k]:
                top[2] = -1
        at = k
    close(at, 0)
    return found


def repeats_of(data: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repeat, length, string, offset): every occurrence of every maximal repeat in the strings that ``data`` joins."""
    begins = np.cumsum(sizes) - sizes
    string, offset, common = suffix_array(data, begins, sizes, window)
    before = np.where(offset > 0, data[np.maximum(begins[string] + offset - 1, 0)].astype(np.int64), -1) if len(string) else offset
    found = np.array(repeat_intervals(common, before, window), np.int64).reshape(-1, 3)
    length, first, n = found[:, 0], found[:, 1], found[:, 2] - found[:, 1] + 1
    repeat = np.repeat(np.arange(len(found)), n)
    which = np.arange(len(repeat)) - np.repeat(np.cumsum(n) - n, n) + first[repeat]
    return repeat, length[repeat], string[which], offset[which]


SPANS = "doc_id long, row long, starts array<int>, lengths array<int>"
#: Contexts in one suffix array: equal strings share an anchor, so a shard is cut between anchors.
TOGETHER = 4_000


def _later_repeats(window: int, gram: int):
    def find(rows: pa.Table) -> pa.Table:
        ids, texts, begins, anchors, sizes = (np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in rows[c]]) for c in _PARTS)
        data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
        at = np.cumsum(sizes) - sizes
        h = gram_hashes_of(_cut_out(data, at + anchors, sizes - anchors, gram)[0])
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        cuts = [0]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            if b - cuts[-1] > TOGETHER and a > cuts[-1]:
                cuts.append(a)
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            mine = order[a:b]
            cut, own = _cut_out(data, at[mine], sizes[mine], 2 * window - gram)
            repeat, length, string, offset = repeats_of(cut[own], sizes[mine], window)
            if len(repeat):
                string = mine[string]
                edge = np.flatnonzero(np.r_[True, repeat[1:] != repeat[:-1]])
                late = ids[string] > np.minimum.reduceat(ids[string], edge)[repeat]
                found.append((ids[string[late]], texts[string[late]], (begins[string] + offset)[late], length[late]))
        i, t, place, length = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((place, t, i))
        i, t, place, length = i[order], t[order], place[order], length[order]
        edge = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]) if len(i) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[edge, len(i)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, length)]
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": i[edge], "row": t[edge], "starts": lists[0], "lengths": lists[1]})

    return find


def _cutter(window: int, gram: int):
    left = window - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, "__text", SLICE_BYTES):
                kept, counts, gone, spans = [], [], [], []
                for doc_id, text, row, removed in zip(*(part[c].to_pylist() for c in ("__id", "__text", "__row", "__removed"))):
                    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                    if doc_id is None or not removed:
                        kept.append(raw.tobytes())
                        counts.append(len(raw))
                        gone.append(0)
                        spans.append(0)
                        continue
                    edge = np.zeros(len(raw) + 1, np.int32)
                    for r in removed:
                        if r["row"] == row:
                            start, length = np.array(r["starts"], np.int64), np.array(r["lengths"] or (), np.int64)
                            if not len(length):  # contexts
                                start, length = np.maximum(start - left, 0), np.minimum(start + window, len(raw)) - np.maximum(start - left, 0)
                            np.add.at(edge, start, 1)
                            np.add.at(edge, start + length, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    kept.append(raw[~out].tobytes())
                    counts.append(len(raw))
                    gone.append(int(out.sum()))
                    spans.append(int((np.diff(np.r_[0, out.astype(np.int8)]) == 1).sum()))
                result = part.drop_columns(["__id", "__text", "__row", "__removed"])
                for name, values, kind in (("__kept", kept, pa.binary()), ("__bytes", counts, pa.int64()), ("__gone", gone, pa.int64()), ("__spans", spans, pa.int64())):
                    result = result.append_column(name, pa.array(values, kind))
                yield result
            pa.default_memory_pool().release_unused()

    return cut


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__id`` and ``__row``: a hash of the text where several rows share the id, else 0."""
    keyed = docs.withColumn("__id", F.col(id_col).cast("long"))
    shared = written(keyed.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1 and __id is not null").select("__id", F.lit(True).alias("__several")), "shared-ids")
    zero = F.lit(0).cast("long")
    if shared.isEmpty():
        return keyed.withColumn("__row", zero)
    return keyed.join(shared, "__id", "left").withColumn("__row", F.when(F.col("__several"), F.xxhash64(text_col)).otherwise(zero)).drop("__several")


def dedup_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__kept`` (the remaining bytes of each text), ``__bytes``, ``__removed`` and ``__spans``.

    A byte goes if a string of ``window`` bytes (40 or more) that covers it also starts in a document with a smaller id;
    matches lie within a document and are judged on the input. A cut may fall inside a character, so what is kept is
    bytes. Null or empty text has none; rows without an id keep all and remove nothing elsewhere; rows that share an id do
    not remove each other; rows may repeat; an empty table gives no rows; other columns pass through.
    """
    if window < GRAM + 16:
        raise ValueError(f"window under {GRAM + 16}")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    rows = _with_rows(docs, id_col, text_col)
    named = rows.where(F.col("__id").isNotNull() & F.col(text_col).isNotNull()).select(F.col("__id").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    hits = written(_exchanged(named, window, GRAM, buckets).groupBy("bucket").applyInArrow(_settle, HITS), "contexts")
    asked = hits.where(F.size("wanted") > 0).groupBy(F.col("doc_id").alias("__aid")).agg(F.collect_list(F.struct("row", "wanted")).alias("__hits"))
    # Both joins below are left joins on the same columns of the same exchange, so texts are shuffled once. Rows without
    # an id are dealt by their text; should that meet an id, what it finds is passed over.
    keyed = rows.select(*[c for c in docs.columns if c != text_col], "__id", F.col(text_col).alias("__text"), "__row")
    keyed = keyed.withColumn("__key", F.coalesce("__id", F.xxhash64("__text"))).repartition("__key")
    near = keyed.join(asked.hint("shuffle_hash"), F.col("__key") == F.col("__aid"), "left")
    spans = near.mapInArrow(_contexts(window, GRAM, buckets), CONTEXTS).groupBy("bucket").applyInArrow(_later_repeats(window, GRAM), SPANS)
    whole = hits.where(F.size("known") > 0).select("doc_id", "row", F.col("known").alias("starts"), F.array().cast("array<int>").alias("lengths"))
    removed = whole.unionByName(spans).groupBy(F.col("doc_id").alias("__rid")).agg(F.collect_list(F.struct("row", "starts", "lengths")).alias("__removed"))
    joined = keyed.join(removed.hint("shuffle_hash"), F.col("__key") == F.col("__rid"), "left").drop("__key", "__rid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("__id", "__text", "__row", "__removed").schema)
    cut = joined.mapInArrow(_cutter(window, GRAM), f"{schema}, __kept binary, __bytes long, __gone long, __spans long")
    others = [F.col(c) for c in docs.columns if c != text_col]
    return cut.select(*others, "__kept", "__bytes", F.col("__gone").alias("__removed"), "__spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_bytes(docs).select(
        "doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits.
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), places AS (
  SELECT r, doc_id, i, md5(x[2 * i - 1 : 2 * i + 2 * {WINDOW} - 2]) AS phrase
  FROM (SELECT r, doc_id, x, unnest(generate_series(1, len(x) // 2 - {WINDOW} + 1)) AS i FROM docs WHERE doc_id IS NOT NULL)
), firsts AS (
  SELECT phrase, min(doc_id) AS first_doc FROM places GROUP BY phrase HAVING min(doc_id) < max(doc_id)
), later AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {WINDOW} AS goes_on FROM places JOIN firsts USING (phrase) WHERE doc_id > first_doc
), spans AS (
  SELECT r, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT r, i, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM later) GROUP BY r, k
), parts AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS since, lead(a) OVER (PARTITION BY r ORDER BY a) IS NULL AS last FROM spans
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
    string_agg(x[2 * since - 1 : 2 * a - 2] || CASE WHEN last THEN x[2 * b - 1 :] ELSE '' END, '' ORDER BY a) AS x
  FROM parts JOIN docs USING (r) GROUP BY r
)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r)
"""
