"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a run of documents of one task. Its words become numbers (the benchmark's vocabulary; any other word ends a
stretch), its stretches are suffix-sorted, and their Burrows-Wheeler transform goes into a wavelet matrix. All test
phrases step backwards through it together by rank; rows of the ranges found walk left to a sampled suffix position;
the occurrences become word spans that are merged per document. No row is shuffled.

The benchmark is broadcast in blocks of a checked size, a dozen bytes for a byte of text. Each block is one more pass of
the same task over its rows, by a Python worker of its own, so a benchmark of many blocks takes memory for as many workers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written

#: Fixed values of the contract: the words of a text, and the words in a window.
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WINDOW = 10
#: Bytes of benchmark text in one broadcast block, and of training text in one index.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Words in one index: a longer text goes in stretches that overlap by a window less one word.
INDEX_WORDS = 1 << 20
SAMPLE = 16
_IN_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Phrases:
    """Windows of benchmark items as rows of word numbers, by length, each with the items that have it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                size = min(window, len(ids))
                by_length.setdefault(size, []).append((k, np.lib.stride_tricks.sliding_window_view(ids, size)))
        self.groups = []
        for length, found in sorted(by_length.items()):
            item = np.repeat(np.array([k for k, _ in found], np.int32), [len(rows) for _, rows in found])
            both = np.unique(np.c_[np.concatenate([rows for _, rows in found]), item], axis=0)  # each window of each item once
            first = np.flatnonzero(np.r_[True, (both[1:, :-1] != both[:-1, :-1]).any(axis=1)])
            self.groups.append((length, both[first, :-1].copy(), np.r_[first, len(both)], both[:, -1].astype(np.int64)))
        self.shortest = min(by_length, default=0)
        self.longest = max(by_length, default=0)


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit of the symbols a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            ones = np.r_[0, np.cumsum(bits)]
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = symbols[np.argsort(bits, kind="stable")]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place upto[i]."""
        first = np.zeros_like(upto)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            first = np.where(one, zeros + ones[first], first - ones[first])
            upto = np.where(one, zeros + ones[upto], upto - ones[upto])
        return upto - first


class FMIndex:
    """Backward search over stretches of positive symbols; 0 ends a stretch and the text."""

    def __init__(self, text: np.ndarray, top: int):
        n, ends = len(text), text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())  # each end is its own smallest symbol
        width = 1
        while True:  # prefix doubling; an end is unique, so no comparison runs past its stretch
            after = np.r_[rank[width:], np.full(min(width, n), -1)]
            order = np.lexsort((after, rank))
            step = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(step)]
            if n < 2 or rank[order[-1]] == n - 1:
                break
            width *= 2
        self.bwt = text[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.ranks = WaveletMatrix(self.bwt, top)
        position = np.arange(n)
        begins = np.r_[True, ends[:-1]]
        since = position - np.maximum.accumulate(np.where(begins, position, 0))
        self.sampled = np.where((since % SAMPLE == 0)[order], order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k].astype(np.int64)
            low[alive] = self.first[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, walking, steps = self.sampled[rows], np.arange(len(rows)), 0
        rows = rows.copy()
        while len(walking := walking[found[walking] < 0]):
            steps += 1
            at = rows[walking]
            symbol = self.bwt[at]
            rows[walking] = self.first[symbol] + self.ranks.rank(symbol, at)
            hit = self.sampled[rows[walking]]
            found[walking] = np.where(hit >= 0, hit + steps, -1)
        return found


def search_shard(texts: list[str | None], phrases: Phrases, index_words: int | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """Per text: its words, its merged hit spans (word numbers, end exclusive), and the items that occur."""
    most = index_words or INDEX_WORDS
    known = phrases.vocabulary.get
    ids, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        ids.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
    begin = np.r_[0, np.cumsum(counts)]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if not phrases.shortest or not begin[-1]:
        return counts, spans, items
    # Stretches of vocabulary words within a document, as long as the shortest phrase or longer; each is followed by a 0.
    flat = np.concatenate([*(x for a in ids for x in (a, _END))])
    word_at = np.arange(len(flat)) - np.repeat(np.arange(len(texts)), np.array(counts) + 1)
    edge = np.flatnonzero(np.diff(np.r_[0, flat > 0, 0]))
    starts, stops = edge[::2], edge[1::2]
    long = stops - starts >= phrases.shortest
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return counts, spans, items
    # Stretches longer than an index are cut with an overlap; what is found twice is merged. An index takes whole stretches.
    pieces = -(-(stops - starts) // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, stops = np.repeat(starts, pieces) + nth * most, np.repeat(stops, pieces)
    stops = np.minimum(stops, starts + most + phrases.longest - 1)
    size = stops - starts + 1
    batch = np.cumsum(size) // most
    cover = np.zeros(int(begin[-1]) + 1, np.int64)
    for b in np.unique(batch):
        start, n_words = starts[batch == b], size[batch == b]
        take = np.arange(n_words.sum()) + np.repeat(start - np.r_[0, np.cumsum(n_words)[:-1]], n_words)
        text = flat[take]
        text[np.cumsum(n_words) - 1] = 0
        index = FMIndex(text, len(phrases.vocabulary))
        for length, rows, owner_at, owners in phrases.groups:
            low, high = index.search(rows)
            n = high - low
            if not n.sum():
                continue
            which = np.repeat(np.arange(len(rows)), n)
            row = np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
            at = word_at[take[index.locate(row)]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(begin, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d].update(owners[owner_at[w] : owner_at[w + 1]].tolist())
    # Spans of different documents touch where one ends and the next begins, so they are cut at document starts.
    hit = np.cumsum(cover[:-1]) > 0
    for d in np.unique(np.searchsorted(begin, np.flatnonzero(hit), side="right") - 1).tolist():
        turn = np.flatnonzero(np.diff(np.r_[0, hit[begin[d] : begin[d + 1]], 0]))
        spans[d] = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
    return counts, spans, items


_END = np.zeros(1, np.int64)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def shards_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``limit`` characters, or of one row if that is longer."""
    start = held = 0
    for k, text in enumerate(batch[column]):
        n = len(text.as_buffer() or b"") if text.is_valid else 0
        if held and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _searcher(block: Broadcast, text_col: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for batch in batches:
            for part in shards_of(batch, text_col, SHARD_BYTES):
                counts, spans, items = search_shard(part[text_col].to_pylist(), phrases)
                before = part["__spans"].to_pylist()
                spans = [[*((s["start"], s["end"]) for s in old or []), *new] for old, new in zip(before, spans)]
                named = [sorted({*(old or []), *(phrases.names[i] for i in new)}) for old, new in zip(part["__items"].to_pylist(), items)]
                out = part.drop_columns(["__words", "__spans", "__items"])
                out = out.append_column("__words", pa.array(counts, pa.int64()))
                out = out.append_column("__spans", pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS))
                out = out.append_column("__items", pa.array(named, pa.list_(pa.string())))
                yield finish(out) if finish else out

    return search


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
               finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, finished: str | None = None) -> DataFrame:
    """``docs`` with ``__words``, ``__spans`` (hit words, to be merged) and ``__items`` (ids that occur, sorted as strings).

    Null or empty text has no words; items with a null id or text, or without words, have no window; rows and items may
    repeat (items of one id are one item); empty tables on either side give no hits; other columns pass through.
    A benchmark over ``block_bytes`` goes in blocks, one after the other: each is fetched, shared, searched for in all texts
    and its hits written before the next, so only one is held at a time. ``finish`` makes what is returned (``finished``, a
    schema) of each batch in the last pass, in the same worker.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", __words long, __spans array<struct<start:long,end:long>>, __items array<string>"
    out = docs.withColumns({"__words": F.lit(0).cast("long"), "__spans": F.array().cast("array<struct<start:long,end:long>>"), "__items": F.array().cast("array<string>")})
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        last = k == blocks - 1 and finish is not None
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in mine], window))
        out = out.mapInArrow(_searcher(phrases, text_col, finish if last else None), finished if last else schema)
        if k < blocks - 1:  # one block at a time on the driver and on the executors
            out = written(out, "leaks")
            phrases.unpersist()
    return out


def _cutter(text_col: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch[text_col].to_pylist()
        for k, spans in enumerate(batch["__spans"].to_pylist()):
            if not spans:
                continue
            words = [m.span() for m in _IN_WORD.finditer(texts[k])]
            merged = merge_spans([(s["start"], s["end"]) for s in spans])
            ends = [0, *(words[b - 1][1] for _, b in merged)]
            texts[k] = "".join([*(texts[k][end : words[a][0]] for end, (a, _) in zip(ends, merged)), texts[k][ends[-1] :]])
        out = batch.drop_columns(["__words", "__spans", "__items"])
        return out.set_column(out.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    return cut


def cut_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every merged span of benchmark words cut out of the text; other texts are left as they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return find_leaks(docs, benchmark, text_col, finish=_cutter(text_col), finished=schema)


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    hit = [sum(b - a for a, b in merge_spans([(s["start"], s["end"]) for s in x])) for x in batch["__spans"].to_pylist()]
    items = batch["__items"].to_pylist()
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], batch["__words"], pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
         pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit])],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), finish=_digest,
                      finished="doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), items AS (
  SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows))
), found AS (
  SELECT r, item_id, i, p.n FROM places p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase
), hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
