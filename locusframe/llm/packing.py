"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. After window ``w`` a queue should have been served its target share of ``w`` windows;
what it lacks is its deficit, which is carried on. A window's places go, one after the other, to the queue that is
furthest behind (Webster's rule, ties to the first queue), so every window is full and no deficit reaches a few tokens.
The service a queue has had by any window is a function of the token totals alone. A task therefore computes the
deficits that it takes over at its first window instead of waiting for the tasks before it.

A queue that runs dry leaves the round and the others share by their targets. Two passes: tokens of each document are
written once; the queues' totals and the place of each task's rows in each queue (one row a task and queue) then place
every piece.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm.common import table, written
from locusframe.llm.decontamination import shards_of

#: Fixed values of the contract.
CAPACITY = 2048
END_OF_DOCUMENT = 1
#: Beyond so many sources those without a target share so many queues, each source at its own share of its queue, so what is broadcast stays small.
MAX_QUEUES = 512
CACHED_WORDS = 200_000
#: Bytes of text in one slice.
SLICE_BYTES = 1 << 20


#: What the shortcuts below hold for: each blank ends a token, letters of any case are one piece, marks another.
_KNOWN = {
    "type": "BPE", "end_of_word_suffix": "</w>", "normalizers": ["NFC", "Replace", "Lowercase"],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
_made: dict[str, WordTokens] = {}


class WordTokens(dict):
    """Packed ids of words, found when first asked for. White space ends every token of this tokenizer, so words stand alone.

    A word of small Latin letters is one piece for the tokenizer's model; a run of marks after a plain letter is a piece
    of its own; all other words go through the whole tokenizer. A tokenizer with other rules reads whole texts instead.
    Words are kept for the whole life of the Python worker, at most two generations of CACHED_WORDS.
    """

    #: Marks that may follow a word; those that special tokens and contractions are made of are not among them.
    MARKS = ".,!?;:*#$%&)-"

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.end = self._packed([END_OF_DOCUMENT])
        self.older: dict[str, bytes] = {}
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.by_word = _rules(self.tokenizer) == _KNOWN

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The one of this Python worker."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0180"):
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return self._packed([t.id for t in self.model.tokenize(shown)])
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            core = word.rstrip(self.MARKS)
            # Small letters below U+0180 keep their last letter in lower case; others (capital dotted I) may end in a mark.
            if core and core != word and core[-1] < "\u0180" and core[-1].islower():
                found = self[core] + self[word[len(core) :]]
            else:
                found = self._word(word)
        self[word] = found
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned ids (``kind``) of each text, then the end of the document."""
        if not self.by_word:
            return [self._packed(x.ids) + self.end for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out = []
        for t in texts:
            t = t or ""
            # Without a special token case does not matter to the tokenizer, but for I and a dot above, which it composes first.
            if "<|" not in t and "\u0307" not in t:
                t = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            out.append(b"".join([*map(self.__getitem__, filter(None, t.replace("\n", " ").split(" "))), self.end]))
            if len(self) > CACHED_WORDS:
                self.older = dict(self)
                self.clear()
        return out


def _rules(tokenizer: Tokenizer) -> dict:
    """The rules of a tokenizer that WordTokens relies on."""
    made = json.loads(tokenizer.to_str())
    steps = (made.get("normalizer") or {}).get("normalizers") or []
    pieces = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    level = pieces[-1]
    plain = level.get("type") == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and len(pieces) == 2
    return {
        "type": made["model"]["type"], "end_of_word_suffix": made["model"].get("end_of_word_suffix"), "normalizers": [x["type"] for x in steps],
        "split": pieces[0].get("pattern", {}).get("Regex") if plain else None,
    }


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models show for each byte: its own if it prints, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


def _tokenizer(path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = WordTokens.of(path), TaskContext.get().partitionId()
        width = np.dtype(made.kind).itemsize
        served: dict[str, int] = {}
        for batch in batches:
            for part in shards_of(batch, "text", SLICE_BYTES):
                ids = made.ids(part["text"].to_pylist())
                before = []
                for queue, x in zip(part["queue"].to_pylist(), ids):
                    before.append(served.get(queue, 0))
                    served[queue] = before[-1] + len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * part.num_rows, pa.int32()), part["queue"], part["doc_id"], pa.array(before, pa.int64()),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["chunk", "queue", "doc_id", "before", "n", "ids"])
        made.older = {}  # what an idle worker holds is one generation

    return tokenize


@dataclass
class Schedule:
    """Who is served what: phases of (first rank, tokens of each queue before it, tokens of each queue in it)."""

    phases: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    total: int = 0

    @classmethod
    def of(cls, totals: list[int], targets: list[float]) -> Schedule:
        left, used, made = np.array(totals, np.int64), np.zeros(len(totals), np.int64), cls()
        while left.sum():
            share = np.where(left > 0, np.array(targets, float), 0.0)
            if not share.sum():
                share = left.astype(float)
            rounds = (left[share > 0] / share[share > 0]).min()
            n = np.where(share > 0, np.minimum(left, np.floor(share * rounds + 1e-6)), 0).astype(np.int64)
            if not n.sum():
                n = np.where(share > 0, np.minimum(left, 1), 0)
            made.phases.append((made.total, used.copy(), n))
            made.total += int(n.sum())
            used, left = used + n, left - n
        return made

    def rank(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About which token of all the place-th of its queue is; within as many as there are queues."""
        out = np.zeros(len(queue))
        for first, used, n in self.phases:
            inside = (place >= used[queue]) & (place < used[queue] + n[queue])
            q = queue[inside]
            out[inside] = first + (place[inside] - used[q] + 0.5) / n[q] * n.sum()
        return out

    def served(self, ranks: np.ndarray) -> np.ndarray:
        """(ranks, queues): tokens of each queue among the first so many of all."""
        out = np.zeros((len(ranks), len(self.phases[0][1]) if self.phases else 0), np.int64)
        for first, used, n in self.phases:
            here = np.flatnonzero((ranks >= first) & ((ranks < first + n.sum()) | (ranks == self.total)))
            live = np.flatnonzero(n)
            for k in range(0, len(here), 4096):
                at = here[k : k + 4096]
                x = (ranks[at] - first)[:, None]
                share = n[live][None, :] / n.sum()
                got = np.clip(np.floor(x * share - (len(live) / 2 + 1) * share - 1.5), 0, None).astype(np.int64)
                rows = np.arange(len(at))
                while (rows := rows[got[rows].sum(axis=1) < x[rows, 0]]).size:
                    most = np.argmin(np.where(got[rows] < n[live], (got[rows] + 0.5) / n[live], np.inf), axis=1)
                    got[rows, most] += 1
                out[at] = used
                out[np.ix_(at, live)] += got
        return out


def _placer(schedule: Schedule, number: dict[str, int], capacity: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                yield _pieces(batch.slice(k, 500), schedule, number, capacity)

    return place


def _pieces(batch: pa.RecordBatch, schedule: Schedule, number: dict[str, int], capacity: int) -> pa.RecordBatch:
    queue = np.array([number[q] for q in batch["queue"].to_pylist()], np.int64)
    start = batch["start"].to_numpy(zero_copy_only=False)
    n = batch["n"].to_numpy(zero_copy_only=False)
    # A window or two on each side make up for the estimate; what does not overlap falls away.
    spare = 1 + -(-len(number) // capacity)
    low = np.maximum(schedule.rank(queue, start) // capacity - spare, 0).astype(np.int64)
    high = np.minimum(schedule.rank(queue, start + n - 1) // capacity + spare, (schedule.total - 1) // capacity).astype(np.int64)
    many = high - low + 1
    doc = np.repeat(np.arange(len(n)), many)
    window = np.arange(many.sum()) + np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
    edges = np.unique(np.concatenate([window, window + 1]))
    served = schedule.served(np.minimum(edges * capacity, schedule.total))
    at = np.searchsorted(edges, window)
    after = np.searchsorted(edges, window + 1)
    q = queue[doc]
    first = np.maximum(start[doc], served[at, q])
    last = np.minimum(start[doc] + n[doc], served[after, q])
    some = first < last
    doc, window, at, after, q, first, last = (x[some] for x in (doc, window, at, after, q, first, last))
    ahead = np.cumsum(served[after] - served[at], axis=1) - (served[after] - served[at])
    offset = ahead[np.arange(len(q)), q] + first - served[at, q]
    begin = first - start[doc]
    ids = [np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype("<u4") for x, m in zip(batch["ids"].to_pylist(), n.tolist())]
    sums = [zlib.crc32(ids[d][a : a + m].tobytes()) for d, a, m in zip(doc.tolist(), begin.tolist(), (last - first).tolist())]
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"].take(pa.array(doc)), pa.array(begin), pa.array(last - first), pa.array(sums, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(offset),
         batch["queue"].take(pa.array(doc))],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])


def _grouped(placed: DataFrame, chunks: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``placed`` with sources without a target in queues by hash, ordered there by how far a document is in its source.

    Prefix sums run within 1,024 steps of a queue, plus the totals of the steps before.
    """
    own = F.col("queue").isin([x for t in targets for x in (f"={t}", *(["null"] if t == "null" else []))])
    group = F.when(own, F.col("queue")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES))))
    sizes = chunks.groupBy("queue").agg(F.sum("n").alias("size"))
    far = (F.col("start") + F.col("n") / 2) / F.col("size")
    rows = placed.join(sizes, "queue").withColumns({"far": far, "step": F.floor(far * 1024), "group": group})
    ahead = Window.partitionBy("group").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy("group", "step").agg(F.sum("n").alias("m")).select("group", "step", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("group", "step").orderBy("far", "queue", "start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(steps, ["group", "step"])
    return written(rows.select("doc_id", F.col("group").alias("queue"), (F.col("begin") + F.col("inside")).alias("start"), "n", "ids"), "token-groups")


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``targets``: weight of each source in a window; by default its share of all tokens, which keeps the mixture to the
    last window. Sources without a target follow when the others are served. Only the last sequence is not full.
    Beyond MAX_QUEUES sources each with a target keeps its own queue; the others share queues by hash (``#n``), and in
    such a queue documents come in the order of how far each is in its source, so all its sources run out together.
    Null text is empty (one token, the end of the document); null sources are one queue; rows may repeat and are packed
    each by itself; an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    many = docs.agg(F.count_distinct(source)).first()[0] > MAX_QUEUES
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), source.alias("queue"))
        .mapInArrow(_tokenizer(path), "chunk int, queue string, doc_id long, before long, n long, ids binary"), "tokens")
    chunks = rows.groupBy("queue", "chunk").agg(F.sum("n").alias("n"))
    chunks = written(chunks, "token-chunks")
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = chunks.select("queue", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = rows.join(begins, ["queue", "chunk"]).select("doc_id", "queue", (F.col("begin") + F.col("before")).alias("start"), "n", "ids")
    if many:
        placed = _grouped(placed, chunks, targets or {})
        chunks = placed
    totals = {r[0]: r[1] for r in chunks.groupBy("queue").agg(F.sum("n")).orderBy("queue").collect()}  # MAX_QUEUES rows and one a target at most
    number = {q: k for k, q in enumerate(totals)}
    asked = {q: (targets or {}).get(q[1:] if q[0] == "=" else q, 0.0) if q[0] != "#" else 0.0 for q in totals}
    wanted = [asked[q] if targets else float(t) for q, t in totals.items()]
    schedule = Schedule.of(list(totals.values()), wanted)
    return placed.mapInArrow(_placer(schedule, number, capacity),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
