"""Personal data: fixed patterns, plus overlapping candidates judged by gradient-boosted trees.

High-recall generators propose spans that the fixed patterns miss (written-out addresses, numbers with other
separators). Features of a candidate's format and context go to boosted regression trees; a threshold per kind, set on a
calibration part for the wanted precision, selects what is added. Fixed-pattern spans always stay.

No table labels personal data, so the trees learn from the corpus itself: each sampled fixed-pattern match is rewritten
in place into a form that the patterns miss (a positive), or spoiled (check digit, range, length: a negative), and
candidates of texts without any match are negatives too. The sample is bounded (``train_docs`` whole documents of at
most ``train_chars`` characters); scoring reads every whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import hash_sample, table
from locusframe.llm.decontamination import shards_of

#: Fixed values of the contract: kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: High-recall generators.
WORDED = re.compile(r"[A-Za-z0-9._%+-]{2,64}[ \[({<]{1,2}(?:at|AT|@)[ \])}>]{1,2}[A-Za-z0-9-]+(?:(?:\.|[ \[({<]{1,2}(?:dot|DOT)[ \])}>]{1,2})[A-Za-z0-9-]+)+")
SPACED_IP = re.compile(r"[0-9]{1,3}(?:[ \[(]{0,2}[.,][ \])]{0,2}[0-9]{1,3}){3}(?![0-9])")
DIGITS = re.compile(r"[0-9(][0-9 ()./_-]{6,26}[0-9]")

Span = tuple[str, int, int]
TEXT_BYTES = 8 << 20


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    values = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    twice = values[1::2] * 2
    return int(values[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def only_digits(text: str) -> str:
    """The ASCII digits of a text."""
    return re.sub("[^0-9]", "", text)


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in found.split(".")))  # whatever zeros lead
    digits = only_digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each @ outwards: a match has one @, and what may stand before it has none."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)
        free = min(free, at) if at >= 0 else free


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern: of a run of numbers with dots between, each four in turn."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            ends = [k for k, c in enumerate(m[0]) if c == "."] + [len(m[0])]
            for k in range(3, len(ends), 4):
                yield m.start() + (ends[k - 4] + 1 if k > 3 else 0), m.start() + ends[k]


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """What ``PATTERNS[kind].finditer`` finds, in time in proportion to the text."""
    if kind == "email":
        return _emails(text)
    return _ips(text) if kind == "ip" else ((m.start(), m.end()) for m in PATTERNS[kind].finditer(text))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; matches that fail their test are dropped."""
    return in_order([(kind, a, b) for kind in KINDS for a, b in _matches(kind, text) if _holds(kind, text[a:b])])


class Taken:
    """Stretches of a text, merged where they overlap."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2])
        return k > 0 and self.ends[k - 1] > span[1]

    def add(self, span: Span) -> None:
        """A span that meets none."""
        k = bisect_left(self.starts, span[1])
        self.starts.insert(k, span[1])
        self.ends.insert(k, span[2])


def in_order(spans: list[Span]) -> list[Span]:
    """Spans by start, kinds in their listed order at one start."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of the generators, each with the kind that it might be."""
    out: list[Span] = []
    if " at " in text or "(at)" in text or "[at]" in text or "@" in text or "AT" in text:
        out += [("email", m.start(), m.end()) for m in WORDED.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in SPACED_IP.finditer(text)]
    for m in DIGITS.finditer(text):
        start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
        n = len(only_digits(m[0]))
        if 12 <= n <= 19:
            out.append(("card", m.start(), m.end()))
        if 7 <= n <= 15:
            out.append(("phone", start, m.end()))
    return out


#: Context words that announce a kind; counted in the characters before a candidate.
HINTS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


def features(text: str, span: Span) -> list[float]:
    """What the trees read of a span: its format, its digits and letters, and the words around it."""
    kind, start, end = span
    found, before, after = text[start:end], text[max(0, start - 30) : start].lower(), text[end : end + 12]
    digits = only_digits(found)
    groups = [len(g) for g in re.findall("[0-9]+", found)]
    parts = [int(g[:6]) for g in re.findall("[0-9]+", found)]
    marks = re.findall("[^0-9A-Za-z]", found)
    return [
        float(KINDS.index(kind)), float(len(found)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(set(marks))), float(len(marks)), float(bool(digits) and luhn(digits)), float(max(parts, default=0) <= 255), float(len(parts) == 4),
        float("@" in found), float(bool(re.search(r"\b(at|AT)\b", found))), float(bool(re.search(r"\b(dot|DOT)\b", found))), float(found.count(".")), float("(" in found and ")" in found),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:].isdigit() or after[:1].isdigit()), float(before[-1:] in "=\"'#$&%*:/"),
        float(after[:1] in "=\"'#$&%*:/" if after else 0), float(any(h in before for h in HINTS[kind])), float(sum(c.isdigit() for c in before + after)),
        float(groups[:3] == [3, 3, 4]), float(groups == [4, 4, 4, 4]), float(found.startswith("+")),
    ]


class BoostedTrees:
    """Gradient boosting of depth-limited trees on the logistic loss; splits at quantiles of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, leaf: float = 1.0):
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.depth, share = depth, min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 24))) for f in range(x.shape[1])] if len(y) else []
        for _ in range(trees if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, p * (1 - p)
            splits, node = [], np.zeros(len(y), np.int64)
            for level in range(depth):  # one split a level, shared by its nodes
                best = (-1.0, 0, 0.0)
                for f, points in enumerate(cuts):
                    for c in points:
                        side = node * 2 + (x[:, f] > c)
                        g, h = np.bincount(side, slope, 2 << level), np.bincount(side, curve, 2 << level)
                        gain = float((g * g / (h + leaf)).sum())
                        if gain > best[0] + 1e-12:
                            best = (gain, f, float(c))
                splits.append(best[1:])
                node = node * 2 + (x[:, best[1]] > best[2])
            g, h = np.bincount(node, slope, 1 << depth), np.bincount(node, curve, 1 << depth)
            self.trees.append(splits)
            self.leaves.append(rate * g / (h + leaf))
            score = score + self.leaves[-1][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for splits, leaves in zip(self.trees, self.leaves):
            node = np.zeros(len(x), np.int64)
            for f, c in splits:
                node = node * 2 + (x[:, f] > c)
            total += leaves[node]
        return 1 / (1 + np.exp(-total))


def _rewritten(kind: str, found: str, turn: int) -> str:
    """A form of the same datum that the fixed patterns miss."""
    digits = only_digits(found)
    if kind == "email":
        name, _, host = found.partition("@") if turn % 2 else (re.sub("[0-9]", "", found) or found).partition("@")
        name, host = name.strip(".") or "name", host or "host"
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}"][turn % 3]
    if kind == "ip":
        return found.replace(".", ["[.]", " . ", "(.)"][turn % 3])
    if kind == "card":
        return ["_", "/", "."][turn % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}"][turn % 3]


def _spoiled(kind: str, found: str, turn: int) -> str:
    """A look-alike that is none: the check digit, range or length no longer holds."""
    digits = only_digits(found)
    if kind == "email":
        return found.partition("@")[0] + [" at the ", " at 5 dot ", " at "][turn % 3] + "of"
    if kind == "ip":
        return ", ".join(str(300 + int(p) % 600) for p in found.split("."))
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + turn % 8) % 10)
        return ["", " ", "_"][turn % 3].join(wrong[k : k + 4] for k in range(0, len(wrong), 4))
    return [digits[-9:-2], f"{digits[:2]}/{digits[2:4]}/{digits[4:8]}", digits[:8] + "-" + digits[:1], digits][turn % 4]


class Model:
    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, texts: list[str], precision: float = 0.98) -> Model:
        x: list[list[float]] = []
        y: list[int] = []
        of: list[int] = []
        for number, text in enumerate(texts):
            base = base_spans(text)
            taken = Taken(base)
            for kind, start, end in base:
                for label, make in ((1, _rewritten), (0, _spoiled)):
                    for turn in range(3):
                        changed = text[max(0, start - 60) : start] + (put := make(kind, text[start:end], turn + start)) + text[end : end + 60]
                        at = min(60, start)
                        near = [c for c in candidates(changed) if c[1] < at + len(put) and c[2] > at]
                        exact = [c for c in near if c[0] == kind and c[1] <= at + 2 and c[2] >= at + len(put) - 1]
                        for c in exact if label else near:
                            x.append(features(changed, c))
                            y.append(label)
                        if label:
                            for c in near:
                                if c[0] != kind:
                                    x.append(features(changed, c))
                                    y.append(0)
            for c in candidates(text):
                if not taken.meets(c):
                    x.append(features(text, c))
                    y.append(0)
            of += [number] * (len(y) - len(of))
        xs, ys = np.array(x, float).reshape(-1, len(features("", ("email", 0, 0)))), np.array(y, float)
        kept = np.array(of, np.int64) % 4 == 3  # whole documents: rewrites of one match stay on one side
        trees = BoostedTrees(xs[~kept], ys[~kept])
        score = trees.score(xs[kept])
        thresholds = {}
        for k, kind in enumerate(KINDS):
            mine = xs[kept][:, 0] == k
            s, t = score[mine], ys[kept][mine]
            order = np.argsort(-s, kind="stable")
            good = np.cumsum(t[order]) >= precision * np.arange(1, len(t) + 1)
            thresholds[kind] = max(0.5, float(s[order][np.flatnonzero(good)[-1]])) if good.any() else 2.0
        return cls(trees, thresholds)

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """Selected candidates of each text that overlap no fixed-pattern span, the best of those that overlap."""
        owner, proposed, rows = [], [], []
        for k, (text, base) in enumerate(zip(texts, bases)):
            taken = Taken(base)
            for c in candidates(text):
                if not taken.meets(c):
                    owner.append(k)
                    proposed.append(c)
                    rows.append(features(text, c))
        out: list[list[Span]] = [[] for _ in texts]
        chosen = [Taken() for _ in texts]
        if rows:
            score = self.trees.score(np.array(rows))
            for n in np.argsort(-score, kind="stable").tolist():
                c = proposed[n]
                if score[n] >= self.thresholds[c[0]] and not chosen[owner[n]].meets(c):
                    out[owner[n]].append(c)
                    chosen[owner[n]].add(c)
        return out


def fit_pii(docs: DataFrame, text_col: str = "text", train_docs: int = 3000, train_chars: int = 20_000) -> Model:
    """Fit on at most ``train_docs`` whole documents of at most ``train_chars`` characters that hold a digit or an @, drawn
    by hash; three in four for the trees, the others for the thresholds. Without any, nothing is added."""
    some = docs.where(F.col(text_col).rlike("[0-9@]") & (F.char_length(text_col) <= train_chars)).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return Model.fit([r[0] for r in hash_sample(some, train_docs, "h", "t").select("t").collect()])


def _finder(model: Broadcast, text_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shards_of(batch, text_col, TEXT_BYTES):
                texts = [t or "" for t in part[text_col].to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = model.value.added(texts, bases)
                both = [in_order([*a, *b]) for a, b in zip(bases, more)]
                written = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                out = part.append_column("__base", pa.array([written(x) for x in bases], _SPANS))
                yield out.append_column("__spans", pa.array([written(x) for x in both], _SPANS))

    return find


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (kind, start, end) in code points, by start, then kind.

    Null text is empty and has no spans; rows may repeat; an empty table gives no rows; other columns pass through.
    """
    kind = "array<struct<kind:string,start:long,end:long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", __base {kind}, __spans {kind}"
    return docs.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(model), text_col), schema)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    pieces = F.aggregate(
        "__spans", F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["s"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("s"), x["end"].alias("at"))))
    marked = find_pii(docs, model, text_col).withColumn("__p", pieces)
    text = F.concat(F.col("__p.s"), F.substring(F.col(text_col), (F.col("__p.at") + 1).cast("int"), F.char_length(text_col)))
    return marked.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases = batch["__base"].to_pylist()
        counts = [pa.array([sum(s["kind"] == k for s in x) for x in bases], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *counts, pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in bases]), pa.array([_joined(x) for x in batch["__spans"].to_pylist()])],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs)).drop("text")
    return found.mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
