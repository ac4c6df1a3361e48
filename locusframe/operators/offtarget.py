"""Substitution-tolerant search of guides in a genome, its scores and roll-ups."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.seq import revcomp, windows_of
from locusframe.operators.stats import avg_rank

#: The published position penalties of a mismatch, and the factor of the last two PAM bases.
POSITION_PENALTY = (
    0.000, 0.000, 0.014, 0.000, 0.000, 0.395, 0.317, 0.000, 0.389, 0.079,
    0.445, 0.508, 0.613, 0.851, 0.732, 0.828, 0.615, 0.804, 0.685, 0.583,
)
PAM_FACTOR = {"GG": 1.0, "AG": 0.259, "GA": 0.069, "AA": 0.0, "TG": 0.038, "CG": 0.107}
OTHER_PAM = 0.02
SPACER, SITE = 20, 23
HIT = "guide string, chrom string, pos long, strand string, site string, pam string, mismatches int"


def offtargets(chunks: DataFrame, guides: DataFrame, k: int = 4) -> DataFrame:
    """Hits of all guides in one pass over chunk rows (chrom, chunk_start, seq) that overlap by 22 bases, so that a site
    lies whole in one chunk only and each hit comes once.

    Plus-strand sites end in GG, minus-strand sites begin with CC; up to ``k`` substitutions in the 20 bases. A task
    tests the anchor first and compares what is left with every guide, on arrays; only hits leave it. The guides are a
    stated query set.
    Repeated guides count once, guides under 20 letters or null and null sequences give no hit; letters other than
    ACGT match nothing.
    """
    wanted = sorted({r[0][:SPACER].upper() for r in guides.select("guide").collect() if r[0] and len(r[0]) >= SPACER})
    code = np.full(256, 9, np.uint8)
    for n, b in enumerate(b"ACGT"):
        code[b] = code[b + 32] = n
    plus = np.array([[code[c] for c in g.encode()] for g in wanted], np.uint8).reshape(len(wanted), SPACER)
    shared = chunks.sparkSession.sparkContext.broadcast((wanted, plus, (3 - plus)[:, ::-1], code))
    limit = k

    def one_hot(letters: np.ndarray) -> np.ndarray:
        return (letters[:, :, None] == np.arange(4, dtype=np.uint8)).reshape(len(letters), 4 * SPACER).astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, forward, backward, table = shared.value
        wanted_hot = {"+": one_hot(forward).T, "-": one_hot(backward).T}
        turned = np.arange(256, dtype=np.uint8)
        turned[list(b"ACGT")] = list(b"TGCA")
        for batch in batches:
            starts = batch["chunk_start"].to_numpy(zero_copy_only=False)
            seqs = [(s or "").upper() for s in batch["seq"].to_pylist()]
            found: dict[str, list[tuple]] = {"+": [], "-": []}
            for n, seq in enumerate(seqs):
                s = table[np.frombuffer(seq.encode(), np.uint8)]
                last = len(s) - SITE + 1
                if last > 0:
                    for strand, at, first in (("+", np.flatnonzero((s[21 : 21 + last] == 2) & (s[22 : 22 + last] == 2)), 0), ("-", np.flatnonzero((s[:last] == 1) & (s[1 : 1 + last] == 1)), 3)):
                        found[strand].append((np.full(len(at), n), at, s[at[:, None] + np.arange(first, first + SPACER)]))
            letters_of = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
            raw = np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)
            hits: list[tuple] = []
            for strand, parts in found.items():
                if not parts or not names:
                    continue
                owner, at, letters = (np.concatenate(x) for x in zip(*parts))
                for k in range(0, len(at), 20_000):  # sites x guides as one matrix product
                    bad = SPACER - one_hot(letters[k : k + 20_000]) @ wanted_hot[strand]
                    p, g = np.nonzero(bad <= limit)
                    if not len(p):
                        continue
                    n, pos = owner[k + p], at[k + p]
                    sites = raw[(letters_of[n] + pos)[:, None] + np.arange(SITE)]
                    sites = sites if strand == "+" else turned[sites][:, ::-1]
                    text = [pa.array(np.ascontiguousarray(x).view(f"S{x.shape[1]}").reshape(-1).tolist(), pa.binary()).cast(pa.string()) for x in (sites[:, :SPACER], sites[:, SPACER:])]
                    hits.append((pa.array(names).take(pa.array(g)), batch["chrom"].take(pa.array(n)), pa.array(starts[n] + pos), pa.array([strand] * len(p)), *text, pa.array(bad[p, g].astype(np.int32))))
            yield from (pa.RecordBatch.from_arrays(list(h), ["guide", "chrom", "pos", "strand", "site", "pam", "mismatches"]) for h in hits)

    return chunks.select("chrom", F.col("chunk_start").cast("long").alias("chunk_start"), "seq").mapInArrow(scan, HIT)


def sites(df: DataFrame, seq: str, key: str, minus: bool = True, last: bool = True) -> DataFrame:
    """(key, pos, strand, site, pam): places of a sequence whose PAM is NGG. ``last`` takes the last legal place too."""
    rows = windows_of(df, seq, [key], SITE, [(21, "GG"), *([(0, "CC")] if minus else [])]).withColumnRenamed("at", "pos")
    if not last:
        rows = rows.where(F.col("pos") < F.col("n") - SITE)
    found = [F.when(F.substring("w", 22, 2) == "GG", F.struct(F.lit("+").alias("strand"), "w"))]
    if minus:
        found.append(F.when(F.substring("w", 1, 2) == "CC", F.struct(F.lit("-").alias("strand"), revcomp("w").alias("w"))))
    out = rows.select(key, "pos", F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "pos", "x.strand", "x.w")
    return out.select(key, "pos", "strand", F.substring("w", 1, SPACER).alias("site"), F.substring("w", SPACER + 1, 3).alias("pam"))


#: Sites that are compared with all guides at once.
AT_ONCE = 20_000


def offtargets_seeded(places: DataFrame, guides: DataFrame, k: int = 4) -> DataFrame:
    """The same join for given places: a task compares its sites with every guide as one matrix product, so a pair that is
    too far apart never becomes a row and nothing is shuffled. Segments as seeds would be two or three letters at eight
    mismatches, which rule out next to nothing.

    places (.., site, pam), guides (guide). Guides are a stated query set and go to every task. Letters are compared as
    they are, the first 20; a pair of different lengths does not meet. Null guides or sites meet nothing; repeated sites
    each count.
    """
    wanted = sorted({r[0] for r in guides.select(F.upper(F.substring("guide", 1, SPACER))).distinct().collect() if r[0]})
    letters = sorted({ord(c) for g in wanted for c in g})  # a letter that no guide has agrees with none
    shared = places.sparkSession.sparkContext.broadcast(wanted)
    limit, columns = k, places.columns

    def one_hot(words: list[str]) -> np.ndarray:
        codes = np.array(words, f"U{SPACER}").view(np.uint32).reshape(len(words), SPACER)
        return (codes[:, :, None] == np.array(letters, np.uint32)).reshape(len(words), -1).astype(np.float32)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        if not names:
            return
        hot, sizes = one_hot(names).T, np.array([len(g) for g in names])
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                found = [(s or "")[:SPACER] for s in part["site"].to_pylist()]
                bad = sizes - one_hot(found) @ hot
                p, g = np.nonzero((bad <= limit) & (np.array([len(s) for s in found])[:, None] == sizes))
                hit = [c.take(pa.array(p)) for c in part.columns]
                yield pa.RecordBatch.from_arrays([*hit, pa.array(names, pa.string()).take(pa.array(g)), pa.array(bad[p, g].astype(np.int32))], [*columns, "guide", "mismatches"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return places.mapInArrow(compare, f"{fields}, guide string, mismatches int")


def local_offtargets(seqs: DataFrame, guides: DataFrame, seq: str, key: str, k: int = 4) -> DataFrame:
    """Plus strand of the given sequences only, perfect matches left out, the last legal place not taken."""
    return offtargets_seeded(sites(seqs, seq, key, minus=False, last=False), guides, k).where("mismatches > 0")


def _codes(words: pa.Array) -> np.ndarray:
    """The first SPACER letters of each word as numbers, 0 past its end; an empty word is one letter that nothing else equals."""
    cut = pc.utf8_slice_codeunits(pc.fill_null(words, "").cast(pa.string()), 0, SPACER)
    padded = pc.utf8_rpad(cut, SPACER, "\0")
    text = b"".join(padded.cast(pa.binary()).to_pylist()) if padded.offset or len(padded) == 0 else padded.buffers()[2].to_pybytes()[: int(np.frombuffer(padded.buffers()[1], np.int32)[len(padded)])]
    if len(text) == SPACER * len(words):
        codes = np.frombuffer(text, np.uint8).reshape(len(words), SPACER).astype(np.uint32)
    else:
        codes = np.array(cut.to_pylist(), f"U{SPACER}").view(np.uint32).reshape(len(words), SPACER).copy()
    codes[codes[:, 0] == 0, 0] = 1
    return codes


def _differ(guide: pa.Array, site: pa.Array) -> np.ndarray:
    a, b = _codes(guide), _codes(site)
    return (a != b) & (a > 0) & (b > 0)


def _product(factors: Iterable[np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n)
    for f in factors:  # in order of places, as rounding depends on it
        out *= f
    return out


def _scores(values: np.ndarray, *given: pa.Array) -> pa.Array:
    """``values``, null where one of ``given`` is."""
    return pa.array(values, pa.float64(), mask=np.logical_or.reduce([g.is_null().to_numpy(zero_copy_only=False) for g in given]))


def _penalties(bad: np.ndarray) -> np.ndarray:
    return _product((np.where(bad[:, i], 1.0 - p, 1.0) for i, p in enumerate(POSITION_PENALTY)), len(bad))


def _penalty(guide: pa.Array, site: pa.Array) -> pa.Array:
    return _scores(_penalties(_differ(guide, site)), guide, site)


def _mit(guide: pa.Array, site: pa.Array) -> pa.Array:
    bad = _differ(guide, site)
    n = bad.sum(axis=1).astype(float)
    last = SPACER - 1 - bad[:, ::-1].argmax(axis=1)
    spread = (last - bad.argmax(axis=1)) / np.where(n > 1, n - 1, 1.0)
    near = np.where(n > 1, 1 / ((19 - spread) / 19 * 4 + 1), 1.0)
    return _scores(np.where(n == 0, 1.0, _penalties(bad) * near / np.where(n == 0, 1.0, n * n)), guide, site)


def cfd_style(guide: str, site: str, pam: str) -> Column:
    """Product of position penalties at mismatches and the factor of the last two PAM letters."""
    factor = F.create_map(*[F.lit(x) for kv in PAM_FACTOR.items() for x in kv])
    return F.arrow_udf(_penalty, "double")(guide, site) * F.coalesce(F.try_element_at(factor, F.upper(F.expr(f"right({pam}, 2)"))), F.lit(OTHER_PAM))


def mit_score(guide: str, site: str) -> Column:
    """Penalties x spread of the mismatches x their number; a perfect match is 1."""
    return F.arrow_udf(_mit, "double")(guide, site)


def cfd(hits: DataFrame, weights: DataFrame, pams: DataFrame, guide: str = "guide", site: str = "site", pam: str = "pam") -> DataFrame:
    """``hits`` with ``cfd`` from exact tables: weights (key: guide base, site base, place from 1; weight), pams (pam, weight).

    A pair without a weight makes the score 0, as does an unknown PAM. The weights are a catalogue and go to every task.
    """
    given = [(r[0], r[1]) for r in weights.select("key", F.col("weight").cast("double")).collect() if r[0] is not None]
    table = {(k[0], k[1], int(k[2:]) - 1): w for k, w in given if re.fullmatch("..[1-9][0-9]*", k, re.S) and int(k[2:]) <= SPACER}
    if len({k for k, _ in given}) < len(given):
        raise ValueError("a weight is given twice")
    alphabet = np.array(sorted({ord(c) for k in table for c in k[:2]} or {0}), np.uint32)
    dense = np.zeros((SPACER, len(alphabet) + 1, len(alphabet) + 1))  # the last row and column are for other letters
    place = {chr(c): n for n, c in enumerate(alphabet.tolist())}
    for (a, b, i), w in table.items():
        dense[i, place[a], place[b]] = w or 0.0

    def weight(guide: pa.Array, site: pa.Array) -> pa.Array:
        a, b = _codes(guide), _codes(site)
        at = [np.where(alphabet[k := np.minimum(np.searchsorted(alphabet, x), len(alphabet) - 1)] == x, k, len(alphabet)) for x in (a, b)]
        return _scores(_product((np.where(a[:, i] != b[:, i], dense[i, at[0][:, i], at[1][:, i]], 1.0) for i in range(SPACER)), len(a)), guide, site)

    factors = F.broadcast(pams.agg(F.map_from_entries(F.collect_list(F.struct("pam", "weight"))).alias("__p")))
    full = (F.char_length(guide) >= SPACER) & (F.char_length(site) >= SPACER)
    score = F.arrow_udf(weight, "double")(F.upper(guide), F.upper(site)) * F.coalesce(F.try_element_at(F.col("__p"), F.upper(F.expr(f"right({pam}, 2)"))), F.lit(0.0))
    return hits.crossJoin(factors).withColumn("cfd", F.when(full, score).otherwise(0.0)).drop("__p")


def offtarget_summary(hits: DataFrame, cap: int = 5000, max_mm: int = 4) -> DataFrame:
    """Per guide: hits by mismatches, perfect matches, specificities, worst site, whether a scan would have been cut.

    Perfect matches are counted and not scored. Sums are whole: the cap only sets ``truncated``.
    """
    imperfect = F.col("mismatches") > 0
    part = hits.groupBy("guide").agg(
        F.sum((~imperfect).cast("long")).alias("perfect"), F.sum(imperfect.cast("long")).alias("n_hits"),
        *[F.sum((F.col("mismatches") == m).cast("long")).alias(f"mm{m}") for m in range(1, max_mm + 1)],
        F.sum(F.when(imperfect, F.col("cfd")).otherwise(0.0)).alias("cfd_sum"), F.sum(F.when(imperfect, F.col("mit")).otherwise(0.0)).alias("mit_sum"),
        F.max_by(F.when(imperfect, F.col("site")), F.when(imperfect, F.struct(F.round("cfd", 9).alias("c"), F.col("site")))).alias("worst_site"))
    return part.select("*", (1 / (1 + F.col("cfd_sum"))).alias("cfd_specificity"), (100 / (100 + 100 * F.col("mit_sum"))).alias("mit_specificity"), (F.col("n_hits") > cap).alias("truncated"))


def cutoff_sweep(hits: DataFrame, cuts: Sequence[int], gate: float) -> DataFrame:
    """(guide, cut, n_hits, cfd_specificity, passes) with only hits of at most ``cut`` mismatches."""
    table = F.broadcast(hits.sparkSession.createDataFrame([(int(c),) for c in cuts], "cut int"))
    inside = (F.col("mismatches") > 0) & (F.col("mismatches") <= F.col("cut"))
    out = hits.crossJoin(table).groupBy("guide", "cut").agg(F.sum(inside.cast("long")).alias("n_hits"), (1 / (1 + F.sum(F.when(inside, F.col("cfd")).otherwise(0.0)))).alias("cfd_specificity"))
    return out.withColumn("passes", F.col("cfd_specificity") >= gate)


def rank_guides(df: DataFrame, k: int, floor: float, part: str = "symbol") -> DataFrame:
    """Guides by on_target x cfd_specificity x 1.1 (open chromatin) x 0.7 (common variant); the floor decides ``accepted``.

    Two steps: the first max(4k, 40) by on-target score, then the first ``k`` accepted by rank key. A part with none
    keeps its best guide with ``reason``.
    """
    pre = df.withColumn("__n", F.row_number().over(Window.partitionBy(part).orderBy(F.desc("on_target"), "guide"))).where(F.col("__n") <= max(4 * k, 40)).drop("__n")
    key = F.coalesce("on_target", F.lit(0.0)) * F.coalesce("cfd_specificity", F.lit(0.0)) * F.when(F.col("open_chromatin"), 1.1).otherwise(1.0) * F.when(F.col("common_snp"), 0.7).otherwise(1.0)
    keyed = pre.withColumn("rank_key", key).withColumn("accepted", F.coalesce(F.col("cfd_specificity") >= floor, F.lit(False)))
    order = Window.partitionBy(part).orderBy(F.desc("accepted"), F.desc("rank_key"), "guide")
    placed = keyed.withColumn("place", F.row_number().over(order)).where((F.col("place") == 1) | (F.col("accepted") & (F.col("place") <= k)))
    return placed.withColumn("reason", F.when(~F.col("accepted"), F.concat(F.lit("no guide reaches specificity "), F.lit(floor).cast("string"))))


def ontarget_labels(a: DataFrame, b: DataFrame, bucket: int = 400) -> DataFrame:
    """Union of two assays (id, gene, value): the first ranked to [0, 1] and grouped in buckets of ``bucket`` rows by id."""
    ranked = avg_rank(a, "value")
    group = F.concat(F.lit("bucket"), F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1) / bucket).cast("string"), F.lit("_"), F.pmod(F.xxhash64("id"), F.lit(64)).cast("string"))
    return ranked.select("id", group.alias("grp"), F.col("rank_pct").alias("label"), F.lit("a").alias("assay")).unionByName(b.select("id", F.col("gene").alias("grp"), F.col("value").alias("label"), F.lit("b").alias("assay")))
