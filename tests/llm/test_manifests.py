"""Merkle manifest, prefix trie and suffix-array dedup against plain versions, on hard cases and on empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

from locusframe.llm import merkle, suffix_dedup, trie
from tests.llm.conftest import prose


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """(root, [path of each leaf]): a path lists (slot, other digests) by level."""
    paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(of):
            run = level[at - at % arity : at - at % arity + arity]
            paths[k].append((at % arity, run[: at % arity] + run[at % arity + 1 :]))
        level = [digest(*level[k : k + arity]) for k in range(0, len(level), arity)]
        of = [at // arity for at in of]
    return (level or [None])[0], paths


def plain_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: digest(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])])
    trees = {}
    for r in rows:
        touched = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        trees.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["n_chars"]), leaf(r, r["n_chars"] + 1) if touched else None, r["doc_id"]))
    names = sorted(trees)
    for k in names:
        trees[k].sort(key=lambda x: x[:2])
    built = {k: tree([x[1] for x in trees[k]], arity) for k in names}
    root, upper = tree([built[k][0] for k in names], arity)
    out = []
    for k, up in zip(names, upper):
        for (_, own, tampered, doc_id), path in zip(trees[k], built[k][1]):
            path, at = path + up, tampered or own
            for slot, others in path:
                at = digest(*others[:slot], at, *others[slot:])
            out.append((doc_id, own, built[k][0], root, digest(*[x for _, others in path for x in others]), at, at == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def manifest_docs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"text {k % 5} é", ["en", "fr", "ß", "", None][min(4, int(rng.integers(0, 9)))], "s" if k % 3 else None, int(rng.integers(0, 99)) if k % 4 else None) for k in range(77)]
    rows += [(3, "again", "en", "s", 2), (3, "again", "en", "s", 2), (3, None, "en", None, 2**63 - 1), (None, "", "en", "", 1), (None, None, None, None, None), (5000, "x" * 200_000, "alone", "s", 7)]
    rows += [(700 + k, "hot", "hot", "s", 3) for k in range(130)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at int, tree string")


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(manifest_docs, arity):
    got = sorted((tuple(r) for r in merkle.manifest(manifest_docs, arity).collect()), key=repr)
    want = plain_manifest(manifest_docs.collect(), arity)
    assert got == want and {r[-1] for r in got} == {True, False}


def test_manifest_of_few(manifest_docs):
    for rows in (manifest_docs.limit(0), manifest_docs.where("doc_id = 5000"), manifest_docs.where("lang = 'ß'")):
        got = sorted((tuple(r) for r in merkle.manifest(rows).collect()), key=repr)
        assert got == plain_manifest(rows.collect(), 2)


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((turn is not None, turn or 0), digest(f"{len(role.encode())}:", role, text), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    rest = lambda c: int(np.fmod(c, 5))
    built = {c: tuple(own.get(c - rest(c), [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :]) for c, v in own.items()}
    members, children = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in under) if under else 1
        saved[p] = sum(saved[q] for q in under) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], digest(",".join(map(str, sorted(c for c in m if built[c] == p))))) for p, m in members.items()), key=repr)


def test_trie(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(-12, 60), 10**12, 2**62]:
        for k in range(int(rng.integers(1, 9))):
            rows.append((c, k, ["user", "bot"][k % 2], f"turn {k} é {int(rng.integers(0, 2))}"))
    rows += [(100 + k, t, "user", f"the same {t}") for k in range(60) for t in range(4)]  # a hot conversation
    rows += [(200, t, "user", f"long {t}") for t in range(90)] + [(201, t, "user", f"long {t}") for t in range(70)] + [(202, 0, "user", "x" * 50_000)]
    rows += [(203, None, "user", "first"), (203, 1, None, None), (203, 1, None, None), (203, 1, "user", "tie"), (None, 0, "user", "nobody"), (204, 3, "", ""), (204, -2, "a", "b")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string")
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert sorted((tuple(r) for r in trie.prefix_trie(df.where("conv_id = 204")).collect()), key=repr) == plain_trie([r for r in rows if r[0] == 204])


def test_ends_of_a_hot_node_are_hashed_by_chunks(spark):
    n = 3 * trie.CHUNK + 5
    ended = spark.range(n).selectExpr("2L as depth", "cast(7 as decimal(38,0)) a", "cast(8 as decimal(38,0)) b", "id * 3 as conv_id").union(spark.sql("select 1L, cast(1 as decimal(38,0)), cast(2 as decimal(38,0)), 5L"))
    got = {r["depth"]: r["ends_sha256"] for r in trie.ends_of(ended).collect()}
    assert got == {2: digest(",".join(str(3 * k) for k in range(n))), 1: digest("5")}


def plain_bytes(rows, window):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - window + 1) if i is not None else ():
            w = b[s : s + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1) if i is not None else ():
            if first[b[s : s + window]] < i:
                gone[s : s + window] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [None, 4])
def test_suffix_dedup(spark, nasty, empty, monkeypatch, fan):
    if fan:  # coarse buckets first
        monkeypatch.setattr(suffix_dedup, "MAX_FAN", fan)
    out = suffix_dedup.dedup_bytes(nasty)
    got = sorted(((r["doc_id"], r["__bytes"], r["__removed"], r["__spans"], bytes(r["__kept"])) for r in out.collect()), key=repr)
    assert got == plain_bytes([(r["doc_id"], r["text"]) for r in nasty.collect()], suffix_dedup.WINDOW)
    assert {"source", "shard", "digest", "row", "n"} <= set(out.columns) and suffix_dedup.dedup_bytes(empty).count() == 0


@pytest.mark.parametrize("window", [50, 64])
def test_suffix_dedup_of_few_letters(spark, window):
    rng = np.random.default_rng(window)
    pool = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(20, 120, 25)] + ["a" * 300, "ab" * 120, "é" * 90, prose(40, 3)]
    rows = [(k, "".join(pool[int(x)] for x in rng.integers(0, len(pool), int(rng.integers(0, 6))))) for k in range(60)] + [(3, pool[-1] * 2), (3, "a" * 77), (61, "a" * (window - 1)), (62, "b" * window)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["__bytes"], r["__removed"], r["__spans"], bytes(r["__kept"])) for r in suffix_dedup.dedup_bytes(df, window).collect()), key=repr)
    assert got == plain_bytes(rows, window)


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)) for n in rng.integers(40, 500, 60)]
    texts.append(rng.integers(97, 110, 5 * suffix_dedup.PIECE_BYTES // 2).astype(np.uint8).tobytes())
    text, place, anchor, context = suffix_dedup.anchors_of(texts)
    seen = {}
    for k, t in enumerate(texts):
        mine = place[text == k]
        assert (np.diff(mine) > 0).all() and (anchor[text == k] == suffix_dedup.gram_hashes(t, 24)[mine]).all()
        if len(t) >= 50:
            assert mine[0] <= 26 and np.diff(mine).max(initial=0) <= 27 and mine[-1] >= len(t) - 50
        for p, c in zip(mine[:2000].tolist(), context[text == k][:2000].tolist()):
            own = (t[max(p - 26, 0) : p + 50], min(p, 26))
            assert seen.setdefault(c, own) == own
    assert len(set(seen.values())) == len(seen) and (text == 60).sum() < len(texts[-1]) / 11


def test_maximal_repeats():
    rng = np.random.default_rng(3)
    for _ in range(200):
        strings = [bytes(rng.integers(97, 99, int(rng.integers(4, 40))).astype(np.uint8)) for _ in range(int(rng.integers(2, 9)))]
        found = suffix_dedup.repeats_of(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), 4)
        got = {}
        for _, n, s, at in zip(*(x.tolist() for x in found)):
            got.setdefault(strings[s][at : at + n], set()).add((s, at))
        held = {}
        for k, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + 4, len(s) + 1):
                    held.setdefault(s[a:b], set()).add((k, a))
        # Maximal: followed, and preceded, by different letters or by an end.
        right = lambda w, v: len({strings[k][a + len(w) : a + len(w) + 1] or k for k, a in v}) > 1 or any(a + len(w) == len(strings[k]) for k, a in v)
        left = lambda v: len({strings[k][a - 1 : a] for k, a in v}) > 1 or any(a == 0 for _, a in v)
        assert got == {w: v for w, v in held.items() if len(v) > 1 and right(w, v) and left(v)}
