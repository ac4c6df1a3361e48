"""Each operator against a plain version of its contract, on a table of hard cases; and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from locusframe.llm import decontamination, embedding_dedup, html_extract, line_dedup, packing, pii, sharding, simhash, substring_dedup, toxicity
from tests.llm.conftest import prose


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, nasty, empty):
    got = sharding.assign_shards(nasty, 7).collect()
    assert len(got) == nasty.count() and sharding.assign_shards(empty, 7).count() == 0
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 7) and r["grown_shard"] in (r["shard"], 7)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for (t,) in nasty.select("text").collect())
    assert want == sorted((r["size"], r["text_crc32"]) for r in got)
    ids = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**63 - 1, -(2**63), 123456789)], "k long")
    for n in (1, 2, 40, 1000):
        assert all(r["shard"] == jump(r["k"], n) for r in sharding.with_jump_hash(ids, "k", n).collect())


def test_packing(nasty, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(nasty, capacity=256).collect()
    assert packing.pack(empty).count() == 0
    ids = {}  # rows that share an id are told apart by their length
    for i, t in nasty.select("doc_id", "text").collect():
        x = tok.encode(t or "", add_special_tokens=False).ids + [1]
        ids.setdefault((i, len(x)), []).append(x)
    runs = defaultdict(list)
    for r in pieces:
        runs[r["doc_id"], r["doc_tokens"]].append(r)
    assert set(runs) == set(ids)
    for key, rows in runs.items():
        length = key[1]
        taken = np.zeros(length, np.int64)
        for r in rows:
            a, m = r["start"], r["length"]
            assert 0 < m and a + m <= length
            taken[a : a + m] += 1
            assert r["ids_crc32"] in {zlib.crc32(np.array(x[a : a + m], "<u4").tobytes()) for x in ids[key]}
        assert (taken == len(ids[key])).all()  # each id in exactly one piece
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or s == len(by) - 1
    share, seen = Counter(), Counter()
    for r in pieces:
        share[r["queue"]] += r["length"]
        if r["sequence_id"] < 20:
            seen[r["queue"]] += r["length"]
    total = sum(share.values())
    assert all(abs(seen[q] - 20 * 256 * share[q] / total) <= len(share) for q in share)


def test_packing_targets(nasty):
    pieces = packing.pack(nasty, {"a": 0.5, "hot": 0.5}, capacity=64).where("sequence_id < 10").collect()
    got = Counter()
    for r in pieces:
        got[r["queue"]] += r["length"]
    assert set(got) == {"=a", "=hot"} and abs(got["=a"] - got["=hot"]) <= 2


def test_packing_words():
    import public_tokenizers

    made = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    assert made.by_word
    texts = ["", None, "a<|endoftext|>b C.", "It's I'LL don't. Σας ὈΔΥΣΣΕΎΣ.", "é. ́x", "x\x1cy\x0bz w", "你好。 12.5 3,4 ...,, A.B. É. ß!", "<|ENDOFTEXT|> <a>.", "ﬁne K", "abc*** (def)- g#h",
             "BİZİMKİ.", "DENİZLİ, X", "Lİ! I\u0327\u0307A i\u0307.", "ŉ. ǅ, K. ª! x'S."]
    rng = np.random.default_rng(11)
    letters = list("aAzZİIıiſŉßéÉ\u0307\u0301ǅΣσςKÅ中가\u0327'.,!?;:*#$%&)-(12½²<|> \n\t\xa0\u3000\u200bẞªº_/\x00\x1c\x85") + ["<|endoftext|>", "'LL", "it's", "<|", "İ."]
    texts += ["".join(letters[k] for k in rng.integers(0, len(letters), n)) for n in rng.integers(0, 14, 6000)]
    want = [made.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for _ in range(2):  # asked for the first time, and from the cache
        assert [np.frombuffer(b, made.kind).tolist() for b in made.ids(texts)] == want
    made.by_word = False
    assert [np.frombuffer(b, made.kind).tolist() for b in made.ids(texts[:500])] == want[:500]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- c --><div class=\"ad\">Buy this now</div>{body}<footer>&copy; footer words</footer></body></html>"


def test_html(spark):
    body = lambda k: "<article><h1>Title {0}</h1><p><b>{1}<br><p>{2} &amp;&lt;&eacute;\n\t x</p><p>Be.</p></article>".format(k, prose(12, k), prose(40, k + 1))
    rows = [(k, "u", page(body(k))) for k in range(40)] + [(90, "u", None), (91, "u", ""), (92, None, page(body(92))[:-20]), (93, "u", "plain < text"), (None, "u", page(body(1)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["__text"] for r in html_extract.extract_text(df, html_extract.fit_pages(df)).collect()}
    for k in (0, 7, 39, 92):
        assert got[k] == f"Title {k}\n{prose(12, k)}\n{prose(40, k + 1)} &<é x\nBe."
    assert got[90] == "" and got[91] == ""
    blank = df.limit(0)
    assert html_extract.extract_text(blank, html_extract.fit_pages(blank)).count() == 0


def test_html_bad_pages_take_linear_time():
    from time import process_time

    for page in ("<a " * 250_000, "<div>x" * 160_000, "<a '\">" * 150_000, "<script " * 120_000 + ">", "<p class='" * 100_000, "<b><p>" * 150_000, "<!--" * 250_000, "<td><a href=x>y" * 60_000):
        began = process_time()
        html_extract.blocks_of(page)
        assert process_time() - began < 10, page[:20]
    assert html_extract.blocks_of("a<b>c<p>d<!-- e") == [((), "ac", 0), (("p",), "d", 0)]
    assert [b[1] for b in html_extract.blocks_of("<p>a<script>if (x<y) {</script>b<p>c<style>z")] == ["ab", "c"]
    assert [b[1] for b in html_extract.blocks_of("<p title='a>b'>x <a href=\"u>y</a> z")] == ["x y z"]


def test_html_adverts_and_comments_inside_an_article(spark):
    body = lambda k: f"<article><h1>Title {k}</h1><p>{prose(30, k)}.</p><div class=\"ad\">{prose(6, k + 7)}</div><p>{prose(40, k + 1)}.</p><section class=\"comments\"><p>{prose(12, k + 3)}</p></section></article>"
    df = spark.createDataFrame([(k, "u", page(body(k))) for k in range(60)], "page_id long, url string, html string")
    got = {r["page_id"]: r["__text"] for r in html_extract.extract_text(df, html_extract.fit_pages(df)).collect()}
    right = sum(got[k] == f"Title {k}\n{prose(30, k)}.\n{prose(40, k + 1)}." for k in range(60))
    assert right >= 54, right


def test_toxicity(spark, nasty, empty):
    texts = [(k, prose(40, k) + (" vile awfulword" if k % 4 == 0 else ""), "s") for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), None) for k in range(400)] + [(None, 1, None), (900, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(docs, labels)
    held = [r for r in toxicity.score_toxicity(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and all((r["__score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    scored = toxicity.score_toxicity(nasty, model).collect()
    assert len(scored) == nasty.count() and all(0 <= r["__score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0


W5 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_decontamination(spark, nasty, empty, monkeypatch):
    items = [(1, prose(70, 2)), (2, prose(25, 3)), (2, prose(9, 4)), (3, "line number"), (4, None), (5, "!!"), (None, prose(60, 9)), (6, prose(12, 77))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = W5.findall((t or "").translate(AZ))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))

    def plain(text):
        w = W5.findall((text or "").translate(AZ))
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    named |= owners
        return len(w), len(hit), sorted(named)

    want = sorted((i if i is not None else -1, *plain(t)) for i, t in nasty.select("doc_id", "text").collect())
    for block in (1 << 20, 200):  # one block, and several
        found = decontamination.find_leaks(nasty, bench, block_bytes=block).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["__words"], sum(b - a for a, b in decontamination.merge_spans([(s["start"], s["end"]) for s in r["__spans"]])), r["__items"]) for r in found)
        assert got == want
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(nasty, bench.limit(0)).where(F.size("__items") > 0).count() == 0
    def cut(text):
        lower = (text or "").translate(AZ)
        places = [m.span() for m in W5.finditer(lower)]
        w = [lower[a:b] for a, b in places]
        hit = sorted({j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)})
        out, at = "", 0
        for k in hit:
            if k - 1 not in hit:
                out += text[at : places[k][0]]
            at = places[k][1]
        return (out + text[at:]) if hit else text

    again = decontamination.cut_leaks(nasty, bench)
    assert again.columns == nasty.columns
    assert table(again, "doc_id", "text") == sorted(((i, cut(t)) for i, t in nasty.select("doc_id", "text").collect()), key=repr)
    phrases = decontamination.Phrases([(str(i), t) for i, t in items if i is not None and t])
    texts = [t for (t,) in nasty.select("text").collect()] + [prose(70, 2) * 3]
    assert decontamination.search_shard(texts, phrases, 13) == decontamination.search_shard(texts, phrases)  # long texts in cut stretches


def test_fm_index_finds_all():
    rng = np.random.default_rng(3)
    text = np.where(rng.random(3000) < 0.03, 0, rng.integers(1, 5, 3000))
    text[-1] = 0
    index = decontamination.FMIndex(text, 4)
    phrases = rng.integers(1, 5, (200, 5))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [k for k in range(len(text) - 4) if (text[k : k + 5] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_simhash(nasty, empty):
    def fingerprint(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(AZ))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    rows = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(nasty).collect()]
    assert sorted(Counter((i, f) for i, f, _ in rows).items(), key=repr) == sorted(Counter((i, fingerprint(t)) for i, t in nasty.select("doc_id", "text").collect()).items(), key=repr)
    fps = sorted({f for _, f, _ in rows})
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    first = {}
    for i, f, _ in rows:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    assert all(c == first.get(root[f]) for _, f, c in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_bk_forest_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) for _ in range(60)]))
    forest = simhash.BKForest(values, np.zeros(len(values), np.int64))
    got = {(int(a), int(b)) for q, n in forest.within(np.arange(len(values)), 2) for a, b in zip(q, n)}
    assert got == {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}


@pytest.mark.parametrize("tree", [20_000, 40])
def test_fingerprint_links_of_cut_shards(spark, tree):
    rng = np.random.default_rng(8)
    base = np.uint64(0xABCDEF0123456789)
    values = np.unique(base ^ (np.uint64(1) << rng.integers(0, 20, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = [tuple(r) for r in simhash.fingerprint_links(fps, tree=tree).collect()]
    assert all((a % 2**64 ^ b % 2**64).bit_count() <= 64 for a, b in got)

    def parts(links):
        root = {int(v): int(v) for v in values.view(np.int64)}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return Counter(frozenset(x for x in root if find(x) == r) for r in root if find(r) == r)

    want = [(int(a), int(b)) for a in values.view(np.int64) for b in values.view(np.int64) if (int(a) % 2**64 ^ int(b) % 2**64).bit_count() <= 2]
    assert parts(got) == parts(want)


@pytest.mark.parametrize("tree,few", [(20_000, None), (8, 4)])
def test_near_copies(spark, nasty, empty, tree, few):
    rng = np.random.default_rng(9)
    rows = [(i, t, s) for i, t, s in nasty.select("doc_id", "text", "source").collect()]
    for k in range(30):  # families at similarities around 0.8
        words = prose(60 + 10 * (k % 5), 500 + k).split()
        for c in range(8):
            w = list(words)
            for at in rng.integers(0, len(w), c):
                w[at] = f"changed{rng.integers(1000)}"
            rows.append((10_000 + 10 * k + c, " ".join(w), "f"))
    rows += [(20_000 + k, prose(50, 777) + f" tail{k} {prose(2, k)}", "hot") for k in range(120)] + [(10_000, prose(30, 4), "same id"), (None, prose(60, 9), "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = [tuple(re.findall("[^\x20\x09-\x0d]+", (t or "").translate(AZ))) for _, t, _ in rows]
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    named = [k for k, r in enumerate(rows) if r[0] is not None]
    root = {k: k for k in named}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in named:
        for b in named:
            if a < b and (words[a] == words[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in named:
        groups[find(k)].append(rows[k][0])
    got = simhash.keep_one_near_copy(docs, tree=tree, few=few).collect()
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in rows)
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(min(g) for g in groups.values())
    assert simhash.keep_one_near_copy(empty).count() == 0 and simhash.keep_one_near_copy(nasty).columns == nasty.columns


def test_a_large_family_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words, made = prose(200, 5).split(), []
    for k in range(1_500):  # near the text they come from, but mostly not to each other
        w = list(words)
        for at in rng.choice(200, 4, replace=False):
            w[at] = f"changed{rng.integers(10**6)}"
        made.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(made)] + [(5_000, " ".join(words)), (6_000, prose(200, 6))]
    seen, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    got = simhash.keep_one_near_copy(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 6_000] and sum(seen) < 40 * len(rows), seen


def test_classes_that_share_a_node_are_told_apart(spark):
    rows = [(bytes([k]) * 16, k // 3) for k in range(9)]
    got = simhash._told_apart(spark.createDataFrame(rows, "class binary, node long")).collect()
    assert len({r["node"] for r in got}) == 9 and sum(r["node"] in (0, 1, 2) for r in got) == 3


def test_components(spark):
    from locusframe.llm.common import connected_components

    chain = [(k, k + 1) for k in range(60)] + [(200, 201), (201, 200), (7, 7), (None, 3)] + [(300, k) for k in range(301, 340)]
    got = dict(connected_components(spark.createDataFrame(chain, "src long, dst long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 200: 200, 201: 200, **{k: 300 for k in range(300, 340)}}


def plain_substrings(rows, window):
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(i, first.get(x, i))
    want = []
    for i, w in docs:
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return want


@pytest.mark.parametrize("window, fan", [(50, 8192), (10, 8192), (50, 16), (10, 5)])
def test_substring_dedup(nasty, empty, window, fan, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_FAN", fan)  # below the 64 buckets: by coarse buckets first
    want = plain_substrings(nasty.select("doc_id", "text").collect(), window)
    got = substring_dedup.dedup_substrings(nasty, window)
    assert table(got, "doc_id", "__words", "__removed", "text") == sorted(want, key=repr)
    assert got.columns[: len(nasty.columns)] == nasty.columns and substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_volume_does_not_depend_on_buckets():
    rng = np.random.default_rng(4)
    docs = [(10 * k, 0, rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.zeros(300, np.uint32), np.arange(300)) for k in range(2000)]
    e = substring_dedup.Entries.of(docs)
    size = {}
    for buckets in (64, 2560, 25_600):
        rows = substring_dedup._packed(e, lambda x: substring_dedup._shared(x, 25), buckets, 5)
        size[buckets] = sum(len(zlib.compress(b)) for c in ("hashes", "steps", "ids", "sizes") for b in rows[c].to_pylist() if b)
        back = substring_dedup._unpack(rows.to_pylist(), 5).ordered()
        assert (back.ids == e.ids).all() and (back.places == e.places).all() and (back.hashes == e.hashes & np.uint64((1 << 40) - 1)).all()
    assert size[25_600] < 3 * size[64], size  # the id of a document with each entry, and no more


def test_substring_passage_of_every_document(spark):
    shared = prose(60, 1)
    docs = spark.createDataFrame([(k, f"{prose(5 + k % 7, k)} {shared} {prose(4, 9000 + k)}") for k in range(4000)], "doc_id long, text string").repartition(4)
    parts = docs.select("doc_id", "text").where("doc_id < 3000").collect()
    e = substring_dedup.Entries.of([(r[0], 0, h := substring_dedup.rolling(substring_dedup.word_hashes(r[1].encode()), 25), np.zeros(len(h), np.uint32), np.arange(len(h))) for r in parts])
    known, sent = substring_dedup._shared(e, 25)
    assert len(known) >= 36 * 3000 and len(sent) < len(e.ids) - 35 * 2900
    want = plain_substrings(docs.collect(), 50)
    assert sum(n >= 60 for _, _, n, _ in want) == 3999
    assert table(substring_dedup.dedup_substrings(docs), "doc_id", "__words", "__removed", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("per_shard, hot", [(200_000, 2000), (2, 2)])
def test_line_dedup(nasty, empty, per_shard, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "POSTINGS_PER_SHARD", per_shard)  # small: shards are salted
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    docs = [(i, (t or "").split("\n")) for i, t in nasty.select("doc_id", "text").collect()]
    holders = defaultdict(set)
    for i, lines in docs:
        if i is not None:
            for x in lines:
                holders[key(x)].add(i)
    want = []
    for i, lines in docs:
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert table(line_dedup.dedup_lines(nasty), "doc_id", "__lines", "__dropped", "text") == sorted(want, key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_is_reversible(spark):
    docs = spark.createDataFrame([(k, f"common opening line\nown line number {k}\nshared by pairs {k // 2}") for k in range(12)], "doc_id long, text string")
    whole = line_dedup.build_state(docs)
    late = line_dedup.insert_documents(line_dedup.build_state(docs.where("doc_id < 7")), docs.where("doc_id >= 7"))
    assert table(line_dedup.repeated_lines(late.postings, late), "doc_id", F.hex("digest")) == table(line_dedup.repeated_lines(whole.postings, whole), "doc_id", F.hex("digest"))
    left = line_dedup.delete_documents(whole, docs.where("doc_id in (0, 3)"))
    fresh = line_dedup.build_state(docs.where("doc_id not in (0, 3)"))
    assert table(line_dedup.repeated_lines(left.postings, left), "doc_id", F.hex("digest")) == table(line_dedup.repeated_lines(fresh.postings, fresh), "doc_id", F.hex("digest"))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    made = line_dedup.CuckooFilter.of(keys)
    assert made.contains(keys).all() and made.contains(rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)).mean() < 0.01
    made.delete(keys[:2000])
    assert made.contains(keys[2000:]).all() and made.contains(keys[:2000]).mean() < 0.01
    assert line_dedup.CuckooFilter.of(keys[:0]).contains(keys).sum() == 0


def test_pii(spark, nasty, empty):
    texts = [f"{prose(5, k)} mail bob.{k}@host{k}.example.org call +1 (415) 555-{1000 + k} at 10.0.{k}.7 card 4111 1111 1111 1111 {prose(5, k + 1)}" for k in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (98, "v 1.2.3.4.5 999.1.1.1 +12 4111111111111112 1234567890123456"), (99, None)], "doc_id long, text string")
    model = pii.fit_pii(docs)
    for r in pii.find_pii(docs, model).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["__base"]]
        assert set(base) <= {(s["kind"], s["start"], s["end"]) for s in r["__spans"]}
        if r["doc_id"] < 60:
            assert [k for k, _, _ in base] == ["email", "phone", "ip", "card"]
        if r["doc_id"] == 99:
            assert base == []
        if r["doc_id"] == 98:
            assert [(k, r["text"][a:b]) for k, a, b in base] == [("ip", "1.2.3.4")]
    one = spark.createDataFrame([(1, "call (415) 555-2671 today")], "doc_id long, text string")
    assert pii.redact(one, model).first()["text"] == "call [phone] today"
    assert pii.find_pii(nasty, model).count() == nasty.count() and pii.find_pii(empty, pii.fit_pii(empty)).count() == 0


def test_pii_base_spans_are_those_of_the_patterns():
    from time import process_time

    rng = np.random.default_rng(12)
    letters = list("aZ09.@-+_% ()~\n") + ["1.2.3.4", "10.20.30.40.50.60.70.80", "a@b.c", "@x.y", "+1 (2", "4111 1111 1111 1111", "999.1.1.1", ".."]
    for n in rng.integers(1, 40, 4000):
        text = "".join(letters[k] for k in rng.integers(0, len(letters), n))
        for kind in pii.KINDS:
            assert list(pii._matches(kind, text)) == [(m.start(), m.end()) for m in pii.PATTERNS[kind].finditer(text)], (kind, text)
    for text in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "+1" * 400_000, "a@" * 400_000, "+" + "(" * 500_000, "a@b.c " * 150_000):
        began = process_time()
        pii.base_spans(text)
        assert process_time() - began < 10, text[:10]


def test_pii_taken_stretches():
    rng = np.random.default_rng(13)
    spans = [("ip", int(a), int(a + n)) for a, n in zip(rng.integers(0, 300, 60), rng.integers(1, 8, 60))]
    taken = pii.Taken(spans)
    for a in range(310):
        assert taken.meets(("ip", a, a + 3)) == any(a < e and a + 3 > s for _, s, e in spans)


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 12))
    rows = [(k, (base[k % 40] + rng.normal(size=12) * (0.15 if k < 80 else 0.5)).astype(np.float32).tolist()) for k in range(160)]
    rows += [(200 + k, rows[3][1]) for k in range(30)] + [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [1.0] * 5), (304, []), (305, [None] * 12), (306, [float("inf")] + [0.0] * 11), (307, [2.0] * 5), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, label int")
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if g else None for (_, v), g in zip(rows, good)]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(near):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    first = {}
    for k, (i, _) in enumerate(rows):
        first[root[k]] = min(i, first.get(root[k], i))
    want = sorted((i, len(near[k]), first[root[k]], i == first[root[k]]) for k, (i, _) in enumerate(rows))
    assert sum(map(len, near)) > 500
    assert sorted(map(tuple, embedding_dedup.near_vectors(df).collect())) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0 and embedding_dedup.near_vectors(df.where("vec_id = 300")).first()["kept"]


def test_registry_digests(spark):
    import duckdb

    from locusframe.llm import registry
    from tests.compare import rows

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, query in registry.QUERIES.items():
        got = query(spark, sf)
        if name in registry.SQL:
            assert rows(got.toPandas()) == rows(con.execute(registry.SQL[name]).df()), name
        else:
            assert got.count() > 0
    assert hashlib.sha256(b"").hexdigest()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.dtypes == docs.dtypes, name
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            counts.append(docs.count())
    assert counts[0] == counts[1] and counts[2] == counts[3]
    assert out.select("doc_id").distinct().count() == docs.count()
