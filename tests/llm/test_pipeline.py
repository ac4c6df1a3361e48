"""The stages of the pipeline on a small corpus with planted cases, each against what its input should give."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from locusframe.llm import toxicity
from tests.llm.conftest import prose

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("corpus"))
    passage = prose(30, 71)
    rows, labels = [], []
    for k in range(240):
        text = f"opening line number {k % 8} of every text\n{prose(60, k)}"
        if k % 6 == 0:
            text += " vile awfulword"
        if k % 40 == 1:
            text += f" {passage} {prose(5, 900 + k)}"
        rows.append((k, text))
        labels.append((k, 1, int(k % 6 == 0)))
    rows += [(300 + k, rows[7][1]) for k in range(5)] + [(310, rows[7][1].replace(" ", "  ").upper()), (311, rows[7][1] + " one more"), (7, rows[8][1]), (7, rows[7][1])]
    rows += [(400, None), (401, ""), (None, rows[9][1])]
    docs = spark.createDataFrame([(i, t, "en", "web" if (i or 0) % 3 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, prose(40, 3))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, spark.read.parquet(f"{sf}/documents.parquet")


def test_toxic_documents_go(spark, corpus):
    sf, docs = corpus
    out = STAGES["toxicity"](spark, docs, sf)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    want = Counter(r["doc_id"] for r, s in zip(rows, model.score([r["text"] for r in rows])) if s < 0.5)
    assert Counter(r["doc_id"] for r in out.collect()) == want and out.columns == docs.columns
    assert all(want[k] == 0 for k in range(0, 240, 6)) and all(want[k] for k in range(240) if k % 6)


def test_repeated_lines_go(spark, corpus):
    sf, docs = corpus
    out = STAGES["line dedup"](spark, docs, sf).collect()
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for r in docs.where("doc_id is not null").collect():
        for x in (r["text"] or "").split("\n"):
            holders[key(x)].add(r["doc_id"])
    want = []
    for r in docs.collect():
        kept = [x for x in (r["text"] or "").split("\n") if r["doc_id"] is None or len(key(x)) < 10 or r["doc_id"] == min(holders[key(x)])]
        want.append((r["doc_id"], "\n".join(kept), len("\n".join(kept))))
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out), key=repr) == sorted(want, key=repr)


def test_one_of_each_near_copy_stays(spark, corpus):
    sf, docs = corpus
    out = STAGES["simhash near-dedup"](spark, docs, sf)
    got = Counter(r["doc_id"] for r in out.collect())
    assert got[None] == 1 and out.columns == docs.columns
    # Id 7 has two texts: its own, with copies 300 to 311, and that of 8, of which the row with the smaller id stays.
    assert got[7] == 2 and not any(got[k] for k in (8, *range(300, 305), 310, 311))
    assert got[400] + got[401] == 1 and all(got[k] == 1 for k in range(240) if k not in (7, 8))


def test_benchmark_words_are_cut(spark, corpus):
    sf, docs = corpus
    out = {(r["doc_id"], r["n_chars"]): r["text"] for r in STAGES["benchmark decontamination"](spark, docs, sf).collect()}
    for r in docs.collect():
        cut = r["text"].replace(prose(30, 71), "") if r["text"] else r["text"]
        assert out[r["doc_id"], len(cut or "") if cut is not None else None] == cut


def test_all_tokens_are_packed(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf, docs = corpus
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    pieces = STAGES["packing"](spark, docs, sf).collect()
    assert sum(r["length"] for r in pieces) == want
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert all(used[k] == 2048 for k in range(len(used) - 1))
    first = [r for r in pieces if r["start"] == 0 and r["length"] == r["doc_tokens"] and r["doc_id"] == 401]
    assert first and first[0]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
