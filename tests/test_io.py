"""Readers by round trip, sinks, streams."""

import gzip
import json

from pyspark.sql import functions as F

from locusframe.sources import readers as rd
from locusframe.sources import writers as wr
from locusframe.streaming import streams


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(p)


def test_intervals(spark, tmp_path):
    p = put(tmp_path, "a.narrowPeak.gz", "track x\n#c\nchr1\t5\t9\tp\t.\t+\t\nchr1\t5\nchr2\t1\t2\tq\t7\t-\t3.5\t1\n")
    assert [tuple(r) for r in rd.read_narrowpeak(spark, p).orderBy("chrom").collect()] == [("chr1", 5, 9, "p", 0.0, "+", 0.0), ("chr2", 1, 2, "q", 7.0, "-", 3.5)]
    assert rd.read_bed(spark, put(tmp_path, "a.bed", "chr1\t1\t4\n")).first()["signal"] == 0.0


def test_genes_variants_signal(spark, tmp_path):
    line = 'chr1\th\tgene\t{}\t{}\t.\t{}\t.\tgene_id "e"; gene_name "{}";\n'
    p = put(tmp_path, "g.gtf", line.format(10, 20, "-", "AB") + line.format(1, 2, "+", "AB") + line.format(3, 8, "+", "CD"))
    assert {(r["symbol"], r["tss"]) for r in rd.read_gene_tss(spark, p).collect()} == {("AB", 20), ("CD", 3)}
    p = put(tmp_path, "v.vcf", "##x\n#CHROM\nNC_000001.11\t10\trs1\tA\tT\n7\t5\trs2\nGL1\t5\trs3\n")
    assert sorted((r["chrom"], r["start_pos"], r["end_pos"]) for r in rd.read_variants(spark, p).collect()) == [("chr1", 9, 10), ("chr7", 4, 5)]
    assert rd.read_signal(spark, put(tmp_path, "s.bedGraph", "chr1\t0\t5\t1.5\n")).first()["value"] == 1.5


def test_matrices(spark, tmp_path):
    p = put(tmp_path, "m.gct", "#1.2\n2\t2\nName\tAB (1)\tAB (2)\tCD\nr1\t1\t2\tx\nr2\t3\t4\t5\n")
    assert sorted(map(tuple, rd.read_wide_matrix(spark, p, "name", skip=2).collect()), key=str) == [("r1", "AB", 1.0), ("r1", "CD", None), ("r2", "AB", 3.0), ("r2", "CD", 5.0)]
    coords = spark.createDataFrame([("hg1", "chr1", 0, 5), ("hg2", "chr1", 5, 9)], ["peak", "chrom", "start_pos", "end_pos"])
    got = rd.peak_activity(spark, put(tmp_path, "a.tsv", "hg1\t1\t3\nhg2\t0\t0\nmm1\t5\t5\n"), coords).collect()
    assert [(r["peak"], r["mean"], r["top"]) for r in got] == [("hg1", 2.0, 3.0)]
    spec = rd.CatalogSpec({"symbol": ("HGNC symbol",), "tf": ("is tf?",), "q": ("qvalue",)}, numbers=("q",), equals={"tf": "yes"})
    got = rd.read_catalog(spark, put(tmp_path, "c.tsv", "HGNC symbol\tIs TF?\tQvalue\nA\tYes\t0.1\nB\tNo\t1\nC\tyes\tn/a\n"), spec)
    assert sorted(map(tuple, got.collect())) == [("A", "Yes", 0.1), ("C", "yes", None)]
    w = rd.read_weights(spark, put(tmp_path, "w.txt", "AC1 0.5\nAG2,0.25\nx\n"), "[ACGT]{2}[0-9]+", 2)
    assert {tuple(r) for r in w.collect()} == {("AC1", 0.5), ("AG2", 0.25)}


def test_fasta_chunks(spark, tmp_path):
    p = put(tmp_path, "x.fa", ">c1 d\nACGTACGTAC\nGTACGT\n>c2\nTTT\n")
    got = rd.read_fasta(spark, p, chunk=6, overlap=2)
    assert sorted(map(tuple, got.collect())) == [("c1", 0, "ACGTACGT"), ("c1", 6, "GTACGTAC"), ("c1", 12, "ACGT"), ("c2", 0, "TTT")]
    assert rd.check_assembly(got, spark.createDataFrame([("c1", 16), ("c2", 4)], ["chrom", "size"]), 6).first()["chrom"] == "c2"


def test_motifs_and_samples(spark, tmp_path):
    p = put(tmp_path, "j.pfm", ">MA1 AB::CD\nA [ 4 0 ]\nC [ 0 4 ]\nG [ 0 0 ]\nT [ 0 0 ]\n>MA2 AB\nA [ 1 ]\nC [ 1 ]\nG [ 1 ]\nT [ 1 ]\n")
    rows = rd.read_pwms(spark, p).collect()
    assert {(r["tf"], r["pos"]) for r in rows} == {("AB", 0), ("AB", 1), ("CD", 0), ("CD", 1)}
    soft = "^DATABASE = x\n^SAMPLE = GSM1\n!Sample_title = t\n!Sample_organism_ch1 = Homo sapiens\n!Sample_characteristics_ch1 = Cell Type: a: b\n!Sample_characteristics_ch1 = cell type: c\n!Sample_status = Public on Jan 02 2020\n!Sample_supplementary_file_1 = NONE\n!Sample_supplementary_file_2 = f\n"
    r = rd.read_soft(spark, put(tmp_path, "s.soft", soft)).first()
    assert r["sample"] == "GSM1" and r["characteristics"] == {"cell type": ["a: b", "c"]} and r["files"] == ["f"] and str(r["released"]) == "2020-01-02"
    m = put(tmp_path, "m.json", json.dumps({"artifacts": [{"name": "a", "bytes": 1}, {"name": "b", "bytes": 2}]}))
    assert rd.read_manifests(spark, m).count() == 2
    names = spark.createDataFrame([("x/GSM12_ATAC_rep2.bw",), ("y.txt",)], ["f"])
    assert [tuple(r)[1:] for r in rd.classify_filenames(names, "f").collect()] == [("GSM12", "ATAC-seq", 2, "bw"), (None, None, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "chr1", k, k + 1) for k in range(50)], ["accession", "chrom", "start_pos", "end_pos"])
    wr.write_windows(df, f"{tmp_path}/w", 10)
    m = wr.shard_manifest(spark, f"{tmp_path}/w")
    assert m.count() >= 5 and m.select("collection").distinct().count() == 1
    wr.write_sorted(df, f"{tmp_path}/s")
    wr.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 50
    calls = []
    for _ in range(2):
        assert wr.cached(spark, f"{tmp_path}/c", lambda s: calls.append(1) or df).count() == 50
    assert calls == [1]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"g{k % 3}", "s", "train" if k % 2 else "locus_test") for k in range(12)], ["example_id", "sample_group", "study", "split"])
    rows.write.parquet(f"{tmp_path}/in")
    rows.limit(4).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    q = streams.stream_windows(spark, f"{tmp_path}/in", rows.schema, include=("s",))
    streams.run_once(q, f"{tmp_path}/ck1", "append", lambda df, n: seen.append(df.count()))
    assert sum(seen) == 12
    got = {}
    streams.run_once(streams.stream_leakage(q, ["locus_test"]), f"{tmp_path}/ck2", "update", lambda df, n: got.update({r["sample_group"]: r["leak"] for r in df.collect()}))
    assert got == {"g0": True, "g1": True, "g2": True}
