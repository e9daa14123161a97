"""Readers, writers and streaming."""

import gzip

import pytest
from pyspark.sql import functions as F

from loomspan import streaming
from loomspan.sources import formats, readers, writers


def put(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_formats_compile(spark):
    row = spark.createDataFrame([([str(i) for i in range(30)],)], "cells array<string>")
    for name, f in formats.FORMATS.items():
        if f.keys:
            row.select(*[readers.compile_key(e, F.col("cells")).alias(k) for k, e in f.keys.items()]).collect()
    assert "bed" in formats.find("bed") and "macs_output" in formats.find("tag_height")
    with pytest.raises(ValueError):
        readers.compile_key("__import__('os')", F.col("cells"))


def test_bed_and_summits(spark, tmp_path):
    p = put(tmp_path / "a.bed", "chr1\t10\t20\tx\t1.5\t+\nchr2\t30\t40\ty\t2\t-\n\n")
    got = readers.read_table(spark, p, "bed").orderBy("rid").collect()
    assert [(r.rid, tuple(r.loc), r.name, r.score, r.strand) for r in got] == [(0, ("chr1", 10, 20), "x", 1.5, "+"), (1, ("chr2", 30, 40), "y", 2.0, "-")]
    q = put(tmp_path / "m.xls", "# comment\n# more\nchr\tstart\tend\tlength\tsummit\ttags\tp\tfold\tfdr\nchr1\t100\t200\t101\t30\t7\t1\t3.5\t0\n")
    assert tuple(readers.read_table(spark, q, "macs_summit").first().loc) == ("chr1", 130, 130)
    assert readers.read_table(spark, q, "macs_output").first().tag_height == 7


def test_sniffed_csv(spark, tmp_path):
    text = 'loc,name,score\rchr1:10-20,"a, ""b""",1\rchr2:30-40,c,\r'
    for p in (put(tmp_path / "s.csv", text), str(tmp_path / "s.csv.gz")):
        if p.endswith("gz"):
            gzip.open(p, "wt", newline="").write(text)
        got = readers.read_table(spark, p, "default").orderBy("rid").collect()
        assert [(tuple(r.loc), r.name, r.score) for r in got] == [(("chr1", 10, 20), 'a, "b"', 1), (("chr2", 30, 40), "c", None)]


def test_sam_gtf_and_expression(spark, tmp_path):
    sam = put(tmp_path / "x.sam", "r1\t0\tchr1\t100\t50\t4M\t*\t0\t0\tACGT\tIIII\tXS:A:-\nr2\t0\tchr1\t100\t50\t4M\t*\t0\t0\tACGT\tIIII\n")
    got = readers.read_table(spark, sam, "sam_tophat_xs").collect()
    assert [(r.name, r.strand, tuple(r.loc)) for r in got] == [("r1", "-", ("chr1", 100, 100))]
    gtf = put(tmp_path / "x.gtf", '#c\nchr1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "G1"; n "2";\n')
    r = readers.read_table(spark, gtf, "gtf").first()
    assert (tuple(r.loc), r.feature, r.attributes) == (("chr1", 5, 9), "exon", {"gene_id": "G1", "n": "2"})
    e = put(tmp_path / "e.tsv", "name\tid\tA\tB\nx\t1\t1.5\tNaN\ny\t2\tbad\n")
    df, names = readers.read_expression(spark, e, {"name": 0}, 2)
    assert names == ["A", "B"] and {r.name: r.conditions for r in df.collect()} == {"x": [1.5, 0.0], "y": [0.0, 0.0]}


def test_sequences(spark, tmp_path):
    fa = put(tmp_path / "x.fa", ">one desc\nACGT\nacgt\n>two\nNN\n")
    assert {r.name: r.seq for r in readers.read_fasta(spark, fa).collect()} == {"one desc": "ACGTacgt", "two": "NN"}
    fq = put(tmp_path / "x.fq", "@a:1:2:3:4:5/1\nAC\n+\n@I\n@a:1:2:3:4:5/2\nGT\n+\n!J\n@b\nA\n")
    reads = readers.read_fastq(spark, fq)
    got = reads.orderBy("rec").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == [("@a:1:2:3:4:5/1", "AC", [31, 40]), ("@a:1:2:3:4:5/2", "GT", [0, 41])]
    assert readers.split_pairs_fastq(reads).count() == 0 and readers.split_pairs_fastq(reads.withColumn("id", F.lit("@a:1:2:3:4:5:6"))).count() == 1
    assert writers.fastq_lines(reads).orderBy("value").first().value == "@a:1:2:3:4:5/1\nAC\n+\n@I"


def test_wig(spark, tmp_path):
    w = put(tmp_path / "x.wig", "track x\nvariableStep chrom=chr1 span=5\n10 1.5\n20 2\nfixedStep chrom=chr2 start=100 step=10\n3\n4\n")
    got = sorted(tuple(r) for r in readers.read_wig(spark, w).collect())
    assert got == [("chr1", 10, 5, 1.5), ("chr1", 20, 5, 2.0), ("chr2", 100, 1, 3.0), ("chr2", 110, 1, 4.0)]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, ("chr1", 10, 20), "a", 1.5, "-"), (1, ("chr2", 1, 2), None, None, None)], "rid long, loc struct<chrom: string, left: bigint, right: bigint>, name string, score double, strand string")
    out = str(tmp_path / "o.bed")
    writers.write_bed(df, out, name="name", score="score", strand="strand", single=True)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["chr1\t10\t20\ta\t1.5\t-", "chr2\t1\t2\t0\t0\t+"]
    back = readers.read_table(spark, out, "bed")
    assert {tuple(r.loc) for r in back.collect()} == {("chr1", 10, 20), ("chr2", 1, 2)}
    writers.write_delimited(df, str(tmp_path / "o.csv"), key_order=["name"], single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).columns == ["name", "rid", "loc", "score", "strand"]
    line = writers.gtf_lines(df.where("rid = 0"), strand="strand", score="score").first().value
    assert line == 'chr1\tsource\texon\t10\t20\t1.5\t-\t.\trid "0"; name "a";'
    assert writers.fasta_lines(df.withColumn("seq", F.lit("AC")), ["loc"]).first().value == ">chr1:10-20\nAC"


def test_stream_join(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "chr1", 15), (2, "chr1", 99)], "id long, chrom string, pos long").write.parquet(src)
    stream = spark.readStream.schema("id long, chrom string, pos long").parquet(src)
    features = spark.createDataFrame([(7, ("chr1", 10, 20))], "gid long, loc struct<chrom: string, left: bigint, right: bigint>")
    at = F.struct(F.col("chrom"), F.col("pos").alias("left"), F.col("pos").alias("right"))
    joined = streaming.interval_join(stream, features, at, F.col("loc")).select("a.id", "b.gid")
    q = joined.writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("hits").collect()] == [(1, 7)]
