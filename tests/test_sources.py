"""Round trips of the file formats, the workspace and streaming."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from strandloom.operators.graph import Graph, mirrored
from strandloom.sources import fastx, gfa
from strandloom.sources.workspace import Workspace


def put(path, text):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">one first > still\nACG\nT\n>two\nGG\n")
    assert [tuple(r) for r in fastx.read_fasta(spark, p).orderBy("record_id").collect()] == [(1, "one", "first > still", "ACGT"), (2, "two", "", "GG")]
    assert fastx.read_fasta(spark, p, 3).count() == 1
    z = put(tmp_path / "b.fa.gz", ">x\nAC\n")
    assert fastx.read_fasta(spark, z).first().seq == "AC"


def fq(seqs):
    return "".join(f"@r{i} c\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))


def test_stores(spark, tmp_path):
    a = fastx.read_fastq(spark, put(tmp_path / "1.fq", fq(["ACGTACGT", "AC", "AAAACC"])))
    b = fastx.read_fastq(spark, put(tmp_path / "2.fq.gz", fq(["TTTT", "TTTTTT", "GGGGGGGG"])))
    got = [tuple(r) for r in fastx.paired_store(a, b, "p", 3, 6).select("read_id", "seq").orderBy("read_id").collect()]
    assert got == [(1, "ACGTAC"), (2, "TTTT"), (3, "AAAACC"), (4, "GGGGGG")]
    long_ = fastx.long_store(a.withColumn("seq", F.concat("seq", F.lit("xn"))), "l", 5)
    assert [tuple(r) for r in long_.select("read_id", "seq").orderBy("read_id").collect()] == [(1, "ACGTACGTNN"), (2, "AAAACCNN")]
    asked = fastx.read_sequences(long_, spark.createDataFrame([(1,), (-2,), (9,)], "read_id long"))
    assert {r.read_id: r.seq for r in asked.collect()} == {1: "ACGTACGTNN", -2: "NNGGTTTT", 9: ""}
    assert fastx.detected_read_size(a) == 8
    with pytest.raises(Exception):
        fastx.read_fastq(spark, put(tmp_path / "bad.fq", "r\nA\n+\nI\n")).collect()


def test_linked(spark, tmp_path):
    a = fastx.read_fastq(spark, put(tmp_path / "1.fq", fq(["T" * 16 + "G" * 7 + "ACC", "A" * 15 + "C" + "G" * 7 + "TTT", "N" * 16 + "G" * 7 + "CCC"])))
    b = fastx.read_fastq(spark, put(tmp_path / "2.fq", fq(["AA", "CC", "GG"])))
    got = [tuple(r) for r in fastx.linked_store(a, b, "k").select("read_id", "tag", "seq").orderBy("read_id").collect()]
    assert got == [(1, 0, "CCC"), (2, 0, "GG"), (3, 1, "TTT"), (4, 1, "CC"), (5, 4**16 - 1, "ACC"), (6, 4**16 - 1, "AA")]
    assert spark.range(1, 5).select(fastx.mate(F.col("id")).alias("m")).collect()[0].m == -2


def test_gfa1(spark, tmp_path):
    p = put(tmp_path / "g.gfa", "H\tVN:Z:1.0\nS\ts1\tAACC\nS\ts2\tTTTT\nS\ts3\t*\tLN:i:3\tUR:Z:g.fasta\nS\tgap_1\t*\tLN:i:50\nL\ts1\t+\ts2\t+\t3M\nL\ts1\t-\tgap_1\t+\t0M\nL\tgap_1\t+\ts3\t+\t0M\n")
    put(tmp_path / "g.fasta", ">s3\nACA\n")
    g, names = gfa.read_gfa(spark, p)
    ids = {r.name: r.node_id for r in names.collect()}
    assert ids == {"s1": 1, "s2": -2, "s3": 3} and {r.seq for r in g.nodes.collect()} == {"AACC", "AAAA", "ACA"}
    assert {tuple(r) for r in mirrored(g.links).select("source", "dest", "dist").collect()} == {(-1, -2, -3), (-2, -1, -3), (1, 3, 50), (3, 1, 50)}
    with pytest.raises(ValueError):
        gfa.read_gfa(spark, str(tmp_path / "g.fasta"))


def test_gfa_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "AACC"), (2, "AAGT"), (3, "ACAA")], "node_id long, seq string")
    links = spark.createDataFrame([(-1, 2, -2), (-2, -3, 10)], "source long, dest long, dist int")
    for write, kind in ((gfa.write_gfa1, "1.gfa"), (gfa.write_gfa2, "2.gfa2")):
        out = str(tmp_path / kind)
        write(spark, Graph(nodes, links), out)
        g, names = gfa.read_gfa(spark, out)
        new = {int(r.name.removeprefix("seq")): r.node_id for r in names.collect()}
        want = {(new[abs(s)] * (1 if s > 0 else -1), new[abs(d)] * (1 if d > 0 else -1), x) for s, d, x in [(-1, 2, -2), (2, -1, -2), (-2, -3, 10), (-3, -2, 10)]}
        assert {tuple(r) for r in mirrored(g.links).select("source", "dest", "dist").collect()} == want, kind


def test_bcalm(spark, tmp_path):
    p = put(tmp_path / "u.fa", ">0 LN:i:6 L:+:1:+\nAACCGT\n>1 LN:i:6 L:-:0:-\nCCGTAA\n")
    g, names = gfa.read_bcalm(spark, p, 5)
    assert {tuple(r) for r in g.links.collect()} in ({(-1, 2, -4)}, {(-1, -2, -4)})
    with pytest.raises(ValueError):
        gfa.read_bcalm(spark, p, 4)


def test_workspace(spark, tmp_path):
    ws = Workspace(spark)
    ws.add("nodes", "main", spark.range(3))
    ws.add_operation("made", "test", "three rows").entries.append("x")
    with pytest.raises(ValueError):
        ws.add("nodes", "main", spark.range(1))
    with pytest.raises(KeyError):
        ws.get("links", "none")
    where = str(tmp_path / "ws")
    os.makedirs(where)
    ws.dump(where)
    again = Workspace.load(spark, where)
    assert again.get("nodes", "main").count() == 3 and again.journal[0].entries == ["x"] and "3 rows" in again.ls()
    assert again.journal_table().first().tool == "test"


def test_stream_counts(spark, tmp_path):
    from strandloom.operators.kmer_counts import count_kmers
    from strandloom.streaming.kmer_stream import read_stream, run_to_end, streaming_counts

    rows = [("s", "paired", i, "ACGTACGTTGCA"[i % 3 :], None) for i in range(20)]
    reads = spark.createDataFrame(rows, "store string, kind string, read_id long, seq string, tag long")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    got = run_to_end(streaming_counts(read_stream(spark, str(tmp_path / "in")), 5), "counts", str(tmp_path / "cp"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in count_kmers(reads, 5).collect()}


def in_small_splits(spark, f):
    """``f`` with files read in splits of a few hundred bytes, which Spark hands out by size."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_of_split_files_stay_in_order(spark, tmp_path):
    import random

    r = random.Random(8)
    folder = tmp_path / "fq"
    folder.mkdir()
    seqs = [["".join(r.choice("ACGT") for _ in range(r.randrange(5, 90))) for _ in range(n)] for n in (60, 25, 90)]
    for i, s in enumerate(seqs):
        put(folder / f"{i}.fq", fq(s))
    want = [x for s in seqs for x in s]
    whole = [x.seq for x in fastx.read_fastq(spark, str(folder)).orderBy("record_id").collect()]
    split = in_small_splits(spark, lambda: [x.seq for x in fastx.read_fastq(spark, str(folder)).orderBy("record_id").collect()])
    assert whole == split == want
    fa = tmp_path / "fa"
    fa.mkdir()
    for i, s in enumerate(seqs):
        put(fa / f"{i}.fa", "".join(f">n{i}_{j} c\n{x[:40]}\n{x[40:]}\n" for j, x in enumerate(s)))
    read = lambda: [(x.name, x.seq) for x in fastx.read_fasta(spark, str(fa)).orderBy("record_id").collect()]
    named = [(f"n{i}_{j}", x) for i, s in enumerate(seqs) for j, x in enumerate(s)]
    assert read() == named and in_small_splits(spark, read) == named
    g = put(tmp_path / "big.gfa", "H\tVN:Z:1.0\n" + "".join(f"S\ts{j}\t{x}\n" for j, x in enumerate(want)) + "".join(f"L\ts{j}\t+\ts{j + 1}\t+\t0M\n" for j in range(50)))
    names = in_small_splits(spark, lambda: {x.name: abs(x.node_id) for x in gfa.read_gfa(spark, g)[1].collect()})
    assert names == {f"s{j}": j + 1 for j in range(len(want))}


def test_no_shared_folder_on_a_cluster_raises(spark):
    from strandloom import session

    class Jvm:
        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Sc

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = type("Fake", (), {"sparkContext": type("Context", (Jvm,), {"master": master}), "conf": Conf})
        with pytest.raises(RuntimeError):
            session.shared_dir(fake)


def test_intermediate_tables_are_deleted(spark):
    from strandloom import session

    kept = session.persisted(spark.range(5), "test")
    assert kept.count() == 5 and os.path.isdir(kept._kept_at.removeprefix("file://"))
    session.discard(kept)
    assert not os.path.exists(kept._kept_at.removeprefix("file://"))
