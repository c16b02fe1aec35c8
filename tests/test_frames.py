"""DataFrame operators on golden vectors, formats in round trips, streams."""

import pytest
from pyspark.sql import functions as F

from readforge.functions import columns as C
from readforge.operators import graphs as G
from readforge.operators import intervals as I
from readforge.operators import kmers as K
from readforge.operators import pileup as P
from readforge.sources import formats
from readforge.streaming import adapters


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, starts, ends):
    return spark.createDataFrame([(0, s, e) for s, e in zip(starts, ends, strict=True)], "rname int, t_start long, t_end long")


@pytest.mark.parametrize(("start", "want"), [(0, [0, 1, 2, 2, 1, 0, 0, 0, 1, 1]), (10, [0, 0, 0, 0, 0, 1, 1, 1, 1, 1])])
def test_window_coverage(spark, start, want):
    own = frame(spark, [1, 2, 3, 8, 10, 15], [3, 4, 5, 10, 10, 200])
    depth = {r.pos: r.depth for r in I.window_coverage(own, start, 10).collect()}
    assert [depth.get(i, 0) for i in range(start, start + 10)] == want


@pytest.mark.parametrize(
    ("window", "least", "want"),
    [((0, 10000), 0, [(0, 10000)]), ((0, 10000), 1, [(1, 5), (8, 10), (900, 1010), (2000, 10000)]), ((0, 10000), 2, [(2, 4)]), ((0, 10000), 3, []), ((100, 10000), 0, [(100, 10000)]), ((100, 10000), 1, [(900, 1010), (2000, 10000)])],
)
def test_covered_intervals(spark, window, least, want):
    own = frame(spark, [1, 2, 3, 8, 900, 2000], [3, 4, 5, 10, 1010, 20000])
    assert sorted((r.start, r.end) for r in I.covered(own, least, window=window).collect()) == want


def test_covered_by_one_long_read(spark):
    assert [(r.start, r.end) for r in I.covered(frame(spark, [48853], [50687]), 1, window=(50000, 50500)).collect()] == [(50000, 50500)]


def test_overlap_join_has_each_pair_once(spark):
    a = frame(spark, [0, 5, 90, 7], [100, 6, 91, 7])
    b = a.select("rname", F.col("t_start").alias("s"), F.col("t_end").alias("e"))
    got = sorted((r.t_start, r.s) for r in I.overlap_join(a, b, "rname", 8, ("t_start", "t_end"), ("s", "e")).collect())
    assert got == [(0, 0), (0, 5), (0, 90), (5, 0), (5, 5), (90, 0), (90, 90)]


def test_genotype_states(spark):
    rows = [("r", 1, 0, 30)] * 9 + [("r", 1, 1, 30)] * 3 + [("r", 2, 5, 30)] + [("r", 2, 0, 30)] * 3 + [("r", 3, 4, 30), ("r", 3, 0, 17)] + [("r", 4, 3, 30), ("r", 4, 2, 30)]
    got = {r.pos: r for r in P.genotypes(spark.createDataFrame(rows, "rname string, pos int, base int, phred int")).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["GenotypeCalled", "TooManyGaps", "NoData", "GenotypeCalled"]
    assert got[1].genotype == "A" and got[1].fA == 0.75 and got[4].genotype == "G"


def test_distances(spark):
    rows = [(1, "ACGT-A"), (2, "ACGA-C")]
    own = spark.createDataFrame(rows, "id int, s string")
    a, b = own.where("id = 1").select(F.col("s").alias("a")), own.where("id = 2").select(F.col("s").alias("b"))
    assert a.join(b).select(C.percent_identity(F.col("a"), F.col("b"))).first()[0] == 0.5
    assert value(spark, K.kimura(F.lit(0.95))) == 10.0 and value(spark, K.kimura(F.lit(0.75))) == 1.95 and value(spark, K.kimura(F.lit(0.93))) == 9.88
    assert value(spark, K.kimura(F.lit(0.0))) == 0


def test_strings(spark):
    assert value(spark, C.split_protected(F.lit("a(b,c),d,e((f,g),h)"))) == ["a(b,c)", "d", "e((f,g),h)"]
    with pytest.raises(Exception, match="balance"):
        value(spark, C.split_protected(F.lit("a(b,c")))
    with pytest.raises(Exception, match="too few"):
        value(spark, C.split_exactly(F.lit("a/b"), "/", 3))
    assert value(spark, C.split_exactly(F.lit("a|b|c|d"), "|", 3)) == ["a", "b", "c|d"]
    assert value(spark, C.after_first(F.lit("k=v=w"), "=")) == "v=w" and value(spark, C.after_first(F.lit("k"), "=")) == ""
    assert value(spark, C.complement(F.lit("ACGTacgtNM-x"))) == "TGCAtgcaNM-\x7f"
    assert value(spark, C.reverse_complement(C.reverse_complement(F.lit("GATTACA")))) == "GATTACA"
    assert value(spark, C.find_all(F.lit("ACACA"), "ACA")) == [0, 2] and value(spark, C.find_all(F.lit("acaca"), "ACA", 1, True)) == [2]


def test_mutations_by_expression(spark):
    m = lambda kind, s, e, b: F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(b).alias("bases"))
    many = F.array(m("INS", 3, 3, "C"), m("SUBS", 6, 7, "T"), m("INS", 0, 0, "G"), m("DEL", 4, 5, ""), m("INS", 2, 2, "T"))
    assert value(spark, C.apply_mutations(F.lit("GATTACA"), many)) == "GGATTCTCT"
    assert value(spark, C.apply_mutations(F.lit("GATTACA"), F.array(m("SUBS", 2, 3, "A"), m("INS", 2, 2, "T")))) == "GATATACA"


def test_names_and_cigar(spark):
    p = value(spark, C.parse_subread_name(F.lit("m1/42/10_250 RQ=0.9")))
    assert (p.movie, p.zmw, p.start, p.end) == ("m1", 42, 10, 250)
    assert value(spark, C.build_cigar(C.parse_cigar(F.lit("10M2I3D=")))) == "10M2I3D" and value(spark, C.reference_length(C.parse_cigar(F.lit("5M2I3D4N1X")))) == 13
    assert value(spark, F.size(C.parse_cigar(F.lit("*")))) == 0
    o = value(spark, C.unpack_offset(C.pack_offset(F.lit(123456789012), F.lit(65535))))
    assert (o.block, o.inside) == (123456789012, 65535)


def test_qualities(spark):
    assert value(spark, C.trim_tail(F.array(*[F.lit(x) for x in (30, 10, 25, 5, 3)]))) == [30, 10, 25]
    assert value(spark, C.trim_tail(F.array(F.lit(1)))) == []
    s = value(spark, C.array_statistics(F.array().cast("array<int>")))
    assert s.max != s.max and s.mean != s.mean
    assert value(spark, C.log_add(F.lit(float("-inf")), F.lit(float("-inf")))) == float("-inf")


def test_sections(spark):
    cut = lambda a, b: value(spark, C.section(F.lit("ABCDEFGH"), F.lit(a), F.lit(b)))
    assert (cut(2, 4), cut(6, 2), cut(3, 3)) == ("CDE", "GHAB", "DEFGHABC")


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\nACGT\nAC\n>r2\nGG\n")
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("r1 x", "ACGTAC"), ("r2", "GG")]
    (tmp_path / "a.fq").write_text("@r1\nACG\n+\n@II\n@r2\nA\n+x\n#\n")
    got = {r.name: r for r in formats.read_fastq(spark, str(tmp_path / "a.fq")).collect()}
    assert got["r1"].qual == [31, 40, 40] and got["r2"].seq == "A"
    assert [r.name for r in formats.trimmed(spark.createDataFrame([("good", "ACGT", [40, 40, 40, 2]), ("bad", "AC", [5, 5]), ("even", "AC", [20, 20])], "name string, seq string, qual array<int>")).collect()] == ["good"]
    (tmp_path / "a.bed").write_text("track name=x\nchr1\t5\t9\nchr1\t\t7\t8\tn\t3\nbroken\t1\n")
    rows = formats.read_bed(spark, str(tmp_path / "a.bed")).orderBy("start").collect()
    assert [(r.chrom, r.start, r.end, r.name, r.score) for r in rows] == [("chr1", 5, 9, None, None), ("chr1", 7, 8, "n", "3")]
    assert formats.read_bed_groups(spark, str(tmp_path / "a.bed")).first().ranges[0].start == 5
    formats.write_bed(formats.read_bed(spark, str(tmp_path / "a.bed")), str(tmp_path / "out"))
    assert sorted(r.value.count("\t") for r in spark.read.text(str(tmp_path / "out")).collect()) == [2, 11]
    (tmp_path / "none.bed").write_text("track\n")
    with pytest.raises(ValueError):
        formats.read_bed_groups(spark, str(tmp_path / "none.bed"))
    (tmp_path / "list").write_text("x\ny\n")
    assert formats.listed_paths(spark, str(tmp_path / "list")) == ["x", "y"]
    for bad in ((None, []), (str(tmp_path / "list"), ["z"])):
        with pytest.raises(ValueError):
            formats.listed_paths(spark, *bad)
    (tmp_path / "p.ini").write_text("[C2.NoQVs]\nMatch=0.2\n")
    assert formats.load_parameters(spark, str(tmp_path / "p.ini")) == {"C2": {"NoQVs": {"Match": 0.2}}}
    formats.register_format("FASTA", parser=lambda *a: None)
    assert formats.PARSERS["fasta"] is formats.read_fasta
    with pytest.raises(ValueError):
        formats.parse(spark, "bam", "x")


def test_scaffolds_and_weights(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("d", "e")], "from_contig string, to_contig string")
    paths = sorted(",".join(r.path) for r in G.without_contained(G.scaffold_paths(links)).collect())
    assert paths == ["a,b,c", "a,b,d,e"]
    tree = spark.createDataFrame([(0, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (2, 4, 4.0)], "child int, parent int, length double")
    weights = {r.leaf: r.weight for r in G.sequence_weights(tree).collect()}
    assert weights[0] == weights[1] and abs(weights[2] - 8 / 12) < 1e-12


def test_stream_collects_children(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("m", 1, "AC"), ("m", 1, "ACG"), ("m", 2, "A")], "movie string, zmw long, seq string").write.parquet(source)
    stream = adapters.read_stream(spark, source, "movie string, zmw long, seq string")
    q = adapters.children_by_parent(stream).writeStream.format("memory").queryName("kids").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from kids").collect())) == [("m", 1, 2, 5), ("m", 2, 1, 1)]
    assert adapters.progress(q)["rows"] == 3


def test_a_failing_sink_is_told(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    told = []

    def broken(df, i):
        raise RuntimeError("disk full")

    q = adapters.map_to_sinks(adapters.read_stream(spark, source, "id long"), lambda d: d, [broken], str(tmp_path / "c"), told.append)
    with pytest.raises(Exception, match="disk full"):
        q.awaitTermination()
    assert len(told) == 1
