"""Alignment lines, index chunks, GenBank entries and the tree of datasets."""

import random

import pytest
from pyspark.sql import functions as F

from readforge.sources import chunks, records


def test_sam(spark, tmp_path):
    path = tmp_path / "a.sam"
    path.write_text("@HD\tVN:1.0\tSO:coordinate\n@CO\tfree text\tand more\nr1\t16\tref\t7\t30\t8M\t*\t0\t0\tACGTACGT\t*\tNM:i:2\tXX:Z:a:b\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    one, two = records.read_sam(spark, str(path)).orderBy("qname").collect()
    assert (one.qname, one.flag, one.pos, one.cigar, one.tags) == ("r1", 16, 7, "8M", {"NM": "i:2", "XX": "Z:a:b"}) and two.seq == "*" and two.tags == {}
    head = {r.type: r.fields for r in records.sam_header(spark, str(path)).collect()}
    assert head == {"HD": {"VN": "1.0", "SO": "coordinate"}, "CO": {"text": "free text\tand more"}}
    records.write_sam(records.read_sam(spark, str(path)), str(tmp_path / "b"))
    assert sorted(map(tuple, records.read_sam(spark, str(tmp_path / "b")).drop("tags").collect())) == sorted(map(tuple, records.read_sam(spark, str(path)).drop("tags").collect()))
    (tmp_path / "bad.sam").write_text("r1\t16\n")
    with pytest.raises(Exception, match="not an alignment line"):
        records.read_sam(spark, str(tmp_path / "bad.sam")).collect()


def test_index_bins(spark):
    sizes = [(0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)]
    rng = random.Random(2)
    rows = [(s, s + rng.choice([1, 100, 20_000, 200_000, 3_000_000, 50_000_000])) for s in (rng.randrange(1 << 28) for _ in range(200))]
    want = {(s, e): next(first + (s >> shift) for first, shift in reversed(sizes) if s >> shift == (e - 1) >> shift) for s, e in rows}
    got = spark.createDataFrame(rows, "s long, e long").select("s", "e", records.index_bin(F.col("s"), F.col("e")).alias("b")).collect()
    assert {(r.s, r.e): r.b for r in got} == want


def test_chunks_are_merged(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), s, s + rng.randrange(1, 30)) for s in (rng.randrange(400) for _ in range(60))]
    want = set()
    for b in range(3):
        now = None
        for s, e in sorted(((s, e) for k, s, e in rows if k == b), key=lambda x: (x[0], -x[1])):
            if now and s <= now[1]:
                now[1] = max(now[1], e)
            else:
                if now:
                    want.add((b, *now))
                now = [s, e]
        want.add((b, *now))
    got = records.merged_chunks(spark.createDataFrame(rows, "bin long, chunk_start long, chunk_end long"), ["bin"])
    assert {tuple(r) for r in got.collect()} == want


ENTRY = """LOCUS       AB000001                 70 bp    DNA     linear   PRI 01-JAN-2000
DEFINITION  First line
            and second.
ACCESSION   AB000001
FEATURES             Location/Qualifiers
     source          1..70
                     /organism="Homo sapiens"
                     /pseudo
     CDS             join(3..10,
                     complement(21..25))
                     /note="says ""yes"" over
                     two lines"
                     /codon_start=1
ORIGIN
        1 acgtacgtac ggggtttttt accccaaaat acgtacgtac acgtacgtac acgtacgtac
       61 ttttttttta
//
"""


def test_genbank(spark, tmp_path):
    path = tmp_path / "a.gb"
    path.write_text(ENTRY + ENTRY.replace("AB000001", "AB000002").replace("join(3..10,\n                     complement(21..25))", "complement(join(1..2,4))"))
    one, two = records.read_genbank(spark, str(path)).orderBy("locus").collect()
    assert (one.locus, one.length, one.definition, one.accession, len(one.seq)) == ("AB000001", 70, "First line and second.", "AB000001", 70)
    assert [f.key for f in one.features] == ["source", "CDS"] and one.features[1].location == "join(3..10,complement(21..25))"
    assert [tuple(q) for q in one.features[0].qualifiers] == [("organism", "Homo sapiens"), ("pseudo", None)]
    assert [tuple(q) for q in one.features[1].qualifiers] == [("note", 'says "yes" over two lines'), ("codon_start", "1")]
    cds = {r.locus: (r.bases, r.qualifiers) for r in records.features_of(records.read_genbank(spark, str(path)), "CDS").collect()}
    assert cds["AB000001"][0] == "GTACGTAC" + "GGGGT" and cds["AB000002"][0] == "AGT"
    assert cds["AB000001"][1] == {"note": ['says "yes" over two lines'], "codon_start": ["1"]}
    records.write_genbank(records.read_genbank(spark, str(path)), str(tmp_path / "b"))
    again = {r.locus: r for r in records.read_genbank(spark, str(tmp_path / "b")).collect()}
    assert again == {"AB000001": one, "AB000002": two}


def test_tree_of_datasets(spark, tmp_path):
    store = chunks.ChunkStore(spark, "file://" + str(tmp_path / "store"))
    assert store.children() == [] and store.read_dataset("/a/x") is None
    store.create_group("/a/b")
    store.write_dataset("/a/x", spark.range(3))
    store.write_dataset("/a/x", spark.range(2))
    assert store.read_dataset("/a/x").count() == 5
    assert store.children("/a") == ["b", "x"] and store.children("/a", "group") == ["b"] and store.children("/a", "dataset") == ["x"]
    store.write_attribute("/a", "n", 4)
    store.write_attribute("/a", "n", 5)
    assert store.read_attribute("/a", "n") == 5 and store.read_attribute("/a", "m") is None
    assert store.write_string_array("/a/x", "names", ["one", None, "three"]) == 6 and list(store.read_attribute("/a/x", "names")) == ["one", "", "three"]
    store.delete_attribute("/a", "n")
    assert store.read_attribute("/a", "n") is None and store.children("/a") == ["b", "x"]
    with pytest.raises(ValueError):
        store.write_attribute("/none", "n", 1)
