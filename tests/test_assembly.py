"""Assembly by overlaps against a plain version of its rule, and on sequences whose origin is known."""

import random

import pytest

from readforge.operators import graphs as G

PAIRS = str.maketrans("ACGT", "TGCA")
TURNS = {"+": lambda s: s, "-": lambda s: s.translate(PAIRS)[::-1], "r": lambda s: s[::-1], "c": lambda s: s.translate(PAIRS)}


def assembled(spark, reads, least, standard=True):
    frame = spark.createDataFrame(list(reads.items()), "id long, seq string")
    contigs, unmerged, gone = G.overlap_assembly(frame, least, standard)
    return {r.contig: (r.seq, r.ids) for r in contigs.collect()}, {r.id for r in unmerged.collect()}, {r.id: r.container for r in gone.collect()}


def plain_links(reads, least, turns):
    found = {}
    nodes = [(i, t) for i in reads for t in turns]
    for a in nodes:
        for b in nodes:
            x, y = TURNS[a[1]](reads[a[0]]), TURNS[b[1]](reads[b[0]])
            fits = [n for n in range(least, len(x)) if y.startswith(x[-n:])] if a[0] != b[0] else []
            if fits:
                found[a, b] = max(fits)
    rank = lambda a, b, other: (-found[a, b], other[0], a[1] != b[1])
    best = lambda kind, n: min((p for p in found if p[kind] == n), key=lambda p: rank(*p, p[1 - kind]))
    return {(*p, n) for p, n in found.items() if best(0, p[0]) == p and best(1, p[1]) == p}


@pytest.mark.parametrize("standard", [True, False])
def test_links_equal_plain_version(spark, standard):
    rng = random.Random(11)
    origin = "".join(rng.choice("ACGT") for _ in range(300))
    turns = ["+", "-"] if standard else list(TURNS)
    reads = {}
    for i in range(25):
        at = rng.randrange(260)
        reads[i] = TURNS[rng.choice(turns)](origin[at : at + 40])
    frame = spark.createDataFrame(list(reads.items()), "id long, seq string")
    got = {(tuple(r.src), tuple(r.dst), r.overlap) for r in G.best_overlaps(frame, 12, standard).collect()}
    assert got == plain_links(reads, 12, turns) and got


@pytest.mark.parametrize("standard", [True, False])
def test_a_known_sequence_is_put_together(spark, standard):
    rng = random.Random(12)
    origin = "".join(rng.choice("ACGT") for _ in range(500))
    turns = ["+", "-"] if standard else list(TURNS)
    reads = {i: TURNS[rng.choice(turns)](origin[i * 20 : i * 20 + 60]) for i in range(23)}
    reads |= {100: origin[45:70], 101: reads[3], 102: "".join(rng.choice("ACGT") for _ in range(50)), 103: "ACG", 104: ""}
    contigs, unmerged, gone = assembled(spark, reads, 15, standard)
    ((seq, ids),) = contigs.values()
    assert origin in {t(seq) for t in TURNS.values()} and sorted(ids) == list(range(23))
    assert unmerged == {102, 103, 104} and gone.keys() == {100, 101} and gone[101] == 3


def test_circles_are_cut_once(spark):
    rng = random.Random(13)
    ring = "".join(rng.choice("ACGT") for _ in range(200))
    reads = {i: TURNS[rng.choice("+-")]((ring + ring)[i * 20 : i * 20 + 50]) for i in range(10)}
    contigs, unmerged, gone = assembled(spark, reads, 15)
    ((seq, ids),) = contigs.values()
    assert sorted(ids) == list(range(10)) and len(seq) == 230 and not unmerged and not gone
    assert any(t(seq)[:200] in ring + ring for t in (TURNS["+"], TURNS["-"]))


def test_nothing_to_join(spark):
    contigs, unmerged, gone = assembled(spark, {1: None, 2: "", 3: "AC", 4: None}, 5)
    assert not contigs and unmerged == {1, 2, 3} and gone == {4: 1}


def test_sequences_meet_on_a_few_pieces():
    rng = random.Random(14)
    seqs = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(100)]
    for few in (G._beginnings, G._ends):
        row, found = few(seqs, 50)
        assert len(row) < 5 * len(seqs)
        # each length has one
        lengths = sorted((r, n) for r, lo, hi in zip(row.tolist(), found["lo"].tolist(), found["hi"].tolist(), strict=True) for n in range(lo, hi + 1))
        assert lengths == [(r, n) for r in range(100) for n in range(50, 201 - (few is G._ends))]
    row, _ = G._windows_least(seqs, 50)
    assert len(row) < 20 * len(seqs)


def test_links_of_repeats_equal_plain_version(spark):
    rng = random.Random(15)
    origin = "ACG" * 12 + "".join(rng.choice("ACGT") for _ in range(30)) + "A" * 25 + "ACGTT" * 8
    reads = {i: TURNS[rng.choice("+-")](origin[at : at + rng.randint(20, 45)]) for i, at in enumerate(rng.randrange(len(origin) - 20) for _ in range(30))}
    frame = spark.createDataFrame(list(reads.items()), "id long, seq string")
    got = {(tuple(r.src), tuple(r.dst), r.overlap) for r in G.best_overlaps(frame, 12).collect()}
    assert got == plain_links(reads, 12, ["+", "-"]) and got
    _, gone = G.without_contained_reads(frame, 12)
    inside = {i for i in reads for j in reads if any(t in "+-" and (len(reads[i]) < len(reads[j]) or i > j and len(reads[i]) == len(reads[j])) and f(reads[i]) in reads[j] for t, f in TURNS.items())}
    assert {r.id for r in gone.collect()} == inside and inside
