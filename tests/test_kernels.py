"""Golden vectors and properties of the sequence kernels."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readforge.operators import alignment as A
from readforge.operators import consensus as N
from readforge.operators import graphs as G
from readforge.operators import pileup as P

DNA = st.text("ACGT", max_size=14)


def test_variant_calls():
    target = "TCTCATAATCGCCCACGGGCTTACATCCTCATTACTATTCTGCCTAGCAAACTCAAAAAAAAATTTAAAAAACTT"
    query = "TCTCATAATCGCCCCCACGGGCTTACATTCATTACTGTTCTGCCTAGCAAACTCAAAAAAATTTAAAAAACTA"
    found = A.call_variants(A.align(target, query, "local"), target)
    assert [(v["type"], v["start"], v["indel"], v["bases"]) for v in found] == [("INDEL", 10, "Insertion", "CC"), ("INDEL", 25, "Deletion", "CC"), ("SNP", 36, None, None), ("INDEL", 53, "Deletion", "AA")]
    assert found[2]["alt_base"] == "G" and found[3]["hp_base"] == "A"


def test_position_lookup():
    reference = "CCCGGGGATCCTCTAGAATGCATCAGTAGAGTACGATGCTACAGCTGTGACTGTGCGCACTGCTGAGTCTGTCACTCATG"
    query = "TGGGATCCTCTAGAATGCATCAGTAGAGTACGATGCTACAGCTGTGACTGTGCGCACTGCTGAGTCTGTCAC"
    assert A.query_position(A.align(reference, query, "local"), 5) == 2


@settings(max_examples=150, deadline=None)
@given(DNA, DNA, st.sampled_from(["global", "local", "overlap"]))
def test_alignment_scores(target, query, mode):
    a = A.align(target, query, mode, A.diagonal_scores(2, -3), -4, -1)
    score, last = 0, ""
    for t, q, c in zip(a.target, a.query, a.transcript, strict=True):
        score += (2 if t == q else -3) if c in "MR" else (-1 if last == c else -4)
        last = c
    assert score == a.score
    assert target[a.target_start :].startswith(a.target.replace("-", "")) and query[a.query_start :].startswith(a.query.replace("-", ""))
    assert mode != "local" or a.score >= 0


def test_leftmost_gaps_keep_both_sequences():
    assert A.gaps_leftmost("GAAAT", "GAA-T") == ("GAAAT", "G-AAT")
    assert A.gaps_leftmost("ACACACT", "ACAC--T") == ("ACACACT", "--ACACT")


def test_iupac_scores():
    s = A.iupac_scores(5, -4, 2)
    assert (s("A", "A"), s("A", "R"), s("C", "R"), s("R", "N")) == (5, 2, -4, 2)


def test_chain_is_trimmed_and_ordered():
    assert A.longest_chain([(0, 0, 10), (8, 8, 5), (30, 2, 9), (20, 20, 4)]) == [(0, 0, 10), (10, 10, 3), (20, 20, 4)]
    assert A.longest_chain([]) == []


def test_clusters_follow_a_diagonal():
    assert A.clusters([(0, 0, 100), (110, 112, 100), (5000, 10, 150)], least_score=180) == [[(0, 0, 100), (110, 112, 100)]]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=9), st.integers(0, 6))
def test_best_spaced_is_best(items, spacing):
    chosen = A.best_spaced(items, spacing)
    best = 0
    for mask in range(1 << len(items)):
        own = sorted(items[i] for i in range(len(items)) if mask >> i & 1)
        if all(b[0] - a[0] > spacing for a, b in zip(own, own[1:], strict=False)):
            best = max(best, sum(s for _, s in own))
    assert sum(items[i][1] for i in chosen) == best


def test_mutations():
    t = "GATTACA"
    assert N.apply([N.insertion(3, "C"), N.insertion(2, "T"), N.insertion(0, "G"), N.substitution(6, "T"), N.deletion(4)], t) == "GGATTCTCT"
    assert N.apply([N.substitution(2, "A"), N.insertion(2, "T")], t) == "GATATACA"
    assert N.apply([N.substitution(0, "C")], "ACGTACGTACGT") == "CCGTACGTACGT" and N.apply([N.deletion(4)], "ACGTACGTACGT") == "ACGTCGTACGT"
    assert N.transcript([], t) == "MMMMMMM" and N.transcript([N.insertion(5, "C"), N.insertion(1, "T")], t) == "MIMMMMIMM"
    both = [N.deletion(2), N.insertion(5, "C"), N.substitution(4, "G")]
    assert N.transcript(both, t) == "MMDMRIMM" and N.positions(both, t) == [0, 1, 2, 2, 3, 5, 6, 7]
    assert N.positions([N.insertion(0, "A")], "GG") == [1, 2, 3] and N.positions([N.deletion(0)], "AGG") == [0, 0, 1, 2]


def test_enumeration():
    t = "GAATC"
    assert len(N.all_single(t)) == 40 and len(N.unique_single(t)) == 35
    centre = [N.substitution(1, "T")]
    assert len(N.unique_near(t, centre, 1)) == 15 and len(N.unique_near(t, centre, 2)) == 21
    assert set(N.unique_near(t, [*centre, N.substitution(3, "G")], 2)) == set(N.unique_single(t))
    assert set(N.dinucleotide("ACACACGCGCGTGTG")) == {N.insertion(0, "AC"), N.deletion(0, 2), N.insertion(5, "CG"), N.deletion(5, 7)}


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=9), st.text("ACGT", min_size=1, max_size=9))
def test_forward_and_backward_agree(read, template):
    best, total = N.Scorer(read, template), N.Scorer(read, template, mode="sum")
    assert math.isclose(best.alpha[-1][-1], best.score) and math.isclose(total.alpha[-1][-1], total.score, abs_tol=1e-9)
    assert best.score <= total.score + 1e-9


def test_bad_tags_are_refused():
    with pytest.raises(ValueError):
        N.Scorer("ACGT", "ACGT", tags="ACGX")


def test_consensus_is_found():
    template = "ACGTTGCAAGTCCATGACGT"
    reads = [N.simulate_read(template, i) for i in range(9)]
    assert N.refine(reads, N.partial_order_consensus(reads)[0]) == (template, True)
    assert np.mean(N.consensus_qualities(reads, template)) > 30  # a base of a run may be lower: merges are cheap
    with pytest.raises(ValueError):
        N.partial_order_consensus([""])


def test_simulation_without_errors_in_sum():
    assert N.simulate_read("ACGTACGT", 1) == N.simulate_read("ACGTACGT", 1)
    assert len(N.simulate_read("ACGT" * 50, 3, truncated_sum=True)) > 100


def test_diploid_alleles():
    scores = np.array([[0, -9.0, -20], [0, -9, -20], [-9, 0, -20], [-9, 0, -20]])
    a, b, factor, split = N.diploid_site(scores)
    assert (a, b, split) == (0, 1, [0, 0, 1, 1]) and factor > 0


def test_statistics():
    assert math.isclose(N.binomial_survival(3, 10, 0.5), 0.828125) and N.binomial_survival(-1, 5, 0.2) == 1.0 and N.binomial_survival(5, 5, 0.2) == 0.0
    x = np.linspace(-2, 2, 400)
    y = (np.random.default_rng(0).random(400) < 1 / (1 + np.exp(-(1 + 2 * x)))).astype(float)
    w = N.logistic_regression(np.column_stack([np.ones_like(x), x, x * x]), y)
    assert abs(w[1] - 2) < 0.8 and N.decision_points(np.array([-1.0, 0.0, 1.0])) == [-1.0, 1.0]


def test_em_takes_quality_into_account():
    theta, rounds = P.em_frequencies(np.array([0] * 9 + [1]), np.array([40.0] * 9 + [2.0]))
    assert theta[0] > 0.95 and math.isclose(theta.sum(), 1.0) and rounds > 1


def test_parameters_and_chemistries():
    p = N.read_parameters("[P4.AllQVs]\nMatch = 0.1\nBranch=-2\n[P6.AllQVs]\nMatch=1e-3")
    assert p["P4"]["AllQVs"] == {"Match": 0.1, "Branch": -2.0} and p["P6"]["AllQVs"]["Match"] == 0.001
    t = N.ChemistryTable()
    assert t.insert("*", 1) and t.insert("P4", 2) and not t.insert("P4", 3)
    assert t.at("P4") == 2 and t.at("new") == 1
    with pytest.raises(KeyError):
        N.ChemistryTable().at("P4")


def test_ambiguous_consensus():
    assert P.ambiguous_consensus(["D", "N"]) == "B" and P.ambiguous_consensus(["A", "A"]) == "A" and P.ambiguous_consensus(["A", "W"]) == "X"
    assert P.ambiguous_consensus(["B", "D"]) == "B"


def test_barcodes_are_apart():
    codes = N.barcodes(8, 9, 6)
    assert len(set(codes)) == 8 and all(a != b for c in codes for a, b in zip(c, c[1:], strict=False))


def test_guide_tree_joins_the_closest_first():
    d = [[0, 1, 8, 9], [1, 0, 8, 9], [8, 8, 0, 2], [9, 9, 2, 0]]
    edges = G.guide_tree(d)
    parent = {c: p for c, p, _ in edges}
    assert parent[0] == parent[1] and parent[2] == parent[3] and len(edges) == 6
    assert G.linkage("mafft")(1.0, 3.0) == pytest.approx(1.1)


def test_random_graph_of_reads_gives_reads_back(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    reads = spark.createDataFrame([(genome[i : i + 60],) for i in range(0, 241, 5)], "seq string")
    nodes = G.kmer_nodes(reads, 15)
    built = G.contigs(nodes, G.de_bruijn_edges(nodes).where("same_orientation")).collect()
    assert [r.seq for r in built] == [genome]


def test_long_weak_paths_erode_whole(spark):
    from readforge.operators import graphs

    # a path of 25 weak nodes hangs on a circle of strong ones
    circle = [("c0", "c1"), ("c1", "c2"), ("c2", "c0")]
    path = [(f"p{i}", f"p{i + 1}" if i < 24 else "c0") for i in range(25)]
    nodes = spark.createDataFrame([(f"c{i}", 5) for i in range(3)] + [(f"p{i}", 1) for i in range(25)], "kmer string, n long")
    left, edges = graphs.erode(nodes, spark.createDataFrame(circle + path, "src string, dst string"), 2)
    assert sorted(r.kmer for r in left.collect()) == ["c0", "c1", "c2"] and edges.count() == 3


def test_mutations_are_scored_as_by_rescoring_the_reads():
    rng = random.Random(17)
    for case in range(120):
        text = lambda lo: "".join(rng.choice("ACGT" if case % 2 else "AC") for _ in range(rng.randint(lo, 14)))  # noqa: E731, B023
        template, reads = text(1), [text(1), text(1)]
        mutations = [*N.all_single(template), N.insertion(rng.randint(0, len(template)), "AC")]
        if len(template) > 4:
            mutations += [N.deletion(0, 2), N.deletion(2, 5), N.substitution(1, "GT")]
        total = lambda t: sum(N.Scorer(r, t).score for r in reads)  # noqa: E731, B023
        want = [total(N.apply([m], template)) - total(template) for m in mutations]
        assert np.allclose(N.score_mutations(reads, template, mutations), want)
    assert N.score_mutations(["ACG"], "ACG", []) == [] and N.consensus_qualities(["ACG"], "") == []
