"""Queries that SQL can't express, run as registered, against plain loops over small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readforge.functions.fixtures import fixture, with_fixtures
from readforge.operators import alignment as A
from readforge.operators import consensus as N
from readforge.operators import kmers as K
from readforge.operators import pileup as P
from readforge.operators import profiles as M
from readforge.plans import catalog

from . import compare

SF = "/root/testdata/sf0.001"
LETTERS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
PAIRS = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def docs():
    """Texts that share passages, with changes, on both sides of a sub-read's border; an empty one, one without letters, one missing."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    changed = passage[:60] + "x" + passage[61:100] + passage[102:]
    own = lambda n: " ".join(word() for _ in range(n))
    texts = {0: passage + " " + own(20), 1: own(15) + changed, 100: changed + own(25), 7: own(40), 8: passage, 200: own(3), 9: "", 300: "12 !", 10: None, 11: own(5) + passage[:80]}
    return {i: (t, "web" if i == 8 else "a") for i, t in texts.items()}


@pytest.fixture(scope="module")
def small(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(i, t, s) for i, (t, s) in docs.items()], "doc_id long, text string, source string").write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def reads(docs):
    return {i: re.sub("[^A-Za-z]", "", t).lower().translate(LETTERS) for i, (t, _) in docs.items() if t is not None}


@pytest.fixture(scope="module")
def sub(reads):
    return {i * 1048576 + p // 200: s[p : p + 200] for i, s in reads.items() for p in range(0, len(s), 200)}


@pytest.fixture(scope="module")
def best(sub):
    out = {}
    for i, own in sub.items():
        for j, ref in sub.items():
            for strand, seq in ((False, own), (True, own.translate(PAIRS)[::-1])):
                if (i >> 20) % 100 == 0 and i >> 20 != j >> 20 and any(seq[k : k + 20] in ref for k in range(len(seq) - 19)):
                    a = A.align(ref, seq, "local")
                    key = (a.score, len(a.target.replace("-", "")), -j, not strand)
                    if a.score >= min(0.2 * len(seq), 60) and key > out.get(i, ((),))[0]:
                        out[i] = (key, j, strand, a)
    return {i: x[1:] for i, x in out.items()}


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name, sf=small: [tuple(r) for r in catalog.queries()[name](spark, sf).collect()]


def test_best_alignments(run, best):
    assert {r[:6] for r in run("q8_q10_q20_best_alignments")} == {(i, j, "Reversed" if t else "Forward", a.score, a.target_start, a.target_start + len(a.target.replace("-", ""))) for i, (j, t, a) in best.items()}
    assert len(best) >= 2


def test_alignment_statistics(run, best):
    want = {i: (*[a.transcript.count(c) for c in "MRID"], len(a.transcript), a.transcript.count("M") / len(a.transcript)) for i, (_, _, a) in best.items()}
    assert {r[0]: r[1:] for r in run("q16_alignment_statistics")} == want


def test_orientations(run, best, sub, docs):
    labels = Counter()
    for i in sub:
        if (i >> 20) % 100 == 0:
            j, turned, _ = best.get(i, (None, None, None))
            if j is None:
                labels["NoAln"] += 1
            elif docs[j >> 20][1] != "web":
                labels["Reversed" if turned else "Forward"] += 1
    assert Counter(dict(run("q21_orientation"))) == labels


def test_variants_and_reports(run, best, sub):
    called = {i: A.call_variants(a, sub[j]) for i, (j, _, a) in best.items()}
    want = Counter((str(best[i][0]), v["start"], i, v["type"], v["length"]) for i, vs in called.items() for v in vs)
    assert Counter(r[:5] for r in run("q22_s20_variant_report")) == want and want
    report = {(i, best[i][0], len(vs), len(best[i][2].target.replace("-", "")), sum(v["type"] == "INDEL" for v in vs), sum(v["type"] == "SNP" for v in vs)) for i, vs in called.items()}
    assert {r[1:] for r in run("s19_a8_read_report")} == report


def test_position_lookup(run, best):
    at = {i: A.query_position(a, 20) for i, (_, _, a) in best.items()}
    assert {r[0]: r[1] for r in run("q23_position_lookup")} == {i: q - best[i][2].query_start for i, q in at.items() if q is not None}


@pytest.fixture(scope="module")
def matches(reads):
    """By pair: (place in reference, place in query, length) of every maximal run of 20 equal bases or more on a diagonal."""
    out = {}
    for i, q in reads.items():
        for j, r in reads.items():
            for d in range(-len(q), len(r)) if i % 100 == 0 and i != j else ():
                run = 0
                for p in range(len(q) + 1):
                    if p < len(q) and 0 <= p + d < len(r) and q[p] == r[p + d]:
                        run += 1
                        continue
                    if run >= 20:
                        out.setdefault((i, j), []).append((p - run + d, p - run, run))
                    run = 0
    return out


def test_chains_and_clusters(run, matches):
    assert Counter(run("q5_w4_chains")) == Counter((*k, *m) for k, found in matches.items() for m in A.longest_chain(found))
    want = Counter((*k, len(c), sum(n for *_, n in c), min(q for _, q, _ in c), max(q + n for _, q, n in c)) for k, found in matches.items() for c in A.clusters(found, least_score=24))
    assert Counter((r[0], r[1], *r[3:]) for r in run("q6_clusters")) == want and want


# ---- graphs of 12-mers


@pytest.fixture(scope="module")
def graph(reads):
    nodes = Counter(s[i : i + 12] for s in reads.values() for i in range(len(s) - 11))
    begins = {}
    for v in nodes:
        begins.setdefault(v[:-1], []).append(v)
    return nodes, {(u, v) for u in nodes for v in begins.get(u[1:], [])}


@pytest.fixture(scope="module")
def contigs(graph):
    nodes, edges = graph
    outs, ins = Counter(u for u, _ in edges), Counter(v for _, v in edges)
    follow = {u: v for u, v in edges if outs[u] == 1 and ins[v] == 1 and u != v}
    out = {}
    for head in nodes.keys() - set(follow.values()):
        path = [head]
        while path[-1] in follow:
            path.append(follow[path[-1]])
        out[head] = (head + "".join(x[-1] for x in path[1:]), len(path), sum(nodes[x] for x in path) / len(path))
    return out


def test_eroded_nodes(run, graph):
    left, links = dict(graph[0]), set(graph[1])
    while gone := {n for n, c in left.items() if c < 2} - ({a for a, _ in links} & {b for _, b in links}):
        left = {n: c for n, c in left.items() if n not in gone}
        links = {(a, b) for a, b in links if a not in gone and b not in gone}
    assert dict(run("h3_eroded_nodes")) == left and len(left) < len(graph[0])


def test_contigs(run, graph, contigs):
    _, edges = graph
    sources, targets = {u for u, _ in edges}, {v for _, v in edges}
    tips = {h for h, (s, n, _) in contigs.items() if n <= 3 and (s[-12:] not in sources or h not in targets)}
    parallel = {}
    for h, (s, _, c) in contigs.items():
        parallel.setdefault((s[:11], s[-11:]), []).append((-c, h))
    worse = {h for group in parallel.values() for _, h in sorted(group)[1:]}
    assert {(h, n, k, round(c, 9)) for h, n, k, c in run("h4_h6_contigs")} == {(h, len(s), n, round(c, 9)) for h, (s, n, c) in contigs.items() if h not in tips | worse}
    assert {(h, n, round(c, 9)) for h, n, c in run("h5_low_coverage_purge")} == {(h, len(s), round(c, 9)) for h, (s, _, c) in contigs.items() if c >= 2}


def test_reads_on_contigs(run, reads, contigs):
    at = {}
    for h, (s, _, _) in contigs.items():
        for p in range(len(s) - 11):
            at.setdefault(s[p : p + 12], []).append((h, p))
    hits = Counter((i, h, p - r) for i, s in reads.items() for r in range(len(s) - 11) for h, p in at.get(s[r : r + 12], ()))
    kind = lambda k, n: "FullOverlap" if n == len(reads[k[0]]) - 11 else "PartialOverlap"
    want = {o: (sum(kind(k, n) == o for k, n in hits.items()), len({k[0] for k, n in hits.items() if kind(k, n) == o})) for o in {kind(k, n) for k, n in hits.items()}}
    assert {r[0]: r[1:] for r in run("h7_read_contig_map")} == want


# ---- consensus


def test_simulated_reads_and_their_scores(run, sub):
    copies = {(r[0], r[1]): r[2] for r in run("n14_simulated_reads")}
    assert copies.keys() == {(i, c) for i in sub for c in range(2)}
    first = 0
    for i, c, top, total in run("n5_n6_read_scores"):
        if c == first:
            read = copies[i, c] or ""
            assert np.isclose(top, N.Scorer(read, sub[i]).score) and np.isclose(total, N.Scorer(read, sub[i], mode="sum").score) and total >= top - 1e-9


def test_distances_of_following_sub_reads(run, sub):
    assert dict(run("c33_weighted_distance")) == {i: A.weighted_distance(s, sub[i + 1]) for i, s in sub.items() if i + 1 in sub}


# ---- tables of the driver


@pytest.fixture(scope="module")
def piles():
    rows = compare.connect(SF).execute(with_fixtures("select rname, pos, base, phred from pileup_bases", "pileup_bases")).fetchall()
    out = {}
    for r, p, b, q in rows:
        out.setdefault((r, p), []).append((b, q))
    return out


def test_refined_frequencies(run, piles):
    got = {r[:2]: r[2:] for r in run("g2_em_refinement", SF)}
    want = {}
    for key, rows in piles.items():
        good = [(b, q) for b, q in rows if b < 4 and q > P.LEAST_QUALITY]
        if good and sum(b == 5 for b, _ in rows) / len(rows) < 0.1:
            b, q = (np.array(x) for x in zip(*good, strict=True))
            want[key] = np.bincount(b, minlength=4) / len(b) if len(set(b)) == 1 else P.em_frequencies(b, q.astype(float))[0]
    assert got.keys() == want.keys() and all(np.allclose(got[k][:4], want[k], atol=1e-9) for k in want)


def test_diploid_sites(run, piles):
    got = {r[:2]: r[2:] for r in run("n11_diploid_sites", SF)}
    want = set()
    for key, rows in piles.items():
        good = [(b, q) for b, q in rows if b < 4 and q > 17]
        if len({b for b, _ in good}) > 1:
            want.add(key)
            a, b, factor, split = N.diploid_site(np.array([[np.log1p(-min(10 ** (-q / 10), 0.999)) if x == c else np.log(10 ** (-q / 10) / 3) for c in range(4)] for x, q in good]))
            row = got[key]
            assert row[:2] == ("ACGT"[a], "ACGT"[b]) and np.isclose(row[2], factor) and row[3:] == (sum(split), len(good))
    assert got.keys() == want


def test_best_spaced_variants(run):
    items = compare.connect(SF).execute(with_fixtures("select ref, pos, count(*) from variants group by ref, pos", "variants")).fetchall()
    by_ref = {}
    for ref, pos, n in items:
        by_ref.setdefault(ref, {})[pos] = n
    got = {}
    for ref, pos, n in run("w5_n13_best_spaced", SF):
        assert by_ref[ref][pos] == n
        got.setdefault(ref, []).append(pos)
    for ref, found in by_ref.items():
        best = [0.0] * (max(found) + 2)  # best total of positions below
        for p in range(max(found) + 1):
            best[p + 1] = max(best[p], found.get(p, 0) + best[max(0, p - 10)])
        own = sorted(got[ref])
        assert sum(found[p] for p in own) == best[-1] and all(b - a > 10 for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("name", ["m4_kmer_distances", "o10_o11_nearest", "m1_m3_kimura_matrix", "j8_read_by_reference"])
def test_searches_compare_without_joining_pairs(spark, small, name):
    """Neither k-mers nor pairs of whole sequences are joined; texts that are empty or missing are as in SQL."""
    df = catalog.queries()[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Cartesian" not in plan
    assert compare.difference(df, compare.connect(small), catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["q1_exact_matches", "q2_j11_seed_matches", "q5_w4_chains", "q6_clusters"])
def test_matches_are_made_in_the_references_rows(spark, small, name, monkeypatch):
    """No k-mer is shuffled; islands, chains and clusters are those of a join, also where few hits are held at once."""
    monkeypatch.setattr(K, "HITS", 50)
    df = catalog.queries()[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    own = fixture(spark, small, "reads").select(F.col("zmw").alias("id"), "seq")
    joined = K.seed_matches(own.where("id % 100 = 0"), own, 20, name.startswith("q2"), F.col("query") != F.col("ref"))
    plain = A.chained(joined) if "chains" in name else A.clustered(joined) if "clusters" in name else joined
    assert sorted(df.collect()) == sorted(plain.select(df.columns).collect()) != []


def test_distances_of_many_pairs_are_those_of_one():
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 1, 5, 30, 61))))
    a, b = [text() for _ in range(90)], [text() for _ in range(90)]
    b[:30] = [s[: len(s) // 2] + "GA" + s[len(s) // 2 + 1 :] for s in a[:30]]
    assert A.weighted_distances(a, b, block=32).tolist() == [A.weighted_distance(x, y) for x, y in zip(a, b, strict=True)]
    costs = {"mismatch": -700, "gap": -90, "gap_open": -300, "match": 500}
    assert A.weighted_distances(a, b, **costs).tolist() == [A.weighted_distance(x, y, **costs) for x, y in zip(a, b, strict=True)]


def test_consensus_of_simulated_reads(run, sub):
    copies = {}
    for i, s in sub.items():
        for c in range(3):
            if r := N.simulated_copy(i, c, s):
                copies.setdefault(i, []).append(r)
    assert {r[0]: r[1:] for r in run("n10_poa_consensus")} == {i: N.partial_order_consensus(sorted(x)) for i, x in copies.items()}


def test_alignments_of_simulated_reads(run, sub):
    want = {(i, c): s for i, t in sub.items() for c, s in enumerate(M.multiple_alignment([N.simulated_copy(i, c, t) for c in range(3)]))}
    assert {r[:2]: r[2] for r in run("m5_m8_m9_multiple_alignment")} == want
