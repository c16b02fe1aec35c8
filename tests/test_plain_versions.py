"""Queries and kernels that SQL can't express, against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from readforge.functions import columns as C
from readforge.operators import alignment as A
from readforge.operators import consensus as N
from readforge.operators import graphs as G
from readforge.operators import intervals as I
from readforge.operators import kmers as K
from readforge.plans import catalog

SF = "/root/testdata/sf0.001"


def test_checksums(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    want = {i: f"{zlib.crc32((t + ','.join(str((ord(c) * 7 + k + 1) % 41) for k, c in enumerate(t))).encode()):08x}" for i, t in texts.items()}
    assert {r.zmw: r.crc for r in catalog.queries()["c20_checksum"](spark, SF).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_erosion(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    edges = {(f"n{i}", f"n{i + 1}") for i in range(25)} | {tuple(rng.sample(names, 2)) for _ in range(30)} | {("n7", "n7"), ("n40", "n41"), ("n41", "n40")}
    counts = {n: rng.choice([1, 1, 1, 1, 1, 5]) for n in names}
    left, links = dict(counts), set(edges)
    while gone := [n for n, c in left.items() if c < 2 and not (any(a == n for a, _ in links) and any(b == n for _, b in links))]:
        left = {n: c for n, c in left.items() if n not in gone}
        links = {(a, b) for a, b in links if a in left and b in left}
    nodes = spark.createDataFrame(list(counts.items()), "kmer string, n long")
    own, rest = G.erode(nodes, spark.createDataFrame(sorted(edges), "src string, dst string"), 2)
    assert {r.kmer for r in own.collect()} == set(left) and {(r.src, r.dst) for r in rest.collect()} == links and len(left) < 60


def test_batched_scores_are_those_of_single_reads():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    templates = [word(rng.randint(1, 30)) for _ in range(40)] + ["AACC", "A"]
    reads = [N.simulate_read(t, i) for i, t in enumerate(templates[:40])] + ["", "AAAA"]
    for mode in ("max", "sum"):
        assert np.allclose(N.scores(reads, templates, mode=mode, rows=7), [N.Scorer(r, t, mode=mode).score for r, t in zip(reads, templates, strict=True)])


def test_pair_scores_and_expected_totals_are_those_of_single_reads(monkeypatch):
    """Also far apart, where sums without logarithms are too small; others never go the long way."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    templates = [word(rng.randint(1, 60)) for _ in range(60)] + ["AACC", "A", "AAAAAAAA", "ACGT"]
    reads = [N.simulate_read(t, i) or "C" for i, t in enumerate(templates[:60])] + ["T", "AAAA", "AAA", "GGGGGGGG"]
    single = lambda p, mode: [N.Scorer(r, t, p, mode=mode).score for r, t in zip(reads, templates, strict=True)]
    odd = N.Parameters(match=-0.25, branch=-4.5)
    with monkeypatch.context() as only:
        only.setattr(N, "scores", None)
        only.setattr(N, "expected_counts", None)
        assert N.pair_scores(reads, templates, rows=9).tolist() == single(N.Parameters(), "max")
        for p in (N.Parameters(), odd):
            assert np.allclose(N.pair_scores(reads, templates, p, "sum", rows=9), single(p, "sum"), rtol=1e-12, atol=1e-12)
            got = N.expected_totals(reads, templates, p, rows=9)
            only.undo()
            assert np.allclose(got, [N.expected_counts(r, t, p).sum(axis=0) for r, t in zip(reads, templates, strict=True)], rtol=1e-9, atol=1e-12)
            only.setattr(N, "scores", None)
            only.setattr(N, "expected_counts", None)
    assert np.allclose(N.pair_scores(reads, templates, odd), single(odd, "max"))
    far = ["A" * 150, "", "ACGT"], ["C" * 150, "ACGT" * 50, "ACGT"]
    for mode in ("max", "sum"):
        assert np.allclose(N.pair_scores(*far, mode=mode), [N.Scorer(r, t, mode=mode).score for r, t in zip(*far, strict=True)])
    assert np.allclose(N.expected_totals(*far)[[0, 2]], [N.expected_counts(far[0][i], far[1][i]).sum(axis=0) for i in (0, 2)])


def test_kmer_counts_of_any_signs(spark):
    rows = [(1, "ACGTACGTAA"), (2, "ACGNACG"), (3, ""), (4, None), (5, "AC"), (6, "ACGTACGTAA")]
    df = spark.createDataFrame(rows, "zmw long, seq string").coalesce(1)
    plain = lambda s, k: Counter(s[i : i + k] for i in range(len(s or "") - k + 1))
    for k in (3, 9):
        assert {r.kmer: r.n for r in K.kmer_counts(df, k).collect()} == sum((plain(s, k) for _, s in rows), Counter())
        assert {(r.id, r.kmer): r.n for r in K.kmer_frequencies(df, k).collect()} == {(i, x): n for i, s in rows for x, n in plain(s, k).items()}


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_depth_runs_over_bins(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice("ab"), s, s + rng.randint(0, 9)) for s in (rng.randrange(60) for _ in range(80))]
    depth = Counter((k, p) for k, s, e in spans for p in range(s, e))
    runs = I.depth_runs(spark.createDataFrame(spans, "rname string, t_start long, t_end long"), width=width).collect()
    assert Counter({(r.rname, p): r.depth for r in runs for p in range(r.start, r.end)}) == depth and sum(r.end - r.start for r in runs) == len(depth)


def test_weights_of_a_deep_tree(spark):
    edges = [(f"c{i + 1}", f"c{i}", 1.0) for i in range(200)] + [("leaf", "c0", 2.0)]
    got = {r.leaf: r.weight for r in G.sequence_weights(spark.createDataFrame(edges, "child string, parent string, length double")).collect()}
    assert got == pytest.approx({"c200": 101 / 200, "leaf": 101 / 2})


def test_local_scores_and_spans_are_those_of_the_paths():
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets, queries = [], []
    for i in range(300):
        base = some(rng.randint(0, 60)) if i % 3 else some(rng.randint(1, 4)) * 12
        changed = "".join(rng.choice(["", "A", c, c, c, c, c + rng.choice("ACGT")]) for c in base)
        targets.append(some(rng.randint(0, 9)) + base + some(rng.randint(0, 9)))
        queries.append(changed + some(rng.randint(0, 9)))
    score, span = A._scored([t.encode() for t in targets], [q.encode() for q in queries], True)
    assert (A._scored([t.encode() for t in targets], [q.encode() for q in queries])[0] == score).all()
    want = [A.align(t, q, "local") for t, q in zip(targets, queries, strict=True)]
    assert score.tolist() == [a.score for a in want] and span.tolist() == [len(a.target.replace("-", "")) for a in want]
    wide = ["A" * 40, "ACGT" * 10]
    assert A.local_scores(A._columns([t.encode() for t in wide], 1), A._columns([t.encode() for t in wide], 2), match=1000)[0].tolist() == [40_000, 40_000]


def test_best_aligned_is_the_best_of_all_alignments(spark):
    """Copies, copies inside longer ones, both strands, ties of references; no pair is joined and none but the best gets a path."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base, passage, out = some(150), some(40), {}
    change = lambda s, p: "".join(c if rng.random() > p else rng.choice(["", "G", "CA"]) for c in s)
    for i in range(60):
        own = [base, change(base, 0.04), some(30) + passage + some(60), base[20:90], change(base, 0.1), some(100), ""][i % 7]
        out[i] = own[::-1].translate(str.maketrans("ACGT", "TGCA")) if i % 4 == 3 else own
    frame = spark.createDataFrame(list(out.items()), "id long, seq string").repartition(5)
    asked = frame.where("id % 2 = 0")
    plain = A.best_alignments(A.align_to_references(asked, frame, 12, F.col("id") % 10 != F.col("ref") % 10))
    for pending in (1, 7, 1 << 13):
        got = A.best_aligned(asked, frame, 12, lambda ids, refs: ids % 10 != refs % 10, pending)
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect())) and got.count() > 15
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_best_alignments_are_those_of_all_seeded_pairs(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    change = lambda s: "".join(c if rng.random() > 0.05 else rng.choice("ACGT") for c in s)
    reads = {i: change(base[i % 7 : 90 + i % 20]) for i in range(8)}
    turned = {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in reads.items()}
    frame = spark.createDataFrame(list(reads.items()), "id long, seq string")
    from pyspark.sql import functions as F

    got = {r.id: (r.ref, r.score, r.reversed) for r in A.best_alignments(A.align_to_references(frame, frame, 12, F.col("id") != F.col("ref"))).collect()}
    want = {}
    for i in reads:
        for j in reads:
            for strand, own in ((False, reads[i]), (True, turned[i])):
                if i != j and any(own[k : k + 12] in reads[j] for k in range(len(own) - 11)):
                    a = A.align(reads[j], own, "local")
                    span = len(a.target.replace("-", ""))
                    if a.score >= min(0.2 * len(own), 60) and ((key := (a.score, span, -j, not strand)) > want.get(i, ((),))[0]):
                        want[i] = (key, (j, a.score, strand))
    assert got == {i: v for i, (_, v) in want.items()} and len(got) == 8


def test_anchored_aligners_and_alphabets():
    rng = random.Random(9)
    a = "".join(rng.choice("ACGT") for _ in range(150))
    b = a[:60] + "T" + a[62:100] + a[103:]
    for name in ("MUMmer", "NUCmer"):
        got = A.ALIGNERS[name](a, b)
        assert got.target.replace("-", "") == a and got.query.replace("-", "") == b and len(got.target) == len(got.query)
        assert got.transcript.count("M") >= 144
    assert A.exact_matches("AAACCCGGG", "TTAAACCC", 4) == [(0, 2, 6)] and A.exact_matches("ACGTACGT", "ACGT", 4) == []
    assert A.exact_matches("ACGTACGT", "ACGT", 4, unique=False) == [(0, 0, 4), (4, 0, 4)]
    assert A.is_gap("-") and A.is_ambiguous("n") and not A.is_ambiguous("A") and A.is_termination("*")


def test_nearly_equal_numbers():
    x = 1.0
    for _ in range(4):
        x = math.nextafter(x, 2)
    assert N.almost_equal(1.0, x) and not N.almost_equal(1.0, math.nextafter(x, 2)) and N.almost_equal(0.0, -0.0)
    assert N.almost_equal(5e-324, -5e-324) and not N.almost_equal(math.nan, math.nan)


def test_weighted_fits_are_those_of_single_rows():
    x = np.repeat(np.arange(5.0), 9)
    y = (np.arange(45) % 4 < x).astype(float)
    rows = Counter(zip(x, y, strict=True))
    design = lambda v: np.column_stack([np.ones(len(v)), v])
    keys = np.array(list(rows))
    assert np.allclose(N.logistic_regression(design(x), y), N.logistic_regression(design(keys[:, 0]), keys[:, 1], counts=np.array(list(rows.values()), float)), atol=1e-6)


def test_binomial_expression(spark):
    from pyspark.sql import functions as F

    rows = [(q, n) for n in range(0, 40, 7) for q in range(-1, n + 2)]
    got = spark.createDataFrame(rows, "q long, n long").select("q", "n", C.binomial_survival(F.col("q"), F.col("n"), 0.3).alias("p")).collect()
    assert all(abs(r.p - N.binomial_survival(r.q, r.n, 0.3)) < 1e-9 for r in got)


def test_the_rest_goes_on_without_a_library():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'a1_count_by_keys' in e.queries() and 'op1_pigeonhole_decontamination' not in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, timeout=120).returncode == 0


def test_partial_orders_of_many_groups():
    rng = random.Random(31)
    groups = []
    for g in range(120):
        template = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 8, 30, 90])))
        template = template[:2] * 15 if g % 9 == 0 else template
        groups.append(sorted(r for c in range(rng.randint(1, 5)) if (r := N.simulate_read(template, 10 * g + c))) or ["A"])
    assert N.partial_order_consensuses(groups, 32) == [N.partial_order_consensus(g) for g in groups]
    assert N.partial_order_consensuses([]) == []
    with pytest.raises(ValueError):
        N.partial_order_consensuses([["A", ""]])
