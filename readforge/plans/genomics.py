"""Coverage, pile-ups, k-mers and distances as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from readforge.functions import columns as C
from readforge.operators import intervals as I
from readforge.operators import kmers as K
from readforge.operators import pileup as P

from .registry import query

IV, PB, READS = ("intervals",), ("pileup_bases",), ("reads",)


@query("a16_n1_window_coverage", "select rname, p as pos, count(*) as depth from (select rname, unnest(range(greatest(t_start, 500), least(t_end, 1500))) as p from intervals where t_start < 1500 and t_end > 500) group by rname, p", IV)
def window_coverage(spark, sf, i):
    return I.window_coverage(i, 500, 1000)


@query("w2_n2_covered_intervals", """select rname, min(p) as "start", max(p) + 1 as "end" from (select rname, p, p - row_number() over (partition by rname order by p) as island from
    (select rname, p, count(*) as n from (select rname, unnest(range(t_start, t_end)) as p from intervals) group by rname, p having count(*) >= 8)) group by rname, island""", IV)  # fmt: skip
def covered_intervals(spark, sf, i):
    return I.covered(i, 8)


BINNED = "(select *, unnest(range(t_start // 64, (t_end - 1) // 64 + 1)) as bin from (select rname, t_start, t_end, count(*) as n from intervals where t_start < t_end group by all))"


@query("j9_overlap_join", f"""select a.rname, cast(sum(a.n * b.n) as bigint) as pairs, cast(sum(a.n * b.n * (least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start))) as bigint) as shared from {BINNED} a
    join {BINNED} b on a.rname = b.rname and a.bin = b.bin and a.t_start < b.t_end and b.t_start < a.t_end and greatest(a.t_start, b.t_start) // 64 = a.bin group by a.rname""", IV)  # fmt: skip
def overlap_join(spark, sf, i):
    """All pairs of overlapping intervals; equal intervals are joined once, with their number."""
    own = i.groupBy("rname", "t_start", "t_end").agg(F.count("*").alias("n"))
    right = own.select("rname", F.col("t_start").alias("s2"), F.col("t_end").alias("e2"), F.col("n").alias("n2"))
    both = I.overlap_join(own, right, "rname", 64, ("t_start", "t_end"), ("s2", "e2"))
    n = F.col("n") * F.col("n2")
    return both.groupBy("rname").agg(F.sum(n).alias("pairs"), F.sum(n * (F.least("t_end", "e2") - F.greatest("t_start", "s2"))).alias("shared"))


@query("j10_containment", "select a.rname, a.t_start, b.pos from (select distinct rname, t_start, t_end from intervals) a join (select distinct cast(substring(rname, 4) as int) as r, pos from pileup_bases) b on a.rname = b.r and b.pos >= a.t_start and b.pos < a.t_end", IV + PB)
def containment(spark, sf, i, p):
    points = p.select(F.substring("rname", 4, 9).cast("int").alias("rname"), "pos").distinct().select("rname", F.col("pos").cast("long").alias("s2"), (F.col("pos") + 1).cast("long").alias("e2"))
    spans = i.distinct()
    return I.overlap_join(spans, points, "rname", 32, ("t_start", "t_end"), ("s2", "e2")).select("rname", "t_start", F.col("s2").cast("int").alias("pos"))


@query("a15_gap_fraction", "select rname, pos, avg(case when base = 5 then 1.0::double else 0 end) as gap_fraction, count(*) as depth from pileup_bases group by rname, pos", PB)
def gap_fraction(spark, sf, p):
    return P.gap_fractions(p)


GOOD = "base < 4 and phred > 17"


@query("a13_base_counts", f"select rname, pos, count(*) filter (where {GOOD}) as n, " + ", ".join(f"count(*) filter (where {GOOD} and base = {i}) as n{b}" for i, b in enumerate("ACGT")) + " from pileup_bases group by rname, pos", PB)
def base_counts(spark, sf, p):
    return P.base_counts(p)


@query("g1_g3_genotypes", f"""select rname, pos, status, case when status = 'GenotypeCalled' then case when nA = m then 'A' when nC = m then 'C' when nG = m then 'G' else 'T' end end as genotype,
    """ + ", ".join(f"case when status = 'GenotypeCalled' then n{b}::double / n end as f{b}" for b in "ACGT") + f""" from (select *, greatest(nA, nC, nG, nT) as m,
    case when gaps >= 0.1 then 'TooManyGaps' when n = 0 then 'NoData' else 'GenotypeCalled' end as status from (select rname, pos, avg(case when base = 5 then 1.0::double else 0 end) as gaps,
    count(*) filter (where {GOOD}) as n, """ + ", ".join(f"count(*) filter (where {GOOD} and base = {i}) as n{b}" for i, b in enumerate("ACGT")) + " from pileup_bases group by rname, pos))", PB)  # fmt: skip
def genotypes(spark, sf, p):
    return P.genotypes(p)


#: Frequencies of the same pile-ups, and no genotype; also where gaps are too many.
GENOTYPES_OF_PILES = f"""select rname, pos, case when gaps >= 0.1 then 'TooManyGaps' when n = 0 then 'NoData' else 'GenotypeCalled' end as status, """ + ", ".join(f"case when n > 0 then n{b}::double / n end as f{b}" for b in "ACGT") + f""" from (select rname, pos,
    avg(case when base = 5 then 1.0::double else 0 end) as gaps, count(*) filter (where {GOOD}) as n, """ + ", ".join(f"count(*) filter (where {GOOD} and base = {i}) as n{b}" for i, b in enumerate("ACGT")) + " from pileup_bases group by rname, pos)"  # fmt: skip


@query("g2_em_refinement", None, PB)
def em_refinement(spark, sf, p):
    return P.refined_genotypes(p)


@query("a11_majority", "select rname, pos, substring('ACGTN-', arg_max(base, (n, -base)) + 1, 1) as consensus from (select rname, pos, base, count(*) as n from pileup_bases group by all) group by rname, pos", PB)
def majority(spark, sf, p):
    return P.majority(p)


@query("a14_indel_frequencies", """select rname, pos, allele, n::double / sum(n) over (partition by rname, pos) as frequency, row_number() over (partition by rname, pos order by n desc, allele) = 1 as is_first
    from (select rname, pos, case when base = 5 then '-' else '+' end as allele, count(*) as n from pileup_bases group by all)""", PB)  # fmt: skip
def indel_frequencies(spark, sf, p):
    return P.indel_frequencies(p.select("rname", "pos", F.when(F.col("base") == 5, "-").otherwise("+").alias("allele")))


KMER = "(select zmw, length(seq) - 3 as total, substring(seq, i, 4) as kmer from (select zmw, seq, unnest(range(1, length(seq) - 2)) as i from reads where length(seq) >= 4))"


@query("a17_kmer_frequencies", f"select zmw as id, kmer, count(*) as n, count(*)::double / total as share from {KMER} group by zmw, total, kmer", READS)
def kmer_frequencies(spark, sf, reads):
    return K.kmer_frequencies(reads, 4)


FREQ = f"(select zmw as id, kmer, count(*)::double / total as share from {KMER} group by zmw, total, kmer)"


DISTANCES = f"""select a, b, round(sqrt(greatest(0, na.norm + nb.norm - 2 * dot)), 6) as distance from (select x.id as a, y.id as b, sum(x.share * y.share) as dot from {FREQ} x join {FREQ} y
    on x.kmer = y.kmer and y.id > x.id where x.id % 100 = 0 group by 1, 2) join (select id, sum(share * share) as norm from {FREQ} group by id) na on na.id = a
    join (select id, sum(share * share) as norm from {FREQ} group by id) nb on nb.id = b"""


@query("m4_kmer_distances", DISTANCES, READS)
def kmer_distances(spark, sf, reads):
    """Sequences whose id is divisible by 100, against all."""
    own = reads.select(F.col("zmw").alias("id"), "seq")
    return K.share_distances(own.where("id % 100 = 0"), own, 4).select("a", "b", F.round("distance", 6).alias("distance"))


def exact_matches_sql(k: int, unique: bool = False) -> str:
    """Exact matches of ``k`` bases and more of the reads whose id is divisible by 100 with all others, as islands of k-mers."""
    kmers = f"(select zmw, i - 1 as pos, substring(seq, i, {k}) as kmer from (select zmw, seq, unnest(range(1, length(seq) - {k - 2})) as i from reads where length(seq) >= {k}))"
    refs = f"(select zmw, min(pos) as pos, kmer from {kmers} group by zmw, kmer having count(*) = 1)" if unique else kmers
    hits = f"select q.zmw as query, r.zmw as ref, r.pos - q.pos as diagonal, q.pos as q_pos from (select * from {kmers} where zmw % 100 = 0) q join {refs} r on q.kmer = r.kmer and q.zmw <> r.zmw"
    return f"select query, ref, diagonal, min(q_pos) as q_start, max(q_pos) - min(q_pos) + {k} as length from (select *, q_pos - row_number() over (partition by query, ref, diagonal order by q_pos) as island from ({hits})) group by query, ref, diagonal, island"


def matched(reads, k: int, unique: bool = False):
    own = reads.select(F.col("zmw").alias("id"), "seq")
    return K.exact_islands(own.where("id % 100 = 0"), own, k, unique)


@query("q1_exact_matches", exact_matches_sql(20), READS)
def exact_matches(spark, sf, reads):
    """Matches of 20 bases and more of the reads whose id is divisible by 100 with all other reads."""
    return matched(reads, 20)


@query("q2_j11_seed_matches", exact_matches_sql(20, True), READS)
def seed_matches(spark, sf, reads):
    """The same from k-mers that occur once in the reference read."""
    return matched(reads, 20, True)


BASE_AT = "(select zmw, length(seq) as n, unnest(range(1, length(seq) + 1)) as i, unnest(string_split(seq, '')) as c from reads where length(seq) > 0)"


@query("m1_m3_kimura_matrix", f"""select x, y, same, case when 1 - same < 0.75 then round(-ln(same - (1 - same) * (1 - same) / 5), 6) when 1 - same > 0.93 then 10.0 else
    {list(K.FAR_DISTANCES)}[cast(floor((1 - same - 0.75) * 1000 + 0.5) as int) + 1]::double / 100 end as distance
    from (select p.x, p.y, coalesce(m.same, 0) / p.n::double as same from (select a.zmw as x, b.zmw as y, greatest(length(a.seq), length(b.seq)) as n from reads a join reads b on b.zmw > a.zmw where a.zmw % 100 = 0 and greatest(length(a.seq), length(b.seq)) > 0) p
    left join (select a.zmw as x, b.zmw as y, count(*) as same from {BASE_AT} a join {BASE_AT} b on a.i = b.i and a.c = b.c and b.zmw > a.zmw where a.zmw % 100 = 0 group by 1, 2) m on m.x = p.x and m.y = p.y)""", READS)  # fmt: skip
def kimura_matrix(spark, sf, reads):
    """The triangular matrix's rows for the reads whose id is divisible by 100, against all reads; the shorter is padded with gaps."""
    own = reads.select(F.col("zmw").alias("id"), "seq")
    same = K.equal_places(own.where("id % 100 = 0"), own).select("x", "y", (F.col("equal") / F.col("n")).alias("same"))
    d = K.kimura(1 - F.col("same"))
    return same.select("x", "y", "same", F.when(1 - F.col("same") < 0.75, F.round(d, 6)).otherwise(d).alias("distance"))


OTHERS = f"""select x.id as a, y.id as b, sum(x.share * y.share) as dot from {FREQ} x join {FREQ} y on x.kmer = y.kmer and y.id <> x.id group by 1, 2"""


@query("o10_o11_nearest", f"""select a, arg_min(b, (distance, b)) as b, min(distance) as distance from (select a, b, round(sqrt(greatest(0, na.norm + nb.norm - 2 * dot)), 6) as distance from ({OTHERS})
    join (select id, sum(share * share) as norm from {FREQ} group by id) na on na.id = a join (select id, sum(share * share) as norm from {FREQ} group by id) nb on nb.id = b) group by a""", READS)  # fmt: skip
def nearest(spark, sf, reads):
    """The nearest of all other sequences for each; ties go to the smaller id."""
    return K.nearest_by_shares(reads.select(F.col("zmw").alias("id"), "seq"), 4)
