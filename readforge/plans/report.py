"""The analysis queries over read reports and variants: filters, joins, aggregates, sets, orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query

R, V = ("read_report",), ("variants",)
LONG_RUN = 5


# ---- projections and filters


@query("f1_row_filter", "select movie, zmw, num_errors from read_report where num_errors > 3 and (length > 200 or num_passes < 5)", R)
def row_filter(spark, sf, r):
    return r.where((F.col("num_errors") > 3) & ((F.col("length") > 200) | (F.col("num_passes") < 5))).select("movie", "zmw", "num_errors")


@query("f2_sentinel_filter", "select movie, zmw, reference from read_report where reference is not null and reference <> 'NULL' and algorithm is not null", R)
def sentinel_filter(spark, sf, r):
    return r.where(F.col("reference").isNotNull() & (F.col("reference") != "NULL") & F.col("algorithm").isNotNull()).select("movie", "zmw", "reference")


@query("f3_membership", "select ref, pos, count(*) as n from variants where pos in (29, 44, 75) and ref not in ('CHINA', 'JAPAN') group by ref, pos", V)
def membership(spark, sf, v):
    return v.where(F.col("pos").isin(29, 44, 75) & ~F.col("ref").isin("CHINA", "JAPAN")).groupBy("ref", "pos").agg(F.count("*").alias("n"))


@query("f4_columns_by_pattern", "select num_passes, num_errors, num_indel_errors, num_snp_errors from read_report", R)
def columns_by_pattern(spark, sf, r):
    return r.select(r.colRegex("`num_.*`"))


@query("f5_derived", "select zmw as hole, num_errors::double / length as rate, num_passes - num_errors as spare, num_errors > 2 as bad, 'c4' as label from read_report", R)
def derived(spark, sf, r):
    return r.withColumnRenamed("zmw", "hole").select("hole", (F.col("num_errors") / F.col("length")).alias("rate"), (F.col("num_passes") - F.col("num_errors")).alias("spare"), (F.col("num_errors") > 2).alias("bad"), F.lit("c4").alias("label"))


@query("f7_id_range", "select movie, zmw from read_report where zmw between 10 and 59", R)
def id_range(spark, sf, r):
    return r.where(F.col("zmw").between(10, 59)).select("movie", "zmw")


@query("f8_acceptance", "select movie, zmw, algorithm from read_report where num_passes >= 3 and 1 - num_errors::double / length >= 0.98 and length between 100 and 5000", R)
def acceptance(spark, sf, r):
    return r.where((F.col("num_passes") >= 3) & (1 - F.col("num_errors") / F.col("length") >= 0.98) & F.col("length").between(100, 5000)).select("movie", "zmw", "algorithm")


@query("f9_ratio_test", """select zmw, num_indel_errors::double / num_errors <= 0.34 and num_errors::double / num_passes > 0.1 and num_errors >= 4 as strict,
    num_indel_errors::double / num_errors <= 0.34 and num_errors::double / num_passes > 0.1 as loose from read_report where num_errors > 0""", R)  # fmt: skip
def ratio_test(spark, sf, r):
    loose = (F.col("num_indel_errors") / F.col("num_errors") <= 0.34) & (F.col("num_errors") / F.col("num_passes") > 0.1)
    return r.where("num_errors > 0").select("zmw", (loose & (F.col("num_errors") >= 4)).alias("strict"), loose.alias("loose"))


@query("f13_subset_by_existence", "select movie, zmw from read_report r where exists (select 1 from variants v where v.zmw = r.zmw and v.type = 'SNP' and v.pos < 3)", R + V)
def subset_by_existence(spark, sf, r, v):
    return r.join(v.where("type = 'SNP' and pos < 3"), "zmw", "left_semi").select("movie", "zmw")


@query("f14_relabel", "select case algorithm when 'F' then 'c4' when 'O' then 'C2' else 'master' end as label, case algorithm when 'F' then 1 when 'O' then 0 else 2 end as ord, count(*) as n from read_report group by algorithm", R)
def relabel(spark, sf, r):
    a = F.col("algorithm")
    return r.groupBy("algorithm").agg(F.count("*").alias("n")).select(F.when(a == "F", "c4").when(a == "O", "C2").otherwise("master").alias("label"), F.when(a == "F", 1).when(a == "O", 0).otherwise(2).alias("ord"), "n")


@query("f15_category_bins", """select case when type = 'SNP' then 'SNP' when hp_len - 4 < -2 then 'Below -2' when hp_len - 4 <= 2 then '-2 to 2' else 'Above 2' end as category, count(*) as n
    from variants group by 1""", V)  # fmt: skip
def category_bins(spark, sf, v):
    d = F.col("hp_len") - 4
    return v.groupBy(F.when(F.col("type") == "SNP", "SNP").when(d < -2, "Below -2").when(d <= 2, "-2 to 2").otherwise("Above 2").alias("category")).agg(F.count("*").alias("n"))


@query("f16_strand_collapse", "select zmw, translate(substring(seq, 1, 1), 'TG', 'AC') as base from reads", ("reads",))
def strand_collapse(spark, sf, reads):
    return reads.select("zmw", F.translate(F.substring("seq", 1, 1), "TG", "AC").alias("base"))


@query("f17_interaction_key", "select concat_ws(':', indeltype, cast(pos as varchar)) as k, count(*) as n from variants where type = 'Indel' group by 1", V)
def interaction_key(spark, sf, v):
    return v.where("type = 'Indel'").groupBy(F.concat_ws(":", "indeltype", F.col("pos").cast("string")).alias("k")).agg(F.count("*").alias("n"))


# ---- joins


@query("j1_left_outer_last_wins", """select a.movie, a.zmw, a.num_passes, coalesce(cast(b.num_errors as varchar), 'NA') as num_errors, coalesce(b.algorithm, 'NA') as algorithm
    from (select * from read_report where algorithm = 'O') a left join (select * from (select *, row_number() over (partition by movie, zmw order by algorithm desc) as rn
    from read_report where algorithm <> 'O') where rn = 1) b on a.movie = b.movie and a.zmw = b.zmw""", R)  # fmt: skip
def left_outer_last_wins(spark, sf, r):
    # the last duplicate of a key wins: an aggregate, so equal keys are combined before the shuffle
    last = r.where("algorithm <> 'O'").groupBy("movie", "zmw").agg(F.max_by(F.struct("num_errors", "algorithm"), "algorithm").alias("b"))
    return r.where("algorithm = 'O'").join(last, ["movie", "zmw"], "left").select("movie", "zmw", "num_passes", F.coalesce(F.col("b.num_errors").cast("string"), F.lit("NA")).alias("num_errors"), F.coalesce("b.algorithm", F.lit("NA")).alias("algorithm"))


@query("j2_inner_suffixes", "select a.zmw, a.num_errors as errors_x, b.num_errors as errors_y from read_report a join read_report b on a.zmw = b.zmw where a.algorithm = 'F' and b.algorithm = 'O'", R)
def inner_suffixes(spark, sf, r):
    x = r.where("algorithm = 'F'").select("zmw", F.col("num_errors").alias("errors_x"))
    return x.join(r.where("algorithm = 'O'").select("zmw", F.col("num_errors").alias("errors_y")), "zmw")


@query("j3_composite_key", """select a.zmw, a.reference, a.n as n_f, b.n as n_o from (select zmw, reference, count(*) as n from read_report where algorithm = 'F' group by all) a
    join (select zmw, reference, count(*) as n from read_report where algorithm = 'O' group by all) b using (zmw, reference)""", R)  # fmt: skip
def composite_key(spark, sf, r):
    side = lambda a, n: r.where(F.col("algorithm") == a).groupBy("zmw", "reference").agg(F.count("*").alias(n))
    return side("F", "n_f").join(side("O", "n_o"), ["zmw", "reference"])


@query("j4_natural_chain", """select * from (select movie, zmw, num_errors as e_f from read_report where algorithm = 'F') natural join (select movie, zmw, num_errors as e_o from read_report
    where algorithm = 'O') natural join (select movie, zmw, num_errors as e_p from read_report where algorithm = 'P')""", R)  # fmt: skip
def natural_chain(spark, sf, r):
    parts = [r.where(F.col("algorithm") == a).select("movie", "zmw", F.col("num_errors").alias(f"e_{a.lower()}")) for a in "FOP"]
    return natural(natural(parts[0], parts[1]), parts[2])


def natural(a, b):
    """Join on all columns both sides have."""
    return a.join(b, [c for c in a.columns if c in b.columns])


@query("j5_semi", "select ref, pos, zmw from variants where zmw in (select zmw from read_report where num_errors > 5)", V + R)
def semi(spark, sf, v, r):
    return v.join(r.where("num_errors > 5").select("zmw"), "zmw", "left_semi").select("ref", "pos", "zmw")


@query("j5b_anti", "select distinct zmw from read_report r where not exists (select 1 from variants v where v.zmw = r.zmw)", R + V)
def anti(spark, sf, r, v):
    return r.join(v, "zmw", "left_anti").select("zmw").distinct()


@query("j6_parent_children", "select r.zmw, cast(count(v.zmw) as bigint) as children, coalesce(string_agg(cast(v.pos as varchar), ',' order by v.pos), '') as places from (select distinct zmw from read_report) r left join variants v on v.zmw = r.zmw group by r.zmw", R + V)
def parent_children(spark, sf, r, v):
    kids = v.groupBy("zmw").agg(F.count("*").alias("children"), F.array_sort(F.collect_list("pos")).alias("p"))
    return r.select("zmw").distinct().join(kids, "zmw", "left").select("zmw", F.coalesce("children", F.lit(0)).cast("long").alias("children"), F.coalesce(F.array_join(F.col("p").cast("array<string>"), ","), F.lit("")).alias("places"))


# ---- aggregates


@query("a1_count_by_keys", "select algorithm, reference, count(*) as n from read_report group by algorithm, reference", R)
def count_by_keys(spark, sf, r):
    return r.groupBy("algorithm", "reference").agg(F.count("*").alias("n"))


@query("a2_mean_by_keys", "select algorithm, num_passes, round(avg(num_errors::double / length), 9) as rate from read_report where length is not null and num_errors is not null group by algorithm, num_passes", R)
def mean_by_keys(spark, sf, r):
    return r.dropna(subset=["length", "num_errors"]).groupBy("algorithm", "num_passes").agg(F.round(F.avg(F.col("num_errors") / F.col("length")), 9).alias("rate"))


@query("a3_sum_by_keys", "select reference, cast(sum(num_errors) as bigint) as errors, cast(sum(length) as bigint) as bases from read_report group by reference", R)
def sum_by_keys(spark, sf, r):
    return r.groupBy("reference").agg(F.sum("num_errors").alias("errors"), F.sum("length").alias("bases"))


@query("a4_shares", "select ref, count(*)::double / (select count(*) from variants) as share, avg(case when hp_len - 4 < 0 then 1.0 else 0.0 end) as negative from variants group by ref", V)
def shares(spark, sf, v):
    per = v.groupBy("ref").agg(F.count("*").alias("n"), F.avg(F.when(F.col("hp_len") - 4 < 0, 1.0).otherwise(0.0)).alias("negative"))
    return per.select("ref", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"), "negative")


@query("a5_global", "select cast(sum(num_errors) as bigint) as errors, avg(num_errors) as mean_errors, max(num_errors) as most, median(num_errors) as mid, count(*) filter (where num_errors = 0) as perfect from read_report", R)
def global_scalars(spark, sf, r):
    return r.agg(F.sum("num_errors").alias("errors"), F.avg("num_errors").alias("mean_errors"), F.max("num_errors").alias("most"), F.median("num_errors").alias("mid"), F.count_if(F.col("num_errors") == 0).alias("perfect"))


@query("a6_crosstab", "select indeltype, count(*) filter (where type = 'Indel') as Indel, count(*) filter (where type = 'SNP') as SNP from variants group by indeltype", V)
def crosstab(spark, sf, v):
    return v.groupBy("indeltype").pivot("type", ["Indel", "SNP"]).count().fillna(0)


@query("a7_group_lists", "select zmw, string_agg(cast(pos as varchar) || type, ',' order by pos, type) as all_of from variants group by zmw", V)
def group_lists(spark, sf, v):
    own = F.array_sort(F.collect_list(F.struct("pos", "type")))
    return v.groupBy("zmw").agg(own.alias("x")).select("zmw", F.array_join(F.transform("x", lambda s: F.concat(s["pos"].cast("string"), s["type"])), ",").alias("all_of"))


@query("a8_conditional_counts", "select zmw, count(*) filter (where type = 'Indel') as indels, count(*) filter (where type = 'SNP') as snps from variants group by zmw", V)
def conditional_counts(spark, sf, v):
    return v.groupBy("zmw").agg(F.count_if(F.col("type") == "Indel").alias("indels"), F.count_if(F.col("type") == "SNP").alias("snps"))


@query("a10_outcome_tally", "select case when num_errors = 0 then 'Perfect' when num_passes < 3 then 'TooFewPasses' else 'Success' end as result, count(*) as n from read_report group by 1", R)
def outcome_tally(spark, sf, r):
    return r.groupBy(F.when(F.col("num_errors") == 0, "Perfect").when(F.col("num_passes") < 3, "TooFewPasses").otherwise("Success").alias("result")).agg(F.count("*").alias("n"))


@query("a18_serial_numbers", "select ref, row_number() over (order by first) - 1 as id from (select ref, min(zmw * 100 + pos) as first from variants group by ref)", V)
def serial_numbers(spark, sf, v):
    # one row for each distinct item reaches the single ordering task
    first = v.groupBy("ref").agg(F.min(F.col("zmw") * 100 + F.col("pos")).alias("first"))
    return first.select("ref", (F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("id"))


@query("a19_set_union", "select ref, string_agg(distinct indeltype, ',' order by indeltype) as kinds from variants group by ref", V)
def set_union(spark, sf, v):
    return v.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("indeltype")), ",").alias("kinds"))


@query("a20_paired_comparison", """select reference, count(*) as pairs, count(*) filter (where y < x)::double / count(*) as improved, count(*) filter (where y > x)::double / count(*) as worsened,
    cast(sum(x) as bigint) as errors_x, cast(sum(y) as bigint) as errors_y, case when sum(x) > 0 then 1 - sum(y)::double / sum(x) end as reduction
    from (select a.reference, a.num_errors as x, b.num_errors as y from read_report a join read_report b on a.movie = b.movie and a.zmw = b.zmw where a.algorithm = 'F' and b.algorithm = 'O') group by reference""", R)  # fmt: skip
def paired_comparison(spark, sf, r):
    x = r.where("algorithm = 'F'").select("movie", "zmw", "reference", F.col("num_errors").alias("x"))
    both = x.join(r.where("algorithm = 'O'").select("movie", "zmw", F.col("num_errors").alias("y")), ["movie", "zmw"])
    n = F.count("*")
    return both.groupBy("reference").agg(n.alias("pairs"), (F.count_if(F.col("y") < F.col("x")) / n).alias("improved"), (F.count_if(F.col("y") > F.col("x")) / n).alias("worsened"), F.sum("x").alias("errors_x"), F.sum("y").alias("errors_y"), F.when(F.sum("x") > 0, 1 - F.sum("y") / F.sum("x")).alias("reduction"))


@query("a21_normalised_shares", "select type, indeltype, n::double / sum(n) over (partition by type) as share from (select type, indeltype, count(*) as n from variants group by type, indeltype)", V)
def normalised_shares(spark, sf, v):
    return v.groupBy("type", "indeltype").agg(F.count("*").alias("n")).select("type", "indeltype", (F.col("n") / F.sum("n").over(W.partitionBy("type"))).alias("share"))


@query("a22_per_key_rate", "select v.ref, v.pos, v.n::double / r.n as rate from (select ref, pos, count(*) as n from variants group by ref, pos) v join (select reference, count(*) as n from read_report group by reference) r on v.ref = r.reference", V + R)
def per_key_rate(spark, sf, v, r):
    reads = r.groupBy(F.col("reference").alias("ref")).agg(F.count("*").alias("reads"))
    return v.groupBy("ref", "pos").agg(F.count("*").alias("n")).join(reads, "ref").select("ref", "pos", (F.col("n") / F.col("reads")).alias("rate"))


@query("a23_histogram", "select algorithm, cast(floor(length / 50.0) * 50 as bigint) as bin, count(*) as n from read_report group by 1, 2", R)
def histogram(spark, sf, r):
    return r.groupBy("algorithm", (F.floor(F.col("length") / 50) * 50).cast("long").alias("bin")).agg(F.count("*").alias("n"))


# ---- orders


@query("o1_top_by_score", "select zmw, algorithm, num_errors from read_report order by num_errors desc, zmw, algorithm limit 20", R)
def top_by_score(spark, sf, r):
    return r.orderBy(F.desc("num_errors"), "zmw", "algorithm").limit(20).select("zmw", "algorithm", "num_errors")


@query("o2_by_count", "select ref, n, row_number() over (order by n desc, ref) as place from (select ref, count(*) as n from variants group by ref)", V)
def by_count(spark, sf, v):
    return v.groupBy("ref").agg(F.count("*").alias("n")).select("ref", "n", F.row_number().over(W.orderBy(F.desc("n"), "ref")).cast("long").alias("place"))


@query("o3_by_offset", "select zmw, pos, row_number() over (partition by zmw order by pos, hp_len) as place from variants", V)
def by_offset(spark, sf, v):
    return v.select("zmw", "pos", F.row_number().over(W.partitionBy("zmw").orderBy("pos", "hp_len")).cast("long").alias("place"))


@query("o4_total_order", "select pos, hp_len, type, indeltype from variants order by pos, hp_len, type, indeltype limit 50", V)
def total_order(spark, sf, v):
    return v.orderBy("pos", "hp_len", "type", "indeltype").limit(50).select("pos", "hp_len", "type", "indeltype")


@query("o5_mixed_order", "select rname, t_start, t_end from intervals order by t_start, t_end desc, rname limit 40", ("intervals",))
def mixed_order(spark, sf, i):
    return i.orderBy("t_start", F.desc("t_end"), "rname").limit(40).select("rname", "t_start", "t_end")


@query("o6_top_one", "select reference, max(length) as longest, arg_max(zmw, (length, -zmw)) as zmw from read_report group by reference", R)
def top_one(spark, sf, r):
    return r.groupBy("reference").agg(F.max("length").alias("longest"), F.max_by("zmw", F.struct("length", -F.col("zmw"))).alias("zmw"))


@query("o7_take_skip", "select zmw, algorithm from read_report order by zmw, algorithm, movie limit 30 offset 10", R)
def take_skip(spark, sf, r):
    return r.orderBy("zmw", "algorithm", "movie").offset(10).limit(30).select("zmw", "algorithm")


@query("o8_first_match", "select zmw, algorithm, num_errors from read_report where num_errors > 4 order by zmw, algorithm limit 1", R)
def first_match(spark, sf, r):
    return r.where("num_errors > 4").orderBy("zmw", "algorithm").limit(1).select("zmw", "algorithm", "num_errors")


@query("o12_head", "select zmw, algorithm, movie from read_report order by zmw, algorithm limit 6", R)
def head(spark, sf, r):
    return r.orderBy("zmw", "algorithm").limit(6).select("zmw", "algorithm", "movie")


# ---- windows


@query("w6_first_and_last_max", "select reference, arg_max(zmw, (num_errors, -zmw)) as first_max, arg_max(zmw, (num_errors, zmw)) as last_max from read_report group by reference", R)
def first_and_last_max(spark, sf, r):
    return r.groupBy("reference").agg(F.max_by("zmw", F.struct("num_errors", -F.col("zmw"))).alias("first_max"), F.max_by("zmw", F.struct("num_errors", "zmw")).alias("last_max"))


@query("w7_last_duplicate_wins", "select zmw, max(algorithm) as algorithm, arg_max(num_errors, algorithm) as num_errors from read_report group by zmw", R)
def last_duplicate_wins(spark, sf, r):
    return r.groupBy("zmw").agg(F.max("algorithm").alias("algorithm"), F.max_by("num_errors", "algorithm").alias("num_errors"))


# ---- sets and shape


@query("u1_intersect", "select zmw from read_report where algorithm = 'F' intersect select zmw from read_report where algorithm = 'O' intersect select zmw from read_report where algorithm = 'P'", R)
def intersect3(spark, sf, r):
    part = lambda a: r.where(F.col("algorithm") == a).select("zmw")
    return part("F").intersect(part("O")).intersect(part("P"))


@query("u2_union_labelled", "select zmw, num_errors, 'final' as label from read_report where algorithm = 'F' union all select zmw, num_errors, 'open' from read_report where algorithm = 'O'", R)
def union_labelled(spark, sf, r):
    part = lambda a, label: r.where(F.col("algorithm") == a).select("zmw", "num_errors", F.lit(label).alias("label"))
    return part("F", "final").unionByName(part("O", "open"))


@query("u3_union_distinct", "select pos, type from variants where hp_len = 1 union select pos, type from variants where hp_len = 2", V)
def union_distinct(spark, sf, v):
    return v.where("hp_len = 1").select("pos", "type").union(v.where("hp_len = 2").select("pos", "type")).distinct()


@query("u4_difference", "select zmw from read_report where algorithm = 'F' except select zmw from read_report where algorithm = 'O'", R)
def difference(spark, sf, r):
    return r.where("algorithm = 'F'").select("zmw").subtract(r.where("algorithm = 'O'").select("zmw"))


@query("u5_unpivot", "select zmw, algorithm, kind, n from (select zmw, algorithm, num_indel_errors, num_snp_errors from read_report) unpivot (n for kind in (num_indel_errors, num_snp_errors))", R)
def unpivot(spark, sf, r):
    return r.unpivot(["zmw", "algorithm"], ["num_indel_errors", "num_snp_errors"], "kind", "n")


@query("u6_concat", "select zmw as x from read_report union all select pos from variants", R + V)
def concat(spark, sf, r, v):
    return r.select(F.col("zmw").alias("x")).union(v.select(F.col("pos").cast("long")))


@query("u7_hull", "select rname, min(t_start) as s, max(t_end) as e from intervals group by rname", ("intervals",))
def hull(spark, sf, i):
    return i.groupBy("rname").agg(F.min("t_start").alias("s"), F.max("t_end").alias("e"))
