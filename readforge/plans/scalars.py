"""Scalar functions over reads and qualities."""

from __future__ import annotations

from pyspark.sql import functions as F

from readforge.functions import columns as C

from .registry import query, table

READS, R, V = ("reads",), ("read_report",), ("variants",)


def quals(spark, sf):
    """(zmw, q): qualities 0 to 40 derived from character codes."""
    return table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("zmw"), F.transform(F.split("text", ""), lambda c, i: (F.ascii(c) * 7 + i + 1) % 41).alias("q"))


QUALS = "with quals as (select doc_id as zmw, list_transform(string_split(text, ''), lambda c, i: (ascii(c) * 7 + i) % 41) as q from documents where length(text) > 0)\n"


@query("c1_split_exactly", "select zmw, split_part(movie || '/' || zmw || '/ccs/x', '/', 1) as a, split_part(movie || '/' || zmw || '/ccs/x', '/', 2) as b, 'ccs/x' as rest from reads", READS)
def split_exactly(spark, sf, reads):
    parts = C.split_exactly(F.concat_ws("/", "movie", "zmw", F.lit("ccs/x")), "/", 3)
    return reads.select("zmw", parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("rest"))


@query("c2_split_nonempty", "select zmw, len(list_filter(string_split(seq, 'AC'), lambda x: x <> '')) as n, list_filter(string_split(seq, 'AC'), lambda x: x <> '')[1] as first from reads", READS)
def split_nonempty(spark, sf, reads):
    parts = C.split_nonempty(F.col("seq"), "AC")
    return reads.select("zmw", F.size(parts).cast("long").alias("n"), F.try_element_at(parts, F.lit(1)).alias("first"))


@query("c3_around_delimiter", "select zmw, case when strpos(seq, 'GT') > 0 then substring(seq, strpos(seq, 'GT') + 2) else '' end as after, split_part(movie || '=' || seq, '=', 1) as before from reads", READS)
def around_delimiter(spark, sf, reads):
    return reads.select("zmw", C.after_first(F.col("seq"), "GT").alias("after"), C.around_first(F.concat_ws("=", "movie", "seq"), "=")["before"].alias("before"))


@query("c4_protected_split", "select zmw, 'join(1..' || zmw || ',7)' as first, 3 as n from reads", READS)
def protected_split(spark, sf, reads):
    parts = C.split_protected(F.concat(F.lit("join(1.."), F.col("zmw").cast("string"), F.lit(",7),b(c(d,e),f),g")))
    return reads.select("zmw", parts[0].alias("first"), F.size(parts).alias("n"))


@query("c5_reverse_mixed_case", "select zmw, reverse(seq) as r, upper(substring(movie, 1, 1)) || lower(substring(movie, 2)) as m from reads", READS)
def reverse_mixed_case(spark, sf, reads):
    return reads.select("zmw", F.reverse("seq").alias("r"), C.mixed_case(F.col("movie")).alias("m"))


@query("c6_c7_complements", "select zmw, translate(seq, 'ACGT', 'TGCA') as c, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from reads", READS)
def complements(spark, sf, reads):
    return reads.select("zmw", C.complement(F.col("seq")).alias("c"), C.reverse_complement(F.col("seq")).alias("rc"))


@query("c8_read_names", "select movie, cast(zmw as int) as zmw, cast(zmw % 50 as int) as s, cast(zmw % 50 + length(seq) as int) as e from reads", READS)
def read_names(spark, sf, reads):
    name = F.concat(F.concat_ws("/", "movie", "zmw", F.concat_ws("_", F.col("zmw") % 50, F.col("zmw") % 50 + F.length("seq"))), F.lit(" RQ=0.85"))
    p = C.parse_subread_name(name)
    return reads.select(p["movie"].alias("movie"), p["zmw"].alias("zmw"), p["start"].alias("s"), p["end"].alias("e"))


@query("c9_c10_cigar", """select zmw, (zmw % 90 + 1) || 'M' || (zmw % 7 + 1) || 'I3D' || (zmw % 5 + 1) || 'X' as built, cast(zmw % 90 + 1 + 3 + zmw % 5 + 1 as int) as ref_length from reads""", READS)
def cigar(spark, sf, reads):
    z = F.col("zmw")
    text = F.concat((z % 90 + 1).cast("string"), F.lit("M"), (z % 7 + 1).cast("string"), F.lit("I3D"), (z % 5 + 1).cast("string"), F.lit("X"))
    parsed = C.parse_cigar(text)
    return reads.select("zmw", C.build_cigar(parsed).alias("built"), C.reference_length(parsed).alias("ref_length"))


@query("c11_flags", "select o_orderkey, (o_orderkey % 4096) & 16 <> 0 as is_reverse, (o_orderkey % 4096) & 4 <> 0 as unmapped from orders")
def flags(spark, sf):
    f = F.col("o_orderkey") % 4096
    return table(spark, sf, "orders").select("o_orderkey", C.has_flag(f, 16).alias("is_reverse"), C.has_flag(f, 4).alias("unmapped"))


@query("c12_virtual_offsets", "select o_orderkey, cast(o_orderkey * 65536 + o_custkey % 65536 as bigint) as packed, o_orderkey as block, o_custkey % 65536 as inside from orders")
def virtual_offsets(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", C.pack_offset(F.col("o_orderkey"), F.col("o_custkey") % 65536).alias("packed"))
    return o.select("o_orderkey", "packed", C.unpack_offset(F.col("packed"))["block"].alias("block"), C.unpack_offset(F.col("packed"))["inside"].alias("inside"))


@query("c13_c14_phred", QUALS + "select zmw, q[1] as q1, round(pow(10.0, -q[1] / 10.0), 9) as err, round(1 - pow(10.0, -q[1] / 10.0), 9) as ok, round(-10 * log10(pow(10.0, -q[1] / 10.0)), 6) + 0.0 as back from quals")
def phred(spark, sf):
    q = F.col("q")[0]
    return quals(spark, sf).select("zmw", q.alias("q1"), F.round(C.phred_to_error(q), 9).alias("err"), F.round(1 - C.phred_to_error(q), 9).alias("ok"), (F.round(C.error_to_phred(C.phred_to_error(q)), 6) + 0.0).alias("back"))


@query("c15_base_codes", "select zmw, strpos('ACGTN-', substring(seq, 1, 1)) - 1 as code from reads where length(seq) > 0", READS)
def base_codes(spark, sf, reads):
    return reads.where("length(seq) > 0").select("zmw", (F.instr(F.lit("ACGTN-"), F.substring("seq", 1, 1)) - 1).cast("long").alias("code"))


@query("c16_count_char", "select zmw, length(seq) - length(replace(seq, 'A', '')) as n from reads", READS)
def count_char(spark, sf, reads):
    return reads.select("zmw", C.count_char(F.col("seq"), "A").cast("long").alias("n"))


@query("c17_c18_sigmoids", "select zmw, round(-ln(1 + exp(num_errors::double - 3)), 9) as ls, round(1 / (1 + exp(-num_errors::double)), 9) as lo, round(ln(exp(num_errors::double) + exp(num_passes::double)), 6) as la, case when num_errors - 2 < 0 then 0 else num_errors - 2 end as step from read_report where algorithm = 'P'", R)
def sigmoids(spark, sf, r):
    e, p = F.col("num_errors").cast("double"), F.col("num_passes").cast("double")
    return r.where("algorithm = 'P'").select("zmw", F.round(C.log_sigmoid(e - 3), 9).alias("ls"), F.round(C.logistic(e), 9).alias("lo"), F.round(C.log_add(e, p), 6).alias("la"), F.greatest(F.col("num_errors") - 2, F.lit(0)).cast("long").alias("step"))


@query("c20_checksum")
def checksum(spark, sf):
    """CRC-32 of a read's bases and its quality track, in hexadecimal; SQL has no such checksum."""
    track = F.transform(F.split("text", ""), lambda c, i: ((F.ascii(c) * 7 + i + 1) % 41).cast("string"))
    return table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("zmw"), F.lower(F.lpad(F.hex(F.crc32(F.concat(F.col("text"), F.array_join(track, ",")).cast("binary"))), 8, "0")).alias("crc"))


@query("c21_reference_section", """select zmw, case when zmw % 40 > 20 then substring(seq, 21, zmw % 40 - 20 + 1) else substring(seq, 21) || substring(seq, 1, zmw % 40) end as part from reads""", READS)
def reference_section(spark, sf, reads):
    return reads.select("zmw", C.section(F.col("seq"), F.lit(20), (F.col("zmw") % 40).cast("int")).alias("part"))


@query("c22_c23_variant_text", "select ref, pos, pos + hp_len as end_pos, case when type = 'SNP' then 'A->G @ ' || pos else indeltype || ' @ ' || pos || ' x' || hp_len end as summary from variants", V)
def variant_text(spark, sf, v):
    return v.select("ref", "pos", (F.col("pos") + F.col("hp_len")).alias("end_pos"), F.when(F.col("type") == "SNP", F.format_string("A->G @ %d", "pos")).otherwise(F.format_string("%s @ %d x%d", "indeltype", "pos", "hp_len")).alias("summary"))


@query("c24_w1_homopolymer", "select zmw, length(regexp_extract(substring(seq, 6), '^(A+|C+|G+|T+)')) as hp_len, substring(seq, 6, 1) as hp_base from reads", READS)
def homopolymer(spark, sf, reads):
    run = C.homopolymer(F.col("seq"), F.lit(4))
    return reads.select("zmw", F.length(run).cast("long").alias("hp_len"), F.substring("seq", 6, 1).alias("hp_base"))


@query("c25_apply_mutation", "select zmw, substring(seq, 1, 3) || 'TT' || substring(seq, 4) as ins, substring(seq, 1, 3) || substring(seq, 6) as del, substring(seq, 1, 3) || 'C' || substring(seq, 5) as sub from reads", READS)
def apply_mutation(spark, sf, reads):
    m = lambda kind, end, bases: C.apply_mutation(F.col("seq"), F.lit(kind), F.lit(3), F.lit(end), F.lit(bases))
    return reads.select("zmw", m("INS", 3, "TT").alias("ins"), m("DEL", 5, "").alias("del"), m("SUBS", 4, "C").alias("sub"))


@query("c27_c28_mutation_algebra", "select pos, case when indeltype = 'Insertion' then 97 - pos else 96 - pos end as other, case when indeltype = 'Insertion' then hp_len else -hp_len end as diff, count(*) as n from variants where type = 'Indel' group by all", V)
def mutation_algebra(spark, sf, v):
    kind = F.when(F.col("indeltype") == "Insertion", "INS").otherwise("DEL")
    diff = C.length_difference(kind, F.col("pos"), F.col("pos") + F.col("hp_len"), F.repeat(F.lit("A"), F.col("hp_len")))
    return v.where("type = 'Indel'").select("pos", C.strand_converted(F.col("pos"), kind, F.lit(97)).alias("other"), diff.alias("diff")).groupBy("pos", "other", "diff").agg(F.count("*").alias("n"))


#: The standard genetic code, by first, second and third base in the order T, C, A, G.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_dna(seq, offset: int = 0):
    """Protein of a reading frame; an incomplete last codon is dropped."""
    at = lambda c, k: F.instr(F.lit("TCAG"), F.substring(c, k, 1)) - 1
    codon = lambda c: F.substring(F.lit(GENETIC_CODE), at(c, 1) * 16 + at(c, 2) * 4 + at(c, 3) + 1, F.lit(1))
    return F.array_join(F.transform(F.regexp_extract_all(F.substring(seq, offset + 1, 1 << 30), F.lit("(?s).{3}"), F.lit(0)), codon), "")


PROTEIN = f"""select zmw, coalesce(list_aggregate(list_transform(range(0, cast(length(seq) // 3 as bigint)), lambda i: substring('{GENETIC_CODE}',
    cast((strpos('TCAG', substring(seq, i * 3 + 1, 1)) - 1) * 16 + (strpos('TCAG', substring(seq, i * 3 + 2, 1)) - 1) * 4 + strpos('TCAG', substring(seq, i * 3 + 3, 1)) as bigint), 1)), 'string_agg', ''), '') as protein from reads"""


@query("c29_translation", PROTEIN, READS)
def translation(spark, sf, reads):
    return reads.select("zmw", translate_dna(F.col("seq")).alias("protein"))


@query("c31_kmers", "select zmw, i - 1 as pos, substring(seq, i, 5) as kmer from (select zmw, seq, unnest(range(1, length(seq) - 3)) as i from reads where length(seq) >= 5)", READS)
def kmers(spark, sf, reads):
    return reads.select("zmw", F.posexplode(C.kmers(F.col("seq"), 5)).alias("pos", "kmer")).withColumn("pos", F.col("pos").cast("long"))


@query("c32_url_encode", "select n_nationkey, replace(n_name, ' ', '+') || '%26x%3D1' as u from nation")
def url_encode(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.url_encode(F.concat("n_name", F.lit("&x=1"))).alias("u"))


@query("c35_c36_validation", "select n_nationkey, lower(n_name) in ('china', 'japan') as listed, n_name from nation")
def validation(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", C.one_of_ignoring_case(F.col("n_name"), ["China", "JAPAN"]).alias("listed"), C.checked(F.col("n_name"), r"[A-Z0-9_ ]+").alias("n_name"))


@query("f6_quality_trim", QUALS + """, t as (select zmw, list_slice(q, 1, coalesce(list_max(list_transform(range(1, len(q) + 1), lambda i: case when q[i] >= 20 then i else 0 end)), 0)) as k from quals)
    select zmw, len(k) as kept, round(list_avg(k), 9) as mean from t where len(k) > 1 and list_avg(k) > 20""")  # fmt: skip
def quality_trim(spark, sf):
    k = quals(spark, sf).select("zmw", C.trim_tail(F.col("q"), 20).alias("k"))
    mean = C.array_mean(F.col("k"))
    return k.where((F.size("k") > 1) & (mean > 20)).select("zmw", F.size("k").cast("long").alias("kept"), F.round(mean, 9).alias("mean"))


@query("a9_array_statistics", QUALS + "select zmw, list_max(q)::double as q_max, list_min(q)::double as q_min, round(list_avg(q), 9) as q_mean from quals")
def array_statistics(spark, sf):
    s = C.array_statistics(F.col("q"))
    return quals(spark, sf).select("zmw", s["max"].alias("q_max"), s["min"].alias("q_min"), F.round(s["mean"], 9).alias("q_mean"))


@query("o9_element_range", QUALS + "select zmw, q[3] as third, list_sum(list_slice(q, 2, 4))::bigint as s from quals where len(q) >= 4")
def element_range(spark, sf):
    return quals(spark, sf).where("size(q) >= 4").select("zmw", F.element_at("q", 3).alias("third"), F.aggregate(F.slice("q", 2, 3), F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))


@query("f10_f12_flatten", QUALS + "select zmw, i as ord, q[i] as v from (select zmw, q, unnest(range(1, len(q) + 1)) as i from quals)")
def flatten(spark, sf):
    return quals(spark, sf).select("zmw", F.posexplode("q").alias("ord", "v")).select("zmw", (F.col("ord") + 1).cast("long").alias("ord"), "v")


@query("f11_optional_map", QUALS + "select zmw, v from (select zmw, case when q[1] > 20 then q[1] * 2 end as v from quals) where v is not null")
def optional_map(spark, sf):
    return quals(spark, sf).select("zmw", F.when(F.col("q")[0] > 20, F.col("q")[0] * 2).alias("v")).where("v is not null")


@query("u8_invert_map", "select distinct n_regionkey, n_nationkey from nation")
def invert_map(spark, sf):
    m = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.explode(F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"])))).alias("n_nationkey", "_name")).select("n_regionkey", "n_nationkey")


@query("q4_pattern_finder", "select zmw, i - 1 as at from (select zmw, seq, unnest(range(1, length(seq) - 1)) as i from reads where length(seq) >= 3) where substring(seq, i, 3) = 'ACA'", READS)
def pattern_finder(spark, sf, reads):
    return reads.select("zmw", F.explode(C.find_all(F.col("seq"), "ACA")).alias("at")).withColumn("at", F.col("at").cast("long"))
