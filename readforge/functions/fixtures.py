"""Sequencing-shaped tables derived from the driver's tables by plain SQL, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables, SQL). ``{replace_all}`` is DuckDB's option to replace every match; Spark always does.
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "reads": (("documents",), """
select doc_id as zmw, source as movie,
       translate(lower(regexp_replace(text, '[^A-Za-z]', ''{replace_all})),
                 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq
from documents"""),
    "subreads": (("documents",), """
select zmw * 1048576 + part as id, zmw, movie, part, substring(seq, cast(part * 200 + 1 as int), 200) as seq
from (select zmw, movie, seq, {parts} as part from (
      select doc_id as zmw, source as movie,
             translate(lower(regexp_replace(text, '[^A-Za-z]', ''{replace_all})),
                       'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq
      from documents) r where length(seq) > 0) t"""),
    "intervals": (("lineitem",), """
select cast(l_suppkey % 5 as int) as rname, cast(l_partkey * 3 as bigint) as t_start,
       cast(l_partkey * 3 + l_quantity as bigint) as t_end from lineitem"""),
    "pileup_bases": (("lineitem",), """
select rname, pos, cast(case when r < 7 then 0 when r < 12 then 1 when r < 17 then 2
       when r < 21 then 3 when r = 21 then 4 else 5 end as int) as base, phred
from (select concat('ref', cast(l_suppkey % 5 as {text})) as rname, cast(l_partkey % 200 + 1 as int) as pos,
             cast((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 23 as int) as r,
             cast(l_quantity as int) as phred from lineitem) t"""),
    "read_report": (("orders", "customer", "nation", "lineitem"), """
select concat('m', cast(c.c_nationkey % 3 as {text})) as movie, o.o_custkey as zmw,
       o.o_orderstatus as algorithm, n.n_name as reference, cast(count(*) as bigint) as num_passes,
       cast(sum(case when l_returnflag <> 'N' then 1 else 0 end) as bigint) as num_errors,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as num_indel_errors,
       cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as bigint) as num_snp_errors,
       cast(sum(l_quantity) as bigint) as length
from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
     join lineitem l on l.l_orderkey = o.o_orderkey
group by c.c_nationkey, o.o_custkey, o.o_orderstatus, n.n_name"""),
    "variants": (("lineitem", "orders", "customer", "nation"), """
select n.n_name as ref, cast(l_partkey % 97 as int) as pos, l_orderkey as zmw,
       case when l_returnflag = 'A' then 'SNP' else 'Indel' end as type, cast(l_linenumber as int) as hp_len,
       case l_linestatus when 'O' then 'Insertion' else 'Deletion' end as indeltype
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
     join nation n on c.c_nationkey = n.n_nationkey where l_returnflag <> 'N'"""),
}

#: ``{parts}`` numbers the sub-reads of up to 200 bases that a read is cut into.
SPARK = {"replace_all": "", "text": "string", "parts": "explode(sequence(0L, cast((length(seq) - 1) div 200 as bigint)))"}
DUCKDB = {"replace_all": ", 'g'", "text": "varchar", "parts": "unnest(range(0, (length(seq) + 199) // 200))"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture as a DataFrame over the parquet tables of ``sf_dir``."""
    tables, sql = FIXTURES[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql.format(**SPARK, **{t: "{" + t + "}" for t in tables}), **frames)


def with_fixtures(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the fixtures it reads as common table expressions."""
    return "with " + ", ".join(f"{n} as ({FIXTURES[n][1].format(**DUCKDB)})" for n in names) + "\n" + sql
