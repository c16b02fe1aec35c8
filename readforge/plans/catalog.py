"""Every query of the engine by name, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readforge.functions.fixtures import fixture

from . import genomics, kernels, report, scalars  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query, query

FLAGSHIP_SQL = """
select num_passes, reference, round(rate, 9) as error_rate, case when rate > 0 then round(-10 * log10(rate), 6) end as phred
from (select num_passes, reference, avg(num_errors::double / length) as rate from read_report
      where reference is not null and reference <> 'SmrtBellSequence' and length > 0 group by num_passes, reference)"""


@query("error_rate_by_passes", FLAGSHIP_SQL, ("read_report",))
def error_rate(spark: SparkSession, sf_dir: str, report: DataFrame) -> DataFrame:
    """Mean error rate and its Phred value by pass count and reference."""
    rows = report.where("reference is not null and reference <> 'SmrtBellSequence' and length > 0")
    rate = rows.groupBy("num_passes", "reference").agg(F.avg(F.col("num_errors") / F.col("length")).alias("rate"))
    return rate.select("num_passes", "reference", F.round("rate", 9).alias("error_rate"), F.when(F.col("rate") > 0, F.round(-10 * F.log10("rate"), 6)).alias("phred"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rate(spark, sf_dir, fixture(spark, sf_dir, "read_report"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
