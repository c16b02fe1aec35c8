"""Genotypes and consensus from piled-up bases (0..5 = A, C, G, T, N, -)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGTN-"
N, GAP = 4, 5
MOST_GAPS, LEAST_QUALITY = 0.1, 17

_KEY = ["rname", "pos"]


def gap_fractions(bases: DataFrame) -> DataFrame:
    return bases.groupBy(*_KEY).agg(F.coalesce(F.avg((F.col("base") == GAP).cast("double")), F.lit(0.0)).alias("gap_fraction"), F.count("*").alias("depth"))


def base_counts(bases: DataFrame) -> DataFrame:
    """(rname, pos, n, nA, nC, nG, nT) of the bases that count: no N, no gap, quality above 17."""
    good = (F.col("base") < N) & (F.col("phred") > LEAST_QUALITY)
    count = lambda b: F.count_if(good & (F.col("base") == b))
    return bases.groupBy(*_KEY).agg(F.count_if(good).alias("n"), *[count(i).alias(f"n{BASES[i]}") for i in range(4)])


def genotypes(bases: DataFrame) -> DataFrame:
    """(rname, pos, status, genotype, fA, fC, fG, fT), by one aggregation of the pile-up.

    A position without a usable base keeps its place, with status NoData. Of equal frequencies the first base wins.
    """
    good = (F.col("base") < N) & (F.col("phred") > LEAST_QUALITY)
    per = bases.groupBy(*_KEY).agg(F.avg((F.col("base") == GAP).cast("double")).alias("gaps"), F.count_if(good).alias("n"), *[F.count_if(good & (F.col("base") == i)).alias(f"n{BASES[i]}") for i in range(4)])
    status = F.when(F.col("gaps") >= MOST_GAPS, "TooManyGaps").when(F.col("n") == 0, "NoData").otherwise("GenotypeCalled")
    most = F.greatest(*[f"n{b}" for b in "ACGT"])
    first = F.coalesce(*[F.when(F.col(f"n{b}") == most, b) for b in "ACGT"])
    called = F.col("status") == "GenotypeCalled"
    out = per.withColumn("status", status)
    return out.select(*_KEY, "status", F.when(called, first).alias("genotype"), *[F.when(called, F.col(f"n{b}") / F.col("n")).alias(f"f{b}") for b in "ACGT"])


def em_frequencies(bases: np.ndarray, phred: np.ndarray, counts: np.ndarray | None = None, tolerance: float = 1e-3, most_rounds: int = 1000) -> tuple[np.ndarray, int]:
    """Allele frequencies that take base qualities into account, by expectation maximisation; counts: how often each (base, phred) is there."""
    counts = np.ones(len(bases)) if counts is None else counts
    error = 10.0 ** (-phred / 10)
    given = np.where(bases[:, None] == np.arange(4)[None, :], (1 - error)[:, None], (error / 3)[:, None])
    theta = np.bincount(bases, counts, 4)[:4] / counts.sum()
    before, rounds = -np.inf, 0
    while rounds < most_rounds:
        joint = theta * given
        total = joint.sum(axis=1)
        now = float(counts @ np.log(total))
        rounds += 1
        theta = counts @ (joint / total[:, None]) / counts.sum()
        if now - before <= tolerance:
            break
        before = now
    return theta, rounds


def refined_genotypes(bases: DataFrame) -> DataFrame:
    """(rname, pos, eA, eC, eG, eT, rounds) of the positions that are called, refined where two bases were seen.

    Equal bases of one quality are counted first, so a position is a few hundred rows however deep its pile-up is.
    """
    called = genotypes(bases).where("status = 'GenotypeCalled'").select(*_KEY)
    good = bases.where((F.col("base") < N) & (F.col("phred") > LEAST_QUALITY)).groupBy(*_KEY, "base", "phred").agg(F.count("*").alias("n")).join(called, _KEY, "left_semi")

    def refine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["base", "phred"])
        b, q, n = pdf["base"].to_numpy(), pdf["phred"].to_numpy(float), pdf["n"].to_numpy(float)
        theta, rounds = (np.bincount(b, n, 4)[:4] / n.sum(), 0) if len(set(b)) == 1 else em_frequencies(b, q, n)
        return pd.DataFrame([[*key, *map(float, theta), rounds]], columns=[*_KEY, "eA", "eC", "eG", "eT", "rounds"])

    return good.groupBy(*_KEY).applyInPandas(refine, "rname string, pos int, eA double, eC double, eG double, eT double, rounds int")


def majority(bases: DataFrame) -> DataFrame:
    """(rname, pos, consensus): the most frequent sign, the first in base order if several are."""
    counts = bases.groupBy(*_KEY, "base").agg(F.count("*").alias("n"))
    return counts.groupBy(*_KEY).agg(F.max_by("base", F.struct("n", -F.col("base"))).alias("b")).select(*_KEY, F.substring(F.lit(BASES), F.col("b") + 1, F.lit(1)).alias("consensus"))


def indel_frequencies(alleles: DataFrame) -> DataFrame:
    """(rname, pos, allele, frequency, is_first) from (rname, pos, allele): shares, and the most frequent allele."""
    from pyspark.sql import Window as W

    counts = alleles.groupBy(*_KEY, "allele").agg(F.count("*").alias("n"))
    own = W.partitionBy(*_KEY)
    return counts.select(*_KEY, "allele", (F.col("n") / F.sum("n").over(own)).alias("frequency"), (F.row_number().over(own.orderBy(F.desc("n"), "allele")) == 1).alias("is_first"))


#: Ambiguous protein residues and what they stand for.
AMBIGUOUS = {"B": "DN", "J": "IL", "Z": "EQ"}


def ambiguous_consensus(column: list[str]) -> str:
    """The residue that stands for all of a column: itself, an ambiguity code, or X."""
    whole = set().union(*(set(AMBIGUOUS.get(c, c)) for c in column)) if column else set()
    if len(whole) == 1:
        return whole.pop()
    codes = {frozenset(v): k for k, v in AMBIGUOUS.items()}
    return codes.get(frozenset(whole), "X")


def ambiguous_residue(residues: Column) -> Column:
    """The same for an array column."""
    whole = F.array_sort(F.array_distinct(F.flatten(F.transform(residues, lambda c: F.coalesce(*[F.when(c == k, F.array(*[F.lit(x) for x in v])) for k, v in AMBIGUOUS.items()], F.array(c))))))
    text = F.array_join(whole, "")
    return F.coalesce(F.when(F.size(whole) == 1, text), *[F.when(text == "".join(sorted(v)), k) for k, v in AMBIGUOUS.items()], F.lit("X"))


def batches_of_pileups(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pile-ups as they stream in, each with its majority sign; no state is kept between batches."""
    for pdf in rows:
        yield pdf.assign(consensus=[BASES[np.bincount(b).argmax()] if len(b) else None for b in pdf["bases"]])
