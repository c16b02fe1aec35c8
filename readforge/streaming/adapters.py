"""Streams of reads: ordered results for several sinks, and children collected by parent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def map_to_sinks(rows: DataFrame, step: Callable[[DataFrame], DataFrame], sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, failed: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Each batch goes through ``step`` once and to every sink; an error is told to ``failed`` and ends the stream."""

    def batch(df: DataFrame, number: int) -> None:
        made = step(df).persist()
        try:
            for sink in sinks:
                sink(made, number)
        except Exception as e:
            if failed:
                failed(e)
            raise
        finally:
            made.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def children_by_parent(rows: DataFrame) -> DataFrame:
    """(movie, zmw, n, length) of the sub-reads seen so far, from (movie, zmw, seq); state is two numbers for each parent."""

    def own(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, length = state.get if state.exists else (0, 0)
        for pdf in pdfs:
            n, length = n + len(pdf), length + int(pdf["seq"].str.len().sum())
        state.update((n, length))
        yield pd.DataFrame([(*key, n, length)], columns=["movie", "zmw", "n", "length"])

    return rows.groupBy("movie", "zmw").applyInPandasWithState(own, "movie string, zmw long, n long, length long", "n long, length long", "update", "NoTimeout")


def pileups_to_genotypes(pileups: DataFrame) -> DataFrame:
    """Genotype frequencies of pile-ups (rname, pos, bases array<struct<base, phred>>) by expressions alone, so for streams too."""
    good = F.filter("bases", lambda b: (b["base"] < 4) & (b["phred"] > 17))
    share = lambda i: F.size(F.filter("good", lambda b: b["base"] == i)) / F.size("good")
    gaps = F.size(F.filter("bases", lambda b: b["base"] == 5)) / F.size("bases")
    status = F.when(F.col("gaps") >= 0.1, "TooManyGaps").when(F.size("good") == 0, "NoData").otherwise("GenotypeCalled")
    return pileups.select("rname", "pos", good.alias("good"), gaps.alias("gaps")).select("rname", "pos", status.alias("status"), *[F.when(F.size("good") > 0, share(i)).alias(f"f{b}") for i, b in enumerate("ACGT")])


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches and rows so far."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen)}
