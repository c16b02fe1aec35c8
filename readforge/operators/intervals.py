"""Coverage, covered intervals and range joins over half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Positions whose events one task orders; sums over such bins carry the depth on to the next.
BIN = 1 << 16


def depth_runs(intervals: DataFrame, key: str = "rname", start: str = "t_start", end: str = "t_end", width: int = BIN) -> DataFrame:
    """(key, start, end, depth) with depth above 0; no row holds a position twice.

    +1 and -1 events are summed by position before anything is ordered, so a position's intervals meet as one row.
    Only a bin's events are ordered in one task: the depth before a bin is the sum of the bins before.
    """
    valid = intervals.where(F.col(start) < F.col(end))
    events = valid.select(key, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    net = events.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0").withColumn("_bin", F.floor(F.col("pos") / width))
    bins = W.partitionBy(key).orderBy("_bin")
    sums = net.groupBy(key, "_bin").agg(F.sum("d").alias("_sum"), F.min("pos").alias("_first"))
    ahead = sums.select(key, "_bin", (F.sum("_sum").over(bins) - F.col("_sum")).alias("_before"), F.lead("_first").over(bins).alias("_next"))
    own = W.partitionBy(key, "_bin").orderBy("pos")
    placed = net.withColumns({"depth": F.sum("d").over(own), "end": F.lead("pos").over(own)}).join(ahead, [key, "_bin"])
    runs = placed.select(key, F.col("pos").alias("start"), F.coalesce("end", "_next").alias("end"), (F.col("depth") + F.col("_before")).alias("depth"))
    return runs.where("depth > 0")


def window_coverage(intervals: DataFrame, window_start: int, window_length: int, key: str = "rname", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """(key, pos, depth) for each position of the window that is covered, intervals clipped to the window."""
    lo, hi = F.lit(window_start), F.lit(window_start + window_length)
    runs = depth_runs(clipped(intervals, window_start, window_start + window_length, start, end), key, start, end)
    return runs.select(key, F.explode(F.sequence(F.greatest("start", lo), F.least("end", hi) - 1)).alias("pos"), "depth")


def clipped(intervals: DataFrame, lo: int, hi: int, start: str, end: str) -> DataFrame:
    return intervals.where((F.col(start) < hi) & (F.col(end) > lo)).withColumns({start: F.greatest(start, F.lit(lo)), end: F.least(end, F.lit(hi))})


def covered(intervals: DataFrame, least: int, key: str = "rname", start: str = "t_start", end: str = "t_end", window: tuple[int, int] | None = None) -> DataFrame:
    """(key, start, end): maximal runs with depth of at least ``least``; with 0, the whole window."""
    if window:
        if least <= 0:
            return intervals.select(key).distinct().select(key, F.lit(window[0]).cast("long").alias("start"), F.lit(window[1]).cast("long").alias("end"))
        intervals = clipped(intervals, *window, start, end)
    deep = depth_runs(intervals, key, start, end).where(F.col("depth") >= max(least, 1))
    # runs that touch cancel where they meet, so what is left are the maximal ones
    return depth_runs(deep.select(key, "start", "end"), key, "start", "end").drop("depth")


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int, left_cols: tuple[str, str], right_cols: tuple[str, str]) -> DataFrame:
    """All pairs of overlapping half-open intervals with one key, each pair once.

    Both sides are dealt to bins of ``width``; a pair counts in the bin where its overlap begins. So the join is
    an equi join on (key, bin), and an interval meets only those that share a bin with it.
    """
    ls, le = left_cols
    rs, re = right_cols

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    both = binned(left, ls, le).join(binned(right, rs, re), [key, "_bin"])
    meets = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("_bin")
    return both.where(meets & first).drop("_bin")


def hull(starts: list, ends: list) -> tuple:
    """The least interval that holds all given."""
    return F.least(*starts), F.greatest(*ends)
