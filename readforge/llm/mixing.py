"""Mixing sources to target weights by Pareto order sampling (operator 8), in DataFrame operations only.

A source's target words follow from its weight, at most ``most`` times its size, the excess reshared by
weight. A document should be taken ``rate = target / size of the source`` times (times its own weight, if a
weight column is given). Its whole copies, ``floor(rate)``, are certain; the fraction left is its inclusion
probability ``p``. Documents are ranked by the Pareto value ``(u / (1 - u)) / (p / (1 - p))`` with a random
``u``, the odds of ``u`` over the odds of inclusion, and taken from the smallest on until the words still
missing are reached: a sample of fixed size, in words. The last document is the one nearest to the target.

``u`` is a hash of seed, doc_id and text, so reruns agree, and repeated rows share one fate. Null text has
size 0; null source is a source of its own, ordered last. Sources of size 0 have target 0. An empty table
gives an empty result. Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, read_table, text_or_empty

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 8
#: Sources up to which their plan, one row of numbers each, is broadcast instead of joined by a shuffle.
MOST_BROADCAST = 20_000


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def uniform(seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 from the row's id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_or_empty()).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling without a loop: in ascending order of cap over weight, a source is full if its fair share of
    what the ones before leave is at least its cap; the full ones come first, and the others share the rest.
    """
    kinds = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("_w", kinds.cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    filled = ranked.withColumns({
        "_left": F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0)),
        "_weights": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(ahead), F.lit(0)),
    }).withColumn("_full", F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_weights"))
    rest = filled.withColumns({
        "_open": F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0)),
        "_open_w": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole), F.lit(0)),
    })
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_open").cast("double") * F.col("_w") / F.col("_open_w"))
    return rest.select("source", "source_size", target.alias("target"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int, per_bucket: int) -> DataFrame:
    """For each source: size, target, rate, mean weight and the Pareto value up to which documents are taken once more.

    Only the bucket of ranks in which a source's sample ends is looked at row by row; buckets hold about
    ``per_bucket`` rows of the source, so a hot source is no larger a task than any other.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("_weighted"), F.count("*").alias("_n"))
    plan = materialize(targets(sums.select("source", "source_size"), weights, most).alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "_weighted", "_n"), "mix-targets")
    known = _with_rate(rows, plan, most).withColumn("_bucket", F.floor(F.col("rank") * F.ceil(F.col("_n") / per_bucket)).cast("long"))
    known = materialize(known.select("source", "size", "copies", "xi", "_bucket", "target"), "mix-ranks")
    buckets = known.groupBy("source", "_bucket").agg(F.sum(F.when(F.col("xi").isNotNull(), F.col("size")).otherwise(0)).alias("_words"), F.sum(F.col("size") * F.col("copies")).alias("_certain"), F.max("target").alias("target"))
    ordered = W.partitionBy("source").orderBy("_bucket")
    ends = buckets.withColumns({
        "_missing": F.col("target") - F.sum("_certain").over(W.partitionBy("source")),
        "_before": F.coalesce(F.sum("_words").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    }).where(F.col("_missing") > 0).where((F.col("_before") < F.col("_missing")) & (F.col("_before") + F.col("_words") > 0))
    last = ends.groupBy("source").agg(F.max_by(F.struct("_bucket", "_before", "_missing"), "_bucket").alias("e")).select("source", "e.*")
    inside = known.alias("k").join(last.alias("l"), F.col("k.source").eqNullSafe(F.col("l.source")) & (F.col("k._bucket") == F.col("l._bucket"))).where("xi is not null").select("k.source", "size", "xi", "_before", "_missing", "k._bucket")
    running = W.partitionBy("source").orderBy("xi").rangeBetween(W.unboundedPreceding, W.currentRow)
    taken = inside.groupBy("source", "xi").agg(F.sum("size").alias("size"), F.max("_before").alias("_before"), F.max("_missing").alias("_missing")).withColumn("_to", F.col("_before") + F.sum("size").over(running))
    cut = taken.groupBy("source").agg(F.max(F.when(F.col("_to") - F.col("size") / 2 <= F.col("_missing"), F.col("xi"))).alias("_in"), F.min("xi").alias("_first"))
    # no document of the last bucket fits: everything below its first one is taken
    return materialize(plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "_in", "_first"), "mix-plan")


def _with_rate(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    if plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("r.*", *[F.col(f"p.{c}") for c in plan.columns if c != "source"])
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    own = F.least(F.lit(float(most)), F.when(F.col("_weighted") == 0, F.lit(0.0)).otherwise(F.col("_rate") * F.col("weight") * F.col("source_size") / F.col("_weighted")))
    joined = joined.withColumn("_rate", rate).withColumn("_own", own).withColumn("copies", F.floor("_own").cast("long"))
    p, mean = F.col("_own") - F.col("copies"), F.col("_rate") - F.floor("_rate")
    odds = F.col("u") / (1 - F.col("u"))
    joined = joined.withColumn("xi", F.when(p > 0, odds / (p / (1 - p))))
    # xi read as a number in [0, 1) that is spread evenly where a source has one probability
    spread = F.col("xi") * F.when(mean > 0, mean / (1 - mean)).otherwise(1.0)
    return joined.withColumn("rank", F.coalesce(spread / (1 + spread), F.lit(0.0)))


def _copies(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    joined = _with_rate(rows, plan, most)
    more = F.when(F.col("_in").isNotNull(), F.col("xi") <= F.col("_in")).otherwise(F.col("xi") < F.col("_first"))
    return joined.withColumn("copies", F.col("copies") + F.when(more, 1).otherwise(0))


def _rows(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), uniform(seed).alias("u"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: Column | None = None, per_bucket: int = 5_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row."""
    rows = materialize(_rows(docs, seed, weight), "mix-rows")
    return _copies(rows, _plan(rows, weights, most, per_bucket), most).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, per_bucket: int = 5_000) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns as they were.

    The plan has one row for each source, so documents are read once more and never shuffled for it.
    """
    rows = materialize(_rows(docs, seed, None), "mix-rows")
    plan = _plan(rows, weights, most, per_bucket)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    low = [c.lower() for c in docs.columns]
    own = docs.toDF(*names)
    doc_id, text, source = (own[names[low.index(c)]] for c in ("doc_id", "text", "source"))
    full = own.withColumns({"doc_id": doc_id, "text": text, "source": source.cast("string"), "weight": F.lit(1.0)}).withColumn("u", uniform(seed)).drop("doc_id", "text")
    counted = _copies(full, plan, most)
    return counted.where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)


def op8_pareto_mixing(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rk FROM s),
w AS (SELECT *, rk % 3 + 1 AS w, source_size * 3 AS cap FROM k),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM w),
g AS (SELECT *, lft * w >= cap * lw AS is_full FROM f),
h AS (SELECT *, sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS op, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 0) AS ow FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE op::DOUBLE * w / ow END AS target FROM h),
p AS (SELECT r.doc_id, r.source, r.size, r.u, t.source_size, t.target, least(3.0::DOUBLE, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END) AS rate
    FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(rate) AS c, CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS xi FROM p),
m AS (SELECT *, target - sum(size * c) OVER (PARTITION BY source) AS missing, sum(CASE WHEN xi IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY xi NULLS LAST) AS upto,
    sum(size) OVER (PARTITION BY source, xi) AS tied FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (c + CASE WHEN xi IS NOT NULL AND missing > 0 AND upto - tied / 2.0 <= missing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
