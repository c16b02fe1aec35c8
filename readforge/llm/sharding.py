"""Sharding by balanced label propagation (operator 9), under the law ``rows``: shard sizes differ by one at most.

Every row starts in a shard by the order of its hash. Linked rows then move towards the shard most of their
neighbours are in, in rounds of joins, until no wish can be met. A pair of shards may swap as many rows as wish to go both ways, and a
shard may take more while its linked rows fit in its share; wishes beyond a quota wait, in hash order. So that
neighbours don't chase each other, rounds take turns: one moves rows to higher shards only, one to lower ones, and
one half of the rows, dealt by hash, any way. Rows without links fill what is left of each shard's share, which makes
the sizes even to the row.

A null text counts as empty with size 1; rows with equal texts are linked, however long. A group larger than a
shard's share is spread over several. Repeated rows are rows of their own, counted first and told apart by a number,
so that none of their groups is ranked in one task; a null doc_id stays null. An empty table gives no rows. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, read_table, text_or_empty

SHARDS = 16
#: Propagation also ends when the number of wishes hasn't been lower for so many rounds: rows that only change places.
STILL = 9


def propagate(nodes: DataFrame, links: DataFrame, room: list[int], still: int = STILL) -> DataFrame:
    """(node, shard) when no wish with a quota is left, or none of ``still`` rounds lowered the number of wishes.

    nodes: (node, shard), the linked rows; links: (a, b), each link once; room: the most linked rows a shard may hold.
    """
    shards = len(room)
    links = links.where("a <> b")
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard-links")
    fewest, since = None, 0
    for turn in count():
        votes = both.join(nodes.select(F.col("node").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("shard")).alias("low"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("all"))
        wishes = nodes.join(best, nodes["node"] == best["a"]).select("node", F.col("shard").alias("src"), (-F.col("best.low")).alias("dst"), (F.col("best.n") - F.coalesce(F.element_at("all", F.col("shard")), F.lit(0))).alias("gain"))
        now = (F.col("src") < F.col("dst"), F.col("src") > F.col("dst"), F.xxhash64("node", F.lit(turn)).bitwiseAND(F.lit(1)) == 0)[turn % 3]
        wishes = materialize(wishes.where("gain > 0 and src <> dst").select("node", "src", "dst", now.alias("now")), "shard-wishes")
        # at most shards * shards numbers
        wanted = {(r.src, r.dst): (r.n, r.now) for r in wishes.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if("now").alias("now")).collect()}
        held = {r.shard: r["count"] for r in nodes.groupBy("shard").count().collect()}
        total = sum(n for n, _ in wanted.values())
        fewest, since = (total, 0) if fewest is None or total < fewest else (fewest, since + 1)
        if since == still or not any(k[::-1] in wanted or held.get(k[1], 0) < room[k[1]] for k in wanted):
            break
        wanted = {k: now for k, (_, now) in wanted.items() if now}
        if not wanted:
            continue
        quota = {k: min(n, wanted.get(k[::-1], 0)) for k, n in wanted.items()}
        for dst in range(shards):
            more = {k: n - quota[k] for k, n in wanted.items() if k[1] == dst}
            spare, total = max(0, room[dst] - held.get(dst, 0)), sum(more.values())
            for k, n in more.items():
                quota[k] += n if total <= spare else n * spare // total
        allowed = nodes.sparkSession.createDataFrame([(*k, n) for k, n in quota.items()], "src int, dst int, quota long")
        moves = wishes.where("now").drop("now")
        if any(quota[k] < n for k, n in wanted.items()):
            waiting = ranked(moves, ["src", "dst"], F.xxhash64("node", F.lit(-1 - turn)), "place")
            moves = waiting.join(F.broadcast(allowed), ["src", "dst"]).where("place < quota")
        nodes = materialize(nodes.join(moves.select("node", "dst"), "node", "left").select("node", F.coalesce("dst", "shard").alias("shard")), "shard-nodes")
    return nodes


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    same = ["doc_id", "size", "text_crc32", "text_hash"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = materialize(rows, "shard-rows")
    numbered = materialize(ranked(rows, [], F.xxhash64("doc_id", "text_hash", "copy"), "node"), "shard-numbered")
    total = numbered.count()
    share = [total // shards + (i < total % shards) for i in range(shards)]
    same = ["text_hash", "text_crc32", "size"]
    # a table of its own, so that the join below has two plain shuffles and Spark can split that of a large group
    groups = materialize(numbered.groupBy(*same).agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "shard-groups")
    linked = materialize(numbered.join(groups, same).select("node", "hub"), "shard-linked")
    nodes = linked.select("node", (F.col("node") % shards).cast("int").alias("shard"))
    placed = propagate(nodes, linked.select(F.col("node").alias("a"), F.col("hub").alias("b")), share)
    held = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    alone = ranked(numbered.join(linked, "node", "left_anti"), [], F.xxhash64("node", F.lit(0)), "place")
    ends, upto = [], 0
    for i in range(shards):
        upto += share[i] - held.get(i, 0)
        ends.append(upto)
    fill = F.lit(shards - 1)
    for i in reversed(range(shards - 1)):
        fill = F.when(F.col("place") < ends[i], i).otherwise(fill)
    whole = numbered.join(placed, "node").unionByName(alone.withColumn("shard", fill.cast("int")).drop("place"))
    whole = materialize(whole.select("doc_id", "size", "text_crc32", "shard", "node"), "shard-placed")
    return ranked(whole, ["shard"], F.xxhash64("node", F.lit(1)), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_label_propagation_sharding(spark, sf_dir):
    placed = shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
