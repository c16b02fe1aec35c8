"""De Bruijn graphs, contigs, scaffolds and guide trees as joins over node and edge tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readforge.functions.columns import complement, kmers, reverse_complement
from readforge.operators.kmers import kmer_counts


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``; a temporary one where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/readforge/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kmer_nodes(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n): how often each k-mer occurs."""
    return kmer_counts(reads, k)


def de_bruijn_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, same_orientation): k-mers that overlap in k - 1 bases, on one strand or across strands."""
    ends = nodes.select(F.col("kmer").alias("src"), F.expr("substring(kmer, 2)").alias("join"))
    starts = nodes.select(F.col("kmer").alias("dst"), F.expr("substring(kmer, 1, length(kmer) - 1)").alias("join"))
    other = nodes.select(F.col("kmer").alias("dst"), F.expr("substring(kmer, 2)").alias("tail")).select("dst", reverse_complement(F.col("tail")).alias("join"))
    same = ends.join(starts, "join").select("src", "dst", F.lit(True).alias("same_orientation"))
    return same.unionByName(ends.join(other, "join").where("src <> dst").select("src", "dst", F.lit(False).alias("same_orientation")))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the ``gone`` nodes (column kmer)."""
    return edges.join(gone.select(F.col("kmer").alias("src")), "src", "left_anti").join(gone.select(F.col("kmer").alias("dst")), "dst", "left_anti").select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])


def _weak_chains(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(kmer, unit, place): nodes seen less than ``least`` times that follow each other without a branch share a unit."""
    weak = nodes.where(F.col("n") < least).select("kmer")
    inside = unambiguous(edges).join(weak.select(F.col("kmer").alias("src")), "src", "left_semi").join(weak.select(F.col("kmer").alias("dst")), "dst", "left_semi")
    return path_places(inside, weak).select("kmer", F.col("head").alias("unit"), "place")


def erode(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Take away nodes seen less than ``least`` times from the ends of paths, until none is left at an end.

    A weak path without a branch goes as a whole as soon as one of its ends is open, so such paths are found first, by
    pointer doubling, and go in one step each; what branched before may then be a path of its own. A circle of weak
    nodes has no end and stays.
    """
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    while True:
        units = cut_lineage(_weak_chains(nodes, edges, least))
        named = lambda c: units.select(F.col("kmer").alias(c), F.col("unit").alias(f"{c}_unit"), F.col("place").alias(f"{c}_place"))  # noqa: E731, B023
        links = edges.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
        inside = (F.col("src_unit") == F.col("dst_unit")) & (F.col("dst_place") == F.col("src_place") + 1)  # a link back makes a circle
        links = links.where(~F.coalesce(inside, F.lit(False))).select(F.coalesce("src_unit", "src").alias("src"), F.coalesce("dst_unit", "dst").alias("dst"))
        links = cut_lineage(links.distinct())
        weak, gone = units.select("unit").distinct(), None
        for _ in range(ERODED_AT_ONCE):
            inner = links.select(F.col("src").alias("unit")).distinct().join(links.select(F.col("dst").alias("unit")).distinct(), "unit", "left_semi")
            open_ = cut_lineage(weak.join(inner, "unit", "left_anti"))
            if open_.isEmpty():
                break
            weak = cut_lineage(weak.join(open_, "unit", "left_anti"))
            links = cut_lineage(links.join(open_.select(F.col("unit").alias("src")), "src", "left_anti").join(open_.select(F.col("unit").alias("dst")), "dst", "left_anti"))
            gone = open_ if gone is None else gone.unionByName(open_)
        if gone is None:
            return nodes, edges
        lost = cut_lineage(units.join(gone, "unit", "left_semi").select("kmer"))
        nodes, edges = cut_lineage(nodes.join(lost, "kmer", "left_anti")), cut_lineage(without_nodes(edges, lost))


#: Steps before paths are looked for again.
ERODED_AT_ONCE = 6


def unambiguous(edges: DataFrame) -> DataFrame:
    """Edges whose source has one way out and whose target one way in."""
    one_out = edges.groupBy("src").agg(F.count("*").alias("o")).where("o = 1").select("src")
    one_in = edges.groupBy("dst").agg(F.count("*").alias("i")).where("i = 1").select("dst")
    return edges.join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").where("src <> dst").select("src", "dst")


def path_places(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kmer, head, place): for each node the first node of its path and its distance from there.

    Pointer doubling: in each round a node learns the node twice as far back, so a path of n nodes takes log n
    joins. Nodes on circles have no head and are left out.
    """
    back = nodes.select("kmer").join(links.select(F.col("dst").alias("kmer"), F.col("src").alias("up")), "kmer", "left")
    state = cut_lineage(back.select("kmer", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.coalesce("up", "kmer").alias("far")))
    for _ in range(max(1, state.count().bit_length()) + 1):
        if state.where("up is not null").isEmpty():
            break
        far = state.select(F.col("kmer").alias("up"), F.col("up").alias("_up"), F.col("place").alias("_place"), F.col("far").alias("_far"))
        grown = state.where("up is not null").join(far, "up").select("kmer", F.col("_up").alias("up"), (F.col("place") + F.col("_place")).alias("place"), F.col("_far").alias("far"))
        state = cut_lineage(state.where("up is null").unionByName(grown))
    return state.where("up is null").select("kmer", F.col("far").alias("head"), "place")


def contigs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(head, seq, n_kmers, coverage): sequences of the unambiguous paths."""
    places = path_places(unambiguous(edges.where("same_orientation") if "same_orientation" in edges.columns else edges), nodes)
    placed = places.join(nodes, "kmer")
    path = placed.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "kmer"))).alias("p"), F.avg("n").alias("coverage"))
    return path.select("head", F.concat("head", F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: F.right(x["kmer"], F.lit(1))), "")).alias("seq"), F.size("p").alias("n_kmers"), "coverage")


def without_low_coverage(built: DataFrame, least: float) -> DataFrame:
    return built.where(F.col("coverage") >= least)


def without_tips(built: DataFrame, edges: DataFrame, most_kmers: int) -> DataFrame:
    """Drop short contigs that dangle: nothing leads on from their last node or into their first."""
    k = F.length("head")
    ends = built.withColumn("last", F.expr("right(seq, length(head))"))
    open_end = ends.join(edges.select(F.col("src").alias("last")).distinct(), "last", "left_anti").select("head")
    open_start = ends.join(edges.select(F.col("dst").alias("head")).distinct(), "head", "left_anti").select("head")
    tips = ends.where(F.col("n_kmers") <= most_kmers).join(open_end.union(open_start).distinct(), "head", "left_semi").where(F.length("seq") >= k).select("head")
    return built.join(tips, "head", "left_anti")


def redundant_paths(built: DataFrame, k: int) -> DataFrame:
    """(head): of parallel paths with the same neighbours on both sides all but the best covered one."""
    own = W.partitionBy(F.expr(f"substring(seq, 1, {k - 1})"), F.expr(f"right(seq, {k - 1})")).orderBy(F.desc("coverage"), "head")
    return built.withColumn("_r", F.row_number().over(own)).where("_r > 1").select("head")


def read_contig_map(reads: DataFrame, built: DataFrame, k: int) -> DataFrame:
    """(id, head, offset, shared, overlap): reads (id, seq) on contigs, Full if all their k-mers are there."""
    own = reads.select("id", F.length("seq").alias("size"), F.posexplode(kmers(F.col("seq"), k)).alias("r", "kmer"))
    there = built.select("head", F.posexplode(kmers(F.col("seq"), k)).alias("c", "kmer"))
    hits = own.join(there, "kmer").groupBy("id", "size", "head", (F.col("c") - F.col("r")).alias("offset")).agg(F.count("*").alias("shared"))
    return hits.select("id", "head", "offset", "shared", F.when(F.col("shared") == F.col("size") - k + 1, "FullOverlap").otherwise("PartialOverlap").alias("overlap"))


def mate_links(placed: DataFrame, mates: DataFrame, redundancy: int = 2) -> DataFrame:
    """(from_contig, to_contig, n, mean, sd) from places (id, head, offset) and mates (a, b, insert): contigs linked often enough."""
    a = placed.select(F.col("id").alias("a"), F.col("head").alias("from_contig"), F.col("offset").alias("pa"))
    b = placed.select(F.col("id").alias("b"), F.col("head").alias("to_contig"), F.col("offset").alias("pb"))
    gaps = mates.join(a, "a").join(b, "b").where("from_contig <> to_contig").withColumn("gap", F.col("insert") - F.abs(F.col("pb") - F.col("pa")))
    return gaps.groupBy("from_contig", "to_contig").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("sd")).where(F.col("n") >= redundancy)


def scaffold_paths(links: DataFrame, depth: int = 10) -> DataFrame:
    """(path): all paths of up to ``depth`` links from contigs nothing leads to; breadth first, one join for each level."""
    links = links.select("from_contig", "to_contig").distinct()
    level = links.join(links.select(F.col("to_contig").alias("from_contig")), "from_contig", "left_anti").select(F.array("from_contig", "to_contig").alias("path"))
    done = None
    for _ in range(depth - 1):
        level = cut_lineage(level)
        more = level.join(links, F.element_at("path", -1) == links["from_contig"], "left")
        grows = F.col("to_contig").isNotNull() & ~F.array_contains("path", F.col("to_contig"))
        ended = more.where(~grows | F.col("to_contig").isNull()).select("path").distinct()
        done = ended if done is None else done.unionByName(ended)
        level = more.where(grows).select(F.concat("path", F.array("to_contig")).alias("path"))
        if level.isEmpty():
            break
    out = level if done is None else done.unionByName(level)
    return out.distinct()


def without_contained(paths: DataFrame) -> DataFrame:
    """Drop paths that are part of another one; they meet on the contigs they share."""
    text = paths.select("path", F.concat(F.lit(","), F.array_join("path", ","), F.lit(",")).alias("t"))
    own = text.select("path", "t", F.element_at("path", 1).alias("c"))
    other = text.select(F.col("t").alias("t2"), F.explode("path").alias("c"))
    inside = own.join(other, "c").where((F.col("t") != F.col("t2")) & F.contains("t2", "t")).select("t").distinct()
    return text.join(inside, "t", "left_anti").select("path")


def scaffold_sequence(pieces: DataFrame, k: int) -> DataFrame:
    """(path_id, seq) from (path_id, place, seq, forward): pieces joined without the k - 1 bases they share."""
    own = F.when(F.col("forward"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    listed = pieces.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("place", own.alias("s")))).alias("p"))
    return listed.select("path_id", F.concat(F.col("p")[0]["s"], F.array_join(F.transform(F.slice("p", 2, 1 << 30), lambda x: F.substring(x["s"], k, 1 << 30)), "")).alias("seq"))


# ---- guide trees


def linkage(method: str):
    """How the distance of a merged cluster follows from those of its parts."""
    return {
        "single": min,
        "complete": max,
        "average": lambda a, b: (a + b) / 2,
        "mafft": lambda a, b: 0.9 * min(a, b) + 0.1 * (a + b) / 2,
    }[method]


def guide_tree(distances: list[list[float]], method: str = "average") -> list[tuple[int, int, float]]:
    """(child, parent, length) of a tree over the leaves 0..n-1; the closest pair is merged first, ties by number."""
    join = linkage(method)
    n = len(distances)
    d = {(i, j): distances[i][j] for i in range(n) for j in range(i)}
    live, height, edges, new = list(range(n)), dict.fromkeys(range(n), 0.0), [], n
    get = lambda a, b: d[max(a, b), min(a, b)]
    while len(live) > 1:
        a, b = min(((i, j) for x, i in enumerate(live) for j in live[:x]), key=lambda p: (get(*p), p))
        height[new] = get(a, b) / 2
        edges += [(c, new, height[new] - height[c]) for c in sorted((a, b))]
        for c in live:
            if c not in (a, b):
                d[new, c] = join(get(a, c), get(b, c))
        live = [c for c in live if c not in (a, b)] + [new]
        new += 1
    return edges


def sequence_weights(edges: DataFrame) -> DataFrame:
    """(leaf, weight) from tree edges (child, parent, length): path length to the root over the mean, reciprocal.

    Pointer doubling: a node learns the length to the node twice as far up in each round, so trees of any depth end
    after its logarithm. An edge list with a circle has no root there; that is an error.
    """
    state = cut_lineage(edges.select("child", F.col("parent").alias("up"), F.col("length").cast("double").alias("length")))
    for _ in range(state.count().bit_length() + 1):
        far = state.select(F.col("child").alias("up"), F.col("up").alias("_up"), F.col("length").alias("_length"))
        state = cut_lineage(state.join(far, "up", "left").select("child", F.coalesce("_up", "up").alias("up"), (F.col("length") + F.coalesce("_length", F.lit(0.0))).alias("length"), F.col("_up").isNotNull().alias("_open")))
        if state.where("_open").isEmpty():
            break
        state = state.drop("_open")
    else:
        raise ValueError("the edges hold a circle")
    leaves = state.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_anti")
    mean = leaves.agg(F.avg("length").alias("mean"))
    return leaves.join(F.broadcast(mean)).select(F.col("child").alias("leaf"), (F.col("mean") / F.col("length")).alias("weight"))


# ---- assembly by overlaps


#: How a sequence may lie: as it is, or its reverse complement; without a known direction also reversed or complemented.
TURNED = {"+": lambda s: s, "-": reverse_complement, "r": F.reverse, "c": complement}


def _least_pieces(seqs: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces of ``size`` letters of each sequence, a row each, the largest number behind the last; and the lengths."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    width = int(sizes.max(initial=size))
    letters = np.frombuffer("".join(s.ljust(width, "\0") for s in seqs).encode("utf-32-le"), np.uint32).reshape(len(seqs), width).astype(np.uint64)
    out, n, unit, done = np.zeros((len(seqs), width), np.uint64), 0, letters + np.uint64(1), 1
    while True:  # of 1, 2, 4, ... letters, put together as size has them
        if size & done:
            out[:, : width - n] = out[:, : width - n] * np.uint64(pow(BASE, done, 1 << 64)) + unit[:, n:]
            n += done
        if 2 * done > size:
            break
        unit[:, :-done] = unit[:, :-done] * np.uint64(pow(BASE, done, 1 << 64)) + unit[:, done:]
        done *= 2
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(32)) >> np.uint64(1)
    out = out[:, : width - size + 1].astype(np.int64)
    out[np.arange(out.shape[1]) > (sizes - size)[:, None]] = np.iinfo(np.int64).max
    return out, sizes


BASE = 0x9E3779B97F4A7C15
#: Letters that are hashed at once, with those that shorter sequences are filled up to, but for a longer sequence alone.
AT_ONCE = 1 << 18


def _hashed(rows: DataFrame, of: Callable[[list[str]], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """The columns of ``rows`` but its last, a sequence, with what ``of`` finds for it: row numbers and columns of ``schema``."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, lo = batch.column(batch.num_columns - 1).to_pylist(), 0
            while lo < len(seqs):
                hi, most = lo + 1, len(seqs[lo])
                while hi < len(seqs) and (hi + 1 - lo) * (most := max(most, len(seqs[hi]))) <= AT_ONCE:
                    hi += 1
                part, now, lo = batch.slice(lo, hi - lo), seqs[lo:hi], hi
                at, found = of(now)
                kept = part.select(range(part.num_columns - 1)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, found.values())], names=[*kept.schema.names, *found])

    return rows.mapInArrow(own, ", ".join([*(f"{n} {t}" for n, t in rows.dtypes[:-1]), schema]))


def _beginnings(seqs: list[str], least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For beginnings of every length from ``least``: the first of their least pieces, how far in it stands, and the lengths that have it."""
    size = max(1, least // 2)
    h, sizes = _least_pieces(seqs, size)
    low = np.minimum.accumulate(h, axis=1)
    new = np.ones(h.shape, bool)
    new[:, 1:] = h[:, 1:] < low[:, :-1]
    new &= np.arange(h.shape[1]) <= (sizes - size)[:, None]
    row, at = np.nonzero(new)
    last = np.append(row[1:] != row[:-1], True)
    upto = np.where(last, sizes[row], np.append(at[1:], 0) + size - 1)
    from_ = np.maximum(least, at + size)
    kept = from_ <= upto
    return row[kept], {"key": h[row, at][kept], "at": at[kept].astype(np.int32), "lo": from_[kept].astype(np.int32), "hi": upto[kept].astype(np.int32)}


def _ends(seqs: list[str], least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The same for ends shorter than the whole; how far from the end the piece begins."""
    size = max(1, least // 2)
    h, sizes = _least_pieces(seqs, size)
    low = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1]
    new = h == low
    new &= np.arange(h.shape[1]) <= (sizes - size)[:, None]
    row, at = np.nonzero(new)
    first = np.append(True, row[1:] != row[:-1])
    upto = np.where(first, sizes[row] - 1, sizes[row] - np.append(0, at[:-1]) - 1)
    from_ = np.maximum(least, sizes[row] - at)
    kept = from_ <= upto
    return row[kept], {"key": h[row, at][kept], "at": (sizes[row] - at)[kept].astype(np.int32), "lo": from_[kept].astype(np.int32), "hi": upto[kept].astype(np.int32)}


def _windows_least(seqs: list[str], k: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The least pieces of all windows of ``k`` letters, those of neighbours once."""
    size = max(1, k // 2)
    h, sizes = _least_pieces(seqs, size)
    n, done = k - size + 1, 1
    while done < n:  # of the next 2, 4, ... pieces
        step = min(done, n - done)
        h[:, :-step] = np.minimum(h[:, :-step], h[:, step:])
        done += step
    new = np.ones(h.shape, bool)
    new[:, 1:] = h[:, 1:] != h[:, :-1]
    new &= np.arange(h.shape[1]) <= (sizes - k)[:, None]
    row, at = np.nonzero(new)
    return row, {"key": h[row, at]}


def _turned(turn: Column, seq: Column) -> Column:
    return F.coalesce(*[F.when(turn == t, TURNED[t](seq)) for t in TURNED])


def best_overlaps(reads: DataFrame, least: int, standard: bool = True) -> DataFrame:
    """(src, dst, overlap): the end of ``src`` is the beginning of ``dst`` in ``least`` bases or more, each the other's longest.

    Nodes are (id, turn). What two share has one least piece of half of ``least`` letters, the first if it is there more than once. The end of
    one and the beginning of the other know it for each length without knowing each other, and for all lengths there are a few such pieces.
    They meet on its hash, where it stands gives the length, and only then the letters are compared.
    Of equally long overlaps that with the smaller id counts, then the same turn, which keeps both strands alike.
    """
    turns = ["+", "-"] if standard else list(TURNED)
    own = reads.where(F.length("seq") >= least).select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), TURNED[t](F.col("seq")).alias("seq")) for t in turns])).alias("x")).select("id", "x.*")
    schema = "key long, at int, lo int, hi int"
    begins = _hashed(own, lambda x: _beginnings(x, least), schema).select("key", F.struct("id", "turn").alias("dst"), F.col("at").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    # the whole is left out: a sequence that another begins with is contained in it
    ends = _hashed(own, lambda x: _ends(x, least), schema).select("key", F.struct("id", "turn").alias("src"), "at", "lo", "hi")
    n = F.col("at") + F.col("b")
    met = ends.join(begins, "key").where((F.col("src.id") != F.col("dst.id")) & (n >= F.greatest("lo", "b_lo")) & (n <= F.least("hi", "b_hi"))).select("src", "dst", n.alias("overlap"))
    seqs = reads.select("id", "seq")
    end = F.expr("right(_s, overlap)")
    shared = met.join(seqs, F.col("src.id") == seqs["id"]).withColumn("_s", _turned(F.col("src.turn"), F.col("seq"))).select("src", "dst", "overlap", end.alias("end"))
    equal = shared.join(seqs, F.col("dst.id") == seqs["id"]).where(F.startswith(_turned(F.col("dst.turn"), F.col("seq")), F.col("end")))
    found = equal.groupBy("src", "dst").agg(F.max("overlap").alias("overlap"))
    alike = (F.col("src.turn") != F.col("dst.turn")).cast("int")
    rank = lambda other: F.struct(-F.col("overlap"), F.col(f"{other}.id"), alike)
    found = cut_lineage(found)
    out = found.groupBy("src").agg(F.min_by("dst", rank("dst")).alias("dst"))
    into = found.groupBy("dst").agg(F.min_by("src", rank("src")).alias("src"))
    return found.join(out, ["src", "dst"], "left_semi").join(into, ["src", "dst"], "left_semi")


def without_contained_reads(reads: DataFrame, k: int, standard: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): equal sequences once, by the smallest id, and none that lies inside another; gone: (id, container).

    Where one lies in another, a window of that has the same least piece as its own first ``k`` letters; they meet on its hash.
    """
    turns = ["+", "-"] if standard else list(TURNED)
    forms = F.array(*[TURNED[t](F.col("seq")) for t in turns])
    equal = reads.select("id", "seq", F.array_min(forms).alias("form"))
    first = equal.groupBy("form").agg(F.min("id").alias("container"))
    copies = equal.join(first.withColumnRenamed("form", "_form"), F.expr("form <=> _form")).where("id <> container").select("id", "container")
    single = cut_lineage(equal.join(first.select(F.col("container").alias("id")), "id", "left_semi").select("id", "seq"))
    long_ = single.where(F.length("seq") >= k)
    longest = long_.agg(F.max(F.length("seq")).alias("longest"))
    # nothing is longer than the longest
    small = long_.join(F.broadcast(longest), F.length("seq") < F.col("longest")).select("id", F.explode(F.array_distinct(forms)).alias("form"))
    small = _hashed(small.select("id", F.substring("form", 1, k).alias("form")), lambda x: _windows_least(x, k), "key long").distinct()
    large = _hashed(long_.select(F.col("id").alias("container"), "seq"), lambda x: _windows_least(x, k), "key long")
    met = small.join(large, "key").where("id <> container").select("id", "container").distinct()
    inner = met.join(single.withColumnRenamed("seq", "inner"), "id").select("id", "container", "inner")
    holds = F.coalesce(*[F.when(F.contains("seq", TURNED[t](F.col("inner"))), True) for t in turns], F.lit(False))
    inside = inner.join(single.withColumnRenamed("id", "container"), "container").where((F.length("seq") > F.length("inner")) & holds)
    held = cut_lineage(inside.groupBy("id").agg(F.max_by("container", F.struct(F.length("seq"), -F.col("container"))).alias("container")))
    return single.join(held, "id", "left_anti"), copies.unionByName(held)


def _opened(links: DataFrame) -> DataFrame:
    """Links without one of each circle: that into the node with the smallest name, out of it where it is turned."""
    state = cut_lineage(links.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.least("src", "dst").alias("least")))
    for _ in range(state.count().bit_length() + 1):
        far = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        # what has reached a beginning isn't on a circle and is dropped
        state = cut_lineage(state.join(far, "up").select("node", F.col("_up").alias("up"), F.least("least", "_least").alias("least")))
        if state.isEmpty():
            break
    before = state.where("node = least and node.turn in ('+', 'c')").select(F.col("node").alias("dst"))
    after = state.where("node = least and node.turn in ('-', 'r')").select(F.col("node").alias("src"))
    return links.join(before, "dst", "left_anti").join(after, "src", "left_anti")


def overlap_assembly(reads: DataFrame, least: int, standard: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contigs, unmerged, contained) of reads (id, seq): greedy joins of best overlaps of ``least`` bases or more.

    contigs: (contig, seq, ids), ids in order along it; unmerged: (id, seq) of what joins nothing; contained: (id, container).
    Both strands give the same contig, which is returned once; a circle is cut at its smallest id. Nothing is collected; a path of n sequences takes
    log n joins. ``standard`` False also tries sequences reversed or complemented.
    """
    kept, gone = without_contained_reads(reads, least, standard)
    kept = cut_lineage(kept)
    found = cut_lineage(best_overlaps(kept, least, standard))
    links = cut_lineage(_opened(found))
    ends = found.select(F.explode(F.array("src", "dst")).alias("kmer")).distinct()
    places = path_places(links.select("src", "dst"), ends)
    form = F.coalesce(*[F.when(F.col("kmer.turn") == t, TURNED[t](F.col("seq"))) for t in TURNED])
    placed = places.join(kept, F.col("kmer.id") == kept["id"]).join(links.select(F.col("dst").alias("kmer"), "overlap"), "kmer", "left")
    piece = F.struct("place", "id", form.alias("s"), F.coalesce("overlap", F.lit(0)).alias("overlap"))
    path = placed.groupBy("head").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.substring(x["s"], x["overlap"].cast("int") + 1, F.length(x["s"]))), "")
    built = path.select(text.alias("seq"), F.transform("p", lambda x: x["id"]).alias("ids"))
    forms = F.array(*[TURNED[t](F.col("seq")) for t in (["+", "-"] if standard else TURNED)])
    alike = built.withColumn("form", F.array_min(forms)).groupBy("form").agg(F.min(F.struct(F.col("ids")[0].alias("first"), "seq", "ids")).alias("x"))
    contigs = alike.select(F.col("x.first").alias("contig"), "x.seq", "x.ids")
    merged = ends.select("kmer.id").distinct()
    return contigs, kept.join(merged, "id", "left_anti"), gone
