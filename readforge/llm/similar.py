"""Near copies by the Jaccard similarity of word shingles, found by prefix filtering (the pipeline's second stage).

Words are runs of other bytes than ASCII white space, in lower case; a text of fewer words than a shingle is one
shingle. Texts of the same words are one text. If two sets of ``n`` and ``m`` shingles have a similarity of at least
``4/5``, they share four fifths of the larger one, so in any one order of all shingles they meet within the first
``n - ceil(4n/5) + 1`` and ``m - ceil(4m/5) + 1``. The order puts shingles that are frequent in a part of the texts
last; any order finds all pairs, this one only makes few others meet.

Of a pair's first common shingle on, at least what they have to share must be left in both, or they are not compared.

Operator 4 goes first: what its fingerprints link is compared, and what is similar is together from then on.
Fingerprints of similar texts are often further apart than its three bits, so the rest is found by shingles.

Texts that meet on a shingle are compared with one of them, which has the fewest shingles of its own at the front
of its order and so is the likeliest to be near all others, then those that are still in different groups with each
other. What is compared is compared exactly, so the groups are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import BATCH, connected_components, discard, materialize, small_batches, text_or_empty

WORDS = 5
#: The least similarity as a fraction.
LEAST = (4, 5)
#: Every so many-th text is looked at for frequent shingles, of which at most so many are kept.
PART, MOST_FREQUENT = 16, 200_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * _MULTIPLIER + hashes[j : j + size]
    out = (out ^ out >> np.uint64(33)) * _MIX
    return np.unique(out ^ out >> np.uint64(33))


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: by count among the frequent ones (sorted), else 0, then by hash."""
    size = len(own) - -(-LEAST[0] * len(own) // LEAST[1]) + 1
    if not len(frequent):
        return own[:size]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    return own[np.argsort(np.where(frequent[at] == own, counts[at], 0), kind="stable")[:size]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * shared >= LEAST[0] * (len(a) + len(b) - shared)


def _ident(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def _idents(batches: Iterator[pa.RecordBatch], with_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.fromiter((_ident(words_of(t.as_buffer().to_pybytes())) for t in batch.column(0)), np.uint64, batch.num_rows)
        columns = batch.columns if with_text else batch.columns[1:]
        yield pa.record_batch([pa.array(ids.view(np.int64)), *columns], names=["id", *(batch.schema.names if with_text else batch.schema.names[1:])])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for t in batch.column(0):
            found.append(shingles(words_of(t.as_buffer().to_pybytes())))
        yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["key"])


def _prefixes(order):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        for batch in batches:
            keys, places, ids, sizes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [], [], []
            for t in batch.column(0):
                words = words_of(t.as_buffer().to_pybytes())
                if words:
                    own = shingles(words)
                    keys.append(prefix(own, frequent, counts))
                    places.append(np.arange(len(keys[-1]), dtype=np.int32))
                    ids.append(_ident(words))
                    sizes.append(len(own))
                    lengths.append(len(keys[-1]))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.uint64), lengths).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.concatenate(places))], names=["key", "id", "n", "at"])

    return keyed


#: Shingles a task holds of the texts it compared last; then it begins anew.
HELD = 4_000_000


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    size = 0

    def own(ident: int, text: pa.Scalar) -> np.ndarray:
        nonlocal size
        if ident not in held:
            if size > HELD:
                held.clear()
                size = 0
            held[ident] = shingles(words_of(text.as_buffer().to_pybytes()))
            size += len(held[ident])
        return held[ident]

    for batch in batches:
        ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        keep = [similar(own(a, x), own(b, y)) for (a, b), x, y in zip(ids, batch.column(2), batch.column(3), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; members: (id, text)."""
    left = members.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = members.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_compared, "a long, b long"), "similar-links", BATCH)


def _may_fit(n: str, i: str, m: str, j: str):
    """Whether sets of n and m shingles can be similar if i and j are their first common places: all they share lies from there on.

    A similar pair passes at its first common shingle, so asking at every common one loses none.
    """
    left, right = (F.col(x).cast("long") for x in (n, m))
    return F.least(left - F.col(i), right - F.col(j)) * (LEAST[0] + LEAST[1]) >= (left + right) * LEAST[0]


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).mapInArrow(_sampled, "key long")
    with small_batches(texts.sparkSession):
        top = part.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    keys, counts = np.asarray(top.column("key")).view(np.uint64), np.asarray(top.column("n"))
    by = np.argsort(keys)
    return keys[by], counts[by]


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
        ids = np.fromiter((_ident(words_of(t)) for t in texts), np.uint64, len(texts))
        prints = np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts))
        yield pa.record_batch([pa.array(ids.view(np.int64)), pa.array(prints.view(np.int64))], names=["id", "fp"])


def printed_pairs(docs: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that connect all whose fingerprints operator 4 links."""
    prints = materialize(docs.select(text_or_empty().alias("text")).mapInArrow(_printed, "id long, fp long").distinct(), "similar-prints", BATCH)
    low = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "similar-prints")
    same = prints.join(low, "fp").where("id <> low").select(F.least("id", "low").alias("a"), F.greatest("id", "low").alias("b"))
    left, right = low.select(F.col("fp").alias("a"), F.col("low").alias("x")), low.select(F.col("fp").alias("b"), F.col("low").alias("y"))
    across = simhash.links(low.select("fp")).join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = materialize(same.unionByName(across).distinct(), "similar-pairs")
    discard(prints)
    discard(low)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component) for every row; rows linked through similar pairs share a component.

    The pairs of operator 4's fingerprints are checked first; texts they bring together aren't compared again.
    """
    texts = docs.select(text_or_empty().alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(_frequent(texts))
    keys = materialize(texts.mapInArrow(_prefixes(order), "key long, id long, n int, at int"), "similar-keys", BATCH)
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    met = materialize(keys.join(shared, "key").distinct(), "similar-met")
    discard(keys)
    tagged = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    rows = materialize(tagged.mapInArrow(_idents, "id long, doc_id long, text_hash long"), "similar-rows", BATCH)
    with_id = texts.mapInArrow(partial(_idents, with_text=True), "id long, text string")
    members = materialize(with_id.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), "similar-members", BATCH)

    # the text of a key with the fewest shingles of its own stands nearest to all the others
    own = materialize(met.groupBy("id").agg((F.floor(F.max("n") * (LEAST[1] - LEAST[0]) / LEAST[1]) + 1 - F.count("*")).alias("own")), "similar-own")
    hubs = materialize(met.join(own, "id").groupBy("key").agg(F.min(F.struct("own", F.xxhash64("id").alias("h"), "id", "n", "at")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at")), "similar-hubs")
    star = met.join(hubs, "key").where("id <> hub").where(_may_fit("n", "at", "hub_n", "hub_at"))
    star = materialize(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "similar-pairs")
    discard(own)
    discard(hubs)
    near = _links(printed_pairs(docs), members)
    joined = materialize(connected_components(near, "a", "b"), "similar-joined")
    left, right = joined.select(F.col("node").alias("a"), F.col("component").alias("p")), joined.select(F.col("node").alias("b"), F.col("component").alias("q"))
    unmet = star.join(left, "a", "left").join(right, "b", "left").where("p is null or q is null or p <> q").select("a", "b")
    first = near.unionByName(_links(unmet, members))
    parts = connected_components(first, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("part"))
    placed = materialize(met.join(parts, "id", "left").select("key", "id", "n", "at", F.coalesce("part", "id").alias("part")), "similar-placed")
    discard(met)
    most = placed.groupBy("key", "part").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    # sizes that fit lie in neighbouring bands
    open_ = materialize(placed.join(most, "key").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("int")), "similar-open")
    discard(placed)
    a = open_.where("part <> main").select("key", F.col("id").alias("i"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("part").alias("p"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    across = a.join(open_, ["key", "band"]).where("p <> part").where(_may_fit("n", "at", "m", "j"))
    rest = across.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    rest = materialize(rest, "similar-pairs")
    discard(open_)
    links = first.unionByName(_links(rest, members))
    discard(members)
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    return rows.join(parts, "id", "left").select("doc_id", "text_hash", F.coalesce("component", "id").alias("component"))
