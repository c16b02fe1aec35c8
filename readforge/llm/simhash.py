"""SimHash near-duplicates by pigeonring filtering (operator 4).

A 64-bit fingerprint is cut into eight segments of eight bits on a ring. If two fingerprints differ in at
most three bits, some start segment exists from which every chain of ``l`` consecutive segments differs in
at most ``floor(3 l / 8)`` bits: 0, 0, 1, 1, 1, 2, 2, 3. The first five budgets make the join key: two
segments are equal and of the next three at most one differs, so two of them are equal as well: 32 equal
bits, in three choices, at eight starts. Pairs that meet on a key must pass the chain budgets
before the full Hamming check.

Null text counts as empty; texts without a word have fingerprint zero and are linked like any other.
Repeated rows stay, one result row each; a null doc_id is kept and never names a component unless all its
members lack one. An empty table gives no rows; texts of any length are read whole, their hashes in parts. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, read_table, text_or_empty

SEGMENTS, BITS, MOST = 8, 8, 3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEED = 42


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - words_per_shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in texts), np.uint64, len(texts))
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint as a signed long, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("text_hash"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long, text_hash long")


def _key_masks() -> list[int]:
    """The 24 masks of 32 bits that the first five chain budgets allow."""
    masks = []
    for start in range(SEGMENTS):
        for pair in combinations((2, 3, 4), 2):
            masks.append(sum(0xFF << BITS * ((start + j) % SEGMENTS) for j in (0, 1, *pair)))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer_masks(mask: int) -> list[int]:
    """Masks of 52 bits: the free 32 bits are eight groups of four, of which five at least are equal."""
    free = [i for i in range(64) if not mask >> i & 1]
    groups = [sum(1 << b for b in free[4 * g : 4 * g + 4]) for g in range(8)]
    return [mask | sum(groups[g] for g in chosen) for chosen in combinations(range(8), 5)]


_ONES = np.uint64(0x0101010101010101)
_TOPS = _ONES << np.uint64(7)
_BUDGETS = np.uint64(sum(MOST * (i + 1) // SEGMENTS << BITS * i for i in range(SEGMENTS)))


def chain_viable(difference: np.ndarray) -> np.ndarray:
    """Whether some start of the ring keeps every chain of segment differences within its budget.

    All within one word: byte i of a rotated word of segment counts, times 0x0101..., is the sum of the first i + 1.
    """
    c = difference - (difference >> np.uint64(1) & _ONES * np.uint64(0x55))
    c = (c & _ONES * np.uint64(0x33)) + (c >> np.uint64(2) & _ONES * np.uint64(0x33))
    c = c + (c >> np.uint64(4)) & _ONES * np.uint64(0x0F)
    good = np.zeros(len(c), bool)
    for start in range(SEGMENTS):
        turned = c >> np.uint64(BITS * start) | c << np.uint64(64 - BITS * start) if start else c
        good |= (_BUDGETS + _TOPS - turned * _ONES) & _TOPS == _TOPS
    return good


def _spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within one bounded bucket: a search from each print not reached yet."""
    left, right, open_, = [], [], prints
    while len(open_) > 1:
        frontier, open_ = open_[:1], open_[1:]
        while len(frontier) and len(open_):
            rows = min(128, -(-(1 << 15) // len(open_)))
            block, frontier = frontier[:rows], frontier[rows:]
            difference = block[:, None] ^ open_[None, :]
            near = chain_viable(difference.ravel()).reshape(difference.shape)
            near[near] = np.bitwise_count(difference[near]) <= MOST
            hit = near.any(axis=0)
            if hit.any():
                left.append(block[near[:, hit].argmax(axis=0)])
                right.append(open_[hit])
                frontier = np.concatenate([frontier, open_[hit]])
                open_ = open_[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate(left) if left else none, np.concatenate(right) if right else none


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets (lists of prints, bounded in length)."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.asarray(lists.value_lengths())
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.asarray(lists.flatten()).view(np.uint64)
        two = np.flatnonzero(sizes == 2)
        a, b = flat[starts[two]], flat[starts[two] + 1]
        viable = chain_viable(a ^ b)
        a, b = a[viable], b[viable]
        near = np.bitwise_count(a ^ b) <= MOST
        left, right = [a[near]], [b[near]]
        for i in np.flatnonzero(sizes > 2):
            x, y = _spanning(np.unique(flat[starts[i] : starts[i + 1]]))
            left.append(x)
            right.append(y)
        yield pa.record_batch([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, most_bucket: int = 4096) -> DataFrame:
    """(a, b) over distinct prints ``fp``: enough links within three bits to connect all that are linked.

    A key with more prints than ``most_bucket`` is cut by 20 further bits in 56 ways. Then 12 bits are
    free, so no bucket holds more than 4,096 distinct prints, and every pair within three bits still meets.
    """
    masks = _key_masks()
    keys = prints.select("fp", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("way", "key"))
    # a table of its own, so that Spark can split the shuffle of a key that many prints share
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "print-sizes")
    met = keys.join(sizes, "key")
    usual = met.where(F.col("n") <= most_bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    finer = F.array(*[F.lit(_signed(x)) for m in masks for x in _finer_masks(m)])
    ways = len(_finer_masks(masks[0]))
    split = met.where(F.col("n") > most_bucket).select("fp", "key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), lambda j: F.xxhash64("key", j, F.col("fp").bitwiseAND(F.element_at(finer, (F.col("way") * ways + j + 1).cast("int")))))).alias("key2"))
    dense = split.groupBy("key2").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return usual.unionByName(dense).mapInArrow(_link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, most_bucket: int = 4096) -> DataFrame:
    """(doc_id, fp, text_hash, component, component_id).

    component is a print of the group, component_id the smallest doc_id linked through at most three bits.
    """
    rows = materialize(fingerprints(docs), "prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = links(prints.select("fp"), most_bucket)
    parts = connected_components(found, "a", "b")
    tagged = prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = tagged.join(parts.select("component").distinct(), "component", "left_semi")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    alone = tagged.join(parts.select("component").distinct(), "component", "left_anti").select("fp", "component", F.col("low").alias("component_id"))
    named = linked.join(lows, "component").select("fp", "component", "component_id").unionByName(alone)
    return rows.join(named, "fp").select("doc_id", "fp", "text_hash", "component", "component_id")


def keep_first(docs: DataFrame, most_bucket: int = 4096, groups: DataFrame | None = None) -> DataFrame:
    """One document of each group: the smallest doc_id, or a row without one if no member has an id.

    groups: (doc_id, text_hash, component) of every row; the groups of ``near_duplicates`` if not given.
    A document is its id and text; of repeated rows one stays. All columns of ``docs`` are returned.
    """
    found = near_duplicates(docs, most_bucket) if groups is None else groups
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"))).alias("w"))
    key = ["_none", "_id", "_hash"]
    keyed = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_hash": F.xxhash64(text_or_empty())})
    return keyed.join(first.select("w.*").distinct(), key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash_pigeonring(spark, sf_dir):
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
