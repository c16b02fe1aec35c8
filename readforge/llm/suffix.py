"""Exact substring dedup by prefix-free parsing (operator 6).

A byte is removed if a string of ``length`` bytes (a window) that covers it also starts anywhere else in the corpus.

Parse. A rolling hash runs over all strings of ``GRAM`` bytes. In each window the gram of least hash is the trigger
(the last one if equal): it depends on the window's content alone, so equal windows have equal triggers at the same
place. Triggers cut a text into phrases: a phrase is the bytes of all consecutive windows that have one trigger
place. Phrases overlap by ``length - 1`` bytes, so every window lies in exactly one phrase, and a text becomes a
sequence of phrase numbers (the trigger's hash and the phrase's 128-bit XXH3). Of this parse no suffix array is
needed, since no window reaches into a second phrase: how often each number occurs is all it adds.

Dictionary. Phrases of triggers that occur once in the corpus can't repeat anything and go. Of the others every
distinct phrase is one entry with its count, summed where the texts are read first, so a passage that a third of all
texts share is one entry and not a task's load. A trigger with one phrase is settled: all its windows repeat. The
other entries are cut from one text each.

Corpus order. The entries of one trigger are sorted by their bytes before the trigger, read backwards, and by those
from it on, both with the lengths that neighbours have in common. From these suffix arrays each window gets the class
of what it has before the trigger and of what follows; sorted by both, equal windows are neighbours, and their counts
add up. A trigger with more than ``most_phrases`` distinct phrases is cut into phrases of one window each; these
become entries of the same kind, whose counts are summed over all tasks, so that none holds the whole group.

Null text counts as empty; texts shorter than ``length`` keep all bytes. Repeated rows are two starts of each
string, so they lose everything of ``length`` bytes and more. Texts of any length are parsed in blocks. A null doc_id
stays null; an empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, row_blocks, text_bytes, text_or_empty

LENGTH = 200
GRAM = 64
BLOCK = 1 << 18
#: Entries sorted at once, and the most of one trigger that are sorted in one task.
BATCH_PHRASES, MOST_PHRASES = 8_000, 30_000

_RANDOM = np.random.default_rng(6)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4 * LENGTH)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _POWERS["down"] = np.cumprod(np.full(size, inverse, np.uint64))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The rolling hash of every string of ``gram`` bytes, mixed."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def triggers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the place of its trigger; and the gram hashes."""
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << 22) - 1)
    n = len(hashes)
    keys = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if width > reach:
        keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
    return (low - (keys & low)).astype(np.int64), hashes


def _blocks_of(buffer: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, starts in the bytes, starts in the texts, windows): blocks of whole texts or of parts of one."""
    sizes = np.diff(offsets)
    for lo, hi in row_blocks(offsets, BLOCK):
        if sizes[lo:hi].max(initial=0) <= BLOCK:
            yield buffer[offsets[lo] : offsets[hi]], np.arange(lo, hi), offsets[lo:hi] - offsets[lo], np.zeros(hi - lo, np.int64), np.maximum(sizes[lo:hi] - length + 1, 0)
            continue
        for at in range(0, int(sizes[lo]) - length + 1, BLOCK):
            own = min(BLOCK, int(sizes[lo]) - length + 1 - at)
            yield buffer[offsets[lo] + at : offsets[lo] + at + own + length - 1], np.array([lo]), np.zeros(1, np.int64), np.array([at]), np.array([own])


_PLACE = ["h", "p1", "p2", "lo", "w", "at"]


def places(buffer: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows of the texts, and for each phrase its number (h, p1, p2), first window, windows and trigger in the phrase."""
    out: list[tuple[np.ndarray, ...]] = []
    for data, rows, starts, shift, windows in _blocks_of(buffer, offsets, length):
        if len(data) < length or not windows.any():
            continue
        at, hashes = triggers(data, length, gram)
        # windows that lie in one text, in order
        row = np.repeat(np.arange(len(rows)), windows)
        first = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(len(row))
        place = at[first]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(row)]]) - 1
        own, lo, hi = row[begin], first[begin], first[end]
        raw, digest = data.tobytes(), xxhash.xxh3_128_digest
        numbers = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]), np.int64).reshape(-1, 2)
        out.append((rows[own], hashes[place[begin]].view(np.int64), numbers[:, 0], numbers[:, 1], lo + shift[own] - starts[own], hi - lo + 1, place[begin] - lo))
    if not out:
        return np.zeros(0, np.int64), {c: np.zeros(0, np.int64) for c in _PLACE}
    row, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, dict(zip(_PLACE, columns, strict=True))


def _place_batches(length: int, gram: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            row, columns = places(*text_bytes(batch.column(2)), length, gram)
            yield pa.record_batch([pa.array(k1[row]), pa.array(k2[row]), *map(pa.array, columns.values())], names=["k1", "k2", *columns])

    return found


def _cut_batches(length: int):
    """The bytes of dictionary entries from the texts that were chosen for them; of repeated rows in a row one is read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for k1, k2, text, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (k1, k2) == last:
                    continue
                last, raw, entry = (k1, k2), text.as_buffer().to_pybytes(), spots.values
                lo, w = entry.field("lo").to_pylist(), entry.field("w").to_pylist()
                data = pa.array([raw[a : a + n + length - 1] for a, n in zip(lo, w, strict=True)], pa.binary())
                yield pa.record_batch([*(entry.field(c) for c in _ENTRY[:-1]), data], names=_ENTRY)

    return lambda batches: _merged(cut(batches))


_ENTRY = ["h", "p1", "p2", "n", "d", "at", "bytes"]


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Few larger batches instead of many small ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _common(phrases: list[bytes], most: int) -> np.ndarray:
    """Length of the common prefix with the phrase before, -1 for the first."""
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    table = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in phrases), np.uint8).reshape(-1, most)
    differ = table[1:] != table[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return np.concatenate([[-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])


def _classes(common: np.ndarray, most: int) -> np.ndarray:
    """classes[i, d]: the first phrase in order that shares its first d bytes with phrase i."""
    starts = np.where(common[:, None] < np.arange(most + 1)[None, :], np.arange(len(common))[:, None], 0)
    starts[0] = 0
    return np.maximum.accumulate(starts.astype(np.int32), axis=0)


def repeated_windows(phrases: list[bytes], triggers_at: np.ndarray, counts: np.ndarray, length: int, gram: int) -> list[list[tuple[int, int]]]:
    """For each phrase the runs (from, to) of its windows that occur more than once, by the phrases' counts.

    Phrases are distinct unless their triggers differ. ``triggers_at``: the trigger's place in the phrase.
    """
    before = [s[: a + gram][::-1] for s, a in zip(phrases, triggers_at.tolist(), strict=True)]
    after = [s[a:] for s, a in zip(phrases, triggers_at.tolist(), strict=True)]
    back_order, order = sorted(set(before)), sorted(set(after))
    rank_b, rank_a = ({p: i for i, p in enumerate(own)} for own in (back_order, order))
    left = np.fromiter((rank_b[p] for p in before), np.int64, len(before))
    right = np.fromiter((rank_a[p] for p in after), np.int64, len(after))
    # a window starts ``back`` bytes before the trigger
    most = triggers_at
    n = np.fromiter(map(len, phrases), np.int64, len(phrases)) - length + 1
    own = np.repeat(np.arange(len(n)), n)
    back = np.repeat(most + np.concatenate([[0], np.cumsum(n)[:-1]]), n) - np.arange(len(own))
    suffix = _classes(_common(back_order, length), length)[left[own], back + gram]
    prefix = _classes(_common(order, length), length)[right[own], length - back]
    key = (back * len(back_order) + suffix) * len(order) + prefix
    sort = np.argsort(key, kind="stable")
    ordered = key[sort]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(counts[own[sort]], first)
    again = np.zeros(len(key), bool)
    again[sort] = np.repeat(total > 1, np.diff(np.append(first, len(key))))
    start = np.flatnonzero(again & np.concatenate([[True], ~again[:-1] | (own[1:] != own[:-1])]))
    end = np.flatnonzero(again & np.concatenate([~again[1:] | (own[1:] != own[:-1]), [True]]))
    runs: list[list[tuple[int, int]]] = [[] for _ in phrases]
    for p, a, b in zip(own[start].tolist(), (most[own[start]] - back[start]).tolist(), (most[own[start]] - back[end]).tolist(), strict=True):
        runs[p].append((a, b))
    return runs


def _order_batches(length: int, gram: int, batch_phrases: int):
    """Runs of repeated windows of entries that come sorted by number."""

    def resolved(table: pa.Table) -> pa.RecordBatch:
        # an entry read from two repeated rows is there twice
        number = np.stack([np.asarray(table[c]) for c in ("h", "p1", "p2")], axis=1)
        table = table.take(np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]).any(axis=1)])))
        data = [x.as_buffer().to_pybytes() for x in table["bytes"].combine_chunks()]
        runs = repeated_windows(data, np.asarray(table["at"]), np.asarray(table["n"]), length, gram)
        starts, ends = ([[r[i] for r in own] for own in runs] for i in (0, 1))
        lists = (pa.array(x, pa.list_(pa.int64())) for x in (starts, ends))
        return pa.record_batch([*(table[c].combine_chunks() for c in ("h", "p1", "p2")), *lists], names=["h", "p1", "p2", "a", "b"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < batch_phrases:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = np.asarray(table["h"])
            cut = int(np.searchsorted(h, h[-1]))  # the last trigger may go on
            if cut:
                yield resolved(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
        if n:
            yield resolved(pa.Table.from_batches(held).combine_chunks())

    return ordered


def _window_batches(length: int):
    """Every window of the entries as an entry of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p1, p2, n, _, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(data) - length + 1
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + length]) for i in range(size)]), np.int64).reshape(-1, 2)
                same = (pa.array([x] * size, pa.int64()) for x in (h, p1, p2, n))
                yield pa.record_batch([pa.array(w[:, 0]), pa.array(w[:, 1]), *same, pa.array(np.arange(size))], names=["w1", "w2", "h", "p1", "p2", "n", "i"])

    return lambda batches: _merged(cut(batches))


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, text): the id and the text's hash name a text; rows they don't tell apart are equal."""
    none = F.lit(-(2**63))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("k1"), F.xxhash64(text_or_empty()).alias("k2"), text_or_empty().alias("text"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most_phrases: int = MOST_PHRASES, batch_phrases: int = BATCH_PHRASES) -> DataFrame:
    """(k1, k2, s, e): byte spans, overlapping ones too, that windows found elsewhere cover."""
    longs = lambda names: ", ".join(f"{c} long" for c in names)
    parse = texts.where(F.octet_length("text") >= length).mapInArrow(_place_batches(length, gram), longs(["k1", "k2", *_PLACE]))
    parse = materialize(parse, "parse")
    # sums and dictionaries are tables of their own, so that a join's sides are plain shuffles and Spark can split those
    # of a number that very many texts have
    twice = materialize(parse.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "parse-triggers")
    again = materialize(parse.join(twice, "h"), "parse-repeated")
    discard(parse)
    discard(twice)
    number = ["h", "p1", "p2"]
    # all first values come from one place
    one = [F.first(c).alias(c) for c in ("k1", "k2", "lo", "w", "at")]
    numbers = materialize(again.groupBy(*number).agg(F.count("*").alias("n"), *one), "phrase-numbers")
    sizes = materialize(numbers.groupBy("h").agg(F.count("*").alias("d")), "phrase-groups")
    entries = numbers.join(sizes, "h")
    settled = entries.where("d = 1").select(*number, F.array(F.lit(0).cast("long")).alias("a"), F.array(F.col("w") - 1).alias("b"))
    chosen = entries.where("d > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct(*number, "n", "d", "at", "lo", "w")).alias("spots"))
    dictionary = materialize(texts.join(chosen, ["k1", "k2"]).select("k1", "k2", "text", "spots").mapInArrow(_cut_batches(length), longs(_ENTRY[:-1]) + ", bytes binary"), "dictionary")
    usual = dictionary.where(F.col("d") <= most_phrases).repartition("h").sortWithinPartitions(*number)
    runs = settled.unionByName(usual.mapInArrow(_order_batches(length, gram, batch_phrases), longs(number) + ", a array<long>, b array<long>"))
    large = dictionary.where(F.col("d") > most_phrases)
    if not large.isEmpty():
        windows = materialize(large.dropDuplicates(number).select(*_ENTRY).mapInArrow(_window_batches(length), longs(["w1", "w2", *number, "n", "i"])), "windows")
        shared = materialize(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "windows-repeated")
        found = windows.join(shared, ["w1", "w2"]).groupBy(*number).agg(F.sort_array(F.collect_list("i")).alias("a"))
        runs = runs.unionByName(found.select(*number, "a", F.col("a").alias("b")))
    runs = materialize(runs.where(F.size("a") > 0), "phrase-runs")
    for table in (numbers, sizes, dictionary):
        discard(table)
    spans = again.join(runs, number).select("k1", "k2", "lo", F.explode(F.arrays_zip("a", "b")).alias("r"))
    return spans.select("k1", "k2", (F.col("lo") + F.col("r.a")).alias("s"), (F.col("lo") + F.col("r.b") + length).alias("e"))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans cover."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return s[begin], e[np.concatenate([begin[1:], [len(s)]]) - 1] if len(s) else e


_RESULT = "k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _removal_batches(with_text: bool):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes()
                if not s.is_valid or not len(s.values):
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace") if with_text else None))
                    continue
                a, b = merged_spans(np.asarray(s.values), np.asarray(e.values))
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["k1", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return removed


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_phrases: int = MOST_PHRASES, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    kept is the text that is left; cuts inside a character leave U+FFFD there.
    """
    texts = keyed(docs)
    spans = repeated_spans(texts, length, gram, most_phrases)
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("x")).select("k1", "k2", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    rows = texts.join(lists, ["k1", "k2"], "left").select("k1", "text", "s", "e").mapInArrow(_removal_batches(with_text), _RESULT)
    return rows.select(F.nullif("k1", F.lit(-(2**63))).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op6_prefix_free_dedup(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")
