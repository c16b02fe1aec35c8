"""Benchmark decontamination by pigeonhole edit matching (operator 1).

Texts and items are lower-cased and every run of other characters than letters and digits becomes one space.
An item of ``m`` characters may be present with up to ``k = floor(error_rate * m)`` edits. It is cut into
``k + t`` pieces; by the pigeonhole principle at least ``t`` of them occur unchanged in any such passage, and the
starts of the item they point to lie within ``k`` characters. ``t`` is as large as pieces of five characters
allow. At most ``t - RARE`` of an item's pieces, the most frequent ones of the block, needn't be looked up: ``RARE``
of the others are unchanged all the same. These are found at every place of a block of texts at once; where so many
agree, all pieces are counted, and Myers' bit-parallel distance verifies the places that have ``t``.

Items shorter than ``min_chars`` are found without edits, between word boundaries; scripts without spaces have a
boundary at each character. Items without letters or digits never match, and those without an id can't be named
and are left out. Null text counts as empty, a null doc_id stays null. Repeated items and rows are kept apart; the
result has one row for each contaminated input row. Texts of any length are searched whole, long ones in
overlapping parts. Of equal distances nothing has to be chosen: all items that are present are named. Empty tables give
no rows. Items go to the executors in blocks of at most ``block_bytes``, so the benchmark may have any size. Other
columns are ignored (``contaminated``) or kept as they are (``keep_clean``), whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

ERROR_RATE = 0.15
MIN_CHARS = 25
BLOCK_BYTES = 8 << 20

PIECE_CHARS = 5
#: So many of the rarer pieces of an item have to agree before the others are counted.
RARE = 5
#: Characters searched at once; a longer text is searched in parts that overlap by more than any passage is long.
BLOCK_CHARS = 1 << 20

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_OTHER = re.compile(r"[\W_]+")
#: Thai, Lao, Myanmar, Khmer, kana and Han: scripts without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    text = text or ""
    if text.isascii():
        return b" ".join(text.encode().translate(_PLAIN).split()).decode()
    return _OTHER.sub(" ", text.lower()).strip()


def agreeing(length: int, errors: int) -> int:
    """How many pieces of an item have to agree on a place."""
    return max(1, length // PIECE_CHARS - errors)


def pieces(item: str, errors: int, agree: int = 1) -> list[tuple[int, str]]:
    """``errors + agree`` pieces of nearly even length, with their offsets."""
    n = errors + agree
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item as bit masks for Myers' algorithm."""

    def __init__(self, item: str):
        self.m = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, most: int | None = None) -> tuple[int, int]:
        """The least edit distance to any part of ``text``, and the end of the first part that has it.

        With ``most`` the search ends where no distance up to it can follow; then what it says is only above it.
        """
        m, masks = self.m, self.masks
        all_, top = (1 << m) - 1, 1 << m - 1
        vp, vn, score, best, end = all_, 0, m, m, 0
        give_up = len(text) + (m if most is None else most)
        for j, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | (all_ & ~(d0 | vp)), d0 & vp
            if hp & top:
                score += 1
                if score + j > give_up:  # each sign left takes one off at most
                    break
            elif hn & top:
                score -= 1
            hp, hn = hp << 1 & all_, hn << 1 & all_
            vp, vn = hn | (all_ & ~(d0 | hp)), d0 & hp
            if score < best:
                best, end = score, j
        return best, end


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether no word is cut at the ends of ``text[start:end]``."""
    inside = lambda a, b: a != " " and b != " " and not _UNSPACED.match(a) and not _UNSPACED.match(b)
    return not (start and inside(text[start - 1], text[start]) or end < len(text) and inside(text[end - 1], text[end]))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(signs: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of the ``n`` characters from each place on; equal characters have equal codes."""
    out = np.zeros(max(0, len(signs) - n + 1), np.uint64)
    for i in range(n):
        out = (out + signs[i : i + len(out)]) * _MULTIPLIER
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(42)).astype(np.int64)


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Pieces of a block of items by the code of their first characters, and short items in an automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        short: dict[str, list[int]] = {}
        self.items: list[tuple[int, int, int, Pattern, list[tuple[int, str]]]] = []
        grams: Counter[str] = Counter()
        for ident, text in items:
            plain = normalise(text)
            if not plain:
                continue
            if len(plain) < min_chars:
                short.setdefault(plain, []).append(ident)
                continue
            errors = int(error_rate * len(plain))
            agree = agreeing(len(plain), errors)
            self.items.append((ident, errors, agree, Pattern(plain), pieces(plain, errors, agree)))
            grams.update(plain[i : i + PIECE_CHARS] for i in range(len(plain) - PIECE_CHARS + 1))
        self.short = ahocorasick.Automaton()
        for plain, idents in short.items():
            self.short.add_word(plain, (len(plain), idents))
        if short:
            self.short.make_automaton()
        self.errors = np.array([x[1] for x in self.items], np.int64)
        self.agree = np.minimum(np.array([x[2] for x in self.items], np.int64), RARE)
        self.reach = np.array([x[3].m + x[1] for x in self.items], np.int64)
        if not self.items:
            return
        rows, texts, pool = [], [], 0
        for at, (_, _, agree, pattern, own) in enumerate(self.items):
            texts.append("".join(piece for _, piece in own))
            own.sort(key=lambda p: grams[p[1][:PIECE_CHARS]])  # rare ones first
            rows += [(at, offset, len(piece), pool + offset) for offset, piece in own[: len(own) - agree + min(agree, RARE)]]
            pool += pattern.m
        at, self.offset, self.length, self.where = np.array(rows, np.int64).T
        self.signs = _signs("".join(texts))
        self.chars = min(PIECE_CHARS, int(self.length.min()))
        codes = gram_codes(self.signs, self.chars)[self.where]
        order = np.argsort(codes, kind="stable")
        self.piece_item, self.offset, self.length, self.where = at[order], self.offset[order], self.length[order], self.where[order]
        self.codes, first, self.times = np.unique(codes[order], return_index=True, return_counts=True)
        self.first = first.astype(np.int64)
        # a table by the top bits; codes with the same ones are neighbours
        slots, head, chain = np.unique(_slot(self.codes), return_index=True, return_counts=True)
        self.slots = np.full(1 << 22, -1, np.int32)
        self.slots[slots] = head
        self.chain = int(chain.max())
        self.overlap = 2 * int(self.reach.max()) + 1

    def _regions(self, plains: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the parts of the texts where hits agree; overlapping parts are one."""
        sizes = np.fromiter(map(len, plains), np.int64, len(plains))
        starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))  # between texts stands a sign that no piece holds
        signs = _signs("\0".join(plains))
        codes = gram_codes(signs, self.chars)
        head = self.slots[_slot(codes)]
        near = np.flatnonzero(head >= 0)
        found = []
        for step in range(self.chain):
            own = np.minimum(head[near] + step, len(self.codes) - 1)
            known = self.codes[own] == codes[near]
            found.append((near[known], own[known]))
            near = near[~known]
        hit, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        times = self.times[slot]
        piece = np.repeat(self.first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        place = np.repeat(hit, times)
        for i in range(self.chars, int(self.length.max())):
            longer = self.length[piece] > i
            if not longer.any():
                break
            same = ~longer
            same[longer] = signs[np.minimum(place[longer] + i, len(signs) - 1)] == self.signs[self.where[piece[longer]] + i]
            piece, place = piece[same], place[same]
        # in numbers that set texts so far apart that their hits never agree
        base = starts + self.overlap * np.arange(1, len(plains) + 1)
        text = np.searchsorted(starts, place, side="right") - 1
        width = int(base[-1] + sizes[-1]) + self.overlap
        order = np.sort(self.piece_item[piece] * width + place + self.overlap * (text + 1) - self.offset[piece])
        at, start = order // width, order % width
        last = np.arange(len(at)) + self.agree[at] - 1
        ok = last < len(at)
        ok[ok] = (at[last[ok]] == at[ok]) & (start[last[ok]] - start[ok] <= self.errors[at[ok]])
        if not ok.any():
            return
        at, lo, hi = at[ok], start[ok] - self.errors[at[ok]], start[last[ok]] + self.reach[at[ok]]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (lo[1:] > hi[:-1])]))
        at, lo, hi = at[new], lo[new], hi[np.append(new[1:], len(at)) - 1]
        text = np.searchsorted(base - self.overlap // 2, lo + self.errors[at], side="right") - 1
        yield from zip(text.tolist(), at.tolist(), (lo - base[text]).tolist(), (hi - base[text]).tolist(), strict=True)

    def matches(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text: item_id -> least distance, for the items that are present."""
        out: list[dict[int, int]] = [{} for _ in texts]
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            plain = normalise(text)
            if len(self.short):
                for end, (length, idents) in self.short.iter(plain):
                    if _bounded(plain, end + 1 - length, end + 1):
                        out[i].update(dict.fromkeys(idents, 0))
            if not self.items or not plain:
                continue
            for lo in range(0, max(1, len(plain) - self.overlap), BLOCK_CHARS):
                parts.append(plain[lo : lo + BLOCK_CHARS + self.overlap])
                owners.append(i)
                size += len(parts[-1])
                if size >= BLOCK_CHARS:
                    self._verify(parts, [out[k] for k in owners])
                    parts, owners, size = [], [], 0
        if parts:
            self._verify(parts, [out[k] for k in owners])
        return out

    def _verify(self, parts: list[str], found: list[dict[int, int]]) -> None:
        for i, at, lo, hi in self._regions(parts):
            ident, errors, agree, pattern, own = self.items[at]
            if found[i].get(ident) != 0 and self._enough(parts[i], own, agree, lo, hi - pattern.m):
                best = pattern.search(parts[i][max(0, lo) : max(0, hi)], errors)[0]
                if best <= errors:
                    found[i][ident] = min(best, found[i].get(ident, best))


    @staticmethod
    def _enough(text: str, own: list[tuple[int, str]], agree: int, lo: int, hi: int) -> bool:
        """Whether ``agree`` pieces occur where the item would have to begin from ``lo`` to ``hi``."""
        missing, find = len(own) - agree, text.find
        for offset, piece in own:
            start = lo + offset
            if find(piece, start if start > 0 else 0, max(0, hi + offset + len(piece))) < 0:
                missing -= 1
                if missing < 0:
                    return False
        return True


_BUILT: list = []


def _index(block, error_rate: float, min_chars: int) -> Index:
    """The index of a broadcast block, built once for all tasks of a worker."""
    items = block.value
    if not _BUILT or _BUILT[0] is not items or _BUILT[1:3] != [error_rate, min_chars]:
        _BUILT[:] = [items, error_rate, min_chars, Index(items, error_rate, min_chars)]
    return _BUILT[3]


_HITS = "item_ids array<long>, distances array<int>"


def _matcher(block, error_rate: float, min_chars: int):
    """Adds a block's hits to those of the blocks before, in the same row."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, error_rate, min_chars)
        for batch in batches:
            ids, distances = [], []
            for new, old, far in zip(index.matches(batch.column(1).to_pylist()), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                hits = dict(zip(old, far, strict=True))
                for i, d in new.items():
                    hits[i] = min(d, hits.get(i, d))
                ids.append(sorted(hits))
                distances.append([hits[i] for i in sorted(hits)])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32()))], names=["doc_id", "text", "item_ids", "distances"])

    return matched


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, row.t))
        size += 4 * len(row.t) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_ids, distances) of the rows that hold an item, one row for each, whatever the blocks."""
    context = docs.sparkSession.sparkContext
    schema = f"doc_id long, text string, {_HITS}"
    none = [F.array().cast(kind).alias(name) for name, kind in (("item_ids", "array<bigint>"), ("distances", "array<int>"))]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *none)
    for block in _blocks(benchmark, block_bytes):
        out = out.mapInArrow(_matcher(context.broadcast(block), error_rate, min_chars), schema)
    return out.where(F.size("item_ids") > 0).select("doc_id", "item_ids", "distances")


def _clean_filter(block, at: int, error_rate: float, min_chars: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, error_rate, min_chars)
        for batch in batches:
            yield batch.filter(pa.array([not found for found in index.matches(batch.column(at).to_pylist())], pa.bool_()))

    return kept


def keep_clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they were."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = [c.lower() for c in docs.columns].index("text")
    for block in _blocks(benchmark, block_bytes):
        plain = plain.mapInArrow(_clean_filter(docs.sparkSession.sparkContext.broadcast(block), at, error_rate, min_chars), plain.schema)
    return plain.toDF(*docs.columns)


def op1_pigeonhole_decontamination(spark, sf_dir):
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("item_ids").alias("n_items"), F.array_min("distances").alias("least_distance"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))
