"""Language identification by compression (operator 2).

For each language a raw-content zstandard dictionary is filled with text of that language, in lower case and
with everything but letters and the marks on them taken as spaces. A text, treated likewise, is
compressed with each of them, in chunks of ``CHUNK`` bytes so that a long text can't fall back on its own
beginning; the language whose dictionary gives the fewest bytes wins. If the next best is within
``min_margin`` of the size, the answer is rejected: ``identify`` then says ``und``, while its column
``nearest`` still names the winner.

Dictionaries are learned from a bounded sample: about ``TRAIN_DOCS`` documents of each language, chosen by id
hash, one excerpt of up to ``EXCERPT`` characters of each, and of these at most ``DICT_BYTES`` bytes of whole
characters; of more than ``MOST_LANGS`` languages those with the most documents. What is learned reaches the driver,
so all of these bound it. Every whole text is identified, however long. Null texts and texts without a letter
(numbers such as ``½`` are none) are ``und`` with score 0, as are all if there is nothing to learn from. Ties go to
the language that sorts first. Repeated rows are rows of their own with equal answers; a null doc_id stays null and
is held out, as the checksum of an empty text is 0. An empty table gives no rows. Columns besides
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, read_table

TRAIN_DOCS, EXCERPT, DICT_BYTES, MOST_LANGS = 320, 1_000, 256 << 10, 256
CHUNK, LEVEL, MIN_MARGIN = 2_048, 3, 0.01

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str | None) -> str:
    """Lower-case words of letters and their marks, one space between: case and signs tell no language."""
    text = text or ""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return " ".join(_WORD.findall(text.lower()))


def learn(docs: DataFrame, most_docs: int = TRAIN_DOCS, dict_bytes: int = DICT_BYTES, most_langs: int = MOST_LANGS) -> dict[str, bytes]:
    """Dictionary content by language, from the rows outside the held-out part."""
    rows = docs.where("text is not null and lang is not null").where(crc_mod("doc_id", 5) != 0).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_docs / n))]), F.col("lang"))
    middle = F.greatest(F.lit(1), ((F.char_length("text") - EXCERPT) / 2).cast("int"))
    picked = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 < share).select("lang", "h", F.substring(F.col("text"), middle, F.lit(EXCERPT)).alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():  # about most_docs excerpts of EXCERPT characters for each of most_langs languages
        parts.setdefault(r.lang, []).append((r.h, r.part))
    out = {}
    for lang, own in sorted(parts.items()):
        lines = dict.fromkeys(letters(line) for _, part in sorted(own) for line in part.split("\n"))
        out[lang] = " ".join(lines).strip().encode()[:dict_bytes].decode(errors="ignore").encode()
    return {lang: content for lang, content in out.items() if content}


class Classifier:
    def __init__(self, contents: dict[str, bytes], min_margin: float = MIN_MARGIN, level: int = LEVEL):
        self.langs, self.min_margin = sorted(contents), min_margin
        self.coders = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False, level=level).compress)

    def __call__(self, text: str | None) -> tuple[str, str, float]:
        """(language or und, nearest language or und, score)."""
        raw = letters(text).encode()
        if not self.langs or not raw:
            return "und", "und", 0.0
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = np.array([sum(len(code(c)) for c in chunks) for code in self.coders], float)
        at = int(sizes.argmin())
        # bytes saved over the others, as log-odds that level off for long texts
        score = float(1 / np.exp((sizes[at] - sizes) * 8 / np.sqrt(len(raw) + 16)).sum())
        rest = np.delete(sizes, at)
        narrow = len(rest) and (rest.min() - sizes[at]) / sizes[at] < self.min_margin
        return "und" if narrow else self.langs[at], self.langs[at], score


def identify(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, nearest, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # DICT_BYTES for each of MOST_LANGS languages

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value, min_margin)
        for batch in rows:
            found = [classify(t.as_py()) for t in batch.column(1)]
            lang, nearest, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(nearest, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "nearest", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, lang_pred string, nearest string, score double")


def op2_zstd_dictionary_langid(spark, sf_dir):
    """lang_pred is the nearest language; ``accepted`` says whether the margin is wide enough for ``identify``."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", (F.col("lang_pred") != "und").alias("accepted"))
