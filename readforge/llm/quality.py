"""Quality classifier: a generalised additive model with pairwise interactions (operator 3).

Boosting goes round the features in turn. Each step fits a shallow tree (up to four leaves) to the loss
gradient of one binned feature and adds it to that feature's lookup table; then the strongest pairs get
two-way tables, grown by four-cell trees. A score is the intercept plus one table entry per feature and
pair, looked up for all rows of a batch at once.

Fitting takes at most ``TRAIN_ROWS`` labelled rows (a bounded sample by id hash), whatever ids repeat; scoring
covers every whole text, long ones too. Null text counts as empty and gets a score like any other. A document with
several labels, and each repeated document, counts once for each while the bound lasts. Labels without an id or
quality are ignored. Without labelled rows nothing is known: every score is 0.5, and ``keep_good`` keeps all rows.
Repeated rows are scored alike, a null doc_id stays null, an empty table gives no rows, and columns of any other
names are ignored (``score``) or kept as they are (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, read_table, row_blocks, text_bytes, text_or_empty

TRAIN_ROWS = 20_000
THRESHOLD = 0.7

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _HIGH = range(8)
FEATURES = ["log_bytes", "upper", "lower", "digit", "space", "line", "stop", "symbol", "high", "bytes_per_word", "distinct_words", "words_per_line", "distinct_lines", "longest_word", "marked_words", "repeated_bytes"]


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    table[[9, 11, 12, 13, 32]], table[10] = _SPACE, _LINE
    table[[ord(c) for c in ".,;:'\"?-"]] = _STOP
    return table


_TABLE = _classes()
_MARKS = tuple(b"!#$%&*|~^<>={}[]@\\/_+")


def features(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text of the buffer."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    for lo, hi in row_blocks(offsets, 4 << 20):
        part = buffer[offsets[lo] : offsets[hi]]
        size = np.diff(offsets[lo : hi + 1])
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * 8, size)
        counts = np.bincount(row + _TABLE[part], minlength=8 * (hi - lo)).reshape(-1, 8)
        same = np.zeros(len(part) + 1)
        np.cumsum(np.concatenate([[False], part[1:] == part[:-1]]) if len(part) else np.zeros(0), out=same[1:])
        cuts = offsets[lo : hi + 1] - offsets[lo]
        most = np.maximum(size, 1)
        block = out[lo:hi]
        block[:, 0] = np.log1p(size)
        block[:, 1:9] = counts[:, [_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SYMBOL, _HIGH]] / most[:, None]
        block[:, 15] = (same[cuts[1:]] - same[cuts[:-1]]) / most
        raw = part.tobytes()
        for i in range(hi - lo):
            text = raw[cuts[i] : cuts[i + 1]]
            words, lines = text.split(), text.split(b"\n")
            w = len(words)
            if not w:
                continue
            own = set(words)
            block[i, 9:15] = (len(text) / w, len(own) / w, w / len(lines), len(set(lines)) / len(lines), min(max(map(len, own)), 1000), sum(x[-1] in _MARKS for x in own) / len(own))
    return out


@dataclass
class Model:
    """Bin edges, lookup tables and the intercept, all in log-odds."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


_RIDGE = 2.0


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + _RIDGE) + gr**2 / (hr + _RIDGE) - g.sum() ** 2 / (h.sum() + _RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    _, middle = _best_cut(g, h)
    out = np.zeros(len(g))
    for lo, hi in ((0, middle), (middle, len(g))):
        if lo < hi:
            _, cut = _best_cut(g[lo:hi], h[lo:hi])
            for a, b in ((lo, lo + cut), (lo + cut, hi)):
                if a < b:
                    out[a:b] = g[a:b].sum() / (h[a:b].sum() + _RIDGE)
    return out


def _cells(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best four-cell tree over a grid."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def quarters(c: np.ndarray) -> np.ndarray:
        nw = c[1:-1, 1:-1]
        ne, sw = c[1:-1, -1:] - nw, c[-1:, 1:-1] - nw
        return np.stack([nw, ne, sw, c[-1, -1] - nw - ne - sw])

    qg, qh = quarters(cg), quarters(ch)
    gain = (qg**2 / (qh + _RIDGE)).sum(0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = qg[:, i, j] / (qh[:, i, j] + _RIDGE)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, most_pairs: int = 6, rate: float = 0.15, bins: int = 48, pair_bins: int = 10) -> Model:
    """Cyclic boosting of one-way tables, then of the tables of the strongest pairs."""
    if not len(y):
        return Model()
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    m = Model(base=float(np.log(mean / (1 - mean))))
    d = x.shape[1]
    m.edges = [_edges(x[:, j], bins) for j in range(d)]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    logit = np.full(len(y), m.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = gradient()
            step = rate * _tree(np.bincount(binned[j], g, len(m.tables[j])), np.bincount(binned[j], h, len(m.tables[j])))
            m.tables[j] += step
            logit += step[binned[j]]
    m.coarse = [_edges(x[:, j], pair_bins) for j in range(d)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
        return np.bincount(rough[a] * shape[1] + rough[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    gains = sorted(((-_cells(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(d) for b in range(a)), key=lambda t: t)
    m.pairs = [(a, b) for gain, a, b in gains[:most_pairs] if gain < 0]
    m.pair_tables = [np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(m.pairs):
            g, h = gradient()
            step = rate * _cells(grid(a, b, g), grid(a, b, h))[1]
            m.pair_tables[k] += step
            logit += step[rough[a], rough[b]]
    return m


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*text_bytes(batch.column(0)))
        yield pa.record_batch([batch.column(1), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["quality", "x", "h"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled documents, those of the smallest id hashes, outside the held-out part."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod("doc_id", 4) != 2).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("quality"))
    hashed = F.xxhash64(F.lit(3), "_id")
    known = F.broadcast(usable.withColumn("_h", hashed).orderBy("_h", "_id", "quality").limit(most_rows))  # most_rows small rows
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text")).join(known, "_id")
    rows = own.select("text", "quality", "_h").mapInArrow(_feature_batches, "quality double, x array<double>, h long")
    sample = rows.orderBy("h", "quality", "x").limit(most_rows).toPandas()  # repeated ids too count against the bound
    if not len(sample):
        return Model()
    order = np.lexsort([*np.stack(sample["x"].to_list()).T, sample["quality"].to_numpy()])  # the same model whatever order rows arrive in
    return fit(np.stack(sample["x"].to_list())[order], sample["quality"].to_numpy()[order])


def _score_batches(model: Model, text: str = "_text"):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(text))
            x = features(*text_bytes(own.fill_null("") if own.null_count else own))
            score = model.score(x) if model.tables else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_text"] + [pa.array(score)], names=[c for c in batch.schema.names if c != "_text"] + ["score"])

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    return rows.mapInArrow(_score_batches(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns as they were; all if nothing was learned."""
    if not model.tables:
        return docs
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    plain = docs.toDF(*names)
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    if plain.schema[text].dataType != StringType():
        plain, text = plain.withColumn("_text", text_or_empty(text)), "_text"
    scored = plain.mapInArrow(_score_batches(model, text), schema)
    return scored.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)


def op3_gam_pairs_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
