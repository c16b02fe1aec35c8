"""The registered queries against plain versions, on one small folder of tables with odd rows."""

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from readforge.llm import chat, common, langid, media, quality, sharding, warc

from .test_operators import edit_distance_inside, plain_components, plain_fingerprint, plain_removal

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(21)
    words = {"en": "the house and street are large but this is what they have seen with own eyes".split(), "de": "das haus und die straße sind groß aber das ist was sie mit eigenen augen gesehen haben".split()}
    items = [(i, " ".join(rng.choice(words["en"]) + str(i) for _ in range(14))) for i in range(3)] + [(3, None), (None, "no name at all for this one")]
    docs = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choices(words[lang], k=rng.randint(5, 80)))
        docs.append((i, text.upper() + " $$ {{" if i % 5 == 0 else text + (" " + items[i % 3][1] if i % 10 == 3 else ""), lang, rng.choice(["a", "b", None]), 0, "s", 1))
    docs += [docs[3]] * 3 + [(200, docs[3][1], "en", "a", 0, None, None), (201, None, None, None, None, None, None), (None, "", "en", None, 0, None, 0), (None, docs[7][1], "de", "b", 0, None, 0), (202, "½ ²", "de", "a", 3, None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(120)] + [(1, None, None), (None, 1, 0), (3, 1, 1), (3, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def run(spark, folder, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, folder).collect()


def test_op1(spark, folder, docs):
    from readforge.llm import decontaminate as d

    items = {r.item_id: d.normalise(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.item_id is not None and r.text}
    want = Counter()
    for r in docs:
        far = {i: edit_distance_inside(t, d.normalise(r.text)) for i, t in items.items()}
        found = {i: e for i, e in far.items() if e <= int(d.ERROR_RATE * len(items[i]))}
        if found:
            want[r.doc_id, len(found), min(found.values()), ",".join(map(str, sorted(found)))] += 1
    assert Counter((r.doc_id, r.n_items, r.least_distance, r["items"]) for r in run(spark, folder, "op1_pigeonhole_decontamination")) == want and want


def test_op2(spark, folder, docs):
    learned = langid.learn(spark.read.parquet(f"{folder}/documents.parquet"))
    coders = {}
    for lang, content in learned.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=langid.LEVEL)  # as level and dictionary alone give other parameters
        coders[lang] = zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False, level=langid.LEVEL)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        raw = " ".join(words).encode()
        sizes = {lang: sum(len(c.compress(raw[i : i + langid.CHUNK])) for i in range(0, len(raw), langid.CHUNK)) for lang, c in coders.items()}
        return min(sorted(sizes), key=sizes.get) if raw else "und"

    got = run(spark, folder, "op2_zstd_dictionary_langid")
    assert Counter((r.doc_id, r.lang_pred, r.held_out) for r in got) == Counter((r.doc_id, plain(r.text), held(r.doc_id)) for r in docs)
    assert {r.lang_pred for r in got if r.doc_id in (201, 202)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got if r.held_out}
    known = [r for r in docs if r.doc_id in by and r.doc_id is not None and r.doc_id < 120]
    assert sum(by[r.doc_id] == r.lang for r in known) >= 0.95 * len(known)


def test_ties_and_narrow_margins_are_rejected():
    same = langid.Classifier({"b": b"one two three four", "a": b"one two three four"})
    assert same("one two three")[:2] == ("und", "a")
    assert langid.Classifier({"a": b"one two three four " * 9, "b": b"\0"})("one two three four one two three four")[0] == "a"
    assert langid.letters("½ ² 3 Ⅷ _") == "" and langid.letters("Été हिन्दी x²") == "été हिन्दी x"


def test_op3(spark, folder, docs):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    m = quality.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))

    def plain(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        (x,) = quality.features(raw, np.array([0, len(raw)]))
        bin_ = lambda edges, v: sum(e <= v for e in edges)
        total = m.base + sum(t[bin_(e, v)] for e, t, v in zip(m.edges, m.tables, x, strict=True))
        total += sum(t[bin_(m.coarse[a], x[a]), bin_(m.coarse[b], x[b])] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
        return 1 / (1 + np.exp(-total))

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    got = run(spark, folder, "op3_gam_pairs_quality")
    assert Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in got) == Counter((r.doc_id, held(r.doc_id), round(s, 9), int(s >= 0.7)) for r in docs for s in [plain(r.text)])
    own = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in own) >= 0.95 * len(own)


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same")] * 300 + [(2, "other")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 50 + [(2, 0, 0)] * 7, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or quality.Model())
    quality.train(docs, labels, most_rows=20)
    assert seen == [20]


def test_without_labels_nothing_is_rejected(spark, odd_docs):
    nothing = quality.train(odd_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.keep_good(odd_docs, nothing).count() == odd_docs.count()


def test_op4(spark, folder, docs):
    known = {}
    for k, r in enumerate(docs):
        known[k] = plain_fingerprint(r.text)
    parts = plain_components(known)
    least = defaultdict(list)
    for k, p in parts.items():
        if docs[k].doc_id is not None:
            least[p].append(docs[k].doc_id)
    want = Counter((r.doc_id, f"{known[k]:016x}", min(least[parts[k]], default=None)) for k, r in enumerate(docs))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, folder, "op4_simhash_pigeonring")) == want


def test_op5(spark, folder, docs):
    def plain(text):
        raw = (text or "").encode()
        payload = media.padded(raw)
        image = media.encode_png(payload)
        values = list(payload)
        mean = sum(values) / len(values)
        areas = [sum(values[k : k + len(values) // 64]) / (len(values) // 64) for k in range(0, len(values), len(values) // 64)]
        bright = int("".join("1" if a > mean else "0" for a in areas), 2)
        hist = ",".join(str(sum(v // 16 == b for v in values)) for b in range(16))
        sd = (sum(v * v for v in values) / len(values) - mean**2) ** 0.5
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), f"576x{len(payload) // 576} mean={mean:.3f} sd={sd:.3f} bright={bright:016x} hist={hist}"

    got = run(spark, folder, "op5_media_archives")
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == Counter((r.doc_id, *plain(r.text)) for r in docs)


def test_op6(spark, folder, docs):
    want = Counter((r.doc_id, *p) for r, p in zip(docs, plain_removal([r.text for r in docs], 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, folder, "op6_prefix_free_dedup")) == want


def test_op9(spark, folder, docs):
    got = run(spark, folder, "op9_label_propagation_sharding")
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((r.doc_id, len(raw(r.text)) + 1, zlib.crc32(raw(r.text)), "rows", None) for r in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_propagation_gathers_what_fits(spark):
    """Stars with room for all end in one shard each, as a plain search for components would place them."""
    rng = random.Random(3)
    links, n = [], 0
    for _ in range(30):
        size = rng.randint(2, 9)
        links += [(n + i, n) for i in range(1, size)]
        n += size
    nodes = spark.createDataFrame([(i, rng.randrange(4)) for i in range(n)], "node long, shard int")
    got = {r.node: r.shard for r in sharding.propagate(nodes, spark.createDataFrame(links, "a long, b long"), [n] * 4).collect()}
    cut = sum(got[a] != got[b] for a, b in links)
    assert set(got) == set(range(n)) and cut == 0


def test_repeated_rows_and_null_ids_are_sharded_in_small_tasks(spark):
    rows = [(None, "same")] * 3000 + [(5, "twice")] * 2000 + [(i, f"own {i}") for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1


def test_streams_of_several_members_and_cut_streams(spark, tmp_path):
    raw = [warc.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), "response", None) for i in range(4)]
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(raw[:2])) + gzip.compress(raw[2][:50]) + gzip.compress(raw[2][50:] + raw[3]) + b"\0" * 30)
    assert list(warc.records_of(warc._inflated(f"file://{tmp_path}/two.warc.gz"))) == raw
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(b"".join(raw))[:-9])
    with pytest.raises(ValueError):
        list(warc.records_of(warc._inflated(f"file://{tmp_path}/cut.warc.gz")))


def test_thousands_of_repeated_pages(spark):
    page = "<p>" + "x" * 200
    rows = [(None, "u", page)] * 1500 + [(7, "b", page)] * 1200 + [(7, "a", page)] * 2 + [(9, "c", page)]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(None, "revisit", 7): 1500, (7, "response", None): 1, (7, "revisit", 7): 1201, (9, "revisit", 7): 1}


def test_repeated_messages_do_not_multiply(spark):
    rows = [("t", "a", None, "user", "hi", 0.0), ("t", "b", "a", "assistant", "yo", 1.0)] * 2 + [("t", None, "a", "user", "nowhere", 9.0)]
    frame = spark.createDataFrame(rows, "conv_id string, node string, parent string, role string, text string, score double")
    assert [[t.text for t in r.turns] for r in chat.read_back(chat.chat(frame)).collect()] == [["hi", "yo"]]


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, tmp_path):
    for name, rows in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        path = f"file://{tmp_path}/{name}"
        rows.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        seen = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            seen = common.materialize(stage(spark, seen, path), "t")
            assert seen.columns == odd_docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, seen, path).count() > 0) == (name == "odd")
