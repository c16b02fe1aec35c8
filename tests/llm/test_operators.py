"""Each operator on odd rows, on nothing, and against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readforge.llm import chat, common, decontaminate, langid, media, mixing, quality, sharding, simhash, suffix, warc

# ---- plain versions


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        left, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (c != d))
    return min(row)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: id -> print; the smallest id of each id's group."""
    ids, out = sorted(prints), {}
    for i in ids:
        if i in out:
            continue
        todo, out[i] = [i], i
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in out and (prints[x] ^ prints[y]).bit_count() <= 3:
                    out[y] = i
                    todo.append(y)
    return out


def plain_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


# ---- 1 decontamination


def test_edit_matching_agrees_with_plain_distances(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 40))]
        if d % 2:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(["", "x", "xy"])
            text.insert(len(text) // 2, "".join(own).upper())
        docs.append((d, " ".join(text)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=600)
    found = defaultdict(dict)
    for r in got.collect():
        found[r.doc_id] |= dict(zip(r.item_ids, r.distances, strict=True))
    for d, text in docs:
        plain = decontaminate.normalise(text)
        want = {}
        for i, item in items:
            own = decontaminate.normalise(item)
            if (e := edit_distance_inside(own, plain)) <= int(decontaminate.ERROR_RATE * len(own)):
                want[i] = e
        assert found[d] == want


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "THE quick, brown fox jumps over the lazy dog"), (2, "a"), (3, ""), (4, None), (None, "ein kleiner text"), (5, "!!! ??? 123")], "item_id long, text string")
    hits = Counter((r.doc_id, tuple(r.item_ids)) for r in decontaminate.contaminated(odd_docs, items).collect())
    assert hits == {(1, (1,)): 1, (2, (1,)): 2, (5, (5,)): 1, (7, (2,)): 1}
    clean = decontaminate.keep_clean(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() - 5
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.keep_clean(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_reworded_and_short_items_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    long = [word() for _ in range(30)]
    items = [(0, " ".join(long)), (1, "Who wrote it?"), (2, "東京はどこ")]
    reworded = list(long)
    for k in (4, 13, 22):
        reworded[k] = "zzzzzz"
    texts = [" ".join([word(), *reworded, word()]), "so: who wrote IT, then", "xwho wrote it", "who wrote its", "それで東京はどこですか", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: (r.item_ids, r.distances) for r in decontaminate.contaminated(docs, bench).collect()} == {0: ([0], [18]), 1: ([1], [0]), 4: ([2], [0])}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 3, 5]


def test_blocks_of_items_do_not_change_the_result(spark):
    items = [(i, " ".join(f"word{(i * 7 + j * j) % 50} item{i}" for j in range(5))) for i in range(6)]
    docs = spark.createDataFrame([(1, " and ".join(t for _, t in items)), (1, items[3][1]), (2, "nothing here"), (None, items[0][1] + " " + items[5][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(map(repr, decontaminate.contaminated(docs, bench, block_bytes=n).collect())) for n in (1, 600, 1 << 20)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 3


# ---- 2 language identification


def test_languages_are_told_apart(spark, odd_docs, no_docs):
    en = "the house and the street are large but this is what they have seen with their own eyes ".split()
    de = "das haus und die straße sind groß aber das ist was sie mit eigenen augen gesehen haben ".split()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=rng.randint(20, 60))), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    assert sorted(learned) == ["de", "en"] and all(got[i].nearest == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    odd = langid.identify(odd_docs, learned).collect()
    assert len(odd) == odd_docs.count() and Counter(r.nearest for r in odd if r.doc_id in (3, 4, 5, 8)) == {"und": 4}
    assert langid.learn(no_docs) == {} and {r.nearest for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    assert langid.identify(no_docs, learned).count() == 0


# ---- 3 quality


def test_tables_learn_a_pairwise_rule():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in (1, 2, 4, 5, 6, 7, 8)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(odd_docs, labels)
    got = quality.score(odd_docs, m).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(odd_docs, m, 0.0).columns == odd_docs.columns and quality.keep_good(odd_docs, m, 0.0).count() == odd_docs.count()
    nothing = quality.train(no_docs, labels)
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5} and quality.score(no_docs, m).count() == 0


def test_held_out_documents_do_not_teach(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(400)], "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(400)]
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.train(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


# ---- 4 SimHash


def test_prints_and_groups_agree_with_plain_ones(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    texts = defaultdict(set)
    for r in odd_docs.collect():
        texts[r.doc_id].add(plain_fingerprint(r.text))
    assert len(rows) == odd_docs.count() and all(r.fp % 2**64 in texts[r.doc_id] for r in rows)
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.fp == 0} == {3}
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == sorted([1, 3, 5, 6, 7, -1])
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most_bucket", [1, 8, 4096])
def test_links_lose_no_group(spark, most_bucket):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << i for i in range(40)}
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    edges = simhash.links(frame, most_bucket)
    got = {r.node % 2**64: r.component for r in common.connected_components(edges, "a", "b").collect()}
    want = plain_components({x: x for x in prints})
    groups = lambda m: {frozenset(g) for k in set(m.values()) if len(g := [x for x in m if m[x] == k]) > 1}
    assert groups(got) == groups(want)


def test_chains_keep_all_close_pairs():
    rng = np.random.default_rng(5)
    bits = np.zeros(2000, np.uint64)
    for k in range(3):
        bits ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    assert simhash.chain_viable(bits).all()
    many = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    assert not simhash.chain_viable(many).all()
    for x in [*many[:300].tolist(), *bits[:300].tolist(), 0, 2**64 - 1]:
        own = [(x >> 8 * i & 255).bit_count() for i in range(8)] * 2
        plain = any(all(sum(own[start : start + n]) <= 3 * n // 8 for n in range(1, 9)) for start in range(8))
        assert simhash.chain_viable(np.array([x], np.uint64))[0] == plain


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (7, 8), (8, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(60)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- 5 media


def test_media_round_trip(spark, odd_docs, no_docs):
    folder = common.run_folder(spark, "media")
    media.store(odd_docs, folder, most_file=3000)
    got = media.describe(media.read(spark, folder, range_bytes=700)).collect()
    assert len(got) == odd_docs.count()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append((r.text or "").encode())
    for r in got:
        own = [media.padded(t) for t in texts[r.doc_id] if len(t) == r.n_bytes]
        assert r.payload_sha256 in {hashlib.sha256(p).hexdigest() for p in own} and r.payload_bytes % 576 == 0
        assert r.tail_crc32 == zlib.crc32(own[0][-32:])
    empty = common.run_folder(spark, "media")
    media.store(no_docs, empty)
    assert media.read(spark, empty).count() == 0


def test_broken_members_are_tried_again_by_offset_and_then_reported(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(30)], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/m"
    media.store(docs, folder)
    reader = media.MediaReader(folder, 1 << 20, 3)
    (part,) = reader.partitions()
    whole = [r for b in reader.read(part) for r in b.to_pylist()]
    asked, plain = [], media.Reader.read_at

    def flaky(self, offset, length):
        data = plain(self, offset, length)
        asked.append((offset, length))
        if len(asked) == 3:  # the block of members, with one of them spoilt
            return data[:1000] + bytes([data[1000] ^ 1]) + data[1001:]
        if len(asked) == 4:
            raise OSError("not now")
        return data

    monkeypatch.setattr(media.Reader, "read_at", flaky)
    again = [r for b in reader.read(part) for r in b.to_pylist()]
    assert again == whole and len(whole) == 30 and len(asked) == 5  # foot, offsets, block, and two tries for one member
    asked.clear()
    monkeypatch.setattr(media.Reader, "read_at", lambda self, offset, length: flaky(self, offset, length) if len(asked) < 2 else b"\1" * length)
    with pytest.raises(OSError):
        list(reader.read(part))


# ---- 6 substrings


@pytest.mark.parametrize(("length", "gram", "hot"), [(20, 6, 1000), (20, 6, 3), (200, 64, 20000)])
def test_removal_agrees_with_plain_search(spark, length, gram, hot):
    rng = random.Random(6)
    rnd = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    base = [rnd(300) for _ in range(6)]
    texts = [None, "", rnd(10), "a" * 500, "a" * (length - 1), "é" * 150 + base[0], "é" * 150]
    for _ in range(40):
        texts.append("".join((b := rng.choice(base))[(x := rng.randrange(280)) : x + rng.randint(5, 300)] + rnd(rng.randint(0, 60)) for _ in range(rng.randint(1, 4))) if base else b)
    texts += [texts[-1], texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, length, gram, hot).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, length)


def test_removal_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 50_000)
    rows = odd_docs.collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(odd_docs).collect())
    assert got == Counter((r.doc_id, *x) for r, x in zip(rows, plain_removal([r.text for r in rows], 200), strict=True))
    assert suffix.remove_repeats(no_docs).count() == 0


# ---- 7 WARC


@pytest.mark.parametrize("hot", [10, 20_000])
def test_repeated_rows_do_not_multiply(spark, hot):
    text, other = "".join(chr(97 + i * i * 7 % 26) for i in range(300)), "".join(chr(97 + i * i * 11 % 25) for i in range(260))
    rows = [(7, text)] * 40 + [(None, other)] * 30 + [(8, "x" + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, 50, 16, hot).collect())
    assert got == Counter((i, *p) for (i, _), p in zip(rows, plain_removal([t for _, t in rows], 50), strict=True))
    # each row has its windows once, at most
    assert suffix.repeated_spans(suffix.keyed(docs), 50, 16, hot).count() <= sum(len(t) for _, t in rows)


def test_warc_round_trip(spark):
    page = "<p>ü</p>\r\n\r\nWARC/1.1 " * 20
    rows = [(3, "http://a/ü", page, 1), (1, None, page, 2), (1, None, page, 2), (None, "u", page, 3), (2, "u\nv", "short", 4), (4, "u", "short", 5), (5, "u", None, 6), (6, "u", "x" * 3_000_000, 7), (None, "u", "y" * 200, 8), (None, "v", "y" * 200, 9)]
    got = warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string, digest long")).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == Counter((p, sha(h), len((h or "").encode())) for p, _, h, _ in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == sha(page))
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (3, "revisit", 1): 1, (None, "revisit", 1): 1}
    assert Counter(r.record_type for r in got if r.payload_digest == sha("y" * 200)) == {"response": 1, "revisit": 1}
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    assert warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_several_files_and_ranges(spark):
    rows = [(i, "u", f"page {i} " * 40) for i in range(50)]
    folder = common.run_folder(spark, "warc")
    files = common.materialize(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder + "/raw", most_file=4000), "t")
    ranges = common.materialize(warc.normalise(files, folder + "/members", step=3), "t")
    assert files.count() > 3 and ranges.count() > 16 and sorted(r.page_id for r in warc.read(ranges).collect()) == list(range(50))


# ---- 8 mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, rest = set(), sum(sizes.values())
    while True:
        left = rest - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * w[s] / share >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / share for s in order}
        full |= over
        if len(full) == len(order):
            return {s: most * sizes[s] for s in order}


@pytest.mark.parametrize("per_bucket", [7, 5000])
def test_mix_hits_its_targets(spark, per_bucket):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "b", "b", "B", "ä", None, "zz"])) for i in range(900)] + [(1000, "one", "lonely"), (1001, "", "empty")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), per_bucket=per_bucket).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 3
    want = plain_targets(dict(sizes))
    assert all(abs({r.source: r.target for r in got}[s] - t) < 1e-6 for s, t in want.items())
    assert all(abs(taken[s] - t) <= 15.5 for s, t in want.items())
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), per_bucket=11)
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again.collect()}


def test_weighted_mix_prefers_heavy_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", 1.0 if i % 2 else 3.0) for i in range(2000)] + [(9000 + i, "w " * 10, "b", 1.0) for i in range(500)], "doc_id long, text string, source string, v double")
    got = mixing.mix(docs, weight=F.col("v")).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("light")).agg(F.sum("copies").alias("n"), F.first("target").alias("t")).collect()
    n = {r.light: r.n for r in got}
    assert 2 < n[0] / n[1] < 4.5 and abs(10 * sum(n.values()) - got[0].t) <= 10


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    docs = mixing.mixed_documents(odd_docs)
    assert docs.columns == odd_docs.columns and docs.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


# ---- 9 sharding


def test_shards_are_even_and_copies_stay_together(spark):
    rng = random.Random(9)
    rows = [(i, f"text {rng.randrange(400) if i % 2 else i}") for i in range(1500)] + [(2000 + i, "a large group") for i in range(700)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    groups = defaultdict(list)
    for r in got:
        groups[r.text_crc32].append(r.shard)
    cut = sum(len(g) - max(Counter(g).values()) for g in groups.values() if 1 < len(g) < 700)
    linked = sum(len(g) for g in groups.values() if 1 < len(g) < 700)
    assert cut < 0.25 * linked


def test_groups_that_fit_are_not_cut(spark):
    rows = [(i, f"group {i // 20}" if i < 400 else f"pair {i // 2}" if i < 600 else f"alone {i}") for i in range(1800)]
    groups = defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        groups[r.text_crc32].add(r.shard)
    assert {len(g) for g in groups.values()} == {1}


def test_sharding_of_odd_rows(spark, odd_docs, no_docs):
    got = sharding.shard(odd_docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert max(Counter(r.shard for r in got).values()) == 1 and sharding.shard(no_docs).count() == 0


def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    rows = common.ranked(df, ["g"], F.xxhash64("id"), "r", per_bucket=50).collect()
    assert all(sorted(r.r for r in rows if r.g == g) == list(range(len(range(g, 1000, 3)))) for g in range(3))


# ---- 10 chat


def test_control_strings_survive(spark):
    texts = ["", "\\", "\\\\", "<|im_end|>\n", "<|im_start|>assistant ok", "<\\|", "\\n\n\\|", "<<|>|", "é😀<|", "a\\<|b", None]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "we\nird\\n<|", None) for t in texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.chat(frame)).collect()
    assert len(got) == 1
    assert [(t.role, t.text) for t in got[0].turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert got[0].loss == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert got[0].formatted.count("<|im_start|>") == len(rows)


def test_best_branches_are_chosen(spark):
    rows = [("t", "a", None, "user", "hi", 0.0), ("t", "b", "a", "assistant", "B", 1.0), ("t", "c", "a", "assistant", "C", 5.0), ("t", "d", "b", "user", "D", 9.0), ("t", "e", "gone", "user", "E", 0.5), ("u", "x", "y", "user", "X", 1.0), ("u", "y", "x", "user", "Y", 1.0), ("u", "z", "x", "user", "Z", 1.0)]
    frame = spark.createDataFrame(rows, "conv_id string, node string, parent string, role string, text string, score double")
    got = {(r.conv_id, r.leaf): [t.text for t in r.turns] for r in chat.read_back(chat.chat(frame, top=2)).collect()}
    assert got == {("t", "d"): ["hi", "B", "D"], ("t", "c"): ["hi", "C"]}


def test_long_and_null_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(150)] + [(None, None, None, None), (None, 1, "user", "n"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    got = {r.conv_id: r.turns for r in chat.read_back(chat.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t.text for t in got[1]] == [f"m{i}" for i in range(150)] and [t.text for t in got[None]] == ["", "n"] and len(got[2]) == 2
    assert chat.chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
