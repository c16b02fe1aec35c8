"""The pipeline's stages against plain versions, each on its own input."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from readforge.llm import decontaminate, mixing, quality, simhash, similar

from .test_operators import edit_distance_inside, plain_components, plain_fingerprint, plain_targets


def corpus(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(3)]
    docs, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        text = " ".join(word() for _ in range(rng.randint(15, 40))) if good else " ".join(word().upper() + "$$$" for _ in range(rng.randint(15, 40)))
        if i % 16 == 1:
            text += " " + items[i % 3][1]
        docs.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, int(good), 0))
    docs += [(200 + i, docs[5][1], "en", "a", 0) for i in range(4)] + [(300, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_agree_with_plain_versions(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, seen = {"documents": docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, folder)
        out.write.parquet(f"{folder}/{name}.out")
        seen = spark.read.parquet(f"{folder}/{name}.out")
        kept[name] = seen.collect()
        if name != "sharding":
            assert seen.columns == docs.columns

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in kept["quality"]} == good and len(good) > 100 and not any(i % 4 == 0 and i < 160 for i in good)

    parts = plain_components({r.doc_id: plain_fingerprint(r.text) for r in kept["quality"]})
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(set(parts.values()))

    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in kept["near_duplicates"] if all(edit_distance_inside(i, decontaminate.normalise(r.text)) > int(decontaminate.ERROR_RATE * len(i)) for i in items)]
    assert sorted(r.doc_id for r in kept["decontamination"]) == sorted(clean) and len(clean) < len(kept["near_duplicates"])

    words = lambda t: len((t or "").split())
    sizes, taken, times = Counter(), Counter(), Counter(r.doc_id for r in kept["mixing"])
    for r in kept["decontamination"]:
        sizes[r.source] += words(r.text)
        taken[r.source] += times[r.doc_id] * words(r.text)
    assert max(times.values()) <= mixing.MOST and set(times) <= set(clean)
    assert all(abs(taken[s] - t) <= 25 for s, t in plain_targets(dict(sizes)).items())

    shards = defaultdict(list)
    for r in kept["sharding"]:
        shards[r.shard].append(r.slot)
    assert Counter(r.doc_id for r in kept["sharding"]) == times
    assert len(shards) == 16 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_run_gives_the_last_stage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() > 50


def test_near_duplicates_are_all_of_four_fifths(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = [word() for _ in range(12)]
    texts = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 250))]
        for c in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own + line if c % 3 == 0 else own).upper() if c % 2 else " ".join(own))
    texts += ["", " ", "ab", "AB ", "ab cd ef", " ".join(line), " ".join(line)]

    def plain(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, group = [plain(t) for t in texts], list(range(len(texts)))
    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                far += bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).count("1") > 3
                group = [group[j] if x == group[i] else x for x in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == sorted(first.values()) and 10 < len(got) < len(texts) - 20 and far > 20


def test_near_duplicates_go_through_fingerprints(spark, monkeypatch):
    """The pairs compared first connect exactly the texts that operator 4 links, and its own search finds them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = {}
    for g in range(8):
        base = [word() for _ in range(300)]
        for c in range(8):
            own = list(base)
            for _ in range(c % 4):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked, checked, found, compare = [], [], simhash.links, similar._links
    monkeypatch.setattr(simhash, "links", lambda prints, *a: asked.append(prints.count()) or found(prints, *a))
    monkeypatch.setattr(similar, "_links", lambda pairs, members: checked.append(pairs.collect()) or compare(pairs, members))
    corpus_pipeline.one_of_each_group(spark, docs, "").count()
    prints = {similar._ident(similar.words_of(t.encode())): plain_fingerprint(t) for t in texts.values()}
    parts, group = plain_components(prints), {i: i for i in prints}
    for a, b in checked[0]:
        x, y = group[a % 2**64], group[b % 2**64]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert asked == [len(set(prints.values()))] and group == parts and 8 < len(set(parts.values())) < len(prints) - 8


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """No pass over the texts gets the usual 10,000 rows at once, and none hands them back when only ids are needed."""
    seen, write = [], similar.materialize
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(df, label, rows=None):
        if "MapInArrow" in df._jdf.queryExecution().executedPlan().toString():
            seen.append((label, rows, df.columns))
        return write(df, label, rows)

    monkeypatch.setattr(similar, "materialize", watched)
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)], "doc_id long, text string")
    groups = similar.groups(docs)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and {r.component for r in groups.collect()} and spark.conf.get(key) == before
    assert {label for label, *_ in seen} >= {"similar-keys", "similar-prints", "similar-members", "similar-links", "similar-rows"}
    assert all(rows == similar.BATCH for label, rows, _ in seen if label != "similar-pairs")
    assert [label for label, _, columns in seen if "text" in columns] == ["similar-members"]
