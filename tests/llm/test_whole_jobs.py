"""Cases in which corpus operators once did less than the whole job."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("delayloom.llm")
from delayloom.llm import near_dedup, nearest, packing, quality_rules, queries, rules, sharding, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_sharding_parts_no_group_that_fits(spark):
    texts = ["common"] * 2000 + [f"pair {i // 2}" for i in range(2400)] + [f"five {i // 5}" for i in range(1000)] + [f"own {i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, 8).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(range(len(texts)))
    sizes, shards = Counter(r["shard"] for r in rows), defaultdict(set)
    assert set(sizes.values()) == {750}
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(750)) for k in sizes)
    for r in rows:
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert [t for t, s in shards.items() if len(s) > 1] == ["common"] and len(shards["common"]) == 3


def test_sharding_of_common_texts_is_the_same_however_they_are_met(spark, monkeypatch):
    texts = ["commön"] * 700 + [None] * 200 + [f"three {i // 3}" for i in range(600)] + [f"own {i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for hot, piece in ((1024, 10_000), (3, 7), (1, 1)):
        monkeypatch.setattr(sharding, "HOT", hot)
        monkeypatch.setattr(sharding, "SLICE", piece)
        rows = sharding.shard_documents(docs, 8).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(range(len(texts)))
        assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in rows)
        assert set(Counter(r["shard"] for r in rows).values()) == {225}
        seen.append({r["doc_id"]: r["shard"] for r in rows})
    assert seen[0] == seen[1] == seen[2]
    assert all(len({seen[0][900 + 3 * k + i] for i in range(3)}) == 1 for k in range(200))


def test_group_places_keep_quotas():
    for sizes, quota, parted in [([12, 6, 6, 6], [10] * 3, {12}), ([12, 9, 9], [10] * 3, {12}), ([5, 5, 5], [8, 7], {5}), ([4, 3, 3, 2, 2, 2], [8, 8], set())]:
        whole, rest = sharding.group_places([(0, s, n) for s, n in Counter(sizes).items()], quota)
        used = Counter()
        for _, size, count, k in whole:
            used[k] += size * count
        for _, size, into in rest:
            assert sum(into.values()) == size
            used.update(into)
        assert sum(used.values()) == sum(sizes) and all(used[k] <= q for k, q in enumerate(quota)) and {s for _, s, _ in rest} == parted


def test_packing_ids_of_the_added_token(spark):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary()[0])
    texts = ["<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|>", "one two<|endoftext|><|endoftext|>three\nfour", "<|endoftext|", "a b\n <|endoftext|>\n c", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, *queries.vocabulary()).collect()
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_pipeline_keeps_rows_without_id_and_mixes_repeated_rows_once(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    good = corpus_pipeline.quality(spark, docs, SF).orderBy("doc_id").limit(60).collect()
    tagged = [{**r.asDict(), "text": f"{r['text']} unique{k} ending{k} of{k} row{k}"} for k, r in enumerate(good)]
    null_ids, repeated = [{**x, "doc_id": None, "text": f"{x['text']} without{k}"} for k, x in enumerate(tagged[:12])], [tagged[20]] * 25
    table = spark.createDataFrame(tagged + null_ids + repeated, docs.schema).repartition(4).cache()
    kept = corpus_pipeline.quality(spark, table, SF).cache()
    judged = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert judged[tagged[20]["doc_id"], tagged[20]["text"]] == 26 and sum(i is None for i, _ in judged.elements()) == 12
    near = corpus_pipeline.near(spark, kept, SF).cache()
    after = Counter((r["doc_id"], r["text"]) for r in near.collect())
    assert set(after.values()) == {1} and sum(i is None for i, _ in after) == 12
    # The mix by itself, with rows that near() would have made one.
    for rows in (near, kept):
        words = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(corpus_pipeline.mixing.word_count(F.col("text"))).alias("n")).collect()}
        before, mixed = words(rows), corpus_pipeline.mix(spark, rows, SF).cache()
        levels = corpus_pipeline.mixing.water_levels(spark.createDataFrame(list(before.items()), "source string, source_size long"))
        copies, largest = Counter((r["doc_id"], r["text"]) for r in mixed.collect()), max(len(t.split()) for _, t in judged)
        was = Counter((r["doc_id"], r["text"]) for r in rows.collect())
        assert all(n <= 3 * was[k] for k, n in copies.items())
        assert all(abs(words(mixed).get(r["source"], 0) - r["target"]) <= largest for r in levels.collect())


def test_suffix_dedup_tells_rows_without_id_apart(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = letters(130)
    rows = [(None, letters(400) + passage + letters(300)), (None, letters(150)), (None, passage + letters(20)), (None, letters(900)), (None, letters(1200) + passage), (7, letters(600) + passage + letters(50)), (7, letters(130)), (8, passage)]
    rows += [rows[2], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    body = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    key = lambda i, t: (-(2**63) if i is None else i, body[t])
    seen, want = {}, {}
    for i, t in sorted(set(rows), key=lambda r: key(*r)):
        gone, raw = set(), t.encode()
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s : s + 100], (key(i, t), s)) < (key(i, t), s):
                gone.update(range(s, s + 100))
        want[i, t] = bytes(b for k, b in enumerate(raw) if k not in gone)
    for bucket_rows in (50, 400_000):
        got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup_suffixes(docs, 100, bucket_rows=bucket_rows).collect())
        assert got == Counter((i, len(t), want[i, t]) for i, t in rows)


@pytest.mark.parametrize("kind", ["gaussian", "one long", "few long"])
def test_neighbours_recall_on_unequal_norms(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64))
    if kind != "gaussian":
        x /= np.linalg.norm(x, axis=1)[:, None]
        x[: 1 if kind == "one long" else 14] *= 5
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in nearest.nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 50"), 20).collect():
        found[r["query_id"]].add(r["vec_id"])
    score = x[50::100] @ x.T
    score[np.arange(60), np.arange(50, 6000, 100)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(b.tolist())) / 20 for q, b in zip(range(50, 6000, 100), best, strict=True)]) >= 0.9


def test_suffix_buckets_are_many_with_few_sampled_documents(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh ") for _ in range(1000))) for i in range(60)], "doc_id long, text string")
    seen, deal = [], suffix_dedup._deal
    monkeypatch.setattr(suffix_dedup, "_deal", lambda rows, split: seen.append((rows.select("bucket").distinct().count(), len(split) + 1)) or deal(rows, split))
    assert suffix_dedup.dedup_suffixes(docs, 100, bucket_rows=10, sample_docs=2).filter("n_removed > 0").count() == 0
    assert seen[0][0] == seen[0][1] > 200
    scratch = suffix_dedup.Scratch(spark, "buckets")
    some = spark.range(300).selectExpr("id AS a", "id % 7 AS b")
    split = suffix_dedup._splitters(some, ["a", "b"], 1000, scratch, "few")
    assert split == [(i, i % 7) for i in range(1, 300)]  # fewer rows than buckets: all of them
    split = suffix_dedup._splitters(some, ["a", "b"], 100, scratch, "enough")
    assert len(split) == 99 and split == sorted(split)
    dealt = suffix_dedup._bucket([np.arange(300), np.arange(300) % 7], split)
    assert set(np.bincount(dealt)) == {3} and len(set(dealt)) == 100
    ties = [(5, i) for i in range(50)]
    assert suffix_dedup._bucket([np.full(50, 5), np.arange(50)], ties).tolist() == list(range(1, 51))


def test_long_lists_give_all_pairs_that_can_be_linked(spark):
    """Documents with a large common part and own parts: pairs in one list, linked or not, against brute force."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(240):
        own = rng.choice([2, 8, 14, 20, 26, 60])
        at = rng.randrange(0, 100)
        rows.append((i, " ".join([*base[:at], *[word() for _ in range(own)], *base[at : 120 - rng.randrange(0, 12)]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == label and 1 < len(set(label.values())) < 240


def test_close_pairs_equal_all_pairs(spark):
    rng = random.Random(10)
    rest = []
    for i in range(300):
        n = rng.randrange(5, 200)
        common = [rng.randrange(0, 1 + n // 3) for _ in range(4)]
        rest.append((rng.randrange(3), i, n, rng.randrange(5) * 1000, common, sum(common)))
    df = spark.createDataFrame(rest, "key long, doc_id long, n_shingles long, component long, common array<int>, sum_a int")
    want = set()
    for x in rest:
        for y in rest:
            if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and 100 * min(x[2], y[2]) >= 75 * max(x[2], y[2]):
                if 175 * sum(map(min, x[4], y[4])) >= 75 * (x[2] + y[2]):
                    want.add((x[1], y[1]))
    for block in (7, 500):
        got = [(r["a"], r["b"]) for r in near_dedup._close_pairs(df, suffix_dedup.Scratch(spark, "pairs"), 75, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_entries_that_nothing_can_be_linked_to_meet_nobody(spark, monkeypatch):
    """One list of texts all about 0.7 alike: none has a partner, so none is copied into blocks; linked ones beside them stay linked."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**7)}"
    base = [word() for _ in range(204)]
    rows = [(i, " ".join([*base, *[word() for _ in range(43 + i % 5)]])) for i in range(150)]
    saved, save = {}, near_dedup.Scratch.save
    monkeypatch.setattr(near_dedup.Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows}
    assert saved["rest"].count() > 500 and saved["banded"].count() == 0
    monkeypatch.undo()
    rows += [(1000 + i, " ".join([*base, *[word() for _ in range(3)]])) for i in range(150)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    label, todo = {}, set(sets)
    while todo:
        low = min(todo)
        group, new = set(), {low}
        while new:
            group |= new
            new = {b for a in new for b in todo - group if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
        todo -= group
        label |= dict.fromkeys(group, low)
    assert got == label


def test_partnered_equals_all_pairs(spark):
    rng = random.Random(14)
    rest = []
    for i in range(400):
        n = rng.randrange(5, 60)
        rest.append((rng.randrange(4), i, n, rng.randrange(n + 1) if i % 3 else n))
    for percent in (75, 60, 100):
        can = lambda x, y: x[0] == y[0] and (100 + percent) * min(x[3], y[3]) >= percent * (x[2] + y[2])  # noqa: B023, E731
        want = {x[1] for x in rest if any(can(x, y) for y in rest)}
        df = spark.createDataFrame(rest, "key long, node long, n_shingles long, sum_a int")
        got = [r["node"] for r in near_dedup._partnered(df, percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert 0 < len(want) < 400


def test_quality_forest_counts_every_labelled_document(spark):
    """More labelled rows than were once sent to the driver: statistics used and threshold are those of all of them."""
    rng = random.Random(15)
    words_ = ["river", "stone", "of", "and", "light", "winter", "a", "bridge", "open", "letter"]
    docs, labels = [], []
    for i in range(17_000):
        bad = rng.random() < 0.1
        docs.append((i, " ".join(rng.choice(words_) + ("#" if bad and rng.random() < 0.5 else "") + rng.choice(["", "", ".", "s"]) + str(rng.randrange(99)) * (rng.random() < 0.3) for _ in range(rng.randrange(50, 70)))))
        labels.append((i, int(not bad)))
    docs_, labels_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    forest = quality_rules.fit_quality_forest(docs_, labels_)
    known = [(t, q) for (i, t), (_, q) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    counts = [rules.rule_counts(t) for t, _ in known]
    passed = np.array([not quality_rules.base_failed(c[0], c[4]) for c in counts])
    x, good = np.array([rules.profile(t) for t, _ in known])[passed], np.array([q == 1 for _, q in known])[passed]
    assert passed.sum() > 12_500 and forest.use.tolist() == quality_rules.telling(x, good, 0.2).tolist()
    score = forest.score(x)
    floor = np.quantile(score[good], 0.99)
    steps = np.unique(np.concatenate([[floor], score[score >= floor]]))
    gain = [(score[~good] > s).mean() - (score[good] > s).mean() for s in steps]
    assert abs(forest.threshold - steps[int(np.argmax(gain))]) < 1e-12 and forest.feature.shape[0] == 150
    again = quality_rules.fit_quality_forest(docs_.repartition(5), labels_)
    assert again.threshold == forest.threshold and (again.cut == forest.cut).all()


def test_shards_of_null_and_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(20)] + [(100 + i, f"text {i}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 100}) == 1 and set(Counter(r["shard"] for r in got).values()) == {20}
    placed = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (2, 1), (3, 4)], "link long, shard int")
    assert sharding.cut_groups(placed).first().asDict() == {"groups": 2, "parted": 1, "rows_of_parted": 3}


def test_scratch_is_cleared_and_needs_a_shared_folder(spark, monkeypatch):
    from pathlib import Path

    from delayloom.llm import scratch

    scratch.clear_scratch(spark)
    one = scratch.Scratch(spark, "cleared")
    one.save(spark.range(3), "rows")
    assert Path(one.path).exists() and scratch.clear_scratch(spark) == 1 and not Path(one.path).exists()

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Cluster.conf), "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(ValueError):
        scratch.shared_root(Cluster)


def test_suffix_dedup_finds_out_when_different_strings_share_a_hash(spark):
    """With one bit of the first hash nearly all strings look alike; few buckets with many rows give the same."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, lead = letters(260), letters(16)
    rows = [(i, letters(300) + (passage if i % 3 == 0 else "") + lead + letters(150)) for i in range(12)]
    rows += [(20, "ab" * 400), (21, letters(40) + "ab" * 100), (22, rows[0][1]), (23, rows[0][1]), (24, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = {}, {}
    for i, t in rows:
        gone, raw = set(), t.encode()
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s : s + 100], (i, s)) < (i, s):
                gone.update(range(s, s + 100))
        want[i] = bytes(b for k, b in enumerate(raw) if k not in gone)
    for options in ({"first_bits": 1}, {"first_bits": 1, "bucket_rows": 40}, {"bucket_rows": 10, "max_buckets": 3}, {"bucket_rows": 10}):
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup_suffixes(docs, 100, **options).collect()}
        assert got == want, options
    with pytest.raises(RuntimeError):
        suffix_dedup.ATTEMPTS, before = 1, suffix_dedup.ATTEMPTS
        try:
            suffix_dedup.dedup_suffixes(docs, 100, first_bits=1)
        finally:
            suffix_dedup.ATTEMPTS = before
