"""Operators of the corpus package against brute force, on small tables with awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("delayloom.llm")
from delayloom.llm import line_dedup, mixing, near_dedup, nearest, packing, quality_model, quality_rules, queries, rules, sharding, suffix_dedup, token_counts  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, doc string, body int, rank_ int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages, and extra columns with clashing names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "  \t\n "), (6, "a\n\nb c"), (None, "lost and found"), (7, "é ü ß " * 40)]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(10, 40):
        edit = list(base)
        for _ in range(rng.randrange(0, 9)):
            edit[rng.randrange(len(edit))] = rng.choice(words) + "x"
        rows.append((i, " ".join(edit)))
    for i in range(40, 60):
        own = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        rows.append((i, "\n".join(own + ([passage] if i % 3 == 0 else []))))
    rows += [(60, "x y " * 3000), (61, rows[-1][1]), (61, rows[-1][1])]
    data = [(i, t, [None, "s1", "s2"][k % 3], "d", k, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


def test_sharding_is_even_and_keeps_copies_together(awkward, empty):
    rows = sharding.shard_documents(awkward, 4).collect()
    assert len(rows) == awkward.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for _, t in local(awkward)}
    assert len({r["shard"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_moves_keep_quotas():
    moves = sharding.allowed_moves([10, 10], {(0, 1): 9, (1, 0): 1}, 12)
    assert 10 - moves.get((0, 1), 0) + moves.get((1, 0), 0) <= 12 and 10 + moves.get((0, 1), 0) - moves.get((1, 0), 0) <= 12


def test_mix_meets_targets(awkward, empty):
    rows = mixing.mix_report(awkward).collect()
    assert len(rows) == awkward.count()
    assert sorted(r["size"] for r in rows) == sorted(len(words(t)) for _, t in local(awkward))
    total, target = defaultdict(int), {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        total[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(total[s] - target[s]) <= mixing.PACKET for s in target)
    assert sum(total.values()) == sum(r["size"] for r in rows)
    assert mixing.mix_report(empty).count() == 0


def brute_lines(rows, least):
    docs = sorted({(-(2**63) if i is None else i, t) for i, t in rows if t is not None})
    first, blocks = {}, []
    for i, t in docs:
        kept = [x for x in t.split("\n") if words(x)]
        n = [len(words(x)) for x in kept]
        for s in range(len(kept)):
            for e in range(s + 1, len(kept) + 1):
                if sum(n[s:e]) >= least:
                    key = tuple(kept[s:e])
                    first.setdefault(key, (i, s))
                    blocks.append((i, t, s, e, key))
    gone = defaultdict(set)
    for i, t, s, e, key in blocks:
        if first[key] < (i, s):
            gone[i, t].update(range(s, e))
    return {k: len(v) for k, v in gone.items()}


def test_line_dedup_equals_brute_force(awkward, empty):
    rows = local(awkward)
    want = brute_lines(rows, 12)
    got = line_dedup.dedup_lines(awkward, 12).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*awkward.columns, "n_lines", "n_removed"}
    text = {(r["doc_id"], r["rank_"]): r for r in awkward.collect()}
    for r in got:
        before = text[r["doc_id"], r["rank_"]]["text"]
        key = (-(2**63) if r["doc_id"] is None else r["doc_id"], before)
        assert r["n_removed"] == want.get(key, 0)
        assert (r["text"] is None) == (before is None)
    assert line_dedup.dedup_lines(empty, 12).count() == 0


def test_packing_round_trip(awkward, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary()[0])
    ids, copies = {}, Counter()
    for i, x in local(awkward):
        ids[i] = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        copies[i] += 1
    assert max(copies.values()) == 2
    pieces, bins = Counter(), defaultdict(list)
    for r in packing.pack_documents(awkward, *queries.vocabulary()).collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"], r["start"], r["length"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in copies.items():
        parts = sorted((start, length, c) for (doc, start, length), c in pieces.items() if doc == i)
        assert all(c == n for _, _, c in parts) and sum(x for _, x, _ in parts) == len(ids[i])
        assert [a for a, _, _ in parts] == list(np.cumsum([0, *[x for _, x, _ in parts]])[:-1])
    for parts in map(sorted, bins.values()):
        assert [a for a, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
    assert max(sum(n for _, n in b) for b in bins.values()) <= 2048 and sorted(bins) == list(range(len(bins)))
    assert packing.pack_documents(empty, *queries.vocabulary()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(queries.vocabulary()[0]), packing.Encoder(*queries.vocabulary())
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\xa0", "\u3000", "1", "23", "é", "中", "'s", "don't", "!", "<|endoftext|>", "<|", "end"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    for text in ["a b", "a  b", " a", "a ", "a\n\nb", "don't it's", "é ü 12 3.5!!", "<|endoftext|> x", *texts]:
        assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_harmonic_cut_fills_bins():
    for n in range(1, 5000):
        parts = packing.cut(n, 2048, 16)
        assert sum(p for p, _ in parts) == n and all(p * k <= 2048 and p * (k + 1) > 2048 or p == 2048 // k for p, k in parts)


def brute_counts(text):
    w = [x.decode() for x in words(text)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_rule_counts_equal_brute_force(awkward, documents):
    for _, t in local(awkward) + local(documents.limit(200)):
        assert rules.rule_counts(t) == brute_counts(t)


def test_quality_rules_keep_clean_documents(spark, documents, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.fit_quality_forest(documents, labels)
    rows = quality_rules.quality_verdicts(documents, forest).filter("NOT base_failed").join(labels, "doc_id").collect()
    rate = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert rate(1) > 0.97 and rate(0) < 0.25
    assert quality_rules.quality_verdicts(empty, forest).count() == 0
    assert quality_rules.fit_quality_forest(empty, labels).threshold == 1.0


def path_length(forest, tree, x):
    """Depth at which one row ends in one tree, walked node by node."""
    at = 0
    while forest.feature[tree, at] >= 0:
        at = forest.left[tree, at] + int(x[forest.feature[tree, at]] > forest.cut[tree, at])
    return forest.depth[tree, at]


def test_quality_verdicts_row_by_row(spark, awkward, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.fit_quality_forest(documents, labels)
    mixed = awkward.select("doc_id", "text", "source").unionByName(documents.limit(150).select("doc_id", "text", "source"))
    want = []
    for i, t in local(mixed):
        n, chars, symbols, dup, repeat = brute_counts(t)
        failed = n < 50 or 100 * repeat > 50 * n
        x = np.array(rules.profile(t))[forest.use]
        score = 2 ** (-np.mean([path_length(forest, k, x) for k in range(len(forest.feature))]) / forest.scale)
        want.append((str(i), n, chars, symbols, dup, repeat, failed, bool(not failed and score <= forest.threshold + 1e-12)))
    got = [(str(r["doc_id"]), *[r[c] for c in quality_rules.COUNTS], r["base_failed"], r["kept"]) for r in quality_rules.quality_verdicts(mixed, forest).collect()]
    assert sorted(got) == sorted(want)
    passing = Counter(local(quality_rules.passing(awkward, forest)))
    kept = {(i, t) for (i, t), w in zip(local(mixed), want, strict=True) if w[-1]}
    assert passing == Counter(x for x in local(awkward) if x in kept)


def test_forest_uses_what_tells_labels_apart():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    good = np.arange(400) < 380
    x[:, 1] = np.where(good, 0.0, 1 + x[:, 1])
    assert quality_rules.telling(x, good, 0.2).tolist() == [1]
    forest = quality_rules.fit_forest(x[:, [1]])
    assert (forest.score(x[~good][:, [1]]).min() > forest.score(x[good][:, [1]]).max()) and quality_rules.telling(x, np.ones(400, bool), 0.2).tolist() == [0, 1, 2]


def brute_suffix(rows, size):
    seen, out = {}, {}
    for i, t in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}):
        raw = t.encode()
        for s in range(len(raw) - size + 1):
            seen.setdefault(raw[s : s + size], (i, s))
    for i, t in {(-(2**63) if i is None else i, t or "") for i, t in rows}:
        raw, gone = t.encode(), set()
        for s in range(len(raw) - size + 1):
            if seen[raw[s : s + size]] < (i, s):
                gone.update(range(s, s + size))
        out[i] = bytes(b for k, b in enumerate(raw) if k not in gone)
    return out


@pytest.mark.parametrize("bucket_rows", [50, 400_000])
def test_suffix_dedup_equals_brute_force(awkward, empty, bucket_rows):
    want = brute_suffix(local(awkward), 100)
    for r in suffix_dedup.dedup_suffixes(awkward, 100, bucket_rows=bucket_rows).collect():
        assert bytes(r["kept"]) == want[-(2**63) if r["doc_id"] is None else r["doc_id"]], r["doc_id"]
        assert r["n_removed"] == r["n_bytes"] - len(r["kept"])
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_longest_match_counts_greedy_pieces(awkward, documents, empty):
    import base64

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = {base64.b64decode(x.split()[0]) for x in open(path, "rb") if x.strip()}
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = 0
        while word:
            k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary)
            word, n = word[k:], n + 1
        return n

    small = awkward.unionByName(documents.limit(60).selectExpr("doc_id + 1000 AS doc_id", "text", "source", "'d' AS doc", "0 AS body", "0 AS rank_"))
    want = Counter((i, len(words(t)), sum(greedy(b" " + w) for w in words(t))) for i, t in local(small))
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(small, path).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0
    m = token_counts.LongestMatch([b"a", b"ab", b"abcd", b"c"])
    assert [m.count(w) for w in (b"abc", b"abcd", b"aba", b"abcx")] == [2, 1, 2, 1]


def test_quality_model_on_held_out_rows(spark, documents, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit_quality_model(documents, labels)
    rows = quality_model.score_documents(documents, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert quality_model.score_documents(empty, model).count() == 0


def walk(model, tree, x):
    at = 0
    for _ in range(model.depth):
        at = 2 * at + 1 + int(x[model.feature[tree, at]] > model.cut[tree, at])
    return model.leaf[tree, at - (2**model.depth - 1)]


def test_quality_scores_row_by_row(spark, awkward, documents, empty):
    model = quality_model.fit_quality_model(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for i, t in local(awkward):
        x = rules.profile(t)
        want.append((str(i), round(1 / (1 + np.exp(-(model.start + sum(walk(model, k, x) for k in range(len(model.leaf)))))), 9)))
    got = [(str(r["doc_id"]), round(r["score"], 9)) for r in quality_model.score_documents(awkward, model).collect()]
    assert sorted(got) == sorted(want) and len(got) == awkward.count()
    none = quality_model.fit_quality_model(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_documents(awkward, none).collect())


def test_boosting_learns_a_threshold():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4))
    y = (x[:, 2] > 0.4).astype(float)
    p = quality_model.fit_boosted(x, y, trees=30).score(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97


def recall(x, found, k=20):
    """Share of the true ``k`` nearest, by brute force, and that ranks and scores are right."""
    hits = total = 0
    for q, rows in found.items():
        score = {i: float(np.add.reduce(v * x[q])) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:k]
        rows = sorted(rows)
        assert [r for r, _, _ in rows] == list(range(1, len(best) + 1))
        assert all(score[i] == s for _, i, s in rows) and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits, total = hits + len({i for _, i, _ in rows} & set(best)), total + len(best)
    return hits / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_in_one_block(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect()}
    found = defaultdict(list)
    for r in nearest.nearest_neighbours(v, v.filter("vec_id % 20 = 0"), 20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in x if i % 20 == 0} and recall(x, found) >= 0.95


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, None), (20, [0.0] * 3), (40, [1.0, None]), (60, [1.0, nan]), (None, [1.0, 2.0]), (80, [1.0, 2.0]), (81, [1.0, 2.0]), (100, [1e160, 1.0, 0.0]), (101, [2.0, 0.0, 0.0]), (102, [0.0, 5.0, 0.0])]
    rows += [(120, [1.0]), (120, [1.0]), (121, [2.0])]
    v = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "vec_id long, embedding array<double>, b int, c string")
    found = defaultdict(list)
    for r in nearest.nearest_neighbours(v, v.filter("vec_id % 20 = 0"), 20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in found.items()} == {80: [(1, 81, 5.0)], 100: [(1, 101, 2e160), (2, 102, 5.0)], 120: [(1, 121, 2.0)]}
    assert nearest.nearest_neighbours(v.limit(0), v.limit(0), 20).count() == 0


def test_near_duplicates_equal_brute_force(awkward, empty):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in local(awkward) if i is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_texts_under_one_id_keep_their_links(spark):
    rng = random.Random(12)
    text = lambda: [rng.choice(["k", "m"]) + str(rng.randrange(900)) for _ in range(80)]
    near = lambda w: w[:-2] + ["q", "r"]
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(9, a), (9, b), (9, b), (5, near(a)), (7, near(b)), (20, c), (21, near(c)), (21, d), (30, near(d)), (30, e), (40, near(e)), (50, text())]
    documents = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(documents).collect()}
    assert got == {(9, 5), (5, 5), (7, 5), (20, 20), (21, 20), (30, 20), (40, 20), (50, 50)}


def test_pipeline_stages(spark, tmp_path, awkward):
    import corpus_pipeline

    docs = awkward.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1, 62)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / name.replace(" ", "")))
        at = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in pieces) == at.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
