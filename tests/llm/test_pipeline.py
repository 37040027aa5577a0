"""Every stage of the pipeline against a brute-force version, on real rows and awkward ones."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from delayloom.llm import mixing, quality_rules, queries, rules  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input rows of each stage, and what the last one gave, as lists of plain tuples."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    at = {c: i for i, c in enumerate(docs.columns)}
    longest = sorted((r for r in rows if r[at["text"]]), key=lambda r: -len(r[at["text"]]))[:12]
    set_ = lambda r, **new: tuple(new.get(c, r[i]) for c, i in at.items())
    rows += [set_(longest[0], doc_id=None), set_(longest[1], doc_id=None, source=None), longest[2], longest[2], set_(longest[3], doc_id=900001), set_(longest[4], doc_id=longest[5][at["doc_id"]])]
    rows += [set_(longest[6], doc_id=900002, text=longest[6][at["text"]] + " and a few more words at the end"), set_(longest[7], text=None, doc_id=900003), set_(longest[8], text="", doc_id=900004)]
    folder = tmp_path_factory.mktemp("pipeline")
    table, seen = spark.createDataFrame(rows, docs.schema).repartition(3), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        table.write.parquet(f"{folder}/{k}")
        table = spark.read.parquet(f"{folder}/{k}")
        seen.append([r.asDict() for r in table.collect()])
        table = stage(spark, table, SF)
    seen.append([r.asDict() for r in table.collect()])
    forest = quality_rules.fit_quality_forest(spark.read.parquet(f"{folder}/0"), spark.read.parquet(f"{SF}/labels.parquet"))
    return seen, forest


def bag(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def words(text):
    return (text or "").encode().split()


def test_quality_stage(stages):
    seen, forest = stages

    def passes(text):
        n, *_, repeat = rules.rule_counts(text)
        if n < 50 or 100 * repeat > 50 * n:
            return False
        x, depth = np.array(rules.profile(text))[forest.use], []
        for k in range(len(forest.feature)):
            at = 0
            while forest.feature[k, at] >= 0:
                at = forest.left[k, at] + int(x[forest.feature[k, at]] > forest.cut[k, at])
            depth.append(forest.depth[k, at])
        return 2 ** (-np.mean(depth) / forest.scale) <= forest.threshold + 1e-12

    assert bag(seen[1]) == bag(r for r in seen[0] if passes(r["text"])) and 0 < len(seen[1]) < len(seen[0])


def test_line_stage(stages):
    before, after = stages[0][1:3]
    lines = {}
    for r in before:
        kept = [(i, x) for i, x in enumerate(r["text"].split("\n")) if words(x)]
        lines[(-math.inf if r["doc_id"] is None else r["doc_id"], r["text"])] = kept
    # Rows under one id are ordered by a hash of their text; here only their being different matters.
    first = {}
    for key in sorted(lines):
        kept, n = lines[key], [len(words(x)) for _, x in lines[key]]
        for a in range(len(kept)):
            total = 0
            for b in range(a, min(len(kept), a + 60)):
                total += n[b]
                if total >= 30:
                    first.setdefault(tuple(x for _, x in kept[a : b + 1]), (key, a))
    want = []
    ids = Counter(k for k, _ in lines)
    for r in before:
        key = (-math.inf if r["doc_id"] is None else r["doc_id"], r["text"])
        kept, n, gone = lines[key], [len(words(x)) for _, x in lines[key]], set()
        for a in range(len(kept)):
            total = 0
            for b in range(a, min(len(kept), a + 60)):
                total += n[b]
                if total >= 30 and first[tuple(x for _, x in kept[a : b + 1])] < (key, a):
                    gone.update(i for i, _ in kept[a : b + 1])
        if len(gone) < len(kept) or not gone:
            text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone)
            want.append(r | {"text": text, "n_chars": len(text) if gone else r["n_chars"]})
    alone = lambda rows: bag(r for r in rows if ids[-math.inf if r["doc_id"] is None else r["doc_id"]] == 1)
    assert alone(after) == alone(want) and len(after) < len(before) + 1


def test_near_stage(stages):
    before, after = stages[0][2:4]

    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = defaultdict(set)
    for r in before:
        if r["doc_id"] is not None:
            sets[r["doc_id"]].add(shingles(r["text"]))
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    want, once = [], set()
    for r in before:
        if r["doc_id"] is None:
            want.append(r)
        elif root(r["doc_id"]) == r["doc_id"] and (r["doc_id"], r["text"]) not in once:
            once.add((r["doc_id"], r["text"]))
            want.append(r)
    assert bag(after) == bag(want) and sum(r["doc_id"] is None for r in after) > 0


def test_mix_stage(stages):
    before, after = stages[0][3:5]
    size = [len(words(r["text"])) for r in before]
    sources = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, before, strict=True) if r["source"] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, free, budget = {}, list(sources), sum(total.values())
    while free:  # pour what is left by weight; sources that overflow are full
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * total[s]]
        for s in full or free:
            target[s] = 3 * total[s] if full else level * weight[s]
        free = [s for s in free if s not in target]
    packets = []
    for place, s in enumerate(sources):
        key = lambda i: (hashlib.md5(("mix" if before[i]["doc_id"] is None else f"mix|{before[i]['doc_id']}").encode()).hexdigest(), before[i]["doc_id"] or 0, size[i])
        start = 0
        for turn in range(3):
            for i in sorted((i for i, r in enumerate(before) if r["source"] == s), key=key):
                for at in range(0, size[i], mixing.PACKET):
                    n = min(mixing.PACKET, size[i] - at)
                    packets.append(((start + at + n) / target[s], place, start + at, i, turn, n))
                start += size[i]
    taken, spent = Counter(), 0
    for *_, i, turn, n in sorted(packets):
        taken[i, turn] += max(0, min(n, budget - spent))
        spent += n
    want = [before[i] for (i, _), n in taken.items() if 2 * n >= size[i] and n]
    assert bag(after) == bag(want)
    mixed = Counter()
    for r in after:
        mixed[r["source"]] += len(words(r["text"]))
    assert all(abs(mixed[s] - target[s]) <= max(size) / 2 + mixing.PACKET for s in sources)


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    docs, pieces = stages[0][4:6]
    t = Tokenizer.from_file(queries.vocabulary()[0])
    ids = {r["doc_id"]: [] for r in docs}
    for r in docs:
        ids[r["doc_id"]].append(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4"))
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    bins = defaultdict(list)
    for p in pieces:
        crcs = [zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in crcs
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in map(sorted, bins.values()):
        assert [a for a, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= 2048
    assert sorted(bins) == list(range(len(bins)))
