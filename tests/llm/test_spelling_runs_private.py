"""Spelling variants, periodic runs and personal data against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("delayloom.llm")
from delayloom.llm import periodic_runs, personal_data, queries, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, source string, doc string, word string, shard int, runs int, spans int"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "s", "d", "w", 1, 2, 3) for i, t in texts], SCHEMA).repartition(4)


def saved(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# spelling


def one_edit(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters} | ({word[:i] + word[i + 1 :]} if i < len(word) else set()) | {word[:i] + c + word[i + 1 :] for c in letters if i < len(word)}
    return out - {word}


def expected_variants(counts, ratio=2):
    letters, out = set("".join(counts)), {}
    for w, n in counts.items():
        near = [x for x in one_edit(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(near), counts[form] if form is not None else None)
    full = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        full[w] = (form, root, *rest)
    return full


@pytest.mark.parametrize("shard_words", [7, 1000])
def test_variants_equal_all_single_edits(spark, shard_words):
    rng = random.Random(shard_words)
    counts = {"".join(rng.choice("abcé×ÿ"[: rng.choice([2, 3, 6])]) for _ in range(rng.randrange(0, 9))): rng.choice([1, 2, 3, 6, 12, 24, 99]) for _ in range(250)}
    vocabulary = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 5, "x")], "word string, n long, form string").repartition(3)
    rows = spelling.spelling_variants(vocabulary, shard_words=shard_words).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == expected_variants(counts)
    assert len(rows) == len(counts)


def test_an_index_finds_words_that_share_no_letter_with_it():
    index = spelling.FMIndex([""])
    assert [x.tolist() for x in index.one_error(["a", "", "zz"], np.array([0, 0, 1]))] == [[0], [0]]


def test_spelling_query_on_awkward_texts(spark, empty, tmp_path):
    rng = random.Random(8)
    vocabulary = ["hello", "world", "Größe", "naïve", "ÀÉÎÕÜ", "straße", "tiny", "a×b÷cd"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(1, 40)]
    texts += [(50, None), (51, ""), (52, "12 3 -"), (None, "hello hello hello"), (1, texts[0][1]), (53, "HELLO1world_hello" * 3000)]
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    rows = queries.op11_spelling(spark, saved(spark, table(spark, texts), tmp_path)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == expected_variants(counts)
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0


def test_counts_take_every_batch(spark, monkeypatch):
    df = table(spark, [(i, f"alpha{'bcdefgh'[i % 7]} alpha") for i in range(500)])
    found = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert found["alpha"] == 500 and sum(found.values()) == 1000


# periodic runs


def brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(2500):
        n, kinds, least = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 9]), rng.choice([2, 3, 5, 12])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n > 20 and rng.random() < 0.4:
            a, p = rng.randrange(n), rng.randrange(1, 9)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert [tuple(r) for r in periodic_runs.document_runs(w, least).tolist()] == brute_runs(w, least)


def test_common_prefixes_of_a_tree_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(60):
        seq = [rng.randrange(1, 3) for _ in range(rng.randrange(2, 40))] + [0]
        tours = periodic_runs.SuffixTree(seq, 3).tours(2)
        assert tours[0][0].tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
        assert tours[1][0].tolist() == sorted(range(len(seq)), key=lambda i: [-x if x else -9 for x in seq[i:]])
        i, j = np.array([(a, b) for a in range(len(seq)) for b in range(len(seq)) if a != b]).T
        plain = [next((k for k in range(len(seq)) if seq[a + k : a + k + 1] != seq[b + k : b + k + 1]), 0) for a, b in zip(i, j, strict=True)]
        assert all(periodic_runs.CommonPrefixes(*t)(i, j).tolist() == plain for t in tours)


def test_periodic_query_on_awkward_texts(spark, empty, tmp_path):
    rng = random.Random(3)
    texts = [(i, rng.choice([" ", "\n", "\x0b\t "]).join(rng.choice(["a", "b", "é", "A"]) for _ in range(rng.randrange(0, 90)))) for i in range(200)]
    texts += [(300, None), (301, ""), (302, " \n"), (None, "x y " * 40), (5, texts[5][1]), (303, " z " * 9000), (304, " ".join(str(k % 700) for k in range(3000)))]
    got = queries.op12_periodic_runs(spark, saved(spark, table(spark, texts), tmp_path)).collect()
    expected = []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in texts:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w, 12) if len(w) < 5000 else [(0, len(w), 1)]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        expected.append((i, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None) > 10
    assert periodic_runs.periodic_runs(empty).count() == 0


# personal data


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), m.end(), kind) for kind, (pattern, fits) in rules.items() for m in re.finditer(pattern, text) if fits(m)]
    return sorted(found, key=lambda x: (x[0], list(rules).index(x[2])))


PIECES = ["a", "b@", "@", ".", "-", "1", "22", "255", "300", " ", "+", "(", ")", "%", "4111", "1111", "é", "\n", ".1.2.3", "x.y", "4111111111111111", "+1 (659) 555-3949", "😀", "٣"]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        spans = personal_data.find_spans(text)
        assert [(a, b, kind) for kind, a, b, base, _ in spans if base] == plain_base(text)
        held = sorted((a, b) for _, a, b, base, _ in spans if not base)
        assert all(x[1] <= y[0] for x, y in zip(held, held[1:])) and all(b <= a2 or b2 <= a for a, b in held for a2, b2, _ in plain_base(text))


@pytest.mark.parametrize("text, spans", [
    ("pay 4465758382889437 4465758382889437 now", "card:4:20,card:21:37"), ("visa 4222222222222", "card:5:18"), ("4222222222222 pieces", ""), ("IBAN DE89 3704 0044 0532 0130 00 AND", "iban:5:32"), ("IBAN DE88 3704 0044 0532 0130 00", ""),
    ("call (659) 555-3949", "phone:5:19"), ("tel 0171 234 5678", "phone:4:17"), ("rows 0171 234 5678", ""), ("SSN 123-45-6789", "ssn:4:15"), ("order 123-45-6789", ""), ("SSN 000-45-6789", ""), ("bob [at] example [dot] com", "email:0:26"),
    ("2001:db8::1:2 and std::vector ab::cd", "ip:0:13"), ("é bob@a.bc 1.2.3.4", "email:2:10,ip:11:18"), ("12:30:45", ""), ("release 1.2.3.4.5", "ip:8:15"),
])
def test_further_spans(text, spans):
    assert ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in personal_data.find_spans(text)) == spans


def test_checksums():
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    assert personal_data.mod97("GB82WEST12345698765432") and not personal_data.mod97("GB83WEST12345698765432")


@pytest.mark.parametrize("piece", ["1", "1.", "a", "a:", "1 ", "+1 ", "A1", "-", "a@", "9999 ", "AA11 "])
def test_long_texts_take_linear_time(piece):
    import time

    start = time.time()
    personal_data.find_spans(piece * 200_000 + ":@")
    assert time.time() - start < 20


def test_personal_query_on_awkward_texts(spark, empty, tmp_path):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randrange(50)))) for i in range(300)]
    texts += [(400, None), (401, ""), (None, "me@x.yz"), (3, texts[3][1]), (402, "word " * 20000 + "me@x.yz")]
    got = queries.op13_personal_data(spark, saved(spark, table(spark, texts), tmp_path)).collect()
    expected = []
    for i, t in texts:
        base, spans = plain_base(t or ""), personal_data.find_spans(t)
        kinds = Counter(k for *_, k in base)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        expected.append((i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], digest, ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert personal_data.personal_data(empty, mask=True).columns == ["doc_id", "spans", "masked"]
    assert personal_data.personal_data(empty).count() == 0


def test_masks_replace_overlapping_spans_once(spark):
    df = table(spark, [(1, "write 4111111111111111@x.yz or +1 (659) 555-3949!"), (2, None), (3, "")])
    assert {r["doc_id"]: r["masked"] for r in personal_data.personal_data(df, mask=True).collect()} == {1: "write <email> or <phone>!", 2: None, 3: ""}
