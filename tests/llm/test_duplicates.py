"""Decontamination and the three kinds of duplicates against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, minhash, substring, suffix
from granary.llm.common import ascii_lower_words, mixed, space_words

WORDS = ["w%d" % i for i in range(40)]


def _random_docs(r, n, shared):
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            at = r.randint(0, len(shared) - 5)
            words[len(words) // 2 : len(words) // 2] = shared[at : at + r.randint(5, 60)]
        yield (i, " ".join(words))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    shared = [r.choice(WORDS) for _ in range(120)]
    rows = list(_random_docs(r, 80, shared)) + [(200, "a " * 70), (201, "b a " * 40), (202, None), (203, ""), (None, " ".join(shared[:50]))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_hits_by_brute_force(spark, docs):
    rows, df = docs
    items = [(1, rows[3][1] or "w1"), (2, "w1 w2 w3"), (3, " ".join((rows[5][1] or "w1 w2").split()[:14])), (4, None), (1, "w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = [x.decode() for x in ascii_lower_words(text or "")]
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    for block in (10**9, 40):  # whole, and in blocks
        got = {r.doc_id: r for r in decontaminate.find_hits(df, bench, block_chars=block).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            w = [x.decode() for x in ascii_lower_words(text or "")]
            hit, found = set(), set()
            for i in range(len(w)):
                for k in range(1, 11):
                    if tuple(w[i : i + k]) in windows and i + k <= len(w):
                        hit |= set(range(i, i + k))
                        found |= windows[tuple(w[i : i + k])]
            digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (got[doc_id].n_words, got[doc_id].n_hit, got[doc_id].n_items, got[doc_id].items_sha256) == (len(w), len(hit), len(found), digest)


@pytest.mark.parametrize("segment", [30, 90, 10**6])
def test_long_and_repeated_items(spark, segment):
    """Items larger than a segment, and a benchmark row that stands there a hundred thousand times."""
    r = random.Random(9)
    items = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (300, 12, 10, 4, 60)]
    docs = [f"{' '.join(r.choice(WORDS) for _ in range(40))} {' '.join(items[k % 5].split()[a : a + 14])} x" for k, a in ((k, r.randrange(0, 280)) for k in range(40))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench = bench.unionByName(spark.range(100_000).selectExpr("1L AS item_id", f"'{items[1]}' AS text"))
    windows = {}
    for k, item in enumerate(items):
        w = item.split()
        for i in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.find_hits(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench, block_chars=200, segment_chars=segment).collect()}
    for i, text in enumerate(docs):
        w, hit, found = text.split(), set(), set()
        for a in range(len(w)):
            for n in (4, 10):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        assert got[i] == (len(hit), len(found))
    assert sum(n > 0 for n, _ in got.values()) > 5


def test_longest_matches():
    block = decontaminate.Block([("7", "a b c d e f")], 3)
    assert decontaminate.longest_matches(["x a b c d y", "d e f"], block, 3) == [(0, "7", 0, 1, 4), (1, "7", 3, 0, 3)]


def test_located_matches_by_brute_force(spark, docs):
    rows, df = docs
    items = [(1, rows[3][1] or "w1"), (2, "w1 w2"), (3, " ".join((rows[5][1] or "w1 w2").split()[:30])), (4, None), (5, rows[-1][1])]
    want = set()
    for doc_id, text in rows:
        w = [x.decode() for x in ascii_lower_words(text or "")]
        for item, other in items:
            v = [x.decode() for x in ascii_lower_words(other or "")]
            for i in range(len(v)):
                for j in range(len(w)):
                    if v[i] != w[j] or i and j and v[i - 1] == w[j - 1]:
                        continue
                    n = 1
                    while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                        n += 1
                    if n >= min(10, len(v)):
                        want.add((doc_id, str(item), i, j, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 10
    for block in (10**9, 40):
        got = [tuple(x) for x in decontaminate.locate_matches(df, bench, block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 200).astype(np.uint64)
    weights = r.random((2, 200)) * 4
    truth = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    found = []
    for salt in range(12):
        s = minhash.signatures(np.tile(mixed(a + np.uint64(salt)), 2), np.repeat([0, 1], 200), 2, 256, weights.ravel())
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - truth) < 0.03


def test_classes_by_brute_force(spark):
    r = random.Random(3)
    rows = []
    for g in range(6):
        base = [r.choice(WORDS) + r.choice(WORDS) for _ in range(120)]
        for c in range(8):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                words[r.randrange(len(words))] = "edit%d" % r.randrange(10**6)
            rows.append((g * 100 + c, " ".join(words)))
    hot = [r.choice(WORDS) + r.choice(WORDS) for _ in range(150)]
    rows += [(1000 + i, " ".join([*hot[:i], "x%d" % i, *hot[i + 1 :]])) for i in range(60)]  # a crowded bucket
    rows += [(2000, "one two"), (2001, "One, two!"), (2002, None), (2003, ""), (2004, "one three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = ascii_lower_words(t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {r.doc_id: r for r in minhash.classify(df).collect()}
    assert {i: got[i].class_id for i in sets} == {i: root(i) for i in sets}
    assert sum(r.kept for r in got.values()) == len({root(i) for i in sets})
    assert minhash.keep_first(df).count() == len({root(i) for i in sets})


def test_large_bucket_of_many_classes(spark):
    """All texts agree in the first band only, and most partners aren't leaders in it."""
    r = random.Random(5)
    rows, bands = [], {}
    for g in range(150):
        base = ["g%dx%d" % (g, i) for i in range(120)]
        for c in range(2):
            rows.append((2 * g + c, " ".join([*base[:60], "own%d" % c, *base[61:]])))
            bands[2 * g + c] = [1] + [r.getrandbits(62) for _ in range(23)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(list(bands.items()), "doc_id long, given array<long>")
    signed = minhash.sign(df).join(given, "doc_id").select("doc_id", "tag", "node", F.col("given").alias("bands")).cache()
    assert len(rows) > 2 * minhash.ALL_PAIRS
    ids = {bytes(row.node): row.doc_id for row in signed.collect()}
    got = {tuple(sorted((ids[bytes(x.a)], ids[bytes(x.b)]))) for x in minhash.links(df, signed).collect()}
    assert got == {(2 * g, 2 * g + 1) for g in range(150)}


@pytest.mark.parametrize("common", [70, 95, 106])
def test_crowded_groups_of_several_classes(spark, common):
    """Clusters around one passage, with a similarity of about 0.4, 0.6 and 0.75 to each other, in any partitioning."""
    r = random.Random(common)
    hot = ["h%d" % i for i in range(common)]
    rows = []
    for g in range(40):
        base = [*hot, *("g%dx%d" % (g, i) for i in range(124 - common))]
        for c in range(3):
            words = list(base)
            words[r.randrange(len(words))] = "own%d" % c
            rows.append((3 * g + c, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if x == old else x for i, x in label.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 7):
        assert {x.doc_id: x.class_id for x in minhash.classify(df.repartition(n)).collect()} == label


def test_classes_of_null_ids(spark):
    rows = [(5, "five words are in here"), (None, "five words are in here"), (9, "nine other words are there"), (None, "nine other words are there"), (None, "x y")]
    got = minhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), str(x.class_id), x.class_size, x.kept) for x in got) == [
        ("5", "5", 2, True), ("9", "9", 2, True), ("None", "5", 2, False), ("None", "9", 2, False), ("None", "None", 1, True),
    ]


def _windows(rows, size):
    """(doc, start) of windows that also start earlier; rows of null id come first."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = [x.decode() for x in space_words(text or "")]
        gone = set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out[doc_id] = (w, gone)
    return out


def test_repeats_by_brute_force(spark, docs):
    rows, df = docs
    for size in (5, 20):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.measure(df, size).collect()}
        for doc_id, (w, gone) in _windows(rows, size).items():
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            assert got[doc_id] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        cut = {r.doc_id: r.text for r in substring.remove_repeats(df, size).collect()}
        for doc_id, (w, gone) in _windows(rows, size).items():
            kept = [x for i, x in enumerate(w) if i not in gone]
            assert (cut[doc_id] or "").split() == kept if doc_id in cut else not kept


def test_copies_of_a_window_choose_the_same_anchor():
    r = random.Random(11)
    for _ in range(150):
        size, letters = r.choice([5, 8, 20]), r.choice([2, 3, 8, 50])
        base = [r.randrange(letters) for _ in range(60)]
        texts = []
        for _ in range(6):
            at = r.randint(0, 30)
            texts.append([r.randrange(letters) for _ in range(r.randint(0, 15))] + base[at : at + r.randint(0, 30)] + [1] * r.choice([0, 0, 40]))
        sizes = np.array([len(t) for t in texts])
        words = mixed(np.array([x * 77 + 5 for t in texts for x in t], np.uint64))
        seen, n = {}, 0
        for doc, start, count, name, _ in zip(*(x.tolist() for x in substring.anchors(words, sizes, size)), strict=True):
            for i in range(start, start + count):
                n += 1
                assert seen.setdefault(tuple(texts[doc][i : i + size]), name) == name
        assert n == sum(max(0, len(t) - size + 1) for t in texts)


@pytest.mark.parametrize("pieces", [2000, 2])
def test_byte_repeats_by_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(suffix, "PIECES", pieces)
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = []
    for i in range(40):
        a = r.randint(0, 400)
        rows.append((i, "".join(r.choice("xyz ") for _ in range(r.randint(0, 90))) + base[a : a + r.randint(100, 500)]))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, ""), (103, None), (104, "é" * 200 + "q"), (105, "x" + "é" * 200)]
    size = 60
    data = {k: (t or "").encode() for k, t in rows}
    counts = Counter(t[i : i + size] for t in data.values() for i in range(len(t) - size + 1))
    got = {r.doc_id: tuple(r)[1:] for r in suffix.measure(spark.createDataFrame(rows, "doc_id long, text string"), size, 16).collect()}
    for k, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert got[k] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_many_null_ids_are_many_documents(spark):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    words = lambda n: " ".join(letters(7) for _ in range(n))
    passage, texts = words(70), [words(62) for _ in range(2990)]
    texts += [f"{passage} {words(3)}" for _ in range(10)]
    rows = [(None, t) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n = len(passage) + 1
    got = sorted((x.n_bytes, x.n_removed) for x in suffix.measure(df).collect())
    assert len(got) == 3000 and sum(x == 0 for _, x in got) == 2990
    assert {x for _, x in got} <= {0, n, n + 1, n + 2, n + 3}  # the words behind may begin alike
    assert sorted(x.n_removed for x in substring.measure(df).collect()) == [0] * 2991 + [70] * 9


def test_repeated_rows(spark):
    """For op8 a row that repeats stands elsewhere, too; for op7 it is the same document."""
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short"), (3, "x" + text[:399]), (None, "y" * 399)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in suffix.measure(df).collect()) == [(0, 0), (1, len(text)), (1, len(text)), (2, 0), (2, 0), (3, 0)]
    assert sorted((x.doc_id or 0, x.n_removed) for x in substring.measure(df).collect())[:3] == [(0, 0), (1, 0), (1, 0)]


@pytest.mark.parametrize("hot", [False, True])
def test_byte_repeats_of_the_contract_by_brute_force(spark, monkeypatch, hot):
    """Strings of 400 bytes, with the grams of 64 that the query uses."""
    if hot:
        monkeypatch.setattr(suffix, "PIECES", 3)
    r = random.Random(12)
    base = "".join(r.choice("abcdefghijk é") for _ in range(3000))
    rows = []
    for i in range(60):
        a, n = r.randint(0, 2000), r.choice((200, 390, 400, 410, 900))
        rows.append((i if i % 5 else None, "".join(r.choice("xyz ") for _ in range(r.randint(0, 300))) + base[a : a + n] + "%d" % i))
    rows += [(100, "a" * 2000), (101, "ab" * 450), (102, ""), (103, None), (104, base), (104, base), (104, base[:1500])]
    data = [(k, (t or "").encode()) for k, t in rows]
    counts = Counter(t[i : i + 400] for _, t in data for i in range(len(t) - 399))
    want = []
    for k, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        want.append((str(k), len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix.measure(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == sorted(want)


@pytest.mark.parametrize("pieces", [2000, 2])
def test_first_copies_stay_by_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(suffix, "PIECES", pieces)
    r = random.Random(15)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = []
    for i in range(40):
        a = r.randint(0, 400)
        rows.append((i if i % 7 else None, "".join(r.choice("xyz ") for _ in range(r.randint(0, 90))) + base[a : a + r.randint(50, 300)] + "%d" % i))
    rows += [(100, "a" * 300), (101, "ab" * 150), (102, ""), (103, None), (104, base[:300]), (104, base[:300]), (104, base[:200])]
    size = 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, want = set(), {}
    for x in suffix._named(df).orderBy("__id").collect():
        if x["__id"] in want:
            continue
        t = x["__text"].encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if t[i : i + size] in seen:
                gone[i : i + size] = True
            seen.add(t[i : i + size])
        want[x["__id"]] = (str(x.doc_id), np.frombuffer(t, np.uint8)[~gone].tobytes())
    got = {(str(x.doc_id), bytes(x.kept)) for x in suffix.remove_later_copies(df, size, 16).collect()}
    assert got == set(want.values())


def test_longest_previous_factors():
    r = random.Random(0)
    for _ in range(80):
        d = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcd") for _ in range(r.randint(0, 30)))
        want = [max([k for j in range(i) for k in range(1, len(d) - i + 1) if d[j : j + k] == d[i : i + k]], default=0) for i in range(len(d))]
        assert suffix.longest_previous_factors(d) == want


@pytest.mark.parametrize("keep_first", [False, True])
def test_one_passage_in_thousands_of_texts(spark, monkeypatch, keep_first):
    """More different pieces around one gram than a suffix array takes, with the production lengths."""
    asked, counted = [], suffix._counted
    monkeypatch.setattr(suffix, "_counted", lambda *x: asked.append(1) or counted(*x))
    r = random.Random(12)
    letters = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, longer = letters(200), letters(260)
    texts = [f"{letters(r.randint(150, 260))}{passage}{letters(r.randint(150, 260))}" for _ in range(2600)]
    texts += [f"{t[:500]}{letters(40)}" for t in texts[:30]]  # copies of whole strings
    texts += [f"{letters(100)}{longer}{passage}{letters(100)}" for _ in range(20)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    places = {}
    order = [r["__id"] for r in suffix._named(frame).select("doc_id", "__id").orderBy("doc_id").collect()] if keep_first else range(len(texts))
    for (i, t), key in zip(rows, order, strict=True):
        for at in range(len(t) - suffix.LENGTH + 1):
            places.setdefault(hash(t[at : at + suffix.LENGTH]), []).append((key, at, i))
    gone = {}
    for found in places.values():
        if len(found) > 1:
            for _, at, i in sorted(found)[1:] if keep_first else found:
                gone.setdefault(i, set()).update(range(at, at + suffix.LENGTH))
    assert len(gone) >= 40
    if keep_first:
        want = {i: "".join(c for at, c in enumerate(t) if at not in gone.get(i, ())) for i, t in rows}
        assert {x.doc_id: bytes(x.kept).decode() for x in suffix.remove_later_copies(frame).collect()} == want
    else:
        assert {x.doc_id: x.n_removed for x in suffix.measure(frame).collect()} == {i: len(gone.get(i, ())) for i, _ in rows}
    assert asked == [1]


def _python_nodes(node, above=None):
    """Pairs of Python nodes of which one feeds the other within a task, so that it has two workers at once."""
    if "Exchange" in node.nodeName():
        above = None
    python = node.nodeName() if any(x in node.nodeName() for x in ("Arrow", "Python", "Pandas")) else None
    found = [(above, python)] if above and python else []
    children = node.children()
    for k in range(children.size()):
        found += _python_nodes(children.apply(k), python or above)
    return found


def test_cutting_takes_one_python_worker_a_task(spark):
    schema = "runs int, text string, doc_id long, id string"
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words, 1, "a"), (2, f"x {words} y", 2, "b"), (3, words, 3, "c"), (4, None, 4, "d"), (5, "", 5, None)], schema)
    cut = substring.remove_repeats(docs.select("text", "doc_id"))
    assert _python_nodes(cut._jdf.queryExecution().executedPlan().initialPlan()) == []
    # other columns may have any name and stay where they are
    cut = substring.remove_repeats(docs)
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in docs.schema]
    expected = [(1, words, 1, "a"), (2, "x y", 2, "b"), (4, None, 4, "d"), (5, "", 5, None)]
    assert sorted(map(tuple, cut.collect())) == expected
