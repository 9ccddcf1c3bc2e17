"""The language model: base scores by brute force, probabilities that add up to one, held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import maxent

HELD = "crc32(cast(doc_id AS string)) % 7 = 2"
EDGES = [None, "", " \t\n", "one", "ONE one Öne ÖNE", "a\x1cb\x00c", "日本 日本", "same line\n" * 500, "same line\n" * 500, "x" * 5000]
SCHEMA = "doc_id long, text string, n_tokens string, word int, key double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], SCHEMA).repartition(3)


def corpus(n=700):
    """Two kinds of texts; in each, what a word is depends on the one before."""
    r = random.Random(4)
    kinds = [{w: [f"{k}{(7 * w + j) % 60}" for j in range(3)] for w in range(60)} for k in "ab"]
    texts = []
    for _ in range(n):
        kind, word, out = r.choice(kinds), r.randrange(60), []
        for _ in range(r.randint(5, 60)):
            out.append(r.choice(kind[word]) if r.random() < 0.95 else f"z{r.randrange(4000)}")
            word = int(out[-1][1:]) % 60
        texts.append(" ".join(out))
    return texts


@pytest.fixture(scope="module")
def rows():
    return [*enumerate([*EDGES, *corpus()]), (None, "no id one one"), (4, "ONE one Öne ÖNE")]


@pytest.fixture(scope="module")
def got(spark, rows):
    return maxent.score_documents(frame(spark, rows), HELD, slots=1 << 14).collect()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        lowered = lowered.replace(space, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def test_base_by_brute_force(got, rows):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        own = tokens(text)
        for r in by_id[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
            assert r.score < 0
    assert by_id[4][0].score == by_id[4][1].score and by_id[7][0].score == pytest.approx(by_id[8][0].score)


def test_held_out_texts_score_better_than_base(got):
    own = [r for r in got if r.held_out]
    base, model = (sum(r[x] for r in own) / sum(r.n_tokens for r in own) for x in ("base_score", "score"))
    assert len(own) > 80 and model > base + 0.6


def test_small_counted_table_gives_the_same(spark, rows, got, monkeypatch):
    monkeypatch.setattr(maxent, "COUNTED", 50)  # nearly all rare words are joined
    again = {(r.doc_id, r.n_tokens): r for r in maxent.score_documents(frame(spark, rows), HELD, slots=1 << 14).collect()}
    for r in got:
        other = again[r.doc_id, r.n_tokens]
        assert (r.n_known, round(r.base_score, 6)) == (other.n_known, round(other.base_score, 6))
        assert r.score == pytest.approx(other.score, rel=1e-3)


def test_probabilities_add_up_to_one():
    r = np.random.default_rng(2)
    counts = r.integers(1, 50, 400)
    tree = maxent.Tree(np.arange(400) * (maxent.LEAVES - 1) // 399, counts, 1 << 12)
    has_words = np.exp(tree.bias[np.repeat(np.arange(len(tree.size)), tree.size)]) > 1e-4
    seen = r.poisson(0.3, has_words.shape) * has_words
    model = maxent.Model(tree, seen, r.uniform(0, 1.2, (maxent.LEVELS, maxent.KINDS, maxent.BUCKETS)).astype(np.float32))
    for before in ([], [17], [5, 390]):
        last = [model.texts(np.array([*before, word]), np.array([len(before) + 1]))[-1] for word in range(400)]
        assert sum(10.0 ** np.array(last)) == pytest.approx(1, abs=2e-3)  # what is missing is at leaves without a word


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(3)
    tree = maxent.Tree(np.arange(50) * (maxent.LEAVES - 1) // 49, r.integers(1, 50, 50), 1 << 11)
    weights = r.uniform(0, 0.8, (maxent.LEVELS, maxent.KINDS, maxent.BUCKETS)).astype(np.float32)
    model = maxent.Model(tree, r.poisson(2, (tree.slots, maxent.BRANCH)), weights)
    ids, sizes = r.integers(0, 50, 600), np.array([100, 500])
    sums = np.zeros((2, *weights.shape))
    model.texts(ids, sizes, tuple(sums))
    for at in [(0, 0, 3), (1, 1, 4), (2, 2, 5)]:
        near = []
        for step in (-0.05, 0.05):
            model.weights = weights.copy()
            model.weights[at] += step
            near.append(model.texts(ids, sizes).sum() * math.log(10))
        assert sums[0][at] == pytest.approx((near[1] - near[0]) / 0.1, rel=0.05, abs=0.5)


def test_edges(spark):
    assert maxent.score_documents(frame(spark, []), HELD, slots=1 << 10).collect() == []
    only = [(i, "some words") for i in range(40) if held(i)]
    for r in maxent.score_documents(frame(spark, only), HELD, slots=1 << 10).collect():  # nothing to learn from
        assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0.0) and -100 < r.score <= 0


def test_equal_contexts_are_worked_out_once(monkeypatch):
    r = np.random.default_rng(5)
    tree = maxent.Tree(np.arange(90) * (maxent.LEAVES - 1) // 89, r.integers(1, 50, 90), 1 << 12)
    weights = r.uniform(0, 0.8, (maxent.LEVELS, maxent.KINDS, maxent.BUCKETS)).astype(np.float32)
    model = maxent.Model(tree, r.poisson(2, (tree.slots, maxent.BRANCH)), weights)
    line = np.append(r.integers(1, 90, 400), maxent.END)
    parts = [line, line, np.array([maxent.END]), r.integers(0, 6, 5000), line[200:]]
    ids, sizes = np.concatenate(parts), np.array(list(map(len, parts)))
    asked, slot = [], tree.slot
    monkeypatch.setattr(tree, "slot", lambda keys, node: asked.append(len(node)) or slot(keys, node))
    got, rows = model.different(ids, sizes), sum(asked)
    asked.clear()
    assert got == pytest.approx(model.texts(ids, sizes), rel=1e-5, abs=1e-6)
    assert rows < sum(asked) / 4
    blobs = maxent.pa.array([maxent.zstandard.ZstdCompressor().compress(x.astype("<u2").tobytes()) for x in parts], maxent.pa.binary())
    for most in (1, 401, 700, 1 << 20):
        found = list(maxent._together(blobs, sizes, most))
        assert np.array_equal(np.concatenate([x for x, _ in found]), ids) and np.array_equal(np.concatenate([n for _, n in found]), sizes)
        assert all(len(x) <= most + sizes.max() for x, _ in found)
    assert list(maxent._together(blobs[:0], sizes[:0], 9)) == []
