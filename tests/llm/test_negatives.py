"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, anchor string"


def brute(rows, k=10, n=5, low=30, high=90):
    good = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a in sorted({r[0] for r in good if r[0] % 10 == 0}):
        _, label, v = min(r for r in good if r[0] == a)
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if len(w) == len(v))
        for s, p, _ in [r for r in ranked if r[1] != a and r[2] == label][:n]:
            fit = [(-t, i) for t, i, other in ranked if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit[:k], 1)]
    return sorted(out)


def answers(spark, rows, **options):
    rows = [(i, label, v and [x if x is None else float(x) for x in v]) for i, label, v in rows]
    frame = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 10 == 0, **options).collect())


def table(seed, n, spread):
    r = random.Random(seed)
    return [(i, r.randint(0, 3), [r.choice((-1, 0, 0.5, 1, spread)) * r.random() ** 2 for _ in range(5)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.25, 3.0])
def test_by_brute_force(spark, spread):
    rows = table(3, 300, spread)
    rows += [(i, i % 4, [0.5, 0.25, 0.5, 0.25, 0.5]) for i in range(300, 420)]  # one common vector: ties
    rows += [(None, 1, [0.1] * 5), (500, None, [0.1] * 5), (510, 1, None), (520, 1, [0.1, None, 1, 1, 1]), (530, 2, [0.1, math.nan, 1, 1, 1]), (540, 2, [math.inf] * 5)]
    rows += [(550, 1, []), (551, 1, []), (552, 2, []), (560, 3, [1.0, 2.0]), (561, 3, [1.0, 2.0]), (562, 1, [0.5, 1.0])]  # other lengths
    rows += [(10, 1, [0.5] * 5), (11, 2, [0.5] * 5), (11, 2, [0.5] * 5)]  # ids that repeat
    want = brute(rows)
    assert len(want) > 500 and answers(spark, rows) == want
    assert answers(spark, rows, block_numbers=150) == want  # several blocks
    assert answers(spark, rows, k=3, positives=2, low=10, high=50) == brute(rows, 3, 2, 10, 50)


def test_edges(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(0, 1, [1.0])]) == []  # no positive
    assert answers(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []  # no negative
    assert answers(spark, [(0, 1, [0.0]), (1, 1, [1.0]), (2, 2, [1.0])]) == [(0, 1, 1, 2, 0, 0)]  # a score of nothing
    assert answers(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5])]) == []  # a negative score has no window


def test_scores_are_exact_at_any_size():
    left, right = np.array([[3.0, -5.0], [1e10, 7.0], [1e30, 0.0]]), np.array([[2.0, 1.0], [1e8, -1.0], [-1e20, 4.0]])
    want = [[max(-negatives.LARGEST, min(negatives.LARGEST, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in right] for a in left]
    assert negatives.scores(left, right).tolist() == want
    assert negatives.scores(left[:2], right[:2]).tolist() == [r[:2] for r in want[:2]]
