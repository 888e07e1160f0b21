"""Hard negatives against brute force in whole numbers."""

import random

import numpy as np
import pytest

from threatflow.llm import negatives

SCHEMA = "vec_id bigint, label int, vector array<double>"


def brute(rows, anchors, k=5, percent=80):
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows})
    out = []
    for i, label, vector in sorted({(i, l, tuple(v)) for i, l, v in anchors}):
        scored = [
            (sum(int(x) * int(y) for x, y in zip(vector, v)), j, l) for j, l, v in rows if j != i and len(v) == len(vector)
        ]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for score, positive, _ in [r for r in scored if r[2] == label][:k]:
            hard = [r for r in scored if r[2] != label and percent * score <= 100 * r[0] <= 100 * score][:k]
            out += [(i, positive, n + 1, r[1], score, r[0]) for n, r in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("width,big", [(3, 9), (16, 90), (37, 200), (5, 2**29)])
def test_same_as_brute_force(spark, width, big):
    rnd = random.Random(width)
    centre = {l: [rnd.randint(-big, big) for _ in range(width)] for l in range(3)}
    rows = []
    for i in range(260):
        base = centre[rnd.choice([0, 0, 1, 2])]
        rows.append((i, rnd.randrange(3), [float(x + rnd.randint(-big // 3, big // 3)) for x in base]))
    rows += rows[:6] + [(500 + i, 1, rows[0][2]) for i in range(9)]  # repeated rows and ties
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "'t' AS task", "2 AS rank")
    got = negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), blocks=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 10 == 0])


def test_bounds_hold():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(300, 50)) * 256)
    s = negatives.Summaries(v)
    assert len(s.levels) == 3
    for a in range(20):
        exact = v @ v[a]
        last = np.inf
        for level in range(len(s.levels)):
            low, high = s.bounds(level, s.of(a), None)
            assert (low <= exact).all() and (exact <= high).all()
            assert (high - low).mean() < last
            last = (high - low).mean()


def test_pruning_leaves_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(4)
    steps = np.repeat(rng.normal(size=(40, 16)), 4, axis=1)  # even segments, as summaries like them
    v = np.floor((steps[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 0.05) * 256)
    s = negatives.Summaries(v)
    rows, scores = negatives.positives_of(s, s.of(0), v[0], np.arange(4000) != 0, 5)
    assert len(rows) < 400
    assert sorted(scores)[-5:] == sorted((v @ v[0])[1:])[-5:]


def test_unusable_rows_and_extremes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [256.0, 0.0]), (1, 1, [200.0, 0.0]), (2, 2, [190.0, 0.0]), (3, 2, [201.0, 0.0]), (4, 2, [-10.0, 0.0]), (5, 2, [160.0, 0.0]), (6, 2, [159.0, 0.0])]
    bad = [(10, None, [1.0, 1.0]), (11, 2, None), (12, 2, [nan, 1.0]), (13, 2, [inf, 1.0]), (14, 2, [None, 1.0]), (15, 2, []), (None, 2, [190.0, 0.0]), (16, 2, [190.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    got = negatives.hard_negatives(df, df).where("anchor_id = 0").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2, 51200, 48640), (0, 1, 2, 5, 51200, 40960)]
    huge = spark.createDataFrame([(0, 1, [1e30, 0.0]), (1, 1, [1e30, 0.0]), (2, 2, [1e30, 0.0]), (3, 2, [-1e30, 0.0])], SCHEMA)
    top = 2**63 - 1
    assert sorted(map(tuple, negatives.hard_negatives(huge, huge.where("vec_id = 0")).collect())) == [(0, 1, 1, 2, top, top)]


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, none).count() == 0
    some = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], SCHEMA)
    assert negatives.hard_negatives(some, some).count() == 0
