"""Joins on ranges by bins of several widths, against all pairs."""

import numpy as np

from tallyhelix.operators import ranges


def test_overlaps_of_ranges_of_any_length(spark):
    rng = np.random.default_rng(1)
    big = [(i, f"c{i % 2}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 3_000_000, 80), [0, 1, 511, 512, 4096, 70_000, 2_000_000, 5_000_000_000] * 10, strict=True))] + [(80, "c0", 9, 4)]
    small = [(i, f"c{i % 2}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 4_000_000, 400), rng.integers(0, 900, 400), strict=True))]
    a = spark.createDataFrame(big, "a long, c string, s long, e long")
    b = spark.createDataFrame(small, "b long, c string, st long, en long")
    got = [(r.a, r.b) for r in ranges.overlapping(a, b, ["c"], ("s", "e"), ("st", "en")).collect()]
    want = {(i, j) for i, c, s, e in big for j, d, st, en in small if c == d and s <= e and st <= e and s <= en}
    assert len(got) == len(set(got)) and set(got) == want


def test_both_ends_within_their_ranges(spark):
    rng = np.random.default_rng(2)
    two = [(i, i % 3, int(s), int(s + n), int(t), int(t + m)) for i, (s, n, t, m) in enumerate(rng.integers(0, 20_000, (150, 4)))] + [(150, 0, 5, 3, 0, 9)]
    points = [(i, i % 3, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 40_000, (300, 2)))]
    a = spark.createDataFrame(two, "a long, k long, s1 long, e1 long, s2 long, e2 long")
    b = spark.createDataFrame(points, "b long, k long, x long, y long")
    got = [(r.a, r.b) for r in ranges.containing(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), ("x", "y")).collect()]
    want = {(i, j) for i, k, s1, e1, s2, e2 in two for j, m, x, y in points if k == m and s1 <= x <= e1 and s2 <= y <= e2}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
