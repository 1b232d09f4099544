"""Places in an order, and the error function, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhelix.functions import scalar as fn
from tallyhelix.operators.numbering import numbered


def test_places_of_rows_in_an_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), f"k{b}", i) for i, (a, b) in enumerate(rng.integers(0, 40, (900, 2)))]
    got = numbered(spark.createDataFrame(rows, "a int, b string, i int").repartition(7), ["a", "b", "i"]).collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in got) == list(range(1, 901))
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0
    assert [tuple(r) for r in numbered(spark.createDataFrame([(None,), (4,)], "a int"), ["a"], "n", 0).orderBy("n").collect()] == [(None, 0), (4, 1)]


def test_error_function(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 2.5, 4.0, 6.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", fn.erf(F.col("z")).alias("e")).collect()
    assert [r.e for r in got] == pytest.approx([math.erf(v) for v in z], abs=1e-14)
    assert spark.range(1).select(fn.truncated_sd(F.lit(2.0)).alias("x")).first().x == pytest.approx(fn.TRUNCATED_SD_2)
