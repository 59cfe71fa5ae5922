"""The training-data operators do the whole job: inputs that a cap or a fixed number of rounds would cut."""

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import matching, names, reading


def test_calibration_weighs_bins_by_all_their_pairs(spark):
    # 40,000 agreeing pairs in a lower bin, 10,000 differing ones in the next: four in five of the pool agree
    pairs = spark.range(50_000).select(F.when(F.col("id") < 40_000, 0.5).otherwise(0.51).alias("score"), (F.col("id") < 40_000).alias("same_doi"))
    knots, values = matching.calibrate(pairs)
    assert np.allclose(np.interp([0.504, 0.508, 0.512], knots, values), 0.8, atol=1e-4)


def test_few_labelled_pairs_leave_the_score_as_confidence(spark):
    none = spark.createDataFrame([], "score double, same_doi boolean")
    knots, values = matching.calibrate(none)
    assert np.allclose(np.interp([0.1, 0.5, 0.9], knots, values), [0.1, 0.5, 0.9], atol=0.01)


def test_isotonic_weights_are_repetitions():
    scores, values, counts = np.array([1.0, 2, 3, 4]), np.array([0.5, 0.75, 0.25, 1.0]), np.array([2, 1, 4, 3])
    repeated = reading.isotonic(np.repeat(scores, counts), np.repeat(values, counts))
    assert all(np.allclose(a, b) for a, b in zip(reading.isotonic(scores, values, counts), repeated, strict=True))


def test_long_chains_of_spellings_reach_their_root(spark):
    # each surname is one letter from the next and two or more from all others
    surnames = ["xwqzyvjxwqzy"[:i] + "kolmanertiso"[i:] for i in range(13)]
    spelt = spark.createDataFrame([(f"Robert {s.capitalize()}", i + 1) for i, s in enumerate(surnames)], "name string, n bigint")
    assert {r.canonical for r in names.attributed(spelt).collect()} == {"person|xwqzyvjxwqzy|robert"}
