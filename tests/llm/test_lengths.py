"""Vectors of several lengths."""

import numpy as np

from rollbook.llm import vectors


def test_vectors_of_other_lengths_change_no_link(spark):
    one, two = [float(x) for x in np.random.default_rng(3).normal(size=(2, 6))[0]], [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, [2 * x for x in one], 0), (3, [*one, 1.0, 5.0], 0), (4, two, 0), (5, [2 * x for x in two], 0), (6, one[:5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    have = {r.id: (r.n_links, r.component_id) for r in vectors.classes(df).collect()}
    assert have == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
