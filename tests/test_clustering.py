"""Lloyd's rounds as jobs against the loop over one group."""

import numpy as np
import pytest

from spikeframe.operators import clustering, sorting


@pytest.mark.parametrize(("clusters", "rounds", "part"), [(3, 30, None), (5, 4, 20), (200, 2, None)])
def test_equals_the_loop(spark, clusters, rounds, part):
    data, want = [], {}
    for g, n in (("a", 150), (None, 41), ("c", 1)):
        rng = np.random.default_rng(n)
        x = np.round(rng.normal(size=(n, 3)) + 4 * rng.integers(0, 3, n)[:, None], 3)
        x = np.floor(x * 2**10) / 2**10  # whole steps, so that means are exact both ways
        data += [(g, i, [float(v) for v in row]) for i, row in enumerate(x)]
        want |= {(g, i): int(c) for i, c in enumerate(sorting.kmeans(x, clusters, rounds))}
    points = spark.createDataFrame(data, "unit string, idx int, features array<double>").repartition(4)
    got = clustering.kmeans(points, clusters, rounds=rounds, part_rows=part)
    assert got.columns == ["unit", "idx", "features", "label"]
    assert {(r["unit"], r["idx"]): r["label"] for r in got.collect()} == want


def test_empty_clusters_are_at_zero(spark):
    """Equal first centres leave the second without points; from then on it is at zero and takes what is near."""
    x = np.array([[5.0], [5.0], [5.0], [0.5], [9.0], [9.0]])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx int, features array<double>")
    got = [r["label"] for r in clustering.kmeans(points, 3, [], rounds=6).orderBy("idx").collect()]
    assert got == sorting.kmeans(x, 3, 6).tolist()
    assert clustering.kmeans(points.limit(0), 3, [], rounds=3).count() == 0
