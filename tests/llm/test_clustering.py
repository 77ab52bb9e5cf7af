import hashlib
import math
import random

import pytest

from lodestone.llm import clustering


def plain(rows, k=clustering.CLUSTERS, rounds=clustering.ROUNDS, dim=clustering.DIM):
    """vec_id and vector to (vec_id, cluster, distance, cluster_inertia, inertia, centroid), one vector at a time."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [q for _, q in sorted((name(i), q) for i, q in kept)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((far(q, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        for n in range(len(cents)):
            own = [q for (_, q), a in zip(kept, at, strict=True) if a == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [near(q) for _, q in kept]
    per = [sum(d for d, a in last if a == n) for n in range(len(cents))]
    return [(i, a, d, per[a], sum(per), cents[a]) for (i, _), (d, a) in zip(kept, last, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cluster int, key string, q int")


def made(seed, n):
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(k, hot if k % 3 == 0 else [rng.uniform(-1, 1) + (k % 5) for _ in range(64)], 1, 2, "x", 3) for k in range(n)]
    bad = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")], [0.5] * 65]
    rows += [(1000 + k, v, None, None, None, None) for k, v in enumerate(bad)]
    return rows + [rows[1], rows[1], (None, rows[2][1], None, None, None, None), (None, [2e5] * 64, None, None, None, None)]


@pytest.mark.parametrize("n", [150, 12])
def test_equals_plain_rounds(spark, n):
    rows = made(n, n)
    got = clustering.cluster(vectors(spark, rows)).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, plain([r[:2] for r in rows])))


def test_empty_and_all_rejected(spark):
    assert clustering.digest(vectors(spark, [])).count() == 0
    out = clustering.digest(vectors(spark, [(1, None, 1, 1, "", 1)]))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_distances_are_exact_beyond_doubles():
    import numpy as np

    x, c = np.array([[1 << 27, 3]]), np.array([[-(1 << 27), 4], [-(1 << 27), 5]])
    assert [a.tolist() for a in clustering.nearest(x, c)] == [[0], [(1 << 56) + 1]]


def test_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.digest(vectors(spark, [(1, [1e9] * 64, 1, 1, "", 1)])).collect()
