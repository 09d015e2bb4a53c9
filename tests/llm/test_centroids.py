import hashlib
import math
import random

import numpy as np
import pytest

from tillpath.llm.centroids import cluster, packed, unpacked, with_summary

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(data, clusters=16, rounds=3, dims=64):
    kept = []
    for vec_id, xs, *_ in data:
        if xs is not None and len(xs) == dims and all(x is not None and math.isfinite(x) for x in xs):
            kept.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in xs]))
    order = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [xs for _, xs in sorted(kept, key=order)[:clusters]]

    def assign():
        out = []
        for _, xs in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(xs, c)) for c in centroids]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            own = [xs for (_, xs), (to, _) in zip(kept, of) if to == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    inertia = [sum(d for to, d in of if to == c) for c in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(r[0], to, d, inertia[to], sum(inertia), marks[to]) for r, (to, d) in zip(kept, of)]


def vectors(seed, count, dims=64, scale=1.0, groups=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, scale / 3) for x in rng.choice(centres)], 0) for i in range(count)]


def awkward():
    inf, nan = float("inf"), float("nan")
    plain = vectors(2, 40)
    bad = [[inf] + [0.0] * 63, [nan] + [0.0] * 63, [None] + [0.0] * 63, [0.0] * 63, [0.0] * 65, [], None, [-inf] * 64]
    return [
        *plain,
        *plain[:5],
        *((100 + i, x, None) for i, x in enumerate(bad)),
        (None, [0.25] * 64, 1),
        (None, [0.25] * 64, 1),
        (200, [0.0] * 64, None),
        (201, [-0.0] * 64, 1),
        (202, [1e6] * 64, 1),
    ]


def check(spark, data, **options):
    df = spark.createDataFrame(data, SCHEMA)
    found = with_summary(*cluster(df, **options)).collect()
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    order = lambda x: tuple((y is None, y or 0) for y in x[:3])
    options.pop("block_dims", None)
    assert sorted((tuple(r[n] for n in names) for r in found), key=order) == sorted(brute(data, **options), key=order)


@pytest.mark.parametrize("data", [vectors(1, 300), awkward(), vectors(3, 9), vectors(4, 60, scale=1e5)])
def test_clusters_equal_brute_force(spark, data):
    check(spark, data)


@pytest.mark.parametrize("block_dims", [1, 5, 64])
def test_any_cut_into_blocks_gives_the_same(spark, block_dims):
    check(spark, vectors(5, 80, dims=10), dims=10, block_dims=block_dims, clusters=4, rounds=5)


def test_equal_vectors_leave_clusters_empty(spark):
    check(spark, [(i, [0.5] * 64, 0) for i in range(40)] + [(99, [1.0] * 64, 0)])


def test_several_chunks(spark):
    check(spark, vectors(6, 1500, dims=8), dims=8, clusters=6)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None, 0)])


def test_components_too_large_to_be_exact_are_refused(spark):
    with pytest.raises(Exception, match="would not be exact"):
        check(spark, [(1, [1e9] * 64, 0)])


@pytest.mark.parametrize("most", [3, 127, -128, 128, 40_000, 2**31, -(2**40)])
def test_packing(most):
    values = np.array([[0, most], [1, -1]])
    assert (unpacked(*packed(values), 2) == values).all()
