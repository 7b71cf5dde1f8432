"""Exact k-NN: partial top-k + final window equals brute force, on any partitioning."""

import numpy as np
import pytest

from scriptorium.operators.knn import knn_brute_force, knn_join


def _frames(spark, nq=23, n=157, dim=7, seed=3, parts=5):
    rng = np.random.default_rng(seed)
    Q = rng.normal(size=(nq, dim)) * rng.uniform(0.2, 3.0, size=(nq, 1))   # unequal lengths
    X = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3.0, size=(n, 1))
    X[10] = X[11]                                                          # exact tie -> broken by id
    qdf = spark.createDataFrame([(int(i), [float(v) for v in Q[i]]) for i in range(nq)], "qid long, qvec array<float>")
    cdf = spark.createDataFrame([(int(i), [float(v) for v in X[i]]) for i in range(n)],
                                "id long, vec array<float>").repartition(parts)
    Q32 = np.array([r for r in qdf.orderBy("qid").select("qvec").toPandas()["qvec"]], dtype=np.float32)
    X32 = np.array([r for r in cdf.orderBy("id").select("vec").toPandas()["vec"]], dtype=np.float32)
    return qdf, cdf, Q32, X32


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_knn_equals_brute_force(spark, metric, strategy):
    qdf, cdf, Q, X = _frames(spark)
    got = knn_join(qdf, cdf, 4, metric=metric, strategy=strategy, block_bytes=400)
    rows = sorted((r.qid, r.id, r.distance, r.rank) for r in got.collect())
    want = sorted(knn_brute_force(list(range(len(Q))), Q, list(range(len(X))), X, 4, metric))
    assert rows == want


def test_knn_independent_of_partitioning_and_excludes_self(spark):
    qdf, cdf, Q, X = _frames(spark, nq=30, n=30)
    a = knn_join(qdf, cdf.repartition(1), 3, exclude_self=True).collect()
    b = knn_join(qdf, cdf.repartition(9), 3, exclude_self=True).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(r.qid != r.id for r in a)


def test_knn_plan_has_no_pairwise_join(spark):
    qdf, cdf, _, _ = _frames(spark)
    plan = knn_join(qdf, cdf, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan


def test_knn_broadcast_bound_is_checked(spark):
    qdf, cdf, _, _ = _frames(spark)
    with pytest.raises(ValueError):
        knn_join(qdf, cdf, 3, strategy="broadcast", max_broadcast_bytes=10)


@pytest.mark.parametrize("copies", [0, 300])
def test_running_nearest_equals_brute_force(copies):
    """Tiles against running bounds: few pairs are looked at again, and copies, ties, NaN and long vectors stay right."""
    from scriptorium.operators import knn
    rng = np.random.default_rng(11)
    X = rng.normal(size=(1500, 16))
    X /= np.linalg.norm(X, axis=1)[:, None]
    X[1500 - copies:] = X[0]
    X[7], X[8] = np.nan, 1e20
    X = X.astype(np.float32)
    ids = rng.permutation(1500)
    near, looked, real = knn.Nearest(ids[:60], X[:60], 3, True, 5), [], knn.topk_block
    knn.topk_block = lambda q, Q, i, x, *a: looked.append(len(q) * len(i)) or real(q, Q, i, x, *a)
    try:
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, 1500, 500):
                near.add(ids[at:at + 500], X[at:at + 500])
    finally:
        knn.topk_block = real
    got = sorted(zip(ids[near.rows[0]].tolist(), near.rows[1].tolist(), near.rows[2].tolist()))
    ok = [i for i in range(1500) if i not in (7, 8)]
    own = [i for i in range(60) if i not in (7, 8)]
    want = sorted((a, b, d) for a, b, d, _ in knn.knn_brute_force(ids[own], X[own], ids[ok], X[ok], 3, exclude_self=True))
    assert [x for x in got if x[0] not in (ids[7], ids[8])] == [(int(a), int(b), d) for a, b, d in want]
    assert copies or sum(looked) < 60 * 1500 // 3
