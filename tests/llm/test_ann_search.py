import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import ann_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k, every):
    v = {i: np.array(e, dtype=np.float32).astype(float) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = {}
    for q, x in v.items():
        if q % every == 0:
            scored = sorted((-float((y * x).sum()), i) for i, y in v.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dims))
    x = centres[rng.integers(0, 8, n)] + spread * rng.standard_normal((n, dims))
    return [(i, [float(a) for a in v], 0) for i, v in enumerate(x.astype(np.float32))]


def run(spark, rows, **how):
    out = {}
    for r in ann_search.search(spark.createDataFrame(rows, SCHEMA).withColumns({"list": F.lit("x"), "rank": F.lit(1)}), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rows = vectors(1500, 24, 1)
    want, found = exact(rows, 20, 20), run(spark, rows)
    assert set(found) == set(want)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    v = {i: np.array(e, dtype=np.float32).astype(float) for i, e, _ in rows}
    assert all(s == pytest.approx(float((v[q] * v[i]).sum()), abs=1e-12) for q in found for i, s in found[q])


def test_all_probes_without_test_are_exact(spark):
    rows = vectors(400, 10, 2)
    rows += [(1000 + k, rows[40][1], 0) for k in range(60)]  # ties
    found, want = run(spark, rows, recall=1.0, epsilon=1e9, k=20), exact(rows, 20, 20)
    assert set(found) == set(want)
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]


@pytest.mark.parametrize("norm", [1.0, 800.0, 8e3, 1e5])
@pytest.mark.parametrize("known", [False, True])
def test_no_neighbour_or_tie_is_lost_at_any_norm(norm, known):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((2500, 64)).astype(np.float32).astype(float)
    v[1200:1260] = v[7]  # ties across chunks
    v *= norm / np.sqrt((v * v).sum(1)).max()
    q, top = v[[7, 1300, 2000, 5]], norm * (1 + 1e-12)
    score = q @ v.T
    kth = -np.sort(-score, axis=1)[:, 19]
    far = (q * q).sum(1) + top * top - 2 * kth if known else None
    row, col = ann_search.scan(q, v, top, ann_search.rotation(65), 20, 1e9, far)
    for i in range(len(q)):
        places = col[row == i]
        assert set(np.flatnonzero(score[i] >= kth[i])) <= set(places) and len(places) < 200


def test_tests_abandon_candidates_and_lose_few():
    rng = np.random.default_rng(3)
    v = np.concatenate([c + rng.standard_normal((400, 64)) for c in 3 * rng.standard_normal((10, 64))])
    top = np.sqrt((v * v).sum(1)).max()
    q = v[::50]
    lost = 0
    row, col = ann_search.scan(q, v, top, ann_search.rotation(65), 20)
    for i in range(len(q)):
        lost += len(set(np.argsort(-(v @ q[i]))[:20]) - set(col[row == i]))
    assert lost <= 0.01 * 20 * len(q)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0, 3.0], 0), (20, [0.0, -1.0], 0), (8, [1.0, 0.0], 0)]
    found = run(spark, rows)
    assert [i for i, _ in found[0]] == [8, 1, 20] and set(found) == {0, 20}
    assert run(spark, []) == {} and run(spark, rows[2:7]) == {}


def test_one_vector(spark):
    assert run(spark, [(0, [1.0, 2.0], 0)]) == {}


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (2, [0.2, 0.1], 0)]
    assert [i for i, _ in run(spark, rows)[0]] == [1, 1, 2]


def test_every_query_gets_k_rows(spark):
    rng = np.random.default_rng(5)
    place = lambda: 10 * rng.standard_normal(24)
    x = np.concatenate([place() + 0.1 * rng.standard_normal((n, 24)) for n in [150] * 20 + [6] * 12])
    ids = np.arange(len(x)) * 20
    ids[rng.random(len(x)) > 0.1] += 1  # one in ten asks
    ids[3000::6] = np.arange(3000, len(x), 6) * 20  # and one of each tiny group
    rows = [(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x.astype(np.float32))]
    rows += [(int(ids[3000]), rows[3000][1], 0)] * 30  # a query of many copies
    found = run(spark, rows, recall=0.01)
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and {len(f) for f in found.values()} == {20}
