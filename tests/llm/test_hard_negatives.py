"""Hard negatives against brute force over integers, with pruning that prunes and without."""

import random

import numpy as np

from cartulary.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, positives=5, negatives=5, low=80, scale=256.0, dims=None):
    keep = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or (dims and len(e) != dims) or not e:
            continue
        keep.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in e], label))
    asks = {}
    for i, v, label in sorted(keep, key=lambda r: (r[2], r[1])):
        if i % every == 0:
            asks.setdefault(i, (v, label))
    out = []
    for a, (av, al) in asks.items():
        ranked = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, v, label in keep if i != a)
        for s, p, _ in [r for r in ranked if r[2] == al][:positives]:
            fit = [(n, i) for n, i, label in ranked if label != al and low * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    out = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dims, seed, spread=1.0, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c, size = rng.choice(centres), rng.lognormvariate(0, spread)
        rows.append((i, [size * (x + rng.gauss(0, 0.5)) for x in c], rng.randrange(labels)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(400, 8, 1)
    rows += [(1000 + i, rows[3 * i][1], (rows[3 * i][2] + i) % 4) for i in range(20)]  # ties
    rows += [(3000, [0.0] * 8, 1), (3010, [-x for x in rows[0][1]], 0)]
    assert mined(spark, rows, every=10) == plain(rows, 10)
    # small pieces: many buckets and blocks meet, most are pruned
    for name, size in (("BUCKET", 16), ("BLOCK", 4), ("CHUNK", 8)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert mined(spark, rows, every=10) == plain(rows, 10)
    assert mined(spark, rows, every=7, positives=2, negatives=9, low=30) == plain(rows, 7, 2, 9, 30)


def test_awkward_rows(spark):
    rows = vectors(60, 4, 2, labels=2)
    rows += [(None, [1.0] * 4, 1), (100, None, 1), (110, [1.0, None, 0.0, 0.0], 0), (120, [float("nan")] * 4, 0), (130, [float("inf")] * 4, 0), (140, [1.0] * 4, None), (150, [], 1), (160, [1.0] * 3, 1)]
    rows += [rows[10], rows[11], (20, [0.5, -0.5, 0.25, 1.0], 1)]  # repeated rows, and a second vector of an anchor's id
    assert mined(spark, rows, every=10) == plain(rows, 10, dims=4)
    assert mined(spark, [], every=10) == []
    # an anchor alone in its label has no positive; a positive of negative score opens no window
    alone = [(0, [1.0, 0.0], 9), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 1), (10, [-1.0, 0.0], 1)]
    assert mined(spark, alone, every=10) == plain(alone, 10)
    assert mined(spark, [(0, [1.0], 1)], every=10) == []
    # scores of a longer vector than any that fits a long: the row takes no part
    huge = vectors(40, 4, 3, labels=2)
    assert mined(spark, [*huge, (500, [1e30] * 4, 1)], every=10) == plain(huge, 10)


def test_exact_beyond_double(spark):
    """Products beyond 2^53 are computed in whole numbers."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(1 << 19), 1 << 19)) for _ in range(3)], i % 2) for i in range(60)]
    rows += [(100 + i, [x if k else x + 1 for k, x in enumerate(rows[i][1])], i % 2) for i in range(30)]
    assert mined(spark, rows, every=10) == plain(rows, 10)


def test_clashing_columns(spark):
    rows = vectors(80, 4, 4, labels=2)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id AS id", "embedding AS e", "CAST(label AS STRING) AS kind", "1 AS block", "2 AS label", "3 AS vec_id", "4 AS norm")
    out = hard_negatives.mine(df, every=10, vec_id="id", embedding="e", label="kind")
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, 10)


def test_bounds_prune():
    """The scan leaves a chunk whose bound falls short: it gives the same as a scan of all."""
    rng = np.random.default_rng(0)
    v = np.floor(rng.standard_normal((3000, 6)) * rng.lognormal(3, 1.5, (3000, 1)))
    a = np.floor(rng.standard_normal((9, 6)) * 50)
    n, none = np.sqrt((v * v).sum(1)), np.zeros(3000, dtype=int)
    high, low = np.full((9, 1), hard_negatives.ANYTHING), np.full((9, 1), hard_negatives.NOTHING)
    rows, _, places, scores = hard_negatives.scan(a, np.full(9, -1), np.sqrt((a * a).sum(1)), np.zeros(9, dtype=int), high, low, v, np.arange(3000), n, none, 5, True)
    for i in range(9):
        s = (v @ a[i]).astype(int)
        best = sorted(zip(-s, range(3000), strict=True))[:5]
        assert [(-x, j) for x, j in best] == list(zip(scores[rows == i], places[rows == i], strict=True))
