import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartulary.llm import mixing
from tests.llm.support import WORD, documents, frame

WEIGHTS = (3, 1, 2)


def plain_targets(sizes):
    """Shares by weight; what is above a cap is shared out again until nothing is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    capped: dict = {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}


def taken(spark, rows):
    plan = mixing.mix(frame(spark, rows).withColumns({c: F.lit("x") for c in ("rh", "size", "copies", "sid", "target")}))
    return plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("copies_in").cast("int")))).collect()


def plain_tilt(sizes, target):
    """By bisection: the tilt at which capped rates take the target."""
    total, mean = sum(sizes), sum(x * x for x in sizes) / sum(sizes)
    words = lambda tilt: sum(x * min(2.0, math.exp(min(tilt * x / mean, 700))) for x in sizes)
    if target >= 2 * total * (1 - 1e-12):
        return math.inf, mean
    low, high = -1e6, 1e6
    for _ in range(300):
        low, high = ((low + high) / 2, high) if words((low + high) / 2) < target else (low, (low + high) / 2)
    return (low + high) / 2, mean


def test_against_a_plain_version(spark):
    rows = documents(400)
    out = taken(spark, rows)
    each, total = defaultdict(list), defaultdict(int)
    for _, t, _, s, _ in rows:
        each[s].append(len(WORD.findall(t or "")))
    sizes = {s: sum(x) for s, x in each.items()}
    want = plain_targets(sizes)
    tilts = {s: plain_tilt([n for n in x if n], want[s]) for s, x in each.items()}
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.copies in (0, 1, 2) and (r.size or not r.copies)
        tilt, mean = tilts[r.source]
        assert r.rate == pytest.approx(min(2.0, math.exp(min(tilt * r.size / mean, 700))) if r.size else 0, rel=1e-5)
        total[r.source] += r.copies * r.size
    for s, t in want.items():
        # one bucket a source: its last and smallest documents pay what is owed, two copies of each at most
        assert total[s] == pytest.approx(t, rel=0.001, abs=5)


def test_many_sources_are_numbered_apart(spark):
    rows = [(i, "w " * (i % 7 + 1), None, f"h{i % 300:03d}" if i % 300 else None, None) for i in range(900)]
    sizes = defaultdict(int)
    for i, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t))
    want = plain_targets(sizes)
    aims = mixing.targets(mixing.sized(frame(spark, rows))).collect()
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    assert {r.source: r.sid for r in aims} == {s: k for k, s in enumerate(order)}
    assert all(r.target == pytest.approx(want[r.source], rel=1e-12) for r in aims)


def test_rates_are_an_exponential_tilt(spark):
    units = mixing.sized(frame(spark, documents(200)))
    aims = mixing.targets(units)
    solved = {r.source: r for r in mixing.solve(units, aims).collect()}
    sums = defaultdict(float)
    for u in units.collect():
        s = solved[u.source]
        if u.size:
            sums[u.source] += u.size * u.copies_in * min(2.0, 2.718281828459045 ** min(s.tilt * u.size / s.mean_size, 700))
    for s, r in solved.items():
        assert sums[s] == pytest.approx(r.target, rel=1e-6)


def test_reruns_agree_under_any_partitioning(spark):
    rows = documents(60)
    df = frame(spark, rows)
    units = [mixing.sized(x) for x in (df, df.repartition(7), df.repartition(3, "lang"), df.orderBy(F.desc("doc_id")), df.coalesce(1))]
    results = set()
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, u in zip((4, 1, 9, 5, 2), units, strict=True):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            solved = mixing.solve(u, mixing.targets(u))
            plan = mixing.rounded(u, solved)
            results.add(tuple(sorted(map(str, plan.select("doc_id", "rh", "rate", "target", "copies").collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert len(results) == 1


def test_rows_repeat_and_names_may_clash(spark):
    rows = documents(100)
    df = frame(spark, rows).withColumnsRenamed({"text": "body", "source": "host"}).withColumns({c: F.lit("x") for c in ("copy", "__copy", "rh")})
    how = {"text": "body", "source": "host"}
    mixed = mixing.mixed_rows(df, **how)
    assert mixed.columns == df.columns
    plan = mixing.mix(df, **how).collect()
    assert mixed.count() == sum(r.copies * r.copies_in for r in plan) and len(plan) == len(set(rows))


def test_empty_table_and_empty_source(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    out = taken(spark, [(1, None, None, "a", None), (2, "one two", None, "b", None)])
    # b's share, all of 3 words, is below its cap of 4; a has no words to take, so its target is 0
    assert {(r.doc_id, r.size, r.source_size, r.target) for r in out} == {(1, 0, 0, 0.0), (2, 2, 2, 3.0)}
    assert {r.doc_id: r.copies for r in out}[1] == 0 and {r.doc_id: r.copies for r in out}[2] in (1, 2)
